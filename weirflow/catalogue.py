"""Queries over the test tables, each a blueprint that the engine runs, with SQL for the same rows.

``CASES`` are single runs: tables to extract, transform tasks, and the frame to give back. The
load and ingestion queries below them write managed tables and read them again.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .config import load_config
from .config.format import Resource
from .errors import AdapterError
from .functions.frames import hide
from .plans import Orchestrator
from .quality.contracts import DataframeContract, Expectation, check_expectations, contract_problems
from .sources import create_adapter
from .streaming import ingest_new_files


@dataclass(frozen=True)
class Case:
    """``tasks``: name -> (input or None, steps); the frame of a task has the task's name."""

    tables: list[str]
    tasks: dict[str, tuple[str | None, list[tuple]]]
    sql: str
    output: str = "out"
    extra: dict[str, Any] = field(default_factory=dict)


def blueprint(case: Case, sf_dir: str) -> dict[str, Any]:
    """The case as a blueprint. The tables hold no NaN, so scans needn't look for it."""
    resources = {f"r_{t}": {"adapter": "file", "params": {"format": "parquet", "path": f"{sf_dir}/{t}.parquet", "options": {"nan_as_null": False}}} for t in case.tables}
    tasks: dict[str, Any] = {f"extract_{t}": {"stage": "extract", "resource": f"r_{t}", "steps": [{"output": t}]} for t in case.tables}
    for name, (source, steps) in case.tasks.items():
        listed = [{"action": s[0], "with": s[1], **(s[2] if len(s) > 2 else {})} for s in steps]
        tasks[name] = {"stage": "transform", "output": name, "steps": listed} | ({"input": source} if source else {})
    return {"metadata": {"id": "catalogue"}, "resources": resources, "tasks": tasks, **case.extra}


def run_case(spark: SparkSession, sf_dir: str, case: Case) -> DataFrame:
    ctx = Orchestrator(load_config(blueprint(case, sf_dir)), spark).run()
    return hide(ctx.state.get(case.output))


def _col(name: str) -> dict:
    return {"col": name}


def _lit(value: Any) -> dict:
    return {"lit": value}


def _where(**conditions: tuple) -> tuple:
    parts = [{c: {"op": v[0], "value": v[1]} if len(v) > 1 else {"op": v[0]}} for c, v in conditions.items()]
    return ("filter", parts[0] if len(parts) == 1 else {"AND": parts})


def _join(right: str, how: str, left_on: Any, right_on: Any, left: str = "${pipe}", **more: Any) -> tuple:
    return ("join", {"left": left, "right": right, "how": how, "left_on": left_on, "right_on": right_on, **more})


#: Customers with their large pending orders, if any: a frame with nulls in the orders' columns.
_LARGE = ("orders", [_where(o_orderstatus=("==", "P"), o_totalprice=(">", 300000))])
_SPARSE_STEPS = [_join("large", "left", "c_custkey", "o_custkey"), ("select", ["c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice", "o_orderpriority"])]
_SPARSE = {"large": _LARGE, "sparse": ("customer", _SPARSE_STEPS)}
_SPARSE_SQL = """
WITH sparse AS (
  SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice, o_orderpriority
  FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) o ON c_custkey = o_custkey
)
"""


def _sparse(steps: list[tuple], sql: str) -> Case:
    return Case(["customer", "orders"], _SPARSE | {"out": ("sparse", steps)}, _SPARSE_SQL + sql)


def _single(table: str, steps: list[tuple], sql: str) -> Case:
    return Case([table], {"out": (table, steps)}, sql)


#: The flagship: revenue of large lines by priority, market segment and region.
FLAGSHIP = Case(
    ["region", "nation", "customer", "orders", "lineitem"],
    {
        "lines": (
            "lineitem",
            [
                _where(l_quantity=(">=", "10.00")),
                ("derive", {"target": "revenue", "expr": {"*": [_col("l_extendedprice"), {"-": [_lit(1), _col("l_discount")]}]}}),
                ("select", ["l_orderkey", "l_linenumber", "revenue"]),
            ],
        ),
        "out": (
            "lines",
            [
                _join("orders", "inner", "l_orderkey", "o_orderkey"),
                _join("customer", "inner", "o_custkey", "c_custkey"),
                _join("nation", "inner", "c_nationkey", "n_nationkey"),
                _join("region", "inner", "n_regionkey", "r_regionkey"),
                ("group", {"by": ["r_name", "c_mktsegment", "o_orderpriority"], "agg": {"revenue": "sum", "l_orderkey": "count", "c_custkey": "nunique"}}),
                ("label", {"l_orderkey": "line_count", "c_custkey": "customers"}),
                ("derive", {"target": "revenue", "expr": {"round": [_col("revenue"), 4]}}),
                ("sort", {"revenue": "desc"}),
            ],
        ),
    },
    """
    SELECT r_name, c_mktsegment, o_orderpriority, round_even(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
           count(l_orderkey) AS line_count, count(DISTINCT c_custkey) AS customers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_quantity >= 10 GROUP BY 1, 2, 3
    """,
)

_STATS = ["mean", "std", "var", "median", "min", "max", "sem"]
_NAMES = ("select", ["p_partkey", "p_name"])

CASES: dict[str, Case] = {
    "cast_float_text": _single(
        "orders",
        [("derive", {"target": "t", "expr": {"concat": [_col("o_orderkey"), _lit(".25")]}}), ("cast", {"t": "float"}), ("select", ["o_orderkey", "t"])],
        "SELECT o_orderkey, o_orderkey + CAST(0.25 AS DOUBLE) AS t FROM orders",
    ),
    "group_product": _single("nation", [("group", {"by": "n_regionkey", "agg": {"n_nationkey": "prod"}})], "SELECT n_regionkey, product(n_nationkey) AS n_nationkey FROM nation GROUP BY 1"),
    "group_skew": _single(
        "customer",
        [("group", {"by": "c_mktsegment", "agg": {"c_acctbal": "skew"}}), ("derive", {"target": "c_acctbal", "expr": {"round": [_col("c_acctbal"), 6]}})],
        "SELECT c_mktsegment, round_even(skewness(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1",
    ),
    "blueprint_e2e": FLAGSHIP,
    # ------------------------------------------------------------ projections and elements
    "label_select": _single("customer", [("label", {"c_custkey": "id", "c_name": "name", "absent": "x"}), ("select", ["id", "name", "c_mktsegment"])], "SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer"),
    "label_swap": _single("lineitem", [("label", {"l_tax": "l_discount", "l_discount": "l_tax"}), ("select", {"columns": ["l_orderkey", "l_linenumber", "l_tax", "l_discount"]})], "SELECT l_orderkey, l_linenumber, l_discount AS l_tax, l_tax AS l_discount FROM lineitem"),
    "drop_columns": _single("supplier", [("drop", ["s_acctbal", "absent"])], "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "map_status": _single("orders", [("map", {"o_orderstatus": {"O": "open", "F": "filled"}}), ("select", ["o_orderkey", "o_orderstatus"])], "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "map_numbers": _single("customer", [("map", {"c_nationkey": {0: 100, 1: 101}}), ("select", ["c_custkey", "c_nationkey"])], "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 100 WHEN 1 THEN 101 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "replace_regex": _single("customer", [("replace", {"c_name": {"regex": "^Customer#0*", "swap": "C-"}}), ("select", ["c_custkey", "c_name"])], "SELECT c_custkey, regexp_replace(c_name, '^Customer#0*', 'C-', 'g') AS c_name FROM customer"),
    "replace_chain": _single("part", [("replace", {"p_brand": [{"regex": r"brand#(\d)$", "swap": r"B0\1", "flags": "i"}, {"regex": "Brand#", "swap": "B"}]}), ("select", ["p_partkey", "p_brand"])], r"SELECT p_partkey, regexp_replace(regexp_replace(p_brand, 'brand#(\d)$', 'B0\1', 'gi'), 'Brand#', 'B', 'g') AS p_brand FROM part"),
    "cast_types": _single(
        "part",
        [("replace", {"p_brand": {"regex": "Brand#", "swap": ""}}), ("cast", {"p_brand": "integer", "p_size": "float", "p_partkey": "string"}), ("select", ["p_partkey", "p_brand", "p_size"])],
        "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part",
    ),
    "cast_dates": _single(
        "events",
        [("derive", {"target": "text", "expr": {"concat": [_col("ts")]}}), ("cast", {"ts": "date", "text": "datetime"}), ("select", ["event_id", "ts", "text"])],
        "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, ts AS text FROM events",
    ),
    "cast_good": _single(
        "orders",
        [("replace", {"o_orderpriority": {"regex": "^([12])-.*$", "swap": r"\1"}}), ("cast", {"o_orderpriority": "integer"}, {"on_error": "quarantine"}), ("select", ["o_orderkey", "o_orderpriority"])],
        "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS o_orderpriority FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2')",
    ),
    "cast_rejected": Case(
        ["orders"],
        {"out": ("orders", [("select", ["o_orderkey", "o_orderpriority"]), ("replace", {"o_orderpriority": {"regex": "^([12])-.*$", "swap": r"\1"}}), ("cast", {"o_orderpriority": "integer"}, {"on_error": "quarantine"})])},
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE left(o_orderpriority, 1) NOT IN ('1', '2')",
        output="out__rejected",
    ),
    "affix_both": _single("customer", [("affix", {"c_custkey": {"text": "K", "position": "prefix"}, "c_mktsegment": {"text": "/seg"}}), ("select", ["c_custkey", "c_mktsegment"])], "SELECT 'K' || c_custkey AS c_custkey, c_mktsegment || '/seg' AS c_mktsegment FROM customer"),
    "normalize_chain": _single("documents", [("normalize", {"lang": ["title"], "source": ["strip", "upper"]}), ("select", ["doc_id", "lang", "source"])], "SELECT doc_id, upper(lang[1:1]) || lower(lang[2:]) AS lang, upper(trim(source)) AS source FROM documents"),
    "normalize_text": _single("documents", [("normalize", {"text": ["nfc", "lower"]}), ("select", ["doc_id", "text"])], "SELECT doc_id, lower(nfc_normalize(text)) AS text FROM documents"),
    # ------------------------------------------------------------ expressions
    "derive_revenue": _single(
        "lineitem",
        [("derive", {"target": "revenue", "expr": {"*": [_col("l_extendedprice"), {"-": [_lit(1), _col("l_discount")]}, {"+": [_lit(1), _col("l_tax")]}]}}), ("select", ["l_orderkey", "l_linenumber", "l_partkey", "revenue"])],
        "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS revenue FROM lineitem",
    ),
    "derive_round_even": _single("lineitem", [("derive", {"target": "half", "expr": {"round": [{"/": [_col("l_quantity"), _lit(2)]}]}}), ("select", ["l_orderkey", "l_partkey", "half"])], "SELECT l_orderkey, l_partkey, round_even(l_quantity / 2, 0) AS half FROM lineitem"),
    "derive_modulo": _single(
        "orders",
        [
            ("derive", {"target": "x", "expr": {"-": [_col("o_custkey"), _lit(75)]}}),
            ("derive", {"target": "up", "expr": {"%": [_col("x"), _lit(7)]}}),
            ("derive", {"target": "down", "expr": {"%": [_col("x"), _lit(-7)]}}),
            ("select", ["o_orderkey", "x", "up", "down"]),
        ],
        "SELECT o_orderkey, o_custkey - 75 AS x, ((o_custkey - 75) % 7 + 7) % 7 AS up, ((o_custkey - 75) % -7 - 7) % -7 AS down FROM orders",
    ),
    "derive_division": _single(
        "lineitem",
        # as in the SQL, a missing divisor counts as zero, and only a positive number by zero is infinite
        [
            ("derive", {"target": "ratio", "expr": {"coalesce": [{"/": [_col("l_tax"), {"nullif": [_col("l_discount"), _lit(0)]}]}, {"nullif": [{"/": [_col("l_tax"), _lit(0)]}, _lit(-math.inf)]}]}}),
            ("select", ["l_orderkey", "l_partkey", "ratio"]),
        ],
        "SELECT l_orderkey, l_partkey, CASE WHEN l_discount <> 0 THEN l_tax / l_discount WHEN l_tax > 0 THEN CAST('inf' AS DOUBLE) END AS ratio FROM lineitem",
    ),
    "derive_functions": _single(
        "customer",
        [
            ("derive", {"target": "tag", "expr": {"concat": [{"lower": [_col("c_mktsegment")]}, _lit("-"), _col("c_custkey")]}}),
            ("derive", {"target": "loud", "expr": {"upper": [_col("c_name")]}}),
            ("derive", {"target": "size", "expr": {"length": [_col("c_name")]}}),
            ("derive", {"target": "debt", "expr": {"abs": [{"-": [_lit(0), _col("c_acctbal")]}]}}),
            ("derive", {"target": "joined", "expr": {"+": [_col("c_name"), _col("c_mktsegment")]}}),
            ("drop", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
        ],
        "SELECT c_custkey, lower(c_mktsegment) || '-' || c_custkey AS tag, upper(c_name) AS loud, length(c_name) AS size, abs(0 - c_acctbal) AS debt, c_name || c_mktsegment AS joined FROM customer",
    ),
    "derive_share": _single("events", [("derive", {"target": "share", "expr": {"/": [_col("value"), {"pipe": "value|max"}]}}), ("select", ["event_id", "share"])], "SELECT event_id, value / (SELECT max(value) FROM events) AS share FROM events"),
    "derive_coalesce": _sparse([("derive", {"target": "price", "expr": {"coalesce": [_col("o_totalprice"), _lit(-1.0)]}}), ("select", ["c_custkey", "o_orderkey", "price"])], "SELECT c_custkey, o_orderkey, coalesce(o_totalprice, -1.0) AS price FROM sparse"),
    "fillna_constant": _sparse([("fillna", {"o_totalprice": 0, "o_orderpriority": "none", "o_orderkey": -1})], "SELECT c_custkey, c_mktsegment, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderpriority, 'none') AS o_orderpriority FROM sparse"),
    "fillna_new_column": _single("region", [("fillna", {"note": "new", "r_name": "x"})], "SELECT r_regionkey, r_name, 'new' AS note FROM region"),
    "fillna_median": _sparse(
        [("fillna", {"o_totalprice": "${pipe:o_totalprice|median}"}), ("derive", {"target": "o_totalprice", "expr": {"round": [_col("o_totalprice"), 4]}}), ("select", ["c_custkey", "o_orderkey", "o_totalprice"])],
        "SELECT c_custkey, o_orderkey, round_even(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM sparse)), 4) AS o_totalprice FROM sparse",
    ),
    # ------------------------------------------------------------ filters
    "filter_compare": _single(
        "lineitem",
        [_where(l_quantity=(">=", "45.00"), l_shipdate=("<", "1996-01-01"), l_returnflag=("!=", "R")), ("select", ["l_orderkey", "l_partkey", "l_quantity"])],
        "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag <> 'R'",
    ),
    "filter_or_not": _single(
        "orders",
        [("filter", {"OR": [{"NOT": {"o_orderstatus": {"op": "in", "value": ["O", "F"]}}}, {"AND": [{"o_totalprice": {"op": "<=", "value": 50000}}, {"o_orderpriority": {"op": "startswith", "value": "1"}}]}]}), ("select", ["o_orderkey"])],
        "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR (o_totalprice <= 50000 AND o_orderpriority LIKE '1%')",
    ),
    "filter_in": _single("part", [_where(p_type=("in", ["PROMO", "SMALL"]), p_size=("not_in", [1, 2, 3])), _NAMES], "SELECT p_partkey, p_name FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size NOT IN (1, 2, 3)"),
    "filter_between": _single("orders", [_where(o_totalprice=("between", [100000, 200000]), o_orderdate=("between", ["1995-01-01", "1996-12-31"])), ("select", ["o_orderkey"])], "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    "filter_text": _single(
        "part",
        [("filter", {"OR": [{"p_name": {"op": "contains", "value": "ol"}}, {"p_name": {"op": "endswith", "value": "ring"}}, {"p_type": {"op": "startswith", "value": "ECO"}}]}), _NAMES],
        "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ol') OR p_name LIKE '%ring' OR p_type LIKE 'ECO%'",
    ),
    "filter_null": _sparse([_where(o_orderkey=("isnull",))], "SELECT * FROM sparse WHERE o_orderkey IS NULL"),
    "filter_not_null": _sparse([_where(o_orderkey=("notnull",))], "SELECT * FROM sparse WHERE o_orderkey IS NOT NULL"),
    "filter_not_equal_nulls": _sparse([_where(o_orderpriority=("!=", "1-URGENT"))], "SELECT * FROM sparse WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    "filter_not_in_nulls": _sparse([_where(o_orderpriority=("not_in", ["1-URGENT", "2-HIGH"]))], "SELECT * FROM sparse WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "filter_negated_nulls": _sparse([("filter", {"NOT": {"o_totalprice": {"op": ">", "value": 350000}}})], "SELECT * FROM sparse WHERE o_totalprice IS NULL OR NOT o_totalprice > 350000"),
    "filter_pipe_column": _single("lineitem", [_where(l_tax=("==", "${pipe:l_discount}")), ("select", ["l_orderkey", "l_partkey", "l_tax"])], "SELECT l_orderkey, l_partkey, l_tax FROM lineitem WHERE l_tax = l_discount"),
    "filter_pipe_mean": _single("orders", [_where(o_totalprice=(">=", "${pipe:o_totalprice|mean}")), ("select", ["o_orderkey"])], "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT avg(o_totalprice) FROM orders)"),
    "filter_pipe_in": _single("events", [_where(user_id=("in", ["${pipe:user_id|max}", "${pipe:user_id|min}", 7])), ("select", ["event_id"])], "SELECT event_id FROM events WHERE user_id IN ((SELECT max(user_id) FROM events), (SELECT min(user_id) FROM events), 7)"),
    "filter_pipe_members": _single("lineitem", [_where(l_partkey=("in", "${pipe:l_suppkey|unique}")), ("select", ["l_orderkey", "l_partkey"])], "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_suppkey FROM lineitem)"),
    # ------------------------------------------------------------ order, duplicates
    "sort_nulls_last": _sparse([("sort", {"o_totalprice": "desc", "c_custkey": "asc"})], "SELECT * FROM sparse"),
    "dedupe_first": _single("events", [("dedupe", {"on": "user_id", "order_by": {"ts": "asc"}})], "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1"),
    "dedupe_last": _single("events", [("dedupe", {"on": ["user_id", "event_type"], "keep": "last", "order_by": {"ts": "asc"}})], "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1"),
    "dedupe_single": _single("lineitem", [("dedupe", {"on": ["l_orderkey", "l_linenumber"], "keep": False}), ("select", ["l_orderkey", "l_linenumber", "l_partkey"])], "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1"),
    "dedupe_rows": _single("orders", [("select", ["o_custkey", "o_orderstatus"]), ("dedupe", {})], "SELECT DISTINCT o_custkey, o_orderstatus FROM orders"),
    "dedupe_row_order": _single("events", [("dedupe", {"on": "user_id"}), ("select", ["event_id", "user_id"])], "SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id"),
    "dedupe_row_order_last": _single("events", [("dedupe", {"on": ["user_id", "event_type"], "keep": "last"}), ("select", ["event_id", "user_id"])], "SELECT max(event_id) AS event_id, user_id FROM events GROUP BY user_id, event_type"),
    "sort_then_dedupe": _single("events", [("sort", {"value": "desc", "event_id": "asc"}), ("dedupe", {"on": "event_type"})], "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1"),
    "select_ignore_missing": _single("nation", [("select", {"columns": ["n_name", "absent", "n_nationkey"], "ignore_missing": True})], "SELECT n_name, n_nationkey FROM nation"),
    # ------------------------------------------------------------ groups and windows
    "group_sum_count": _single(
        "lineitem",
        [
            ("group", {"by": ["l_returnflag", "l_linestatus"], "agg": {"l_quantity": "sum", "l_extendedprice": "sum", "l_discount": "mean", "l_orderkey": "count"}}),
            ("derive", {"target": "l_extendedprice", "expr": {"round": [_col("l_extendedprice"), 2]}}),
            ("derive", {"target": "l_discount", "expr": {"round": [_col("l_discount"), 8]}}),
        ],
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, round_even(sum(l_extendedprice), 2) AS l_extendedprice, round_even(avg(l_discount), 8) AS l_discount, count(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2",
    ),
    "group_statistics": _single(
        "events",
        [
            *[("derive", {"target": f"v_{s}", "expr": _col("value")}) for s in _STATS],
            ("group", {"by": "event_type", "agg": {f"v_{s}": s for s in _STATS}}),
            *[("derive", {"target": f"v_{s}", "expr": {"round": [_col(f"v_{s}"), 6]}}) for s in _STATS],
        ],
        "SELECT event_type, "
        + ", ".join(f"round_even({e}, 6) AS v_{s}" for s, e in zip(_STATS, ["avg(value)", "stddev_samp(value)", "var_samp(value)", "median(value)", "min(value)", "max(value)", "stddev_samp(value) / sqrt(count(value))"], strict=True))
        + " FROM events GROUP BY 1",
    ),
    "group_nunique": _single("lineitem", [("group", {"by": "l_suppkey", "agg": {"l_partkey": "nunique", "l_orderkey": "size"}})], "SELECT l_suppkey, count(DISTINCT l_partkey) AS l_partkey, count(*) AS l_orderkey FROM lineitem GROUP BY 1"),
    "group_null_key": _sparse(
        [("group", {"by": "o_orderpriority", "agg": {"o_totalprice": "sum", "c_custkey": "count"}}), ("derive", {"target": "o_totalprice", "expr": {"round": [_col("o_totalprice"), 2]}})],
        "SELECT o_orderpriority, round_even(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice, count(c_custkey) AS c_custkey FROM sparse GROUP BY 1",
    ),
    "group_first_last": _single("events", [("group", {"by": "user_id", "agg": {"event_type": "first", "value": "last"}})], "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"),
    "group_flags": _single(
        "orders",
        [("derive", {"target": "late", "expr": {"%": [_col("o_orderkey"), _lit(2)]}}), ("cast", {"late": "boolean"}), ("derive", {"target": "early", "expr": _col("late")}), ("group", {"by": "o_custkey", "agg": {"late": "any", "early": "all"}})],
        "SELECT o_custkey, bool_or(o_orderkey % 2 = 1) AS late, bool_and(o_orderkey % 2 = 1) AS early FROM orders GROUP BY 1",
    ),
    "window_running": _single(
        "orders",
        [
            (
                "window",
                {
                    "partition_by": ["o_custkey"],
                    "order_by": {"o_orderdate": "asc", "o_orderkey": "desc"},
                    "add": {"n": {"fn": "row_number"}, "c": {"fn": "cumcount"}, "s": {"fn": "cumsum", "column": "o_orderkey"}, "high": {"fn": "cummax", "column": "o_totalprice"}, "low": {"fn": "cummin", "column": "o_totalprice"}},
                },
            ),
            ("select", ["o_orderkey", "n", "c", "s", "high", "low"]),
        ],
        """SELECT o_orderkey, row_number() OVER w AS n, row_number() OVER w - 1 AS c, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, max(o_totalprice) OVER w AS high, min(o_totalprice) OVER w AS low
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey DESC ROWS UNBOUNDED PRECEDING)""",
    ),
    "window_ranks": _sparse(
        [("window", {"partition_by": "c_mktsegment", "add": {"r": {"fn": "rank", "column": "o_orderpriority"}, "d": {"fn": "dense_rank", "column": "o_orderpriority"}}}), ("select", ["c_custkey", "o_orderkey", "r", "d"])],
        """SELECT c_custkey, o_orderkey,
          CASE WHEN o_orderpriority IS NOT NULL THEN CAST(rank() OVER w AS DOUBLE) END AS r, CASE WHEN o_orderpriority IS NOT NULL THEN CAST(dense_rank() OVER w AS DOUBLE) END AS d
        FROM sparse WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_orderpriority NULLS LAST)""",
    ),
    "window_row_order": _single("events", [("window", {"partition_by": "user_id", "add": {"n": {"fn": "row_number"}, "s": {"fn": "cumsum", "column": "event_id"}}}), ("select", ["event_id", "n", "s"])], "SELECT event_id, row_number() OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"),
    "window_over_all": _single(
        "orders",
        [("window", {"order_by": {"o_orderdate": "asc", "o_orderkey": "asc"}, "add": {"n": {"fn": "row_number"}, "s": {"fn": "cumsum", "column": "o_custkey"}, "r": {"fn": "rank", "column": "o_orderpriority"}, "d": {"fn": "dense_rank", "column": "o_orderdate"}}}), ("select", ["o_orderkey", "n", "s", "r", "d"])],
        """SELECT o_orderkey, row_number() OVER w AS n, CAST(sum(o_custkey) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, CAST(rank() OVER (ORDER BY o_orderpriority) AS DOUBLE) AS r, CAST(dense_rank() OVER (ORDER BY o_orderdate) AS DOUBLE) AS d
        FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""",
    ),
    # ------------------------------------------------------------ joins and unions
    "join_inner": Case(["orders", "lineitem"], {"out": ("lineitem", [_join("orders", "inner", "l_orderkey", "o_orderkey"), ("select", ["l_orderkey", "o_orderkey", "l_partkey", "o_custkey"])])}, "SELECT l_orderkey, o_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "join_left": Case(["customer", "orders"], _SPARSE, _SPARSE_SQL + "SELECT * FROM sparse", output="sparse"),
    "join_right": Case(
        ["customer", "orders"],
        {"large": _LARGE, "out": ("large", [("merge", {"left": "${pipe}", "right": "customer", "how": "right", "left_on": "o_custkey", "right_on": "c_custkey"}), ("select", ["o_orderkey", "o_custkey", "c_custkey"])])},
        "SELECT o_orderkey, o_custkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey",
    ),
    "join_outer": Case(
        ["customer", "supplier"],
        {"a": ("customer", [("label", {"c_nationkey": "nation"}), _where(nation=("<", 20)), ("group", {"by": "nation", "agg": {"c_custkey": "count"}})]), "b": ("supplier", [("label", {"s_nationkey": "nation"}), _where(nation=(">", 5)), ("group", {"by": "nation", "agg": {"s_suppkey": "count"}})]), "out": ("a", [("join", {"left": "${pipe}", "right": "b", "how": "outer", "on": "nation"})])},
        "SELECT nation, c_custkey, s_suppkey FROM (SELECT c_nationkey AS nation, count(*) AS c_custkey FROM customer WHERE c_nationkey < 20 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS s_suppkey FROM supplier WHERE s_nationkey > 5 GROUP BY 1) USING (nation)",
    ),
    "join_cross": Case(["nation", "region"], {"out": (None, [("join", {"left": "nation", "right": "region", "how": "cross"})])}, "SELECT * FROM nation CROSS JOIN region"),
    "join_natural": Case(["nation", "region"], {"n": ("nation", [("label", {"n_regionkey": "r_regionkey"})]), "out": (None, [("join", {"left": "n", "right": "region", "how": "inner"})])}, "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_null_keys": Case(
        ["customer", "orders"],
        _SPARSE | {"sizes": ("sparse", [("group", {"by": "o_orderpriority", "agg": {"c_custkey": "count"}}), ("label", {"c_custkey": "customers"})]), "out": ("sparse", [("join", {"left": "${pipe}", "right": "sizes", "how": "inner", "on": ["o_orderpriority"]}), ("select", ["c_custkey", "o_orderpriority", "customers"])])},
        _SPARSE_SQL + "SELECT c_custkey, s.o_orderpriority, n AS customers FROM sparse s JOIN (SELECT o_orderpriority, count(c_custkey) AS n FROM sparse GROUP BY 1) g ON s.o_orderpriority IS NOT DISTINCT FROM g.o_orderpriority",
    ),
    "join_suffixes": Case(
        ["orders"],
        {"o": ("orders", [("select", ["o_orderkey", "o_custkey", "o_totalprice"])]), "top": ("orders", [("group", {"by": "o_custkey", "agg": {"o_totalprice": "max"}})]), "out": ("o", [("join", {"left": "${pipe}", "right": "top", "on": "o_custkey", "suffixes": ["", "_max"], "relationship": "m:1"})])},
        "SELECT o_orderkey, o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS o_totalprice_max FROM orders",
    ),
    "union_outer": Case(
        ["customer", "supplier"],
        {"a": ("customer", [("label", {"c_custkey": "key", "c_name": "name", "c_acctbal": "balance"}), ("drop", ["c_nationkey"])]), "b": ("supplier", [("label", {"s_suppkey": "key", "s_name": "name", "s_acctbal": "balance"})]), "out": (None, [("union", {"frames": ["a", "b"]})])},
        "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment, CAST(NULL AS INTEGER) AS s_nationkey FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier",
    ),
    "union_inner": Case(
        ["customer", "supplier"],
        {"a": ("customer", [("label", {"c_custkey": "key", "c_name": "name"})]), "b": ("supplier", [("label", {"s_suppkey": "key", "s_name": "name"})]), "out": (None, [("concat", {"frames": ["a", "b"], "columns": "inner"})])},
        "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    ),
    "union_dedupe": Case(
        ["customer", "supplier"],
        {"a": ("customer", [("label", {"c_nationkey": "nation"}), ("select", ["nation"])]), "b": ("supplier", [("label", {"s_nationkey": "nation"}), ("select", ["nation"])]), "out": (None, [("append", {"frames": ["a", "b"], "dedupe": True})])},
        "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
}

_FUZZY = Case(
    ["part"],
    {"misspelt": ("part", [("select", ["p_name"]), ("derive", {"target": "name", "expr": _col("p_name")}), ("replace", {"name": {"regex": "([aeiou])([a-z])$", "swap": r"\2"}}), ("dedupe", ["name"])]), "out": ("part", [_NAMES, ("fuzzy_join", {"right": "misspelt", "left_on": "p_name", "right_on": "name", "threshold": 0.85})])},
    "",
)

_DIFF_SQL = """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'),
     t AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000),
     d AS (SELECT CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'delete' WHEN s.o_orderstatus <> t.o_orderstatus OR s.o_totalprice <> t.o_totalprice THEN 'update' ELSE 'unchanged' END AS _op,
             coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice
           FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)
"""


def _diff(sql: str, **more: Any) -> Case:
    kept = ("select", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return Case(
        ["orders"],
        {"new": ("orders", [_where(o_orderpriority=("!=", "5-LOW")), kept, ("map", {"o_orderstatus": {"P": "X"}})]), "old": ("orders", [_where(o_totalprice=(">", 100000)), kept]), "out": (None, [("compare_diff", {"source": "new", "target": "old", "key": "o_orderkey", **more})])},
        _DIFF_SQL + sql,
    )


CASES |= {
    "diff_exact": _diff("SELECT * FROM d WHERE _op <> 'unchanged'"),
    "diff_hash": _diff("SELECT * FROM d WHERE _op <> 'unchanged'", change_detection="hash"),
    "diff_full": _diff("SELECT * FROM d", emit=["insert", "update", "delete", "unchanged"]),
    "diff_ignore": _diff("SELECT CASE _op WHEN 'insert' THEN 'I' ELSE 'D' END AS kind, o_orderkey, o_orderstatus, o_totalprice FROM d WHERE _op IN ('insert', 'delete')", ignore=["o_orderstatus"], op_column="kind", op_labels={"insert": "I", "delete": "D"}),
}


# ---------------------------------------------------------------- loads
def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise AdapterError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="weirflow-")
    return f"{shared.rstrip('/')}/catalogue-{uuid.uuid4().hex}"


def _loaded(spark: SparkSession, sf_dir: str, tables: list[str], tasks: dict, loads: list[dict], read: str, extra: dict | None = None) -> DataFrame:
    """Runs transforms, loads their frames into managed tables and reads one of these again."""
    case = Case(tables, tasks, "", extra=extra or {})
    plan = blueprint(case, sf_dir)
    target = {"adapter": "db", "params": {"engine": "managed", "path": scratch(spark)}}
    plan["resources"]["target"] = target
    before: list[str] = []
    for k, step in enumerate(loads):
        plan["tasks"][f"load{k}"] = {"stage": "load", "resource": "target", "steps": [step], "depends_on": before}
        before = [f"load{k}"]
    Orchestrator(load_config(plan), spark).run()
    return create_adapter(Resource(name="target", **target), spark).read(read)


_KEPT = ("select", ["o_orderkey", "o_orderstatus", "o_totalprice"])
_FIRST = ("orders", [_where(o_orderstatus=("!=", "F")), _KEPT])
_SECOND = ("orders", [_where(o_orderpriority=("==", "1-URGENT")), _KEPT, ("derive", {"target": "o_totalprice", "expr": {"+": [_col("o_totalprice"), _lit(1)]}})])
_PAIR = {"first": _FIRST, "second": _SECOND}


def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, ["orders"], _PAIR, [{"input": "first", "collection": "t"}, {"input": "second", "collection": "t", "mode": "append"}], "t")


def load_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, ["orders"], _PAIR, [{"input": "first", "collection": "t"}, {"input": "second", "collection": "t", "mode": "upsert", "key": "o_orderkey"}], "t")


def load_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, ["orders"], _PAIR, [{"input": "first", "collection": "t"}, {"input": "second", "collection": "t", "mode": "delete", "key": ["o_orderkey"]}], "t")


def load_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = {"first": _FIRST, "second": ("orders", [_where(o_orderstatus=("==", "P"), o_totalprice=(">", 200000)), _KEPT])}
    return _loaded(spark, sf_dir, ["orders"], tasks, [{"input": "first", "collection": "t"}, {"input": "second", "collection": "t", "write": {"partition_by": ["o_orderstatus"]}}], "t")


def load_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of customers' segments: on the first day all, then a changed part of them."""
    spec = {"track": ["c_mktsegment"], "effective_from": "since", "effective_to": "until", "current_flag": "current"}
    kept = ("select", ["c_custkey", "c_mktsegment"])
    tasks = {"first": ("customer", [_where(c_nationkey=("<", 20)), kept]), "second": ("customer", [_where(c_nationkey=(">=", 10)), kept, ("map", {"c_mktsegment": {"BUILDING": "HOUSING"}})])}
    loads = [{"input": f, "collection": "t", "mode": "scd2", "key": "c_custkey", "scd": spec} for f in ("first", "second")]
    return _loaded(spark, sf_dir, ["customer"], tasks, loads, "t", {"partition": {"field": "day", "bounds": {"start": "2024-03-01"}}})


def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two incremental extracts, which reads again the last day before its mark."""
    plan = blueprint(Case(["events"], {"out": ("events", [("select", ["event_id", "ts"])])}, ""), sf_dir)
    plan["resources"]["marks"] = {"adapter": "db", "params": {"engine": "managed", "path": scratch(spark)}}
    plan["orchestration"] = {"watermark_store": {"resource": "marks"}}
    plan["tasks"]["extract_events"]["incremental"] = {"strategy": "watermark", "cursor": "ts", "initial": "2024-01-03", "lookback": "1d"}
    for _ in range(2):
        ctx = Orchestrator(load_config(plan), spark).run()
    return hide(ctx.state.get("out"))


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a contract finds wrong with the orders, a row each."""
    contract = DataframeContract.model_validate(
        {"columns": {"o_orderkey": {"dtype": "integer", "unique": True}, "o_custkey": {"unique": True}, "o_totalprice": {"dtype": "float", "checks": [{"<=": 400000}, {">": 0}]}, "o_orderstatus": {"allowed": ["O", "F"]}}, "primary_key": ["o_custkey", "o_orderdate"], "foreign_keys": {"o_custkey": "vip.c_custkey"}}
    )
    vip = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0")
    found = contract_problems(spark.read.parquet(f"{sf_dir}/orders.parquet"), contract, {"vip": vip}.get)
    return spark.createDataFrame([(p,) for p in found], "problem string")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken in by a stream over their folder, with a step on the way."""
    at = scratch(spark)
    target = create_adapter(Resource(name="target", adapter="db", params={"engine": "managed", "path": f"{at}/tables"}), spark)
    table = f"{sf_dir}/orders.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    inbox, only = (table, {}) if folder else (sf_dir, {"pathGlobFilter": "orders.parquet"})
    ingest_new_files(spark, inbox, spark.read.parquet(table).schema, target, "orders", f"{at}/state", steps=[_where(o_orderstatus=("==", "O"))], options=only)
    return target.read("orders")


def expectation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expectations on orders that don't hold, a row each."""
    wanted = [
        {"name": "rows", "assert": {"row_count": {"<": 10}}},
        {"name": "status", "assert": {"column": "o_orderstatus", "allowed": ["O", "F"]}},
        {"name": "price", "assert": {"column": "o_totalprice", "min": 1000, "max": "450000"}},
        {"name": "keys", "assert": {"column": "o_orderkey", "not_null": True, "unique": True}},
        {"name": "customers", "assert": {"column": "o_custkey", "unique": True}},
        {"name": "nulls", "assert": {"column": "o_custkey", "null_rate_below": 0.1}},
    ]
    found = check_expectations(spark.read.parquet(f"{sf_dir}/orders.parquet"), [Expectation.model_validate(w | {"on_failure": "warn"}) for w in wanted])
    return spark.createDataFrame([(p,) for p in found], "problem string")


def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two runs, which reads what the first one kept."""
    at = scratch(spark)
    for _ in range(2):
        out = run_case(spark, sf_dir, Case(["customer"], {"out": ("customer", [("group", {"by": "c_nationkey", "agg": {"c_custkey": "count"}})])}, "", extra={"orchestration": {"checkpoint": {"enabled": True, "store": at}}}))
    return out


def sqlite_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a database file, some of them updated, and read from a balance on."""
    at = scratch(spark).removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    base = create_adapter(Resource(name="base", adapter="db", params={"engine": "sqlite", "path": f"{at}/t.db"}), spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    base.write(rows.where("s_nationkey < 20"), "suppliers")
    base.write(rows.where("s_nationkey >= 15").selectExpr("s_suppkey", "s_acctbal + 1 as s_acctbal"), "suppliers", mode="upsert", key="s_suppkey")
    return base.read("suppliers", since=("s_acctbal", 100)).select("s_suppkey", "s_name", "s_acctbal")


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "tsv")


def excel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in one sheet of a workbook, beside another."""
    book = create_adapter(Resource(name="out", adapter="file", params={"format": "excel", "path": f"{scratch(spark)}/b.xlsx"}), spark)
    book.write(spark.read.parquet(f"{sf_dir}/region.parquet"), "regions")
    book.write(spark.read.parquet(f"{sf_dir}/nation.parquet"), "nations")
    return book.read("nations")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV, twice, and read again with inferred types."""
    return _files(spark, sf_dir, "csv")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "json")


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    out = create_adapter(Resource(name="out", adapter="file", params={"format": kind, "path": f"{scratch(spark)}/rows"}), spark)
    out.write(rows)
    out.write(rows.where("c_nationkey = 3"), mode="append")
    return out.read()


_TWICE = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_nationkey = 3)"
_FIRST_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'"
_SECOND_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"
_SCD2_SQL = """
WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 20),
     b AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey >= 10),
     o AS (SELECT a.c_custkey, a.c_mktsegment, b.c_custkey IS NOT NULL AND a.c_mktsegment <> b.c_mktsegment AS changed FROM a LEFT JOIN b USING (c_custkey))
SELECT c_custkey, c_mktsegment, TIMESTAMP '2024-03-01' AS since, CASE WHEN changed THEN TIMESTAMP '2024-03-01' END AS until, NOT changed AS current FROM o
UNION ALL SELECT b.c_custkey, b.c_mktsegment, TIMESTAMP '2024-03-01', NULL, true FROM b LEFT JOIN o USING (c_custkey) WHERE o.c_custkey IS NULL OR o.changed
"""

LOADS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "load_append": (load_append, f"{_FIRST_SQL} UNION ALL {_SECOND_SQL}"),
    "load_upsert": (load_upsert, f"WITH a AS ({_FIRST_SQL}), b AS ({_SECOND_SQL}) SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (o_orderkey)"),
    "load_delete": (load_delete, f"WITH a AS ({_FIRST_SQL}), b AS ({_SECOND_SQL}) SELECT * FROM a ANTI JOIN b USING (o_orderkey)"),
    "load_replace_partition": (load_replace_partition, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_totalprice > 200000)"),
    "load_scd2": (load_scd2, _SCD2_SQL),
    "incremental_since": (incremental_since, "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY"),
    "contract_report": (
        contract_report,
        """
        SELECT 'o_custkey: ' || (count(o_custkey) - count(DISTINCT o_custkey)) || ' repeated values' AS problem FROM orders
        UNION ALL SELECT 'o_totalprice: ' || count(*) || ' values against <= 400000' FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT 'o_orderstatus: ' || count(*) || ' values that aren''t allowed' FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'primary key o_custkey, o_orderdate: ' || (sum(n) - count(*)) || ' repeated rows' FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate) HAVING sum(n) > count(*)
        UNION ALL SELECT 'foreign key o_custkey: ' || count(*) || ' rows without vip.c_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        """,
    ),
    "expectation_report": (
        expectation_report,
        """
        SELECT 'expectation rows: ' || count(*) || ' rows, not < 10' AS problem FROM orders
        UNION ALL SELECT 'expectation status: ' || count(*) || ' values that aren''t allowed' FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'expectation price: ' || CASE WHEN count(*) FILTER (o_totalprice < 1000) > 0 THEN count(*) FILTER (o_totalprice < 1000) || ' values under 1000' ELSE count(*) FILTER (o_totalprice > 450000) || ' values over 450000' END FROM orders
        UNION ALL SELECT 'expectation customers: ' || (count(*) - count(DISTINCT o_custkey)) || ' repeated values' FROM orders
        """,
    ),
    "checkpoint_reuse": (checkpoint_reuse, "SELECT c_nationkey, count(*) AS c_custkey FROM customer GROUP BY 1"),
    "sqlite_upsert": (
        sqlite_upsert,
        "SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN s_name END AS s_name, s_acctbal + CASE WHEN s_nationkey >= 15 THEN 1 ELSE 0 END AS s_acctbal FROM supplier WHERE s_acctbal + CASE WHEN s_nationkey >= 15 THEN 1 ELSE 0 END > 100",
    ),
    "tsv_round_trip": (tsv_round_trip, _TWICE),
    "excel_round_trip": (excel_round_trip, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "stream_ingest": (stream_ingest, "SELECT * FROM orders WHERE o_orderstatus = 'O'"),
    "csv_round_trip": (csv_round_trip, _TWICE),
    "json_round_trip": (json_round_trip, _TWICE),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, case=case: run_case(spark, sf_dir, case)) for name, case in CASES.items()}
    out |= {name: fn for name, (fn, _) in LOADS.items()}
    return out | {"fuzzy_parts": lambda spark, sf_dir: run_case(spark, sf_dir, _FUZZY)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for all queries but the similarity join, which SQL can't express."""
    return {name: case.sql for name, case in CASES.items()} | {name: sql for name, (_, sql) in LOADS.items()}
