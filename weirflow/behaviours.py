"""Queries over how the engine behaves: gates, guards, checks, retries, plugins and blueprints in files.

Each gives rows that SQL can give too: the rows that a run leaves, or a case and what came of it.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import scratch
from .cli import main
from .config import load_config
from .config.format import Resource
from .errors import WeirflowError
from .functions.frames import hide
from .operators import build_transform
from .operators.base import Transform
from .plans import Orchestrator
from .quality.contracts import DataframeContract, check_contract, contract_problems
from .registry import Registry, register_expression, register_load_strategy, register_notifier, register_secret_provider, register_transform
from .secret_providers import MappingSecretProvider
from .sources import Adapter, WriteRequest, create_adapter


def _outcome(run: Callable[[], Any]) -> str:
    """What came of a call: done, or the kind of its error."""
    try:
        run()
    except (WeirflowError, PySparkException) as e:
        return type(e).__name__
    return "done"


def _cases(spark: SparkSession, found: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(found), "name string, outcome string")


def _expected(**outcomes: str) -> str:
    rows = ", ".join(f"('{name}', '{outcome}')" for name, outcome in outcomes.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(name, outcome)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _adapter(spark: SparkSession, kind: str, allow: Sequence[str] = ("read", "write"), **params: Any) -> Adapter:
    return create_adapter(Resource(adapter=kind, params=params, allow=list(allow)), spark, "r")


def _managed(spark: SparkSession) -> Adapter:
    return _adapter(spark, "db", engine="managed", path=scratch(spark))


def _sqlite(spark: SparkSession, **params: Any) -> Adapter:
    at = scratch(spark).removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    return _adapter(spark, "db", engine="sqlite", **({"path": f"{at}/t.db"} | params))


def _plan(sf_dir: str, table: str, steps: list[dict], **more: Any) -> dict[str, Any]:
    """A blueprint that takes one table through steps, as ``out``."""
    plan = {
        "metadata": {"id": "behaviours"},
        "resources": {"src": {"adapter": "file", "params": {"format": "parquet", "path": f"{sf_dir}/{table}.parquet"}}},
        "tasks": {
            "take": {"stage": "extract", "resource": "src", "steps": [{"output": table}]},
            "make": {"stage": "transform", "input": table, "output": "out", "steps": steps},
        },
    }
    for task, keys in more.pop("tasks", {}).items():
        plan["tasks"][task] = plan["tasks"].get(task, {}) | keys
    return plan | more


def _run(spark: SparkSession, plan: dict[str, Any], **how: Any) -> DataFrame:
    return hide(Orchestrator(load_config(plan, **how), spark).run().state.get("out"))


_KEEP = {"action": "select", "with": ["s_suppkey", "s_nationkey"]}


# ---------------------------------------------------------------- sources and sinks
def permission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _table(spark, sf_dir, "region"), []
    for allow in (["read"], ["write"], ["read", "write"]):
        at = scratch(spark)
        _adapter(spark, "file", format="parquet", path=at).write(rows)
        gate = _adapter(spark, "file", allow, format="parquet", path=at)
        found += [(f"{'+'.join(allow)}: read", _outcome(gate.read)), (f"{'+'.join(allow)}: write", _outcome(lambda g=gate: g.write(rows)))]
    return _cases(spark, found)


def file_mode_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region")
    out = _adapter(spark, "file", format="csv", path=scratch(spark))
    return _cases(spark, [(mode, _outcome(lambda m=mode: out.write(rows, mode=m, key=["r_regionkey"]))) for mode in ("replace", "append", "upsert", "delete")])


def atomic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose second request fails leaves nothing of the first."""
    rows, base = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), _managed(spark)
    base.write(rows.where("s_nationkey < 12"), "t")
    more, twice = rows.where("s_nationkey >= 12"), rows.unionByName(rows)
    tried = _outcome(lambda: base.write_batch([WriteRequest(more, "t", "append"), WriteRequest(twice, "t", "upsert", ["s_suppkey"])]))
    return base.read("t").withColumn("tried", F.lit(tried))


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), _managed(spark)
    low, high = rows.where("s_nationkey < 15"), rows.where("s_nationkey >= 10")
    done = [base.write(low, "t"), base.write(high, "t", mode="upsert", key="s_suppkey"), base.write(low, "t", mode="delete", key="s_suppkey"), base.write(low, "t", mode="append")]
    return spark.createDataFrame([(str(r.mode), r.rows_in, r.inserted, r.updated, r.deleted, r.created_table) for r in done], "mode string, rows_in long, inserted long, updated long, deleted long, created boolean")


def contract_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made by a contract has its types."""
    contract = DataframeContract.model_validate({"columns": {"n_nationkey": {"dtype": "integer"}, "n_name": {"dtype": "string"}, "n_regionkey": {"dtype": "string"}}, "primary_key": ["n_nationkey"]})
    base = _managed(spark)
    base.write(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "t", contract=contract)
    return _cases(spark, base.read("t").dtypes)


def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    base = _sqlite(spark)
    base.write(rows, "t")
    return base.read("t")


def chunked_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _sqlite(spark)
    base.write(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "t", chunksize=7)
    return base.read("t")


def database_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _sqlite(spark)
    base.write(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "t")
    return _sqlite(spark, path=base.params["path"], query="SELECT s_nationkey, count(*) AS n FROM t GROUP BY s_nationkey").read("counted")


# ---------------------------------------------------------------- checks
def load_mode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scd = {"track": ["s_nationkey"]}
    steps = {"upsert without key": {"mode": "upsert"}, "delete without key": {"mode": "delete"}, "scd2 without scd": {"mode": "scd2", "key": "s_suppkey"}, "append with scd": {"mode": "append", "scd": scd}, "append by partition": {"mode": "append", "write": {"partition_by": ["s_nationkey"]}}, "scd2": {"mode": "scd2", "key": "s_suppkey", "scd": scd}}
    load = lambda step: {"put": {"stage": "load", "resource": "src", "steps": [{"input": "out", "collection": "t"} | step]}}
    return _cases(spark, [(name, _outcome(lambda s=step: load_config(_plan(sf_dir, "supplier", [_KEEP], tasks=load(s))))) for name, step in steps.items()])


def operator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that are refused when the plan is made, and one when rows are read."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    steps = {
        "window without column": ("window", {"partition_by": "s_nationkey", "add": {"x": {"fn": "cumsum"}}}),
        "window of unknown function": ("window", {"partition_by": "s_nationkey", "add": {"x": {"fn": "nope"}}}),
        "unknown aggregate": ("group", {"by": "s_nationkey", "agg": {"s_suppkey": "nope"}}),
        "missing column": ("sort", {"nope": "asc"}),
        "unknown action": ("nope", {}),
        "integer overflow": ("derive", {"target": "x", "expr": {"*": [{"+": [{"col": "s_suppkey"}, {"lit": 9_000_000_000_000_000_000}]}, {"lit": 3}]}}),
    }
    return _cases(spark, [(name, _outcome(lambda a=action, w=block: build_transform(a, w).run(rows, None).collect())) for name, (action, block) in steps.items()])


def diff_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, suppliers = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    from .plans import ExecutionContext

    ctx = ExecutionContext(spark=spark)
    ctx.state.set("a", nations.select("n_nationkey", "n_name"))
    ctx.state.set("b", suppliers.select("s_suppkey"))
    ctx.state.set("c", nations.select("n_nationkey", "n_name").unionByName(nations.select("n_nationkey", "n_name")))
    blocks = {"no such key": {"source": "a", "target": "a", "key": "nope"}, "key on one side": {"source": "a", "target": "b", "key": "n_nationkey"}, "unknown emit": {"source": "a", "target": "a", "key": "n_nationkey", "emit": ["nope"]}, "good": {"source": "a", "target": "a", "key": "n_nationkey"}}
    return _cases(spark, [(name, _outcome(lambda b=block: build_transform("compare_diff", b).run(None, ctx).collect())) for name, block in blocks.items()])


def contract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required, further and null columns, a row for each problem."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") != 3, F.col("s_name")).alias("s_name"), "s_nationkey")
    contract = DataframeContract.model_validate({"strict": True, "columns": {"s_suppkey": {"nullable": False}, "s_name": {"nullable": False}, "s_phone": {}, "s_fax": {"required": False}}})
    return spark.createDataFrame([(p,) for p in contract_problems(rows, contract)], "problem string")


def contract_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = DataframeContract.model_validate({"columns": {"n_nationkey": {"checks": [{"<": 5}]}}})
    rows = _table(spark, sf_dir, "nation")
    return _cases(spark, [(mode, _outcome(lambda m=mode: check_contract(rows, contract, m))) for mode in ("strict", "warn", "off")])


def contract_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract that doesn't hold, at each place that takes one."""
    schemas = {"few": {"columns": {"s_nationkey": {"checks": [{"<": 5}]}}}}
    target = {"src": _plan(sf_dir, "supplier", [])["resources"]["src"], "dst": {"adapter": "db", "params": {"engine": "managed", "path": scratch(spark)}}}
    put = {"stage": "load", "resource": "dst", "steps": [{"input": "out", "collection": "t"}]}
    places = {
        "nowhere": {"put": put},
        "extract": {"take": {"steps": [{"output": "supplier", "contract": "few"}]}},
        "input": {"make": {"input_contract": "few"}},
        "output": {"make": {"output_contract": "few"}},
        "output, warned": {"make": {"output_contract": "few", "validate": "warn"}},
        "load": {"put": put | {"steps": [put["steps"][0] | {"input_contract": "few"}]}},
    }
    return _cases(spark, [(name, _outcome(lambda t=tasks: _run(spark, _plan(sf_dir, "supplier", [_KEEP], tasks=t, schemas=schemas, resources=target)))) for name, tasks in places.items()])


# ---------------------------------------------------------------- plugins
@register_transform("only_nation", replace=True)
class _OnlyNation(Transform):
    """A plugin for the catalogue: rows of one nation."""

    nation: int

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        return df.where(F.col("s_nationkey") == self.nation)


@register_expression("thrice", replace=True)
def _thrice(x):
    return x * 3


@register_load_strategy("merge_new", replace=True)
def _merge_new(target: DataFrame | None, r: WriteRequest) -> DataFrame:
    return r.frame.withColumn("__how", F.lit("inserted"))


_HEARD: list[tuple[str, str]] = []


@register_notifier("catalogue_ear", replace=True)
class _Ear:
    def notify(self, event: str, message: str, target: str | None = None) -> None:
        _HEARD.append((event, target or ""))


@register_secret_provider("catalogue_box", replace=True)
class _Box(MappingSecretProvider):
    pass


def plugin_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform and an expression that were registered, with a number from a secret provider."""
    steps = [{"action": "only_nation", "with": {"nation": "${secret:nation}"}}, {"action": "derive", "with": {"target": "x", "expr": {"thrice": [{"col": "s_suppkey"}]}}}, {"action": "select", "with": ["s_suppkey", "x"]}]
    return _run(spark, _plan(sf_dir, "supplier", steps), secret_provider=_Box({"nation": "7"}))


def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Registry("catalogue")
    names.add("a", "b")(int)
    again = lambda **how: names.add("a", **how)(str)
    found = [("two names", str(names.names())), ("again", _outcome(again)), ("unknown", _outcome(lambda: names.get("zzz"))), ("replaced", _outcome(lambda: again(replace=True)))]
    return _cases(spark, found)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missed time limit and a failure, as a notifier hears them."""
    _HEARD.clear()
    channels = {"notifications": {"on_failure": [{"type": "catalogue_ear", "target": "ops"}], "on_sla": [{"type": "catalogue_ear", "target": "late"}]}}
    _run(spark, _plan(sf_dir, "supplier", [_KEEP], orchestration=channels | {"sla": {"max_runtime": "0.001s"}}))
    _outcome(lambda: _run(spark, _plan(sf_dir, "supplier", [{"action": "sort", "with": {"nope": "asc"}}], orchestration=channels)))
    return _cases(spark, _HEARD)


_TRIES: list[int] = []


@register_transform("third_time", replace=True)
class _ThirdTime(Transform):
    """A plugin for the catalogue: fails twice."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        _TRIES.append(1)
        if len(_TRIES) < 3:
            raise WeirflowError("not yet")
        return df


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    _TRIES.clear()
    out = _run(spark, _plan(sf_dir, "supplier", [{"action": "third_time"}, _KEEP], tasks={"make": {"retry": {"attempts": 3, "delay": "0s"}}}))
    return out.withColumn("tries", F.lit(len(_TRIES)).cast("long"))


# ---------------------------------------------------------------- blueprints in files
def _files(sf_dir: str, target: str) -> dict[str, Any]:
    """Two files: one with resources and a template, and one that imports it."""
    plan = _plan(sf_dir, "supplier", [{"action": "filter", "with": {"s_nationkey": {"op": "<", "value": "${param:below}"}}}, {"action": "derive", "with": {"target": "tag", "expr": {"lit": "${var:words.tag}-${env:WEIRFLOW_SURELY_UNSET:-none}"}}}, {"action": "select", "with": ["s_suppkey", "s_nationkey", "tag"]}])
    base = {"resources": plan["resources"] | {"dst": {"adapter": "db", "params": {"engine": "managed", "path": target}}}, "templates": {"taken": {"stage": "extract", "resource": "src"}}, "vars": {"words": {"tag": "low"}}}
    main_ = {"imports": ["base.yaml"], "metadata": plan["metadata"], "parameters": {"below": {"type": "integer", "default": 5}}, "defaults": {"retry": {"attempts": 2}}}
    main_["tasks"] = {"take": {"extends": "taken", "steps": [{"output": "supplier"}]}, "make": plan["tasks"]["make"], "put": {"stage": "load", "resource": "dst", "steps": [{"input": "out", "collection": "t"}]}}
    return {"base.yaml": base, "main.yaml": main_}


def _from_files(spark: SparkSession, sf_dir: str, run: Callable[[Path], Any]) -> DataFrame:
    target = scratch(spark)
    with tempfile.TemporaryDirectory() as folder:  # the driver alone reads blueprints
        for name, document in _files(sf_dir, target).items():
            (Path(folder) / name).write_text(yaml.safe_dump(document))
        run(Path(folder) / "main.yaml")
    return _adapter(spark, "db", engine="managed", path=target).read("t")


def blueprint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, a template, a parameter, variables and an environment default."""
    return _from_files(spark, sf_dir, lambda path: Orchestrator(load_config(path, params={"below": "9"}), spark).run())


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(path: Path) -> None:
        with contextlib.redirect_stdout(io.StringIO()):
            main(["run", str(path), "--param", "below=12"])

    return _from_files(spark, sf_dir, run)


def blueprint_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda steps, **more: _plan(sf_dir, "supplier", steps, **more)
    plans = {
        "good": make([_KEEP]),
        "unknown frame": make([{"action": "join", "with": {"left": "${pipe}", "right": "nope", "on": "s_suppkey"}}]),
        "unknown resource": make([_KEEP], tasks={"take": {"resource": "nope"}}),
        "unknown schema": make([_KEEP], tasks={"make": {"output_contract": "nope"}}),
        "made twice": make([_KEEP], tasks={"again": {"stage": "transform", "input": "supplier", "output": "out", "steps": [_KEEP]}}),
        "unknown token": make([_KEEP], metadata={"id": "${var:nope}"}),
        "bad parameter": make([_KEEP], parameters={"p": {"type": "integer", "default": "x"}}),
        "unknown template": make([_KEEP], tasks={"make": {"extends": "nope"}}),
        "unknown key": make([_KEEP], nope=1),
    }
    return _cases(spark, [(name, _outcome(lambda p=plan: load_config(p))) for name, plan in plans.items()])


_LOW = "SELECT s_suppkey, s_nationkey, 'low-none' AS tag FROM supplier WHERE s_nationkey < {}"

BEHAVIOURS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "permission_gate": (permission_gate, _expected(**{"read: read": "done", "read: write": "PermissionDeniedError", "write: read": "PermissionDeniedError", "write: write": "done", "read+write: read": "done", "read+write: write": "done"})),
    "file_mode_guard": (file_mode_guard, _expected(replace="done", append="done", upsert="AdapterError", delete="AdapterError")),
    "atomic_batch": (atomic_batch, "SELECT s_suppkey, s_nationkey, 'AdapterError' AS tried FROM supplier WHERE s_nationkey < 12"),
    "load_metrics": (
        load_metrics,
        """
        WITH n AS (SELECT count(*) FILTER (s_nationkey < 15) AS low, count(*) FILTER (s_nationkey >= 10) AS high, count(*) FILTER (s_nationkey >= 10 AND s_nationkey < 15) AS shared FROM supplier)
        SELECT 'replace' AS mode, low AS rows_in, low AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted, true AS created FROM n
        UNION ALL SELECT 'upsert', high, high - shared, shared, 0, false FROM n
        UNION ALL SELECT 'delete', low, 0, 0, low, false FROM n
        UNION ALL SELECT 'append', low, low, 0, 0, false FROM n
        """,
    ),
    "contract_types": (contract_types, _expected(n_nationkey="bigint", n_name="string", n_regionkey="string")),
    "nan_to_null": (nan_to_null, "SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_acctbal END AS s_acctbal FROM supplier"),
    "chunked_load": (chunked_load, "SELECT c_custkey, c_mktsegment FROM customer"),
    "database_query": (database_query, "SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS n FROM supplier GROUP BY 1"),
    "load_mode_checks": (load_mode_checks, _expected(**dict.fromkeys(("upsert without key", "delete without key", "scd2 without scd", "append with scd", "append by partition"), "ConfigError"), scd2="done")),
    "operator_errors": (operator_errors, _expected(**dict.fromkeys(("window without column", "window of unknown function", "unknown aggregate", "missing column", "unknown action"), "TransformError"), **{"integer overflow": "ArithmeticException"})),
    "diff_errors": (diff_errors, _expected(**dict.fromkeys(("no such key", "key on one side", "unknown emit"), "TransformError"), good="done")),
    "contract_columns": (
        contract_columns,
        """
        SELECT 'column ''s_phone'' is missing' AS problem
        UNION ALL SELECT 'columns that aren''t in the contract: s_nationkey'
        UNION ALL SELECT 's_name: ' || count(*) || ' nulls' FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0
        """,
    ),
    "contract_modes": (contract_modes, _expected(strict="ContractError", warn="done", off="done")),
    "contract_places": (contract_places, _expected(nowhere="done", extract="ContractError", input="ContractError", output="ContractError", **{"output, warned": "done"}, load="ContractError")),
    "plugin_steps": (plugin_steps, "SELECT s_suppkey, s_suppkey * 3 AS x FROM supplier WHERE s_nationkey = 7"),
    "registry_rules": (registry_rules, "SELECT * FROM (VALUES ('two names', '[''a'', ''b'']'), ('again', 'RegistryError'), ('unknown', 'RegistryError'), ('replaced', 'done')) AS v(name, outcome)"),
    "notices": (notices, _expected(sla="late", failure="ops")),
    "retried": (retried, "SELECT s_suppkey, s_nationkey, CAST(3 AS BIGINT) AS tries FROM supplier"),
    "blueprint_files": (blueprint_files, _LOW.format(9)),
    "command_line": (command_line, _LOW.format(12)),
    "blueprint_problems": (
        blueprint_problems,
        _expected(good="done", **dict.fromkeys(("unknown frame", "unknown resource", "unknown schema", "made twice", "bad parameter", "unknown template", "unknown key"), "ConfigError"), **{"unknown token": "InterpolationError"}),
    ),
}
