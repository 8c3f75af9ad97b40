"""Declared schemas and constraints of frames, and soft assertions."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ContractError, ExpectationError
from ..functions.frames import col, is_time, visible
from ..functions.predicate import _literal, coerce

log = logging.getLogger("weirflow")


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", populate_by_name=True)


class ColumnRule(_Strict):
    dtype: str | None = None
    nullable: bool = True
    unique: bool = False
    allowed: list[Any] | None = None
    checks: list[dict[str, Any]] = Field(default_factory=list)
    description: str | None = None
    required: bool = True


class DataframeContract(_Strict):
    name: str | None = None
    columns: dict[str, ColumnRule] = Field(default_factory=dict)
    primary_key: list[str] = Field(default_factory=list)
    foreign_keys: dict[str, str] = Field(default_factory=dict)
    strict: bool = False
    description: str | None = None


_FAMILIES: dict[str, Callable[[T.StructField], bool]] = {
    "integer": lambda f: isinstance(f.dataType, T.IntegralType),
    "float": lambda f: isinstance(f.dataType, T.DoubleType | T.FloatType),
    "number": lambda f: isinstance(f.dataType, T.NumericType),
    "string": lambda f: isinstance(f.dataType, T.StringType),
    "boolean": lambda f: isinstance(f.dataType, T.BooleanType),
    "date": lambda f: is_time(f.dataType),
    "category": lambda f: isinstance(f.dataType, T.StringType) and bool(f.metadata.get("category")),
}
_SAME = {"int": "integer", "bigint": "integer", "double": "float", "numeric": "number", "str": "string", "text": "string", "bool": "boolean", "datetime": "date", "timestamp": "date"}

_CHECKS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def _schema_problems(df: DataFrame, contract: DataframeContract) -> list[str]:
    names, out = visible(df), []
    for name, rule in contract.columns.items():
        if name not in names:
            if rule.required:
                out.append(f"column {name!r} is missing")
            continue
        if rule.dtype:
            family = _SAME.get(rule.dtype, rule.dtype)
            if family not in _FAMILIES:
                out.append(f"{name}: unknown dtype {rule.dtype!r}")
            elif not _FAMILIES[family](df.schema[name]):
                out.append(f"{name}: is {df.schema[name].dataType.simpleString()}, not {rule.dtype}")
    if contract.strict:
        extra = [n for n in names if n not in contract.columns]
        if extra:
            out.append(f"columns that aren't in the contract: {', '.join(extra)}")
    out += [f"primary key column {n!r} is missing" for n in contract.primary_key if n not in names]
    return out


def _measures(df: DataFrame, contract: DataframeContract) -> dict[str, tuple[Column, str]]:
    """Counts that must be 0, with what they mean."""
    names, out = visible(df), {}
    for name, rule in contract.columns.items():
        if name not in names:
            continue
        c, kind = col(name), df.schema[name].dataType
        if not rule.nullable:
            out[f"n{len(out)}"] = F.count_if(c.isNull()), f"{name}: {{}} nulls"
        if rule.allowed is not None:
            good = c.isin(*(_literal(coerce(v, kind), kind) for v in rule.allowed)) if rule.allowed else F.lit(False)
            out[f"n{len(out)}"] = F.count_if(c.isNotNull() & ~F.coalesce(good, F.lit(False))), f"{name}: {{}} values that aren't allowed"
        for check in rule.checks:
            for op, value in check.items():
                if op in _CHECKS:
                    bad = ~_CHECKS[op](c, _literal(coerce(value, kind), kind))
                    out[f"n{len(out)}"] = F.count_if(bad), f"{name}: {{}} values against {op} {value}"
    keys = contract.primary_key
    if keys and all(k in names for k in keys):
        some = F.lit(False)
        for k in keys:
            some = some | col(k).isNull()
        out[f"n{len(out)}"] = F.count_if(some), f"primary key {', '.join(keys)}: {{}} rows with nulls"
    return out


def _repeats(df: DataFrame, contract: DataframeContract) -> list[tuple[DataFrame, str]]:
    """Frames of one row, the number of repeated keys, with what it means. Each rule counts its own
    keys, map-side first; distinct counts in one aggregate would multiply the rows by the rules."""
    names, found = visible(df), []
    for name, rule in contract.columns.items():
        if rule.unique and name in names:
            found.append(([name], df.where(col(name).isNotNull()), f"{name}: {{}} repeated values"))
    keys = contract.primary_key
    if keys and all(k in names for k in keys):
        found.append((keys, df, f"primary key {', '.join(keys)}: {{}} repeated rows"))
    counted = lambda keys, frame: frame.groupBy(*(col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg((F.count(F.lit(1)) - 1).alias("n"))
    return [(counted(keys, frame).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), text) for keys, frame, text in found]


def contract_problems(df: DataFrame, contract: DataframeContract, lookup: Callable[[str], DataFrame | None] | None = None) -> list[str]:
    """All that is wrong with a frame. ``lookup`` gives the frames that foreign keys name."""
    out = _schema_problems(df, contract)
    out += [f"{name}: unknown check {op!r}" for name, rule in contract.columns.items() for check in rule.checks for op in check if op not in _CHECKS]
    measures = _measures(df, contract)
    if measures:
        row = df.agg(*(m.alias(k) for k, (m, _) in measures.items())).first()
        out += [text.format(row[k]) for k, (_, text) in measures.items() if row[k]]
    repeats = _repeats(df, contract)
    if repeats:
        found = reduce(lambda a, b: a.unionByName(b), (frame.withColumn("rule", F.lit(k)) for k, (frame, _) in enumerate(repeats)))
        times = {r["rule"]: r["n"] for r in found.collect()}  # a row for each rule
        out += [text.format(times[k]) for k, (_, text) in enumerate(repeats) if times[k]]
    for name, reference in contract.foreign_keys.items():
        frame_name, _, other = reference.rpartition(".")
        frame = lookup(frame_name) if lookup else None
        if frame is None or name not in visible(df):
            continue
        if other not in visible(frame):
            out.append(f"foreign key {name}: {reference} doesn't exist")
            continue
        keys = frame.select(col(other).alias("__k")).where("__k is not null").distinct()
        orphans = df.where(col(name).isNotNull()).join(keys, col(name) == F.col("__k"), "left_anti").count()
        if orphans:
            out.append(f"foreign key {name}: {orphans} rows without {reference}")
    return out


def check_contract(df: DataFrame, contract: DataframeContract, mode: str = "strict", lookup: Callable | None = None, name: str | None = None) -> None:
    """Raises (strict), logs (warn) or skips (off) a broken contract."""
    if mode == "off":
        return
    problems = contract_problems(df, contract, lookup)
    if problems:
        message = f"contract {name or contract.name or ''}: " + "; ".join(problems)
        if mode == "strict":
            raise ContractError(message)
        log.warning(message)


class Assertion(_Strict):
    column: str | None = None
    row_count: dict[str, int] | None = None
    not_null: bool | None = None
    unique: bool | None = None
    min: Any = None
    max: Any = None
    allowed: list[Any] | None = None
    null_rate_below: float | None = None


class Expectation(_Strict):
    name: str | None = None
    assertion: Assertion = Field(alias="assert")
    on_failure: Literal["warn", "fail"] = "fail"
    description: str | None = None


def _expected(df: DataFrame, a: Assertion) -> list[tuple[Column, Callable[[Any, int], str | None]]]:
    """(measure, judge) of an assertion; a judge gets the measure and the row count."""
    out: list = []
    if a.row_count:
        for op, value in a.row_count.items():
            if op not in _COMPARE:
                raise ExpectationError(f"unknown comparison {op!r}")
            out.append((F.count(F.lit(1)), lambda v, n, op=op, value=value: None if _COMPARE[op](n, value) else f"{n} rows, not {op} {value}"))
    if a.column is None:
        return out
    if a.column not in visible(df):
        raise ExpectationError(f"no column {a.column!r}")
    c, kind = col(a.column), df.schema[a.column].dataType
    lit = lambda v: _literal(coerce(v, kind), kind)
    if a.not_null:
        out.append((F.count_if(c.isNull()), lambda v, n: f"{v} nulls" if v else None))
    if a.unique:
        out.append((F.count(c) - F.count_distinct(c), lambda v, n: f"{v} repeated values" if v else None))
    if a.min is not None:
        out.append((F.count_if(c < lit(a.min)), lambda v, n: f"{v} values under {a.min}" if v else None))
    if a.max is not None:
        out.append((F.count_if(c > lit(a.max)), lambda v, n: f"{v} values over {a.max}" if v else None))
    if a.allowed is not None:
        out.append((F.count_if(c.isNotNull() & ~F.coalesce(c.isin(*map(lit, a.allowed)), F.lit(False))), lambda v, n: f"{v} values that aren't allowed" if v else None))
    if a.null_rate_below is not None:
        out.append((F.count_if(c.isNull()), lambda v, n: None if (v / n if n else 0.0) < a.null_rate_below else f"null rate {v / n if n else 0.0:.4f}, not below {a.null_rate_below}"))
    return out


def check_expectations(df: DataFrame, expectations: list[Expectation]) -> list[str]:
    """Judges all expectations by one job; a failed one raises or is logged. Returns the warnings."""
    plans = [(e, _expected(df, e.assertion)) for e in expectations]
    measures = [m for _, parts in plans for m, _ in parts]
    if not measures:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"), *(m.alias(f"m{k}") for k, m in enumerate(measures))).first()
    at, warned = 0, []
    for e, parts in plans:
        found = []
        for _, judge in parts:
            found.append(judge(row[f"m{at}"], row["n"]))
            at += 1
        wrong = next((f for f in found if f), None)
        if wrong:
            message = f"expectation {e.name or e.assertion.column or ''}: {wrong}"
            if e.on_failure == "fail":
                raise ExpectationError(message)
            log.warning(message)
            warned.append(message)
    return warned
