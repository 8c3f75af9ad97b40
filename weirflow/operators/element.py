"""Actions that map each row by itself."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..errors import ExpressionError, TransformError
from ..functions import pipe
from ..functions.expression import compile_expression
from ..functions.frames import col, is_number, is_time, require, visible
from ..registry import register_transform
from .base import ColumnMap, Transform


@register_transform("label")
class Label(ColumnMap):
    """Renames columns at once; absent ones are passed over."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        names = [self.columns.get(c, c) for c in df.columns]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise TransformError(f"label: two columns would be called {', '.join(sorted(twice))}")
        return df.select(*(col(c).alias(n) for c, n in zip(df.columns, names, strict=True)))


@register_transform("map")
class MapValues(ColumnMap):
    """Replaces values by a table; others, and nulls, stay."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, list(self.columns), "map", TransformError)
        found = {}
        for name, table in self.columns.items():
            if not isinstance(table, dict):
                raise TransformError(f"map: {name} needs a mapping")
            c, kind = col(name), df.schema[name].dataType
            same = all(isinstance(v, str) for v in table.values()) if isinstance(kind, T.StringType) else all(isinstance(v, int | float) and not isinstance(v, bool) for v in table.values()) and is_number(kind)
            keep = c if same else c.cast("string")
            out = None
            for old, new in table.items():
                hit = c.eqNullSafe(F.lit(old)) if isinstance(kind, T.StringType) == isinstance(old, str) else c.cast("string") == F.lit(str(old))
                value = F.lit(new) if same or new is None else F.lit(str(new))
                out = F.when(hit, value) if out is None else out.when(hit, value)
            found[name] = out.otherwise(keep) if out is not None else c
        return df.withColumns(found)


_FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x"}


def java_regex(pattern: str) -> str:
    """A Python pattern in the dialect of the JVM."""
    if re.search(r"\(\?\(", pattern):
        raise ExpressionError(f"conditional groups aren't supported: {pattern!r}")
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)


def java_swap(swap: str) -> str:
    """A Python replacement in the dialect of the JVM."""
    out, at = [], 0
    for m in re.finditer(r"\\(?:g<(\w+)>|(\d{1,2})|(.))|\$", swap, re.S):
        out.append(swap[at : m.start()])
        if m[1]:
            out.append(f"${m[1]}" if m[1].isdigit() else "${" + m[1].replace("_", "") + "}")
        elif m[2]:
            out.append(f"${m[2]}")
        elif m[0] == "$":
            out.append("\\$")
        else:
            out.append({"n": "\n", "t": "\t", "\\": "\\\\"}.get(m[3], m[3]))
        at = m.end()
    return "".join(out) + swap[at:]


@register_transform("replace")
class Replace(ColumnMap):
    """Regular-expression replacement on the text form; a list of rules goes in order."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, list(self.columns), "replace", TransformError)
        found = {}
        for name, rules in self.columns.items():
            c = col(name).cast("string")
            for rule in rules if isinstance(rules, list) else [rules]:
                if not isinstance(rule, dict) or "regex" not in rule or set(rule) - {"regex", "swap", "flags"}:
                    raise TransformError(f"replace: {name} needs {{regex, swap, flags}}")
                flags = rule.get("flags") or ""
                if set(flags) - set(_FLAGS):
                    raise TransformError(f"replace: unknown flags in {flags!r}")
                pattern = java_regex(rule["regex"])
                pattern = f"(?{''.join(sorted(set(flags)))})" * bool(flags) + pattern
                c = F.regexp_replace(c, F.lit(pattern), F.lit(java_swap(str(rule.get("swap", "")))))
            found[name] = c
        return df.withColumns(found)


# ---------------------------------------------------------------- cast
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy", "dd-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd")
_TARGETS = {
    "integer": "bigint",
    "int": "bigint",
    "bigint": "bigint",
    "float": "double",
    "double": "double",
    "number": "double",
    "string": "string",
    "str": "string",
    "text": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "datetime": "datetime",
    "timestamp": "datetime",
    "category": "category",
}


def _parsed(c: Column, kind: T.DataType, target: str) -> Column:
    """The value in the target type, or null where it can't be had."""
    text = isinstance(kind, T.StringType)
    if target == "bigint":
        if text:
            plain = F.when(c.rlike(_NUMBER), F.trim(F.regexp_replace(c, r"\s", "")))
            real = plain.try_cast("double")
            exact = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint"))
            return F.coalesce(exact, F.when((real == F.floor(real)) & (F.abs(real) < 9.3e18), real.try_cast("bigint")))
        if isinstance(kind, T.BooleanType):
            return c.cast("bigint")
        if isinstance(kind, T.FractionalType):
            return F.when(c == F.floor(c), c.try_cast("bigint"))
        if is_time(kind):
            return (F.unix_micros(c.cast("timestamp")) * 1000).cast("bigint")
        return c.try_cast("bigint")
    if target == "double":
        if text:
            return F.when(c.rlike(_NUMBER) | c.rlike(_INFINITE), F.regexp_replace(c, r"\s", "").try_cast("double"))
        return c.cast("double")
    if target == "boolean":
        if isinstance(kind, T.BooleanType):
            return c
        return F.when(c == 1, True).when(c == 0, False) if is_number(kind) else F.lit(None).cast("boolean")
    if target in ("date", "datetime"):
        if text:
            t = F.trim(c)
            when = F.coalesce(t.try_cast("timestamp_ntz"), *(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in _FORMATS))
            when = F.when(t.rlike(r"\d{4,}|\d[./-]\d"), when)
        elif isinstance(kind, T.IntegralType):
            when = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c / 1_000_000_000).cast("decimal(18,6)"))
        else:
            when = c.cast("timestamp_ntz")
        return F.date_trunc("day", when).cast("timestamp_ntz") if target == "date" else when
    return c.cast("string")


@register_transform("cast")
class Cast(ColumnMap):
    """Types by name. A value that doesn't parse raises, or its row is quarantined.

    Blank texts become null: fine in strict mode, quarantined otherwise. ``date`` is a timestamp
    at midnight; ``category`` is text with a mark in the column's metadata.
    """

    supports_quarantine: ClassVar[bool] = True
    #: only these can divert rows
    lenient: ClassVar[frozenset] = frozenset({"bigint", "double", "date", "datetime"})

    def _plan(self, df: DataFrame) -> list[tuple[str, str, Column, Column]]:
        require(df, list(self.columns), "cast", TransformError)
        out = []
        for name, wanted in self.columns.items():
            if wanted not in _TARGETS:
                raise TransformError(f"cast: unknown type {wanted!r}; known: {', '.join(sorted(_TARGETS))}")
            target, c, kind = _TARGETS[wanted], col(name), df.schema[name].dataType
            if target == "boolean" and not is_number(kind) and not isinstance(kind, T.BooleanType | T.NullType):
                raise TransformError(f"cast: {name} ({kind.simpleString()}) can't become boolean")
            new = _parsed(c, kind, target)
            out.append((name, target, new, new.isNull() & c.isNotNull()))
        return out

    def _with(self, df: DataFrame, found: dict[str, Column]) -> DataFrame:
        out = df.withColumns(found)
        for name, wanted in self.columns.items():
            if _TARGETS[wanted] == "category":
                out = out.withMetadata(name, {"category": True})
        return out

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        found = {}
        for name, target, new, bad in self._plan(df):
            wrong = bad & (F.trim(col(name).cast("string")) != "")
            kind = {"date": "timestamp_ntz", "datetime": "timestamp_ntz", "category": "string"}.get(target, target)
            message = F.concat(F.lit(f"cast: {name} can't become {target}: "), F.coalesce(col(name).cast("string"), F.lit("")))
            found[name] = F.when(wrong, F.raise_error(message).cast(kind)).otherwise(new)
        return self._with(df, found)

    def verify(self, df: DataFrame, ctx: Any = None) -> None:
        plan = self._plan(df)
        row = df.agg(*(F.count_if(bad & (F.trim(col(n).cast("string")) != "")).alias(f"c{k}") for k, (n, _, _, bad) in enumerate(plan))).first()
        wrong = [f"{n}: {row[f'c{k}']}" for k, (n, *_) in enumerate(plan) if row[f"c{k}"]]
        if wrong:
            raise TransformError(f"cast: values that don't parse in {', '.join(wrong)}")

    def apply_safe(self, df: DataFrame, ctx: Any = None) -> tuple[DataFrame, DataFrame]:
        plan = self._plan(df)
        flags = [F.coalesce(bad, F.lit(False)) for _, target, _, bad in plan if target in self.lenient]
        flag = reduce(lambda a, b: a | b, flags, F.lit(False))
        marked = df.withColumn("__bad", flag)
        good = marked.where(~F.col("__bad")).drop("__bad")
        return self._with(good, {name: new for name, _, new, _ in plan}), marked.where("__bad").drop("__bad")


# ---------------------------------------------------------------- text
@register_transform("affix")
class Affix(ColumnMap):
    """Puts text before or after the text form; null stays null."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, list(self.columns), "affix", TransformError)
        found = {}
        for name, spec in self.columns.items():
            if not isinstance(spec, dict) or "text" not in spec or spec.get("position", "suffix") not in ("prefix", "suffix") or set(spec) - {"text", "position"}:
                raise TransformError(f"affix: {name} needs {{text, position: prefix or suffix}}")
            parts = [col(name).cast("string"), F.lit(str(spec["text"]))]
            found[name] = F.concat(*(parts if spec.get("position", "suffix") == "suffix" else parts[::-1]))
        return df.withColumns(found)


_PLAIN = {
    "strip": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
    "lstrip": lambda c: F.regexp_replace(c, r"(?U)^\s+", ""),
    "rstrip": lambda c: F.regexp_replace(c, r"(?U)\s+$", ""),
    "upper": F.upper,
    "lower": F.lower,
}
#: What only Python has.
_PYTHON = {"title": str.title, "casefold": str.casefold, **{n.lower(): partial(unicodedata.normalize, n) for n in ("NFC", "NFKC", "NFD", "NFKD")}}
#: The first code point that a form may change or join with what is before it: texts of lower ones have that form already.
_FIRST = {"nfc": 0x300, "nfd": 0xC0, "nfkc": 0xA0, "nfkd": 0xA0}
#: Bytes of an Arrow batch, at an even length of its texts, that are Python objects at once.
_PIECE_BYTES = 1 << 20


def _in_python(chains: list[list[str]]):
    """An Arrow UDF that takes a column for each chain of operations and gives a struct of them all.

    It holds a batch, but only a piece of it as Python objects and of its result.
    """
    changes = [[_PYTHON[op] for op in ops] for ops in chains]

    def changed(texts: pa.Array, ops: list[Callable[[str], str]]) -> pa.Array:
        return pa.array([None if x is None else reduce(lambda y, op: op(y), ops, x) for x in texts.to_pylist()], texts.type)

    @arrow_udf(T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(chains))]))
    def normalised(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            n = len(columns[0])
            step = max(1, n * _PIECE_BYTES // max(sum(c.nbytes for c in columns), 1))
            for at in range(0, n, step):
                yield pa.StructArray.from_arrays([changed(c.slice(at, step), ops) for c, ops in zip(columns, changes, strict=True)], [f"c{k}" for k in range(len(columns))])

    return normalised


def _open_to(c: Column, ops: list[str]) -> Column:
    """The text if the operations may change it, else null: it needn't go to Python."""
    if not _FIRST.keys() >= set(ops):
        return c
    return F.when(c.rlike(rf"[^\x00-\x{{{min(map(_FIRST.get, ops)) - 1:X}}}]"), c)


@register_transform("normalize")
class Normalize(ColumnMap):
    """Text operations in order. What needs Python is done for all columns by one UDF, as far as their orders allow."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, list(self.columns), "normalize", TransformError)
        found, left = {}, {}
        for name, ops in self.columns.items():
            found[name], left[name] = col(name).cast("string"), list(ops) if isinstance(ops, list) else [ops]
            for op in left[name]:
                if op not in _PLAIN and op not in _PYTHON:
                    raise TransformError(f"normalize: unknown operation {op!r}; known: {', '.join(sorted({*_PLAIN, *_PYTHON}))}")
        while any(left.values()):
            chains: dict[str, list[str]] = {}
            for name, ops in left.items():
                while ops and ops[0] in _PLAIN:
                    found[name] = _PLAIN[ops.pop(0)](found[name])
                while ops and ops[0] in _PYTHON:
                    chains.setdefault(name, []).append(ops.pop(0))
            if chains:
                out = _in_python(list(chains.values()))(*(_open_to(found[name], ops) for name, ops in chains.items()))
                found |= {name: F.coalesce(out[f"c{k}"], found[name]) for k, name in enumerate(chains)}
        return df.withColumns(found)


# ---------------------------------------------------------------- values
@register_transform("derive")
class Derive(Transform):
    """Adds or overwrites a column by an expression."""

    target: str
    expr: Any

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        return df.withColumn(self.target, compile_expression(df, self.expr))


@register_transform("fillna")
class FillNa(ColumnMap):
    """Fills nulls with a constant or a reduced column; an absent column is made of it."""

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        found = {}
        for name, value in self.columns.items():
            if value is None:
                raise TransformError(f"fillna: {name} can't be filled with null")
            other = pipe.operand(df, value)
            if isinstance(other, DataFrame):
                raise TransformError(f"fillna: {name} needs a single value")
            fill = F.lit(value) if other is None else other
            if name not in visible(df):
                found[name] = fill
                continue
            kind = df.schema[name].dataType
            whole = isinstance(kind, T.IntegralType)
            if whole and (isinstance(value, float) and not value.is_integer() or other is not None):
                found[name] = F.coalesce(col(name).cast("double"), fill.cast("double"))
            elif is_number(kind) and isinstance(value, str) and other is None:
                raise TransformError(f"fillna: {name} ({kind.simpleString()}) can't be filled with {value!r}")
            else:
                found[name] = F.coalesce(col(name), fill.cast(kind))
        return df.withColumns(found)
