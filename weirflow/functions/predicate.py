"""Predicate trees compiled to boolean columns.

A comparison with a null operand is false, ``!=`` with one is true. In a filter's positive places
the bare comparison keeps the same rows, and Parquet can use it; only below NOT it is wrapped.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError
from . import pipe
from .frames import col, is_number, is_time, require

_COMPARE = {
    "==": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
_TEXT = {"contains": "contains", "startswith": "startswith", "endswith": "endswith"}
OPS = frozenset({*_COMPARE, *_TEXT, "!=", "in", "not_in", "between", "isnull", "notnull"})


def coerce(value: Any, kind: T.DataType) -> Any:
    """A text literal as the column's number or time if it parses, else as it is."""
    if isinstance(value, str):
        if is_number(kind):
            try:
                return int(value) if value.strip().lstrip("+-").isdigit() else float(value)
            except ValueError:
                return value
        if is_time(kind):
            try:
                return datetime.fromisoformat(value.strip().replace("Z", "+00:00")).replace(tzinfo=None)
            except ValueError:
                return value
    return value


def _fits(value: Any, kind: T.DataType) -> bool:
    """Whether a literal can equal a value of the column's type."""
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if is_number(kind):
        return isinstance(value, int | float | Decimal)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool | int)
    if is_time(kind):
        return isinstance(value, date | datetime)
    return True


def _literal(value: Any, kind: T.DataType) -> Column:
    if is_time(kind) and isinstance(value, date | datetime):
        return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()).cast("timestamp_ntz" if not isinstance(kind, T.TimestampType) else "timestamp")
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        return F.lit(bool(value)) if value in (0, 1) else F.lit(None).cast("boolean")
    return F.lit(value)


class Predicate:
    """Compiles trees against a frame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def compile(self, node: Any, negated: bool = False) -> Column:
        """``negated``: the column is used below a NOT, so it may not be null."""
        if not isinstance(node, dict) or len(node) != 1:
            raise ExpressionError(f"a predicate has one key, AND, OR, NOT or a column: {node!r}")
        ((key, body),) = node.items()
        if key in ("AND", "OR"):
            if not isinstance(body, list):
                raise ExpressionError(f"{key} takes a list")
            parts = [self.compile(x, negated) for x in body]
            out = F.lit(key == "AND")
            for k, part in enumerate(parts):
                out = part if not k else (out & part if key == "AND" else out | part)
            return out
        if key == "NOT":
            return ~self.compile(body, True)
        return self._leaf(key, body, negated)

    def _leaf(self, name: str, body: Any, negated: bool) -> Column:
        if not isinstance(body, dict) or "op" not in body or set(body) - {"op", "value"}:
            raise ExpressionError(f"{name}: a condition is {{op, value}}, not {body!r}")
        require(self.df, [name], "predicate")
        op, value = body["op"], body.get("value")
        if op not in OPS:
            raise ExpressionError(f"unknown operator {op!r}; known: {', '.join(sorted(OPS))}")
        c, kind = col(name), self.df.schema[name].dataType
        whole = (lambda x: F.coalesce(x, F.lit(False))) if negated else (lambda x: x)
        if op == "isnull":
            return c.isNull()
        if op == "notnull":
            return c.isNotNull()
        if op in ("in", "not_in"):
            found = self._members(c, kind, value, op, negated or op == "not_in")
            return ~found if op == "not_in" else found
        if op == "between":
            if not isinstance(value, list | tuple) or len(value) != 2:
                raise ExpressionError(f"{name}: between takes two values")
            low, high = (self._side(name, kind, v, ">=") for v in value)
            return whole((c >= low) & (c <= high))
        if op in _TEXT:
            if not isinstance(value, str) or pipe.parse(value):
                raise ExpressionError(f"{name}: {op} takes a plain text")
            return whole(getattr(c.cast("string"), _TEXT[op])(F.lit(value)))
        other = self._side(name, kind, value, op)
        if other is None:  # a literal that can't equal any value of the column
            return F.lit(op == "!=")
        if op == "!=":
            return ~c.eqNullSafe(other) if value is not None else F.lit(True)
        return whole(_COMPARE[op](c, other))

    def _side(self, name: str, kind: T.DataType, value: Any, op: str) -> Column | None:
        found = pipe.operand(self.df, value)
        if isinstance(found, DataFrame):
            raise ExpressionError(f"{name}: a list can't be compared with {op}")
        if found is not None:
            return found
        if value is None:
            return F.lit(None).cast(kind)
        value = coerce(value, kind)
        if not _fits(value, kind):
            if op in ("==", "!="):
                return None
            raise ExpressionError(f"{name} ({kind.simpleString()}) can't be ordered against {value!r}")
        return _literal(value, kind)

    def _members(self, c: Column, kind: T.DataType, value: Any, op: str, negated: bool) -> Column:
        found = pipe.operand(self.df, value)
        if isinstance(found, DataFrame):
            inside = c.isin(found)
            return F.coalesce(inside, F.lit(False)) if negated else inside
        if found is not None or not isinstance(value, list | tuple):
            raise ExpressionError(f"{op} takes a list")
        plain, out = [], None
        for v in value:
            each = pipe.operand(self.df, v)
            if isinstance(each, DataFrame):
                raise ExpressionError("a list reducer can't be a list's element")
            if each is not None:
                out = c == each if out is None else out | (c == each)
            elif v is not None and _fits(v, kind):
                plain.append(_literal(v, kind))
        if plain:
            out = c.isin(*plain) if out is None else out | c.isin(*plain)
        if out is None:
            return F.lit(False)
        return F.coalesce(out, F.lit(False)) if negated else out


def compile_predicate(df: DataFrame, tree: Any) -> Column:
    return Predicate(df).compile(tree)
