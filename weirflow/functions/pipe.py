"""``${pipe:column}`` and ``${pipe:column|reducer}``: the flowing frame inside operands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExpressionError
from .frames import ORDER, col, ordered, require

TOKENS = frozenset({"${pipe}", "$pipe"})
_REFERENCE = re.compile(r"\$\{pipe:([^|}]+?)(?:\|([^}]+))?\}")
LISTS = frozenset({"unique", "set", "list", "values"})


def is_pipe(value: object) -> bool:
    return isinstance(value, str) and value in TOKENS


def parse(value: object) -> tuple[str, str | None] | None:
    """(column, reducer) of a reference, or None."""
    found = _REFERENCE.fullmatch(value) if isinstance(value, str) else None
    return (found[1].strip(), found[2].strip() if found[2] else None) if found else None


_SCALARS = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "median": F.median,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "count": F.count,
    "nunique": F.count_distinct,
}


def scalar(df: DataFrame, column: str, reducer: str) -> Column:
    """A reduced value as a scalar subquery, so it is computed once and in the same job.

    ``first`` and ``last`` are positional, and don't skip nulls.
    """
    require(df, [column], "pipe reference")
    if reducer in ("first", "last"):
        df = ordered(df)
        pick = F.min_by if reducer == "first" else F.max_by
        return df.select(pick(F.struct(col(column).alias("v")), F.col(ORDER))["v"].alias("v")).scalar()
    if reducer not in _SCALARS:
        raise ExpressionError(f"unknown reducer {reducer!r}; known: {', '.join(sorted({*_SCALARS, *LISTS, 'first', 'last'}))}")
    return df.select(_SCALARS[reducer](col(column)).alias("v")).scalar()


def values(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of a column as a frame, for membership tests."""
    require(df, [column], "pipe reference")
    return df.select(col(column).alias("v")).where("v is not null").distinct()


def operand(df: DataFrame, value: object) -> Column | DataFrame | None:
    """A column, a scalar, a frame of values for a list reducer, or None for anything else."""
    found = parse(value)
    if not found:
        return None
    name, reducer = found
    if reducer is None:
        require(df, [name], "pipe reference")
        return col(name)
    return values(df, name) if reducer in LISTS else scalar(df, name, reducer)
