"""Aggregate functions by name. Sums of nothing are 0, first and last skip nulls in row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TransformError
from .frames import ORDER


def _first(c: Column, kind: T.DataType) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), F.col(ORDER)))


def _last(c: Column, kind: T.DataType) -> Column:
    return F.max_by(c, F.when(c.isNotNull(), F.col(ORDER)))


def _sum(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        c = c.cast("int")
    return F.coalesce(F.sum(c), F.lit(0))


AGGREGATES = {
    "sum": _sum,
    "prod": lambda c, k: F.coalesce(F.product(c), F.lit(1.0)),
    "mean": lambda c, k: F.avg(c),
    "count": lambda c, k: F.count(c),
    "size": lambda c, k: F.count(F.lit(1)),
    "min": lambda c, k: F.min(c),
    "max": lambda c, k: F.max(c),
    "median": lambda c, k: F.median(c),
    "std": lambda c, k: F.stddev_samp(c),
    "var": lambda c, k: F.var_samp(c),
    "sem": lambda c, k: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "skew": lambda c, k: F.when(F.count(c) >= 3, F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / F.nullif(F.count(c) - 2, F.lit(0))),
    "nunique": lambda c, k: F.count_distinct(c),
    "first": _first,
    "last": _last,
    "any": lambda c, k: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
    "all": lambda c, k: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
}
ALIASES = {"avg": "mean", "average": "mean", "stddev": "std", "variance": "var", "count_distinct": "nunique", "quantile": "median"}
ORDERED = frozenset({"first", "last"})
_NUMERIC = frozenset({"prod", "mean", "median", "std", "var", "sem", "skew"})


def aggregate(name: str, column: Column, kind: T.DataType) -> Column:
    name = ALIASES.get(name, name)
    if name not in AGGREGATES:
        raise TransformError(f"unknown aggregate {name!r}; known: {', '.join(sorted(AGGREGATES))}")
    if name in _NUMERIC | {"sum"} and not isinstance(kind, T.NumericType | T.BooleanType):
        raise TransformError(f"{name} can't take {kind.simpleString()}")
    return AGGREGATES[name](column, kind)
