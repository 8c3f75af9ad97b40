"""Window columns over a whole frame, without gathering it in one task.

Rows are sorted into ranges. Each range is numbered and totalled by itself, the totals (a row for
each range) are added up on the driver, and every row gets what the ranges before its own come to.
"""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import col

_AT, _RANGE, _BITS = "__at", "__range", 33  # the bits of a running id that count within a partition
_FOLD = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min}
_TWO = {"cumsum": lambda a, b: a + b, "cummax": max, "cummin": min}
_BOTH = {"cumsum": lambda a, b: a + b, "cummax": F.greatest, "cummin": F.least}


def _before(totals: list, folds: dict[str, str]) -> list[tuple]:
    """For each range the count and the folds of the ranges before it; None where there are none."""
    rows, n, kept = [], 0, dict.fromkeys(folds)
    for t in totals:
        rows.append((t[_RANGE], n, *kept.values()))
        n += t["__n"]
        for k, fn in folds.items():
            if t[k] is not None:
                kept[k] = t[k] if kept[k] is None else _TWO[fn](kept[k], t[k])
    return rows


def over_all(df: DataFrame, order: list[Column], add: dict[str, tuple[str, str | None]], ctx: Any = None) -> DataFrame:
    """``df`` with row_number, cumcount, cumsum, cummax and cummin columns in the given order.

    ``order`` must tell all rows apart. The sorted rows are kept for the two readings of them, in
    the context's care if there is one.
    """
    sorted_ = df.orderBy(*order).withColumn(_AT, F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    if ctx is not None:
        ctx.persisted.append(sorted_)
    ranged = sorted_.withColumn(_RANGE, F.shiftright(_AT, _BITS))
    folds = {f"__f{k}": (fn, c) for k, (fn, c) in enumerate(add.values()) if fn in _FOLD}
    summed = ranged.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n"), *(_FOLD[fn](col(c)).alias(f) for f, (fn, c) in folds.items()))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in summed.schema])
    before = _before(sorted(summed.collect(), key=lambda r: r[_RANGE]), {f: fn for f, (fn, _) in folds.items()})
    joined = ranged.join(F.broadcast(df.sparkSession.createDataFrame(before, schema)), _RANGE, "left")
    inside = Window.partitionBy(_RANGE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    found = {}
    for k, (name, (fn, column)) in enumerate(add.items()):
        if fn in ("row_number", "cumcount"):
            at = F.col("__n") + F.col(_AT).bitwiseAND(F.lit((1 << _BITS) - 1))
            found[name] = at + 1 if fn == "row_number" else at
        else:
            own = _FOLD[fn](col(column)).over(inside)
            rest = F.col(f"__f{k}")
            found[name] = F.when(col(column).isNotNull(), F.when(rest.isNull(), own).otherwise(_BOTH[fn](own, rest)))
    return joined.withColumns(found).drop(_AT, _RANGE, "__n", *folds)


def ranks_over_all(df: DataFrame, column: str, add: dict[str, str], ctx: Any = None) -> DataFrame:
    """``df`` with rank or dense_rank columns of a column's values: the distinct values are ranked
    by their counts, and joined to the rows."""
    values = df.where(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = over_all(values, [F.col("__v").asc()], {"__upto": ("cumsum", "__c"), "__dense": ("row_number", None)}, ctx)
    out = df.join(ranked, col(column) == F.col("__v"), "left")
    shown = {"rank": F.col("__upto") - F.col("__c") + 1, "dense_rank": F.col("__dense")}
    return out.withColumns({name: shown[fn].cast("double") for name, fn in add.items()}).drop("__v", "__c", "__upto", "__dense")
