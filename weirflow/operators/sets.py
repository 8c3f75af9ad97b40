"""Actions over a whole frame."""

from __future__ import annotations

from typing import Any, ClassVar, Literal

from pydantic import Field, field_validator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TransformError
from ..functions.aggregates import ALIASES, ORDERED, aggregate
from ..functions.frames import ORDER, col, ordered, require, visible
from ..functions.predicate import compile_predicate
from ..registry import register_transform
from .base import Transform
from .running import over_all, ranks_over_all


def _names(value: Any) -> Any:
    return [value] if isinstance(value, str) else value


@register_transform("filter")
class Filter(Transform):
    """Keeps the rows for which a predicate tree is true."""

    tier: ClassVar[str] = "set"
    root: Any

    @classmethod
    def from_block(cls, block: Any) -> Transform:
        return cls(root=block["root"] if isinstance(block, dict) and set(block) == {"root"} and isinstance(block["root"], dict) else block)

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        return df.where(compile_predicate(df, self.root))


class _Projection(Transform):
    tier: ClassVar[str] = "set"
    columns: list[str] = Field(min_length=1)

    @field_validator("columns")
    @classmethod
    def _once(cls, names: list[str]) -> list[str]:
        if len(set(names)) < len(names):
            raise ValueError("a column is listed twice")
        return names


@register_transform("select")
class Select(_Projection):
    """Columns in the given order; missing ones are errors unless ``ignore_missing``."""

    ignore_missing: bool = False

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        if not self.ignore_missing:
            require(df, self.columns, "select", TransformError)
        kept = [c for c in self.columns if c in visible(df)]
        if not kept:
            raise TransformError("select: none of the columns is there")
        return df.select(*map(col, kept), *([ORDER] if ORDER in df.columns else []))


@register_transform("drop")
class Drop(_Projection):
    """The other columns; missing ones are passed over unless ``ignore_missing`` is false."""

    ignore_missing: bool = True

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        if not self.ignore_missing:
            require(df, self.columns, "drop", TransformError)
        return df.select(*(col(c) for c in df.columns if c not in self.columns or c == ORDER))


@register_transform("sort")
class Sort(Transform):
    """Sorts; nulls come last in both directions. Ties keep their order where rows are numbered,
    which is so if a step of the blueprint depends on it."""

    tier: ClassVar[str] = "set"
    by: dict[str, Literal["asc", "desc"]] = Field(min_length=1)

    @classmethod
    def from_block(cls, block: Any) -> Transform:
        if isinstance(block, dict) and set(block) == {"by"} and isinstance(block["by"], dict):
            return cls.model_validate(block)
        if isinstance(block, dict):
            return cls.model_validate({"by": block})
        return cls.model_validate({"by": dict.fromkeys(_names(block) or [], "asc")})

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, list(self.by), "sort", TransformError)
        keys = [col(c).asc_nulls_last() if way == "asc" else col(c).desc_nulls_last() for c, way in self.by.items()]
        if ORDER not in df.columns:
            return df.orderBy(*keys)
        # later steps see the new order
        return df.orderBy(*keys, ORDER).withColumn(ORDER, F.monotonically_increasing_id())


def _order_columns(spec: dict[str, str] | None) -> list:
    return [col(c).asc_nulls_last() if way == "asc" else col(c).desc_nulls_last() for c, way in (spec or {}).items()]


@register_transform("dedupe")
class Dedupe(Transform):
    """Keeps the first or last row of each key, or (``keep: false``) only rows whose key is single.

    Nulls are equal. ``order_by`` says what first means; else it is the row order.
    """

    tier: ClassVar[str] = "set"
    on: list[str] | None = None
    keep: Literal["first", "last", False] = "first"
    order_by: dict[str, Literal["asc", "desc"]] | None = None

    _one = field_validator("on", mode="before")(_names)

    @classmethod
    def from_block(cls, block: Any) -> Transform:
        return cls.model_validate(block if isinstance(block, dict) else {"on": block or None})

    def needs_order(self) -> bool:
        return self.on is not None and self.keep is not False and not self.order_by

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, [*(self.on or []), *(self.order_by or {})], "dedupe", TransformError)
        names = self.on or visible(df)
        if self.keep is False:  # counted before rows are dealt, so a frequent key isn't gathered
            whole = F.struct(*map(col, df.columns))
            single = df.groupBy(*(col(c).alias(f"__k{k}") for k, c in enumerate(names))).agg(F.count(F.lit(1)).alias("__n"), F.first(whole).alias("__row"))
            return single.where("__n = 1").select("__row.*")
        if self.on is None:
            return df.dropDuplicates(names)
        had = ORDER in df.columns
        df = df if self.order_by else ordered(df)
        order = _order_columns(self.order_by) or [F.col(ORDER).asc()]
        if self.keep == "last":
            order = [col(c).asc_nulls_first() if way == "desc" else col(c).desc_nulls_first() for c, way in self.order_by.items()] if self.order_by else [F.col(ORDER).desc()]
        w = Window.partitionBy(*map(col, names)).orderBy(*order)
        out = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        return out if had or ORDER not in out.columns else out.drop(ORDER)


@register_transform("group")
class Group(Transform):
    """One aggregate for each listed column, which keeps its name; null keys are a group.

    A key that is aggregated too needs another name, and is an error here.
    """

    tier: ClassVar[str] = "set"
    by: list[str] = Field(min_length=1)
    agg: dict[str, str] = Field(min_length=1)

    _one = field_validator("by", mode="before")(_names)

    def needs_order(self) -> bool:
        return any(ALIASES.get(f, f) in ORDERED for f in self.agg.values())

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, [*self.by, *self.agg], "group", TransformError)
        both = set(self.by) & set(self.agg)
        if both:
            raise TransformError(f"group: {', '.join(sorted(both))} can't be a key and be aggregated")
        had = ORDER in df.columns
        if self.needs_order():
            df = ordered(df)
        parts = [aggregate(fn, col(c), df.schema[c].dataType).alias(c) for c, fn in self.agg.items()]
        return df.groupBy(*map(col, self.by)).agg(*parts, *([F.min(ORDER).alias(ORDER)] if had else []))


_RUNNING = frozenset({"row_number", "cumcount", "cumsum", "cummax", "cummin"})
_RANKS = frozenset({"rank", "dense_rank"})


@register_transform("window")
class WindowColumns(Transform):
    """Columns over partitions: row_number, cumcount, rank, dense_rank, cumsum, cummax, cummin.

    rank and dense_rank rank the column's values and ignore ``order_by``; running functions skip
    nulls, which stay null. Rows that a later step takes in order go by ``order_by`` from here on;
    else the result is sorted only if ``sort`` is set, as that costs another shuffle.
    """

    tier: ClassVar[str] = "set"
    partition_by: list[str] = Field(default_factory=list)
    order_by: dict[str, Literal["asc", "desc"]] | None = None
    add: dict[str, dict[str, str]] = Field(min_length=1)
    sort: bool = False

    _one = field_validator("partition_by", mode="before")(_names)

    def needs_order(self) -> bool:
        return any(spec.get("fn") not in ("rank", "dense_rank") for spec in self.add.values())

    def apply(self, df: DataFrame, ctx: Any = None) -> DataFrame:
        require(df, [*self.partition_by, *(self.order_by or {})], "window", TransformError)
        had = ORDER in df.columns
        df = ordered(df)
        for name, spec in self.add.items():
            if set(spec) - {"fn", "column"}:
                raise TransformError(f"window: {name} takes fn and column")
            fn, column = spec.get("fn"), spec.get("column")
            if fn not in _RUNNING | _RANKS:
                raise TransformError(f"window: unknown function {fn!r}")
            if fn not in ("row_number", "cumcount"):
                if not column:
                    raise TransformError(f"window: {fn} needs a column")
                require(df, [column], "window", TransformError)
        out = self._within(df) if self.partition_by else self._over_all(df, ctx)
        if self.order_by and (self.sort or had):
            out = out.orderBy(*_order_columns(self.order_by), ORDER)
        if self.order_by and had:
            out = out.withColumn(ORDER, F.monotonically_increasing_id())
        return out if had else out.drop(ORDER)

    def _within(self, df: DataFrame) -> DataFrame:
        base = Window.partitionBy(*map(col, self.partition_by))
        w = base.orderBy(*_order_columns(self.order_by), ORDER)
        found = {}
        for name, spec in self.add.items():
            fn, c = spec["fn"], col(spec["column"]) if spec.get("column") else None
            if fn in ("row_number", "cumcount"):
                found[name] = F.row_number().over(w).cast("long") - int(fn == "cumcount")
            elif fn in _RANKS:
                ranked = (F.rank() if fn == "rank" else F.dense_rank()).over(base.orderBy(c.asc_nulls_last()))
                found[name] = F.when(c.isNotNull(), ranked).cast("double")
            else:
                total = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min}[fn](c).over(w.rowsBetween(Window.unboundedPreceding, 0))
                found[name] = F.when(c.isNotNull(), total)
        return df.withColumns(found)

    def _over_all(self, df: DataFrame, ctx: Any) -> DataFrame:
        """Without partitions no task may hold all rows: ranges of them are taken by themselves."""
        names = [*df.columns, *self.add]
        running = {n: (s["fn"], s.get("column")) for n, s in self.add.items() if s["fn"] in _RUNNING}
        out = df.drop(*(n for n in self.add if n in df.columns and all(n != s.get("column") for s in self.add.values())))
        if running:
            out = over_all(out, [*_order_columns(self.order_by), F.col(ORDER)], running, ctx)
        for column in dict.fromkeys(s["column"] for s in self.add.values() if s["fn"] in _RANKS):
            out = ranks_over_all(out, column, {n: s["fn"] for n, s in self.add.items() if s["fn"] in _RANKS and s["column"] == column}, ctx)
        return out.select(*map(col, dict.fromkeys(names)))
