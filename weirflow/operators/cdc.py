"""Change data: what differs between a frame and a baseline."""

from __future__ import annotations

from functools import reduce
from typing import Any, ClassVar, Literal

from pydantic import Field, field_validator, model_validator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TransformError
from ..functions.frames import col, hide, ordered, require, visible
from ..registry import register_transform
from .base import Transform, frame_of
from .sets import _names

KINDS = ("insert", "update", "delete", "unchanged")


@register_transform("compare_diff")
class CompareDiff(Transform):
    """Classifies keys as insert, update, delete or unchanged.

    Inserts, updates and unchanged rows carry the source's values, deletes the target's. Nulls
    equal nulls, in keys too. Without columns to compare nothing is an update.
    """

    tier: ClassVar[str] = "collection"
    source: Any
    target: Any
    key: list[str] = Field(min_length=1)
    compare: list[str] | None = None
    ignore: list[str] = Field(default_factory=list)
    change_detection: Literal["exact", "hash"] = "exact"
    emit: list[Literal["insert", "update", "delete", "unchanged"]] = Field(default=["insert", "update", "delete"], min_length=1)
    op_column: str = "_op"
    op_labels: dict[str, str] = Field(default_factory=dict)
    duplicate_keys: Literal["error", "keep_first", "keep_last"] = "error"

    _lists = field_validator("key", "compare", "ignore", mode="before")(_names)

    @model_validator(mode="after")
    def _labels(self) -> CompareDiff:
        unknown = set(self.op_labels) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds in op_labels: {', '.join(sorted(unknown))}")
        return self

    def operands(self) -> list[Any]:
        return [self.source, self.target]

    def needs_order(self) -> bool:
        return self.duplicate_keys != "error"

    def _frames(self, df: DataFrame | None, ctx: Any) -> tuple[DataFrame, DataFrame, list[str]]:
        source, target = frame_of(self.source, df, ctx), frame_of(self.target, df, ctx)
        require(source, self.key, "compare_diff (source)", TransformError)
        require(target, self.key, "compare_diff (target)", TransformError)
        if self.op_column in {*visible(source), *visible(target)}:
            raise TransformError(f"compare_diff: there is a column {self.op_column!r} already")
        common = [c for c in visible(source) if c in visible(target) and c not in self.key]
        if self.compare is not None:
            apart = set(self.compare) - set(common)
            if apart:
                raise TransformError(f"compare_diff: {', '.join(sorted(apart))} aren't in both frames")
            common = self.compare
        return source, target, [c for c in common if c not in self.ignore]

    def verify(self, df: DataFrame | None, ctx: Any = None) -> None:
        source, target, _ = self._frames(df, ctx)
        if self.duplicate_keys == "error":
            for frame, side in ((source, "source"), (target, "target")):
                if frame.groupBy(*map(col, self.key)).count().where("count > 1").limit(1).count():
                    raise TransformError(f"compare_diff: keys of the {side} repeat")

    def _single(self, frame: DataFrame) -> DataFrame:
        if self.duplicate_keys == "error":
            return hide(frame)
        frame = ordered(frame)
        order = F.col("__ord").asc() if self.duplicate_keys == "keep_first" else F.col("__ord").desc()
        ranked = frame.withColumn("__n", F.row_number().over(Window.partitionBy(*map(col, self.key)).orderBy(order)))
        return hide(ranked.where("__n = 1").drop("__n"))

    def apply(self, df: DataFrame | None, ctx: Any = None) -> DataFrame:
        self.verify(df, ctx)
        source, target, compared = self._frames(df, ctx)
        s_names, t_names = visible(source), visible(target)
        s = self._single(source).select(*(col(c).alias(f"s_{k}") for k, c in enumerate(s_names)), F.lit(True).alias("s_is"))
        t = self._single(target).select(*(col(c).alias(f"t_{k}") for k, c in enumerate(t_names)), F.lit(True).alias("t_is"))
        at = lambda c: (F.col(f"s_{s_names.index(c)}"), F.col(f"t_{t_names.index(c)}"))
        on = reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in map(at, self.key)))
        both = s.join(t, on, "full_outer")
        if not compared:
            changed = F.lit(False)
        elif self.change_detection == "hash":
            sides = [F.xxhash64(*(F.coalesce(x.cast("string"), F.lit("\0null")) for x in xs)) for xs in zip(*map(at, compared), strict=True)]
            changed = sides[0] != sides[1]
        else:
            changed = ~reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in map(at, compared)))
        kind = F.when(F.col("t_is").isNull(), 0).when(F.col("s_is").isNull(), 2).when(changed, 1).otherwise(3)
        names = s_names + [c for c in t_names if c not in s_names]
        gone = F.col("s_is").isNull()
        shown = []
        for c in names:
            if c in s_names and c in t_names:
                x, y = at(c)
                shown.append(F.when(gone, y).otherwise(x).alias(c))
            else:
                shown.append((F.col(f"s_{s_names.index(c)}") if c in s_names else F.col(f"t_{t_names.index(c)}")).alias(c))
        text = F.element_at(F.array(*(F.lit(self.op_labels.get(k, k)) for k in KINDS)), F.col("__kind") + 1)
        out = both.withColumn("__kind", kind).where(F.col("__kind").isin(*(KINDS.index(k) for k in self.emit)))
        return out.select(text.alias(self.op_column), *shown)
