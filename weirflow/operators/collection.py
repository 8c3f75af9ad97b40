"""Actions over several frames."""

from __future__ import annotations

from functools import reduce
from typing import Any, ClassVar, Literal

from pydantic import Field, field_validator, model_validator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TransformError
from ..functions.frames import ORDER, col, hide, is_number, is_time, require, visible
from ..registry import register_transform
from .base import Transform, frame_of
from .sets import _names


def joined(left: DataFrame, right: DataFrame, how: str, left_on: list[str], right_on: list[str], suffixes: tuple[str, str], shared: bool, null_keys: bool = True) -> DataFrame:
    """Equi-join in the manner of a merge.

    ``shared``: the keys have one name on both sides and come out once. Null keys match null keys
    unless ``null_keys`` is false. Columns of both sides that collide get suffixes; the left
    frame's come first.
    """
    keys = set(left_on) if shared else set()
    l_names, r_names = visible(left), [c for c in visible(right) if c not in keys]
    both = {c for c in l_names if c not in keys} & set(r_names)
    left_cols = [(c, c + suffixes[0] if c in both else c) for c in l_names]
    right_cols = [(c, c + suffixes[1] if c in both else c) for c in r_names]
    final = [n for _, n in left_cols] + [n for _, n in right_cols]
    twice = {n for n in final if final.count(n) > 1}
    if twice:
        raise TransformError(f"join: columns {', '.join(sorted(twice))} collide; choose other suffixes")
    a = left.select(*(col(c).alias(f"l_{k}") for k, (c, _) in enumerate(left_cols)), *([F.col(ORDER).alias("l_ord")] if ORDER in left.columns else []))
    b = hide(right)
    b = b.select(*(col(c).alias(f"r_{k}") for k, (c, _) in enumerate(right_cols)), *(col(c).alias(f"k_{k}") for k, c in enumerate(right_on)))
    index = {c: f"l_{k}" for k, (c, _) in enumerate(left_cols)}
    if how == "cross":
        out = a.crossJoin(b)
    else:
        sides = []
        for k, (x, y) in enumerate(zip(left_on, right_on, strict=True)):
            kinds = left.schema[x].dataType, right.schema[y].dataType
            if _family(kinds[0]) != _family(kinds[1]):
                raise TransformError(f"join: {x} ({kinds[0].simpleString()}) and {y} ({kinds[1].simpleString()}) have different kinds")
            p, q = F.col(index[x]), F.col(f"k_{k}")
            sides.append(p.eqNullSafe(q) if null_keys else p == q)
        out = a.join(b, reduce(lambda p, q: p & q, sides), {"outer": "full_outer"}.get(how, how))
    shown: list[Column] = []
    for k, (c, name) in enumerate(left_cols):
        if shared and c in keys and how in ("right", "outer"):
            at = left_on.index(c)
            shown.append((F.col(f"k_{at}") if how == "right" else F.coalesce(F.col(f"l_{k}"), F.col(f"k_{at}"))).alias(name))
        else:
            shown.append(F.col(f"l_{k}").alias(name))
    shown += [F.col(f"r_{k}").alias(name) for k, (_, name) in enumerate(right_cols)]
    if "l_ord" in out.columns:
        shown.append(F.coalesce(F.col("l_ord"), F.lit((1 << 63) - 1)).alias(ORDER))
    return out.select(*shown)


def _family(kind: T.DataType) -> str:
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return "number"
    return "time" if is_time(kind) else kind.typeName()


@register_transform("join", "merge")
class Join(Transform):
    """Joins two frames; without keys on all common columns. ``how`` defaults to left."""

    tier: ClassVar[str] = "collection"
    left: Any
    right: Any
    how: Literal["inner", "left", "right", "outer", "cross"] = "left"
    on: list[str] | None = None
    left_on: list[str] | None = None
    right_on: list[str] | None = None
    suffixes: tuple[str, str] = ("_x", "_y")
    relationship: Literal["1:1", "1:m", "m:1", "m:m"] | None = None

    _lists = field_validator("on", "left_on", "right_on", mode="before")(_names)

    @model_validator(mode="after")
    def _keys(self) -> Join:
        if self.on and (self.left_on or self.right_on):
            raise ValueError("give either on, or left_on and right_on")
        if bool(self.left_on) != bool(self.right_on) or len(self.left_on or []) != len(self.right_on or []):
            raise ValueError("left_on and right_on go together, with as many columns")
        if self.how == "cross" and (self.on or self.left_on):
            raise ValueError("a cross join has no keys")
        return self

    def operands(self) -> list[Any]:
        return [self.left, self.right]

    def _resolved(self, df: DataFrame | None, ctx: Any) -> tuple[DataFrame, DataFrame, list[str], list[str], bool]:
        left, right = frame_of(self.left, df, ctx), frame_of(self.right, df, ctx)
        if self.how == "cross":
            return left, right, [], [], False
        if self.left_on:
            require(left, self.left_on, "join (left)", TransformError)
            require(right, self.right_on, "join (right)", TransformError)
            return left, right, self.left_on, self.right_on, self.left_on == self.right_on
        on = self.on or [c for c in visible(left) if c in visible(right)]
        if not on:
            raise TransformError("join: there are no common columns")
        require(left, on, "join (left)", TransformError)
        require(right, on, "join (right)", TransformError)
        return left, right, on, on, True

    def verify(self, df: DataFrame | None, ctx: Any = None) -> None:
        """The relationship, by looking for a repeated key on the sides that may have none."""
        left, right, left_on, right_on, _ = self._resolved(df, ctx)
        one = {"1:1": (True, True), "1:m": (True, False), "m:1": (False, True)}.get(self.relationship, (False, False))
        for unique, frame, keys, side in zip(one, (left, right), (left_on, right_on), ("left", "right"), strict=True):
            if unique and keys and frame.groupBy(*map(col, keys)).count().where("count > 1").limit(1).count():
                raise TransformError(f"join: keys of the {side} frame repeat, against {self.relationship}")

    def apply(self, df: DataFrame | None, ctx: Any = None) -> DataFrame:
        if self.relationship not in (None, "m:m"):
            self.verify(df, ctx)
        left, right, left_on, right_on, shared = self._resolved(df, ctx)
        return joined(left, right, self.how, left_on, right_on, self.suffixes, shared)


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _common_decimal(kinds: list[T.DataType]) -> T.DecimalType | None:
    """The decimal that holds all values of integers and decimals, if there is one."""
    scale = max(getattr(k, "scale", 0) for k in kinds)
    whole = max(k.precision - k.scale if isinstance(k, T.DecimalType) else _DIGITS[type(k)] for k in kinds)
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None


def aligned(frames: list[DataFrame], names: list[str]) -> list[DataFrame]:
    """The frames with columns of common types: numbers widen, other mixtures become text."""
    kinds: dict[str, T.DataType | None] = {}
    for name in names:
        found = [f.schema[name].dataType for f in frames if name in f.columns]
        found = [k for k in found if not isinstance(k, T.NullType)] or found
        if all(k == found[0] for k in found):
            kinds[name] = found[0]
        elif all(isinstance(k, T.IntegralType) for k in found):
            kinds[name] = T.LongType()
        elif all(isinstance(k, T.IntegralType | T.DecimalType) for k in found) and (exact := _common_decimal(found)):
            kinds[name] = exact
        elif all(is_number(k) for k in found):
            kinds[name] = T.DoubleType()
        elif all(is_time(k) for k in found):
            kinds[name] = T.TimestampNTZType()
        else:
            kinds[name] = T.StringType()
    return [f.select(*((col(n).cast(kinds[n]) if f.schema[n].dataType != kinds[n] else col(n)).alias(n) if n in f.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names), *([ORDER] if ORDER in f.columns else [])) for f in frames]


@register_transform("union", "concat", "append")
class Union(Transform):
    """Stacks frames by column name; outer fills with nulls, inner keeps the common columns."""

    tier: ClassVar[str] = "collection"
    frames: list[Any] = Field(min_length=1)
    columns: Literal["outer", "inner"] = "outer"
    dedupe: bool = False
    ignore_index: bool = True

    def operands(self) -> list[Any]:
        return self.frames

    def apply(self, df: DataFrame | None, ctx: Any = None) -> DataFrame:
        frames = [frame_of(f, df, ctx) for f in self.frames]
        names = list(dict.fromkeys(c for f in frames for c in visible(f)))
        if self.columns == "inner":
            names = [c for c in visible(frames[0]) if all(c in visible(f) for f in frames)]
            if not names:
                raise TransformError("union: there are no common columns")
        stacked = aligned(frames, names)
        if any(ORDER in f.columns for f in stacked):  # the frames in turn
            stacked = [f.withColumn(ORDER, (F.col(ORDER) if ORDER in f.columns else F.monotonically_increasing_id()) % F.lit(1 << 52) + F.lit(k << 52)) for k, f in enumerate(stacked)]
        out = reduce(lambda a, b: a.unionByName(b), stacked)
        return out.dropDuplicates(names) if self.dedupe else out
