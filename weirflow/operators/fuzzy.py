"""Joins on similar texts."""

from __future__ import annotations

from typing import Any, ClassVar, Literal

import numpy as np
import pandas as pd
from pydantic import Field, field_validator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..errors import TransformError
from ..functions.frames import ORDER, col, ordered, require, visible
from ..registry import register_transform
from .base import Transform, frame_of
from .collection import joined


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of the table held in one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); two empty texts are alike."""
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


@pandas_udf(DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((similarity(x, y) for x, y in zip(a, b, strict=True)), float, len(a)))


def _numbered(parts) -> list[str]:
    """The k-th occurrence of a part is a name of its own."""
    seen: dict[str, int] = {}
    out = []
    for x in parts:
        seen[x] = seen.get(x, 0) + 1
        out.append(f"{x}{seen[x]}")
    return out


@pandas_udf(ArrayType(StringType()))
def _pairs(s: pd.Series) -> pd.Series:
    """Pairs of neighbouring characters, numbered."""
    return s.map(lambda text: _numbered(map(str.__add__, text, text[1:])))


@pandas_udf(ArrayType(StringType()))
def _single(s: pd.Series) -> pd.Series:
    """Characters, numbered."""
    return s.map(_numbered)


def _characters(c: Column) -> Column:
    return F.array_distinct(F.split(c, ""))


def least_shared(c: Column, t: float) -> Column:
    """How many character pairs a text shares with any text that is alike by ``t``, at least.

    With a common subsequence of s of a and b characters, each character that one text has alone
    breaks two of its pairs or parts one of the other's, so 3s - a - b - 1 pairs are left; s is
    t * (a + b) / 2 or more, and the other text is no shorter than t / (2 - t) of this one.
    """
    a = F.length(c)
    b = F.ceil(a * (t / (2 - t)) - 1e-9)
    return F.ceil((1.5 * t - 1) * (a + b) - 1 - 1e-9)


@register_transform("fuzzy_join")
class FuzzyJoin(Transform):
    """Joins each left key with the right key most like it, from ``threshold`` up.

    Distinct keys are matched, not rows; of equal scores the first right key wins. Unmatched left
    rows match nothing. Texts that are alike share character pairs, so keys meet by their rarest
    ones; where a text is too short (or the threshold too low) for that, by their rarest characters
    within bands of lengths.
    Bounds on lengths and common characters then prune before any text is scored.
    """

    tier: ClassVar[str] = "collection"
    order_sensitive: ClassVar[bool] = True
    left: Any = "${pipe}"
    right: Any
    left_on: str
    right_on: str
    how: Literal["left", "inner"] = "left"
    threshold: float = Field(default=0.85, gt=0, le=1)
    suffixes: tuple[str, str] = ("_x", "_y")

    @field_validator("left_on", "right_on", mode="before")
    @classmethod
    def _single(cls, value: Any) -> Any:
        return value[0] if isinstance(value, list) and len(value) == 1 else value

    def operands(self) -> list[Any]:
        return [self.left, self.right]

    def bridge(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(a, b, score): the best right key of each left key that has one."""
        t = self.threshold
        a = left.select(col(self.left_on).cast("string").alias("a")).where("a is not null").distinct()
        b = ordered(right).select(col(self.right_on).cast("string").alias("b"), ORDER).where("b is not null").groupBy("b").agg(F.min(ORDER).alias("o"))
        la, lb = F.length("a"), F.length("b")
        alike = 2 * F.least(la, lb) >= t * (la + lb) - 1e-9
        long_a, long_b = least_shared(F.col("a"), t) >= 1, least_shared(F.col("b"), t) >= 1
        near = self._by_characters(a.where(~long_a), b).unionByName(self._by_characters(a.where(long_a), b.where(~long_b))).where(alike).distinct()
        if t > 2 / 3:
            near = near.unionByName(self._by_pairs(a.where(long_a), b.where(long_b)).where(alike).distinct())
        # common characters, counted once each, plus what can repeat, bound the subsequence
        shared = F.array_intersect(_characters(F.col("a")), _characters(F.col("b")))
        kept = F.length(F.call_function("translate", F.col("a"), F.array_join(shared, ""), F.lit("")))
        near = near.where(2 * (la - kept) >= t * (la + lb) - 1e-9)
        scored = near.withColumn("score", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(_score("a", "b"))).where(F.col("score") >= t - 1e-12)
        best = Window.partitionBy("a").orderBy(F.desc("score"), "o")
        return scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("a", "b", "score")

    def _by_characters(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of keys that share one of their rarest characters, and whose lengths are in the same
        or in neighbouring bands (these grow so that keys that are alike are one apart at most).

        A common subsequence of s of a and b characters has s >= t * (a + b) / 2, and b is no shorter
        than t / (2 - t) of a: so a shares t / (2 - t) of its characters at least.
        """
        t = self.threshold
        width = float(np.log(max((2 - t) / t, 1.0001)))
        band = F.floor(F.log(F.length("key") + F.lit(1.0)) / width)
        need = F.greatest(F.ceil(F.length("key") * (t / (2 - t)) - 1e-9), F.lit(1))
        first = self._rarest(a, b, _single, F.length("key") - need + 1)
        bands = F.when(F.col("left"), F.array(band)).otherwise(F.array(band - 1, band, band + 1))
        near = self._met(first.withColumn("band", F.explode(bands)), "pair", "band")
        empty = a.where("a = ''").join(b.where("b = ''"), F.col("a") == F.col("b")).select("a", "b", "o")
        return near.unionByName(empty)

    @staticmethod
    def _met(first: DataFrame, *keys: str) -> DataFrame:
        left = first.where("left").select(F.col("key").alias("a"), *keys)
        return left.join(first.where("not left").select(F.col("key").alias("b"), "o", *keys), list(keys)).select("a", "b", "o")

    @staticmethod
    def _rarest(a: DataFrame, b: DataFrame, parts, how_many: Column) -> DataFrame:
        """(left, key, o, pair): of each key's parts the ``how_many`` rarest."""
        each = a.select(F.lit(True).alias("left"), F.col("a").alias("key"), F.lit(None).cast("bigint").alias("o")).unionByName(b.select(F.lit(False).alias("left"), F.col("b").alias("key"), "o"))
        named = each.withColumn("pair", F.explode(parts("key")))
        often = named.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        sorted_ = F.sort_array(F.collect_list(F.struct("n", "pair")))["pair"]
        first = named.join(often, "pair").groupBy("left", "key", "o").agg(sorted_.alias("pairs"))
        return first.withColumn("pair", F.explode(F.slice("pairs", F.lit(1), how_many.cast("int")))).drop("pairs")

    def _by_pairs(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of keys that share one of their rarest character pairs. A key that must share n of
        its p pairs shares one of the first p - n + 1 in any order; the rarest come first."""
        return self._met(self._rarest(a, b, _pairs, F.length("key") - least_shared(F.col("key"), self.threshold)), "pair")

    def apply(self, df: DataFrame | None, ctx: Any = None) -> DataFrame:
        left, right = frame_of(self.left, df, ctx), frame_of(self.right, df, ctx)
        require(left, [self.left_on], "fuzzy_join (left)", TransformError)
        require(right, [self.right_on], "fuzzy_join (right)", TransformError)
        if "__match" in {*visible(left), *visible(right)}:
            raise TransformError("fuzzy_join: a column may not be called __match")
        pairs = self.bridge(left, right)
        marked = left.withColumn("__key", col(self.left_on).cast("string")).join(pairs.select(F.col("a").alias("__key"), F.col("b").alias("__match")), "__key", "left").drop("__key")
        target = right.withColumn("__match", col(self.right_on).cast("string"))
        out = joined(marked, target, self.how, ["__match"], ["__match"], self.suffixes, shared=True, null_keys=False)
        return out.drop("__match")
