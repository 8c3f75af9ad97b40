"""Balanced shards by Karmarkar-Karp differencing.

Rows with equal texts form indivisible groups. Groups are dealt into cells of bounded size; in a
cell, partial partitions (at first one group in one of the shards) are combined, those with the
largest spread first, oppositely ordered, until one is left. The partitions that cells leave are
combined in the same way, level by level, so no task sees more than a cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines n partial partitions of s sums each.

    Returns the sums of the s shards, falling, and for each part and each of its places the shard
    it ends in. Ties in spread go to the part that came first.
    """
    n, s = parts.shape
    if not n:
        return np.zeros(s, np.int64), np.zeros((0, s), np.int64)
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, axis=1)
    # node: places of its members in its own falling order; links make the tree of combinations
    heap = [(-int(v[0] - v[-1]), k) for k, v in enumerate(sums)]
    heapq.heapify(heap)
    vectors = list(sums)
    children: list[tuple[int, np.ndarray, int, np.ndarray] | None] = [None] * n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vectors[a] + vectors[b][::-1]
        by = np.argsort(-total, kind="stable")
        to = np.empty(s, np.int64)
        to[by] = np.arange(s)  # place before -> place after
        vectors.append(total[by])
        vectors[a] = vectors[b] = None
        children.append((a, to, b, to[::-1]))
        heapq.heappush(heap, (-int(vectors[-1][0] - vectors[-1][-1]), len(vectors) - 1))
    place: list[np.ndarray | None] = [None] * len(vectors)
    place[-1] = np.arange(s)
    for k in range(len(vectors) - 1, n - 1, -1):
        a, to_a, b, to_b = children[k]
        place[a], place[b] = place[k][to_a], place[k][to_b]
        place[k] = None
    out = np.empty((n, s), np.int64)
    for k in range(n):
        out[k, order[k]] = place[k]
    return vectors[-1], out


def _level(frame: DataFrame, shards: int, cell: int, key: str) -> tuple[DataFrame, DataFrame]:
    """One level: (parent, sums) of the cells and (key, parent, places) of their members."""
    n = max(1, -(-frame.count() // cell))

    def run(parent: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        sums, places = differencing(np.array(pdf["sums"].tolist(), np.int64).reshape(len(pdf), -1))
        out = pd.DataFrame({key: pdf[key].tolist(), "parent": int(parent[0]), "places": list(places)})
        out.loc[len(out)] = [None, int(parent[0]), sums]
        return out

    kind = frame.schema[key].dataType.simpleString()
    parent = F.pmod(F.xxhash64(F.col(key)), F.lit(n)) if n > 1 else F.lit(0).cast("long")
    done = materialise(frame.select(key, "sums").withColumn("__p", parent).groupBy("__p").applyInPandas(run, f"{key} {kind}, parent long, places array<long>"), "cells")
    return done.where(F.col(key).isNull()).select("parent", F.col("places").alias("sums")), done.where(F.col(key).isNotNull())


def partition(groups: DataFrame, shards: int, *, key: str = "key", weight: str = "weight", cell: int = 4096) -> DataFrame:
    """key, shard for each row of ``groups`` (one row a key, none null); sums differ little.

    Tasks hold ``cell`` parts at most (in expectation). Empty input gives no row.
    """
    first = F.array(F.col(weight).cast("long"), *[F.lit(0).cast("long")] * (shards - 1))
    top, members = _level(groups.select(key, first.alias("sums")), shards, cell, key)
    out = members.select(key, F.col("parent").alias("__c"), F.col("places")[0].alias("shard"))
    while True:
        cells = top.count()
        if cells <= 1:
            return out.select(key, F.col("shard").cast("int").alias("shard"))
        top = top.withColumnRenamed("parent", "__c")
        top, members = _level(top, shards, cell, "__c")
        step = members.select("__c", F.col("parent").alias("__up"), F.col("places").alias("__to"))
        out = out.join(step, "__c").select(key, F.col("__up").alias("__c"), F.element_at("__to", (F.col("shard") + 1).cast("int")).alias("shard"))


def shard_rows(docs: DataFrame, *, shards: int = 24, overhead: int = 8, lanes: int | None = None) -> DataFrame:
    """row (all columns of ``docs``), shard, slot of each row; equal texts share a shard.

    A row counts for its text's UTF-8 bytes plus ``overhead``; null texts have none, and are one
    group. Slots run from 0 in each shard without a gap: rows are dealt into lanes by a hash of
    their number, ranked within (lane, shard), and lifted by the counts of the lanes before, so a
    shard is never sorted as a whole. Only numbers and keys are dealt until then.
    """
    spark = docs.sparkSession
    lanes = lanes or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            F.struct("*").alias("row"),
            F.when(F.col("text").isNull(), "null").otherwise(F.md5(F.encode(text, "utf-8"))).alias("key"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    placed = partition(groups, shards)
    lane = F.pmod(F.xxhash64("__row"), F.lit(lanes))
    dealt = materialise(rows.select("key", F.col("row.doc_id").alias("doc_id"), "__row").join(placed, "key").withColumn("__lane", lane), "dealt")
    counts = dealt.groupBy("shard", "__lane").agg(F.count(F.lit(1)).alias("n"))
    before = counts.alias("a").selectExpr("shard", "__lane", "coalesce(sum(n) over (partition by shard order by __lane rows between unbounded preceding and 1 preceding), 0) as __base")
    rank = "row_number() over (partition by __lane, shard order by doc_id, __row)"
    ranked = dealt.selectExpr("__row", "shard", "__lane", f"{rank} - 1 as __at")
    out = ranked.join(before, ["shard", "__lane"]).select("__row", "shard", (F.col("__base") + F.col("__at")).cast("long").alias("slot"))
    return rows.select("row", "__row").join(out, "__row").select("row", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes what ``shard_rows`` gives as Parquet files in a folder ``shard=N`` for each shard."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_by_bytes(docs: DataFrame, *, shards: int = 24, overhead: int = 8, lanes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the rows that ``shard_rows`` gives."""
    text = F.coalesce("row.text", F.lit(""))
    size, crc = (F.octet_length(text) + overhead).cast("long"), F.crc32(F.encode(text, "utf-8"))
    out = shard_rows(docs, shards=shards, overhead=overhead, lanes=lanes)
    return out.select("row.doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 with near-equal bytes.

    Null texts count 8 bytes and are one group; repeated rows and ids are dealt each; equal spreads
    go by key, equal ids by their place; an empty table gives no row; columns may have any name.
    """
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
