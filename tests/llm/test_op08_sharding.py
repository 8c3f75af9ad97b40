import itertools
import zlib

import numpy as np
import pytest

from weirflow.llm import sharding

DATA = "/root/testdata"


def test_differencing_by_hand():
    """8, 7, 6, 5, 4 in two: differences leave 16 against 14."""
    parts = np.array([[w, 0] for w in (8, 7, 6, 5, 4)])
    sums, places = sharding.differencing(parts)
    assert sums.tolist() == [16, 14]
    got = [sum(w for w, p in zip((8, 7, 6, 5, 4), places, strict=True) if p[0] == s) for s in (0, 1)]
    assert got == [16, 14]


@pytest.mark.parametrize("shards", [2, 3, 5])
def test_places_make_the_sums(shards):
    rng = np.random.default_rng(shards)
    parts = np.zeros((60, shards), np.int64)
    parts[:, 0] = rng.integers(1, 1000, 60)
    parts[::7] = rng.integers(0, 50, (len(parts[::7]), shards))
    sums, places = sharding.differencing(parts)
    made = np.zeros(shards, np.int64)
    for part, place in zip(parts, places, strict=True):
        assert sorted(place) == list(range(shards))
        made[place] += part
    assert made.tolist() == sums.tolist() and sums[0] - sums[-1] <= 40
    greedy = np.zeros(shards, np.int64)
    for w in sorted(parts.sum(1), reverse=True):
        greedy[greedy.argmin()] += w
    assert sharding.differencing(np.zeros((0, shards), np.int64))[0].tolist() == [0] * shards


def test_small_cells_are_combined(spark):
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 500, 700).tolist()
    df = spark.createDataFrame([(f"k{k}", w) for k, w in enumerate(weights)], "key string, weight long").repartition(5)
    out = {r["key"]: r["shard"] for r in sharding.partition(df, 6, cell=40).collect()}
    sums = np.bincount(list(out.values()), [weights[int(k[1:])] for k in out], 6)
    assert len(out) == 700 and sums.max() - sums.min() < 60


def check(out, rows):
    by_id = dict(rows)
    for r in out.itertuples():
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.grown_shard.isna().all() and out.shard.between(0, 23).all()
    texts = {}
    for r in out.itertuples():
        assert texts.setdefault(by_id[r.doc_id], r.shard) == r.shard


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    out = sharding.op8_sharding(spark, f"{DATA}/sf0.01").toPandas()
    check(out, rows)
    sums, groups = out.groupby("shard")["size"].sum(), out.groupby("text_crc32")["size"].sum()
    assert len(out) == len(rows) and sums.max() - sums.min() <= max(64, 2 * max(0, groups.max() - out["size"].sum() / 24) + 64)


def test_edge_rows(docs):
    df = docs((1, None), (2, None), (3, ""), (4, ""), (5, "é" * 50_000), *((k, "same") for k in range(6, 40)), clash=("shard", "key", "size"))
    out = sharding.shard_by_bytes(df).toPandas()
    check(out, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert set(out[out.doc_id <= 4]["size"]) == {8}
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_repeated_rows(docs):
    out = sharding.shard_by_bytes(docs((1, "a"), (1, "a"), (None, "a"), (2, "b")), shards=2, lanes=3).toPandas()
    assert len(out) == 4
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert [len(g) for _, g in itertools.islice(out.groupby("shard"), 2)] in ([3, 1], [1, 3])


def test_rows_and_files_of_shards(spark, docs, tmp_path):
    """Shards hold the rows themselves, all columns and null texts too, and are written as files."""
    df = docs((1, None), (2, ""), (3, "é" * 900), (None, "same"), *((k, "same") for k in range(6, 30)), clash=("shard", "key", "size"))
    sharding.write_shards(sharding.shard_rows(df, shards=3, lanes=2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} <= {f"shard={k}" for k in range(3)}
    whole = back.select("row.*")
    assert whole.columns == df.columns and sorted(map(repr, whole.collect())) == sorted(map(repr, df.collect()))
    digests = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df, shards=3, lanes=2).collect()}
    assert digests == {(r["row"]["doc_id"], r["shard"], r["slot"]) for r in back.collect()}
