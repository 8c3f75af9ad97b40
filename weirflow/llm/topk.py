"""Exact top-k inner-product search by distributed histogram selection.

Rows are packed into strips and queries into blocks. A grid of cells, each of some strips and some
blocks, scores every query against every row, and histograms of the scores, refined again and again
around the bin that holds the kth value, locate each query's kth score exactly. A last pass keeps
the scores above it, and of those equal to it the smallest ids. Intervals and counts stay in
tables: the number of jobs depends on how far scores can lie apart, not on rows or queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, frugal, materialise

_EXACT = 2**53
_LOW, _HIGH = -(2**63), 2**63 - 1
#: Bytes of the float64 components of a cell's rows, and of its queries.
CELL_BYTES = 16 << 20


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components floor(256 * x), and length (-1: takes no part) and start of each row's vector."""
    n = len(column)
    offs = column.offsets.to_numpy()
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(256.0 * flat)
    bad = ~np.isfinite(flat)
    if values.null_count:
        bad |= values.is_null().to_numpy(zero_copy_only=False)
    count = np.concatenate([[0], np.cumsum(bad)])
    wrong = (count[offs[1:]] - count[offs[:-1]]) > 0
    if column.null_count:
        wrong |= column.is_null().to_numpy(zero_copy_only=False)
    return flat, np.where(wrong, -1, np.diff(offs)) if n else np.zeros(0, np.int64), offs


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, quantised vectors) for each vector length of a batch of (id, vector)."""
    ids = batch.column(0)
    known = np.ones(len(ids), bool) if not ids.null_count else ~ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    flat, size, offs = _vectors(batch.column(1))
    for dim in np.unique(size[(size > 0) & known]):
        at = np.flatnonzero((size == dim) & known)
        yield numbers[at], flat[offs[at][:, None] + np.arange(dim)]


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: as floats where these are exact, else as int64, where what is beyond
    its range takes its ends."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if bound < _EXACT:
        return queries @ rows.T
    whole = np.array([[int(v) for v in r] for r in queries], object) @ np.array([[int(v) for v in r] for r in rows], object).T
    return np.minimum(np.maximum(whole, _LOW), _HIGH).astype(np.int64)


def _own(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a query and a row of the same id."""
    some = np.flatnonzero(np.isin(ids, rows))
    at, col = np.nonzero(ids[some][:, None] == rows[None, :])
    return some[at], col


# ---------------------------------------------------------------- strips and blocks
def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    most = np.abs(matrix).max(initial=0)
    return matrix.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


_PACKED = "uid long, d int, n int, most double, ids binary, kind string, vectors binary"


def _packed(frame: DataFrame, size: int) -> DataFrame:
    """At most ``size`` vectors of one length a row, gathered within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def put(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal uid
            ids, matrix = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            at = 0
            while len(ids) - at >= least and at < len(ids):
                part = _narrow(matrix[at : at + size])
                row = uid, dim, len(part), float(np.abs(part.astype(np.float64)).max()), ids[at : at + size].astype(np.int64).tobytes(), part.dtype.str, part.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.string(), pa.binary()), strict=True)], names=[c.split(" ")[0] for c in _PACKED.split(", ")])
                uid, at = uid + 1, at + size
            waiting[dim] = [(ids[at:], matrix[at:])]

        for batch in batches:
            for ids, matrix in _matrices(batch):
                lot = waiting.setdefault(matrix.shape[1], [])
                lot.append((ids, matrix))
                if sum(len(i) for i, _ in lot) >= size:
                    yield from put(matrix.shape[1], size)
        for dim in list(waiting):
            yield from put(dim, 1)

    return frame.mapInArrow(frugal(run), _PACKED)


def _opened(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as float64) of the rows of ``_packed``."""
    for d, ids, kind, vectors in zip(*(table.column(c).to_pylist() for c in ("d", "ids", "kind", "vectors")), strict=True):
        yield np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, d).astype(np.float64)


_STATE = "block long, d int, low binary, high binary, need binary, live long"


def _state_row(block: int, d: int, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> list:
    return [[block], [d], [low.tobytes()], [high.tobytes()], [need.tobytes()], [int(((low < high) & (need > 0)).sum())]]


def _state_schema() -> pa.Schema:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.schema([(c.split(" ")[0], k) for c, k in zip(_STATE.split(", "), kinds, strict=True)])


def _first_state(blocks: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Intervals that hold every score of a query: components are bounded by the rows' greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for block, d, most, (_, m) in zip(*(table.column(c).to_pylist() for c in ("uid", "d", "all_most")), _opened(table), strict=True):
                bound = np.abs(m).sum(1) * most * (1 + 1e-9) + 1
                high = np.where(bound < 2.0**62, np.minimum(bound, 2.0**62).astype(np.int64), _HIGH)
                low = np.where(high == _HIGH, _LOW, -high)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(_state_row(block, d, low, high, np.full(len(m), k, np.int64)), _state_schema(), strict=True)], schema=_state_schema())

    return blocks.join(totals, "d").select("uid", "d", "ids", "kind", "vectors", "all_most").mapInArrow(frugal(run), _STATE)


def _span(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.view(U64) - low.view(U64)


def _next_state(key: tuple, counted: pa.Table, before: pa.Table, bins: int) -> pa.Table:
    """The bins that hold the kth values of a block, as intervals."""
    d = before.column("d")[0].as_py()
    low, high, need = (np.frombuffer(before.column(c)[0].as_py(), np.int64).copy() for c in ("low", "high", "need"))
    q, bin_, n = (counted.column(c).to_numpy() for c in ("q", "bin", "n"))
    by = np.lexsort((-bin_, q))
    q, bin_, n = q[by], bin_[by].astype(U64), n[by]
    total = np.bincount(q, n, len(low)).astype(np.int64)
    open_ = (low < high) & (need > 0)
    need = np.where(open_, np.minimum(need, total), need)
    start = np.concatenate([[0], np.cumsum(n)])
    first = np.searchsorted(q, q)
    upto = start[1:] - start[first]
    hit = np.flatnonzero((upto >= need[q]) & (upto - n < need[q]))
    q, bin_ = q[hit], bin_[hit]
    need[q] -= (upto - n)[hit]
    width = _span(low, high)[q] // U64(bins) + U64(1)
    rest = np.minimum(width - U64(1), _span(low, high)[q] - bin_ * width)
    base = low[q].view(U64) + bin_ * width
    low[q], high[q] = base.view(np.int64), (base + rest).view(np.int64)
    return pa.table([pa.array(v, f.type) for v, f in zip(_state_row(key[0].as_py(), d, low, high, need), _state_schema(), strict=True)], schema=_state_schema())


# ---------------------------------------------------------------- cells
def _grid(strips: DataFrame, asked: DataFrame, shape: DataFrame, work, schema: str) -> DataFrame:
    """``work(strips, blocks)`` for each cell of the grid. ``shape``: for each vector length the
    number of lots of strips (r) and of blocks (c); a strip goes to c cells and a block to r."""
    several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lot = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    keys = ["d", "__r", "__c"]
    across = strips.join(shape, "d").withColumn("__r", lot("r")).withColumn("__c", several("c")).select(*keys, "ids", "kind", "vectors")
    down = asked.join(shape, "d").withColumn("__c", lot("c")).withColumn("__r", several("r")).select(*keys, "uid", "ids", "kind", "vectors", "low", "high", "need")
    return across.groupBy(*keys).cogroup(down.groupBy(*keys)).applyInArrow(work, schema)


def _questions(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    states = (np.frombuffer(x, np.int64) for row in zip(*(table.column(c).to_pylist() for c in ("low", "high", "need")), strict=True) for x in row)
    for uid, (ids, m) in zip(table.column("uid").to_pylist(), _opened(table), strict=True):
        yield uid, ids, m, next(states), next(states), next(states)


def _comparable(s: np.ndarray, *edges: np.ndarray) -> np.ndarray:
    """Scores as int64 where a float couldn't be compared with the edges exactly."""
    if s.dtype != np.int64 and any(len(e) and (e.max() >= _EXACT or e.min() <= -_EXACT) for e in edges):
        return s.astype(np.int64)
    return s


def _histogram(strips: pa.Table, asked: pa.Table, bins: int) -> pa.Table:
    """Counts of scores by bin in each query's interval, from the top until they reach what is
    looked for: bins further down can't hold the kth value."""
    lots, out = list(_opened(strips)), []
    for block, q, m, low, high, need in _questions(asked):
        live = np.flatnonzero((low < high) & (need > 0))
        if not len(live):
            continue
        q, m, low, high, need = q[live], m[live], low[live], high[live], need[live]
        width = _span(low, high) // U64(bins) + U64(1)
        counts = np.zeros(len(live) * bins, np.int64)
        floor = low.copy()
        for ids, rows in lots:
            s = _comparable(_scores(m, rows), low, high)
            inside = (s >= floor[:, None]) & (s <= high[:, None])
            inside[_own(q, ids)] = False
            row, col = np.nonzero(inside)
            if len(row):
                at = (s[row, col].astype(np.int64).view(U64) - low[row].view(U64)) // width[row]
                counts += np.bincount(row * bins + at.astype(np.int64), minlength=len(counts))
                above = np.cumsum(counts.reshape(-1, bins)[:, ::-1], 1)
                reached = above[:, -1] >= need
                last = (bins - 1 - (above >= need[:, None]).argmax(1)).astype(U64)
                floor = np.where(reached, (low.view(U64) + last * width).view(np.int64), low)
        table = counts.reshape(-1, bins)
        above = np.cumsum(table[:, ::-1], 1)[:, ::-1] - table
        row, col = np.nonzero((table > 0) & (above < need[:, None]))
        out.append(pa.table([np.full(len(row), block), live[row].astype(np.int32), col.astype(np.int32), table[row, col]], names=["block", "q", "bin", "n"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())], names=["block", "q", "bin", "n"])


def _winners(strips: pa.Table, asked: pa.Table) -> pa.Table:
    """Scores over the kth value, and of those equal to it the smallest ids, for each query."""
    lots, found = list(_opened(strips)), [(np.zeros(0, np.int64),) * 3]
    for _, q, m, kth, _, need in _questions(asked):
        live = np.flatnonzero(need > 0)
        q, m, kth, need = q[live], m[live], kth[live], need[live]
        tie_row, tie_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ids, rows in lots:
            s = _comparable(_scores(m, rows), kth)
            inside = s >= kth[:, None]
            inside[_own(q, ids)] = False
            row, col = np.nonzero(inside)
            score = s[row, col].astype(np.int64)
            over = score > kth[row]
            found.append((q[row[over]], ids[col[over]], score[over]))
            tie_row, tie_id = np.concatenate([tie_row, row[~over]]), np.concatenate([tie_id, ids[col[~over]]])
            by = np.lexsort((tie_id, tie_row))
            tie_row, tie_id = tie_row[by], tie_id[by]
            fit = np.arange(len(tie_row)) - np.searchsorted(tie_row, tie_row) < need[tie_row]
            tie_row, tie_id = tie_row[fit], tie_id[fit]
        found.append((q[tie_row], tie_id, kth[tie_row]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, *, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", block: int = 1024, bins: int = 1024, strip: int = 2048, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query among all rows but
    those with its id; ties go to the smaller id.

    Vectors that are null, empty or hold nulls or values that aren't finite (or whose 256-fold
    isn't) take no part, as do null ids; a row is compared with the queries of its vector's length.
    Fewer than ``k`` candidates give fewer rows, and none for a query without any; an empty table
    gives no row. Rows that repeat a (query id, id) each count. Scores beyond the range of a long
    take its ends. Other columns, whatever their names, aren't read.

    A cell holds ``cell_bytes`` of rows and of queries, in expectation, and its results are at most
    ``k`` counts or rows a query but for scores above the kth. Nothing is broadcast or collected but
    the number of queries that are still open.
    """
    spark = rows.sparkSession
    of = lambda f: f.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    strips = materialise(_packed(of(rows), strip), "strips")
    blocks = materialise(_packed(of(queries).hint("rebalance"), block), "blocks")
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = lambda least: F.greatest(F.ceil(F.sum(F.col("n") * F.lit(8.0) * F.col("d")) / cell_bytes), least).cast("int")
    totals = strips.groupBy("d").agg(lots(F.least(F.lit(lanes), F.ceil(F.sum("n") / strip))).alias("r"), F.max("most").alias("all_most"))
    shape = materialise(totals.join(blocks.groupBy("d").agg(lots(F.lit(1)).alias("c")), "d"), "shape")
    state = materialise(_first_state(blocks, shape, k), "state")
    packed = blocks.select("uid", "ids", "kind", "vectors")
    asked = lambda of: packed.join(of.withColumnRenamed("block", "uid"), "uid")
    sizes = shape.select("d", "r", "c")
    while state.agg(F.sum("live")).first()[0]:
        open_ = asked(state.where("live > 0"))
        part = _grid(strips, open_, sizes, lambda a, b: _histogram(a, b, bins), "block long, q int, bin int, n long")
        counted = part.groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        found = counted.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(lambda key, a, b: _next_state(key, a, b, bins), _STATE)
        state = materialise(found, "state")
    top = _grid(strips, asked(state), sizes, _winners, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 highest scores for each vector whose id is divisible by 50, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
