"""Language-model scoring by prediction by partial matching.

A byte-context trie holds, for each context of up to ``ORDER`` bytes, the counts of the bytes that
followed it in the training texts. Code lengths are by method D: a byte seen c times in a context
of n symbols and d distinct ones costs -log2((2c - 1) / 2n), an escape to the next shorter context
-log2(d / 2n), and the symbols of the longer context are excluded from there on. A text is
preceded by marks and ends in one, so its probability is that of the whole text.

The trie is whole: no context is dropped, and none of its tables is sent to all executors but that
of single-byte contexts, which has 65,792 entries at most. What a byte costs depends only on it and
the ``ORDER`` bytes before it, a gram. Documents are dealt into blocks; a block lists its distinct
grams with their training counts, by slices of a hash of the three bytes before the last. Lists of a
slice meet ``FAN`` at a time, in as many rounds as there are blocks for, and after each round slices
are finer, so no list grows with the data. In the last ones contexts of three bytes or more are
whole; those of two come by a join. Costs go back the way that lists came, and meet the texts where
these were written, in a table that is bucketed by block: texts are never shuffled. The words of the
unigram score take the same way: they meet by their hashes and counts come back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, HashTable, blocks, frugal, in_class, kept_at, materialise, scan_words, text_buffer

ORDER = 5
BEFORE, END = 0xFF, 0xFE  # bytes that UTF-8 never has
#: Bytes of text that are worked on at once, and those of a block.
PART, BLOCK = 2 << 20, 64 << 20
#: Lists that meet in one; bits of a key's hash that name its slice, at first and more after a round.
FAN, BITS, FINER = 64, 6, 3


def _mask(bytes_: int) -> np.uint64:
    return U64((1 << (8 * bytes_)) - 1)


def gram_codes(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end mark of each text the ``order`` bytes before it and itself, in one
    number, and the n + 1 offsets of the texts in these."""
    n = len(offs) - 1
    out_offs = offs + np.arange(n + 1)
    padded = np.full(int(offs[-1]) + n * (order + 1), BEFORE, np.uint8)
    size = np.diff(offs)
    shift = np.arange(n) * (order + 1) + order
    if len(data):
        padded[np.arange(len(data)) + np.repeat(shift, size)] = data
    padded[offs[1:] + shift] = END
    code = np.zeros(len(padded) - order if len(padded) else 0, U64)
    for k in range(order + 1):
        code <<= U64(8)
        code |= padded[k : len(padded) - order + k]
    # position p of the padded row is code p - order
    keep = np.arange(int(out_offs[-1])) + np.repeat(np.arange(n) * order, size + 1)
    return code[keep], out_offs


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


@dataclass
class _Level:
    """Order k: codes of (context, byte) with counts; contexts with n, d, and what is left of the
    next shorter context's n and d after excluding this one's symbols."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    d: np.ndarray
    left_n: np.ndarray
    left_d: np.ndarray


class Trie:
    """The model; ``tables[k]`` are the sorted codes and counts of order k."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(tables) - 1
        self.levels: list[_Level] = []
        for k, (codes, counts) in enumerate(tables):
            counts = counts.astype(np.float64)
            contexts, first, d = np.unique(codes >> U64(8), return_index=True, return_counts=True)
            n = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            left_n, left_d = np.zeros(len(contexts)), np.zeros(len(contexts))
            if k and len(first):
                below = self.levels[k - 1]
                excluded = np.add.reduceat(below.counts[_find(below.codes, codes & _mask(k))], first)
                shorter = _find(below.contexts, contexts & _mask(k - 1))
                left_n, left_d = below.n[shorter] - excluded, below.d[shorter] - d
            self.levels.append(_Level(codes, counts, contexts, n, d.astype(float), left_n, left_d))

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each code's last byte after the bytes before it."""
        same, back = np.unique(codes, return_inverse=True)
        return self.costs(same)[back]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """``log2`` for codes that are worth no sorting."""
        total = np.zeros(len(codes))
        live = np.arange(len(codes))
        above = np.full(len(codes), -1)  # context of the next longer order, or -1
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            code = codes[live] & _mask(k + 1)
            context = _find(level.contexts, code >> U64(8))
            here, up = context >= 0, above[live] >= 0
            n, d = np.where(here, level.n[context] if len(level.n) else 0, 0.0), np.where(here, level.d[context] if len(level.d) else 0, 0.0)
            if up.any():
                longer = self.levels[k + 1]
                n[up], d[up] = longer.left_n[above[live[up]]], longer.left_d[above[live[up]]]
            gram = _find(level.codes, code)
            hit = here & (gram >= 0)
            total[live[hit]] += np.log2((2 * level.counts[gram[hit]] - 1) / (2 * n[hit]))
            esc = here & ~hit & (n > 0) & (d > 0)
            total[live[esc]] += np.log2(d[esc] / (2 * n[esc]))
            above[live[here]] = context[here]
            live = live[~hit]
        seen = len(self.levels[0].codes)
        total[live] -= np.log2(256 - seen)
        return total

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a buffer."""
        codes, at = gram_codes(data, offs, self.order)
        return np.add.reduceat(self.log2(codes), at[:-1]) * np.log10(2) if len(offs) > 1 else np.zeros(0)


def train_local(texts: list[bytes], order: int = ORDER) -> Trie:
    """A model of a few texts, without Spark."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes, _ = gram_codes(np.frombuffer(b"".join(texts), np.uint8), offs, order)
    return Trie([np.unique(codes & _mask(k + 1), return_counts=True) for k in range(order + 1)])


# ---------------------------------------------------------------- lists of counted keys
def pack(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys by their differences, and values beside them, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(np.diff(keys, prepend=U64(0)).tobytes()), squeeze(np.ascontiguousarray(values).tobytes())


def unpack(keys: bytes, values: bytes, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    return np.cumsum(np.frombuffer(expand(keys), U64), dtype=U64), np.frombuffer(expand(values), kind)


def add_lists(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list with the sums of the counts; keys that were listed with 0 stay."""
    keys, counts = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Listed:
    """Keys of a block, gathered part by part; parts are merged when they are as many as the rest."""

    def __init__(self) -> None:
        self.whole = (np.zeros(0, U64), np.zeros(0, np.int64))
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, trained: np.ndarray, held: np.ndarray) -> None:
        self.parts.append(tuple(np.unique(trained, return_counts=True)))
        other = np.unique(held)
        self.parts.append((other, np.zeros(len(other), np.int64)))
        self.waiting += len(self.parts[-1][0]) + len(self.parts[-2][0])
        if self.waiting > len(self.whole[0]):
            self.sum()

    def put(self, counted: tuple[np.ndarray, np.ndarray]) -> None:
        self.parts.append(counted)
        self.waiting += len(counted[0])
        if self.waiting > len(self.whole[0]) + (1 << 20):
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        self.whole = add_lists([self.whole, *self.parts])
        self.parts, self.waiting = [], 0
        return self.whole


def slice_of(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """By a hash of 32 bits: of the three bytes before a gram's last one, or of a word."""
    hashed = (((keys >> U64(8)) & U64(0xFFFFFF)) + U64(1)) * U64(0x9E3779B97F4A7C15) >> U64(32) if kind == GRAM else keys >> U64(20)
    return ((hashed & U64(0xFFFFFFFF)) >> U64(32 - bits)).astype(np.int64)


def _sliced(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not len(keys):
        return
    lot = slice_of(kind, keys, bits)
    where = np.argsort(lot, kind="stable")
    names, first = np.unique(lot[where], return_index=True)
    for number, at in zip(names.tolist(), np.split(where, first[1:]), strict=True):
        yield number, keys[at], counts[at]


GRAM, WORD, TEXT = 0, 1, 2
_VALUES = {GRAM: "<f4", WORD: "<f8"}


def _listed(docs: DataFrame) -> DataFrame:
    """The documents of each block, and its grams and words by slice with their training counts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, slice int, a binary, b binary, doc_id {id_type}, held boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        block, size = (task.partitionId() if task else 0) << 32, 0
        names = [c.split(" ")[0] for c in schema.split(", ")]
        grams, words = _Listed(), _Listed()
        kind_of_id = None

        def lists() -> Iterator[pa.RecordBatch]:
            for kind, listed in ((GRAM, grams), (WORD, words)):
                found = [(number, *pack(keys, counts)) for number, keys, counts in _sliced(kind, *listed.sum(), BITS)]
                if found:
                    n = len(found)
                    number, a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(number, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(n, kind_of_id), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=names)

        for whole in batches:
            kind_of_id = whole.schema.field(0).type
            for part in blocks(whole, limit=PART):
                data, offs = text_buffer(part.column(2))
                if size and size + len(data) > BLOCK:
                    yield from lists()
                    block, size, grams, words = block + 1, 0, _Listed(), _Listed()
                size += len(data) + 1
                held = part.column(1).fill_null(False)
                out = held.to_numpy(zero_copy_only=False).astype(bool)
                scanned = scan_words(part.column(2))
                low = LOWER[data]
                codes, at = gram_codes(low, offs, ORDER)
                aside = np.repeat(out, np.diff(at))
                grams.add(codes[~aside], codes[aside])
                del codes
                hashes = scanned.hashes(low)
                aside = out[scanned.doc]
                words.add(hashes[~aside], hashes[aside])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([TEXT] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), part.column(0), held, part.column(2).cast(pa.string())], names=names)
        if size:
            yield from lists()

    return docs.select("doc_id", "held", "text").mapInArrow(frugal(run), schema)


_LISTS = "kind int, slice int, node long, a binary, b binary, total long, seen long"


def _rows(kind: int, node: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    n = len(found)
    a, b = zip(*(pack(keys, counts) for _, keys, counts in found), strict=True) if n else ((), ())
    totals = [int(counts.sum()) for _, _, counts in found], [int((counts > 0).sum()) for _, _, counts in found]
    numbers = [pa.array([kind] * n, pa.int32()), pa.array([number for number, _, _ in found], pa.int32()), pa.array([node] * n, pa.int64())]
    return pa.table([*numbers, pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(t, pa.int64()) for t in totals)], names=[c.split(" ")[0] for c in _LISTS.split(", ")])


def _meet(lists: DataFrame, bits: int) -> DataFrame:
    """One list of each (kind, slice, parent), by finer slices of ``bits``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, _, node = (x.as_py() for x in key)
        gathered = _Listed()
        for a, b in zip(table.column("a"), table.column("b"), strict=True):
            gathered.put(unpack(a.as_py(), b.as_py()))
        return _rows(kind, node, list(_sliced(kind, *gathered.sum(), bits)))

    return lists.groupBy("kind", "slice", "parent").applyInArrow(run, _LISTS)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the last three bytes of a slice's grams; 0 for those that are only looked up."""
    for batch in batches:
        for number, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            keys, counts = unpack(a, b)
            tails, n = add_lists([(keys & _mask(3), counts)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tails), number, np.int32)), pa.array(tails.astype(np.int64)), pa.array(n)], names=["slice", "tail", "n"])


def slice_costs(keys: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log2 of the probabilities of a slice's grams; ``pairs`` is the corpus' table of order 1, and
    ``triples`` has that of order 2 for the slice's contexts of two bytes."""
    ones = np.bincount((pairs[0] & U64(0xFF)).astype(np.int64), pairs[1], 256)
    tables = [(np.flatnonzero(ones).astype(U64), ones[ones > 0].astype(np.int64)), pairs, triples]
    seen = counts > 0
    level = (keys[seen], counts[seen])
    longer = [level]
    for k in range(ORDER - 1, 2, -1):
        level = add_lists([(level[0] & _mask(k + 1), level[1])]) if len(level[0]) else level
        longer.append(level)
    return Trie([*tables, *longer[::-1]]).costs(keys)


_VALUED = "kind int, slice int, node long, a binary, b binary"


def _valued(root: DataFrame, triples: DataFrame, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Grams with their costs and words with their counts, slice by slice."""

    def run(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        tails, n = wanted.column("tail").to_numpy(), wanted.column("n").to_numpy()
        by = np.argsort(tails)
        out = []
        for kind, a, b in zip(*(lists.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
            keys, counts = unpack(a, b)
            values = slice_costs(keys, counts, pairs, (tails[by].astype(U64), n[by])) if kind == GRAM else counts
            out.append(pack(keys, values.astype(_VALUES[kind]))[1])
        return pa.table([lists.column("kind"), lists.column("slice"), lists.column("node"), lists.column("a"), pa.array(out, pa.binary())], names=["kind", "slice", "node", "a", "b"])

    lists = root.select("kind", "slice", "node", "a", "b")
    return lists.groupBy("kind", "slice").cogroup(triples.withColumn("kind", F.lit(GRAM)).groupBy("kind", "slice")).applyInArrow(run, _VALUED)


def _answers(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """What the lists that met are worth, from the finer slices of what they came to."""
    kind = _VALUES[key[0].as_py()]
    keys, values = (np.concatenate(x) for x in zip(*(unpack(a, b, kind) for a, b in zip(known.column("a").to_pylist(), known.column("b").to_pylist(), strict=True)), strict=True))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    out = []
    for a in asked.column("a").to_pylist():
        listed = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(a), U64), dtype=U64)
        out.append(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values[np.searchsorted(keys, listed)]).tobytes()))
    return pa.table([asked.column("kind"), asked.column("slice"), asked.column("node"), asked.column("a"), pa.array(out, pa.binary())], names=["kind", "slice", "node", "a", "b"])


def _table(answers: pa.Table, kind: int) -> HashTable | None:
    own = [unpack(a, b, _VALUES[kind]) for k, a, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True) if k == kind]
    return HashTable(*(np.concatenate(x) for x in zip(*own, strict=True)), dtype=np.dtype(_VALUES[kind])) if own else None


#: Bytes of the input, as its source says, for each bucket of blocks.
BUCKET = 32 << 20


def _bucketed(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """``parts`` as written into a table in the shared folder that is bucketed by block: what reads it
    by block needs no shuffle. The number of buckets grows with the input."""
    spark = parts.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    size = sum(n for n in sizes if n < 2**60)  # sources that don't know say more
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(lanes, -(-size // BUCKET)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"weirflow_ppm_{uuid.uuid4().hex}"
    parts.write.format("parquet").option("path", kept_at(spark, "ppm")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside the warehouse
    return found


def score_corpus(docs: DataFrame, held: str = "held") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    ``docs`` has doc_id, text and the boolean ``held``; rows that aren't held train. Null texts
    are empty, and score by their end alone. Without training rows all symbols are as likely.
    Repeated rows and null ids are scored each. An empty table gives no row. Of the columns only
    doc_id, text and ``held`` are read, so others may have any name.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(held), F.lit(False)).alias("held"), "text")
    parts = _bucketed(_listed(rows), rows)
    texts = parts.where(f"kind = {TEXT}").select("block", "doc_id", "held", "text")
    lists = parts.where(f"kind <> {TEXT}").select("kind", "slice", F.col("block").alias("node"), "a", "b")
    parents = lambda frame, n: frame.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(n)) if n > 1 else F.lit(0).cast("long"))
    nodes, bits, rounds = lists.agg(F.count_distinct("node")).first()[0], BITS, []
    while not rounds or nodes > 1:
        nodes = max(1, -(-nodes // FAN))
        met = parents(lists, nodes)
        rounds.append((met, bits))
        bits += FINER * (nodes > 1)
        lists = materialise(_meet(met, bits), "lists", compression="zstd")
    root = lists
    tails = root.where(f"kind = {GRAM}").select("slice", "a", "b").mapInArrow(frugal(_tails), "slice int, tail long, n long")
    tails = materialise(tails.withColumn("pair", F.shiftright("tail", 8)), "tails")
    whole = tails.groupBy("pair", "tail").agg(F.sum("n").alias("n")).where("n > 0")
    triples = tails.select("slice", "pair").distinct().join(whole, "pair").select("slice", "tail", "n")
    found = whole.groupBy(F.col("tail").bitwiseAND(0xFFFF).alias("tail")).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(found.column("tail").to_numpy())
    pairs = found.column("tail").to_numpy()[order].astype(U64), found.column("n").to_numpy()[order].astype(np.int64)
    sums = root.where(f"kind = {WORD}").agg(F.sum("total"), F.sum("seen")).first()
    train_docs = texts.where("not held").count()
    n_train = (sums[0] or 0) + train_docs
    vocabulary = (sums[1] or 0) + (train_docs > 0)
    answers = _valued(root, triples, pairs)
    keys = ("kind", "slice", "parent")
    for asked, coarse in rounds[::-1]:
        known = answers.select("kind", F.shiftright("slice", bits - coarse).alias("slice"), F.col("node").alias("parent"), "a", "b")
        answers = asked.select(*keys, "node", "a").groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_answers, _VALUED)
        bits = coarse
    answers = answers.withColumnRenamed("node", "block")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, words = _table(right, GRAM), _table(right, WORD)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        out = []
        for batch in left.select(["doc_id", "held", "text"]).combine_chunks().to_batches():
            for part in blocks(batch, limit=PART):
                n = part.num_rows
                scanned = scan_words(part.column(2))
                low = LOWER[scanned.data]
                codes, at = gram_codes(low, scanned.doc_offsets, ORDER)
                costs = np.add.reduceat(grams.get(codes)[0], at[:-1], dtype=np.float64)
                hashes = scanned.hashes(low)
                counts = words.get(hashes)[0] if len(hashes) else np.zeros(0)
                tokens = np.bincount(scanned.doc, minlength=n) + 1
                seen = np.bincount(scanned.doc, counts > 0, n).astype(np.int64) + (train_docs > 0)
                base = np.bincount(scanned.doc, np.log10(counts + 1.0), n) + np.log10(train_docs + 1.0) - tokens * np.log10(n_train + vocabulary + 1.0)
                out.append(pa.table([part.column(0), part.column(1), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(costs * np.log10(2))], names=names))
        return pa.concat_tables(out)

    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")


def op10_ppm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those with crc32(doc_id) mod 7 other than 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_corpus(docs.select("doc_id", "text", in_class("doc_id", 7, 2).alias("held")))
