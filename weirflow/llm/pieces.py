"""SentencePiece segmentations sampled by forward filtering and backward sampling.

The lattice of a text has an edge for each vocabulary piece that occurs in it. Forward sums give
the weight of all segmentations of each prefix; walking back from the end, edges are drawn in
proportion to the weight that passes through them, so a segmentation is drawn with its exact
probability. No piece runs across the start of a word (a run of spaces and what follows it), so
the lattice is cut there, and the forward pass is made once for each distinct word of a block.

Draws come from a counter-based generator seeded by the row's key, the word's place and the step:
the same row gives the same segmentation on any cluster. Characters without a piece become byte
pieces, so decoding gives the text back, character for character.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import U64, HashTable, blocks, frugal, mix, text_buffer

_WORD = re.compile(r" *[^ ]+| +")
_MARK = 0x2581
_FACTOR = U64(0xD6E8FEB86659FD93)
BLOCK = 2 << 20


@lru_cache(maxsize=4)
def vocabulary_of(path: str, temper: float) -> Vocabulary:
    """The vocabulary of a file, made once in each worker process."""
    return Vocabulary(path, temper)


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h + code.astype(U64) + U64(0x9E3779B97F4A7C15)) * _FACTOR
    return h ^ (h >> U64(31))


class Vocabulary:
    """Pieces of a model file with their log weights.

    The file's pieces are ranked by merges, not weighted; a piece of rank r weighs
    ``-temper * log(r + 10)`` (Zipf's law), and ``temper`` 0 makes all segmentations alike.
    """

    def __init__(self, path: str, temper: float = 0.5):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        names: list[tuple[int, str]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                names.append((i, piece))
        if any("▁" in p.lstrip("▁") for _, p in names):
            raise ValueError("a piece runs across the start of a word")
        self.size = n
        self.longest = max(len(p) for _, p in names)
        if self.longest >= 32:
            raise ValueError("a piece of 32 characters or more")
        rank = np.arange(n, dtype=np.float64)
        self.weight = -temper * np.log(rank - min(i for i, _ in names) + 10, where=rank >= min(i for i, _ in names), out=np.zeros(n))
        # all prefixes of the pieces, with the id (from 1) where the prefix is a piece, else 0
        size = np.array([len(p) for _, p in names])
        number = np.array([i + 1 for i, _ in names])
        code = np.zeros((len(names), self.longest), np.uint32)
        code[np.arange(self.longest) < size[:, None]] = np.frombuffer("".join(p for _, p in names).encode("utf-32-le"), np.uint32)
        h, keys, values = np.zeros(len(names), U64), [], []
        for k in range(self.longest):
            live = size > k
            h[live] = _step(h[live], code[live, k])
            keys.append(h[live])
            values.append(np.where(size[live] == k + 1, number[live], 0))
        keys, values = np.concatenate(keys), np.concatenate(values)
        found, back = np.unique(keys, return_inverse=True)
        ids = np.zeros(len(found))
        np.maximum.at(ids, back, values)
        self.table = HashTable(found, ids.astype(np.float32))
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_first = np.concatenate([[0], np.cumsum(sizes)])
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: list[int]) -> str:
        """The text of a row's ids (the space in front of the first word isn't its own)."""
        return b"".join(self.bytes[i] for i in ids)[1:].decode()

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids, one after the other."""
        size = np.diff(self.byte_first)[ids]
        base = np.cumsum(size) - size
        return self.byte_pool[np.repeat(self.byte_first[:-1][ids] - base, size) + np.arange(int(size.sum()))]


class Lattice:
    """Edges of distinct words, by the character they end at, with draw probabilities."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        literal = code == _MARK
        code[code == 32] = _MARK
        code[literal] = 0xFFFFFFFF  # a mark in the text isn't a space
        n = len(code)
        self.stop = np.cumsum(length) - 1  # last character of each word
        first = self.stop + 1 - length
        word_first = np.repeat(first, length)
        word_end = np.repeat(self.stop, length)
        starts, sizes, ids = [], [], []
        at, h = np.arange(n), np.zeros(n, U64)
        for size in range(1, vocabulary.longest + 1):
            fits = at + (size - 1) <= word_end[at]
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = _step(h, code[at + (size - 1)])
            value, missing = vocabulary.table.get(h)
            if size == 1:
                alone = np.ones(n, bool)
                alone[at[~missing & (value > 0)]] = False
            at, h, value = at[~missing], h[~missing], value[~missing].astype(np.int64)
            piece = value > 0
            starts.append(at[piece].astype(np.int32))
            sizes.append(np.full(int(piece.sum()), size, np.int32))
            ids.append((value[piece] - 1).astype(np.int32))
        # characters without a piece of their own: pseudo pieces after the vocabulary
        odd = np.flatnonzero(alone) if n else np.zeros(0, np.int64)
        codes, back = np.unique(code[odd], return_inverse=True)
        codes[codes == 0xFFFFFFFF] = _MARK
        self.odd = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        starts.append(odd.astype(np.int32))
        sizes.append(np.ones(len(odd), np.int32))
        ids.append((vocabulary.size + back).astype(np.int32))
        start, size, piece = (np.concatenate(x) for x in (starts, sizes, ids))
        del starts, sizes, ids, at, h
        weight = np.append(vocabulary.weight, np.full(len(codes), -20.0))[piece]
        end = start + size - 1
        depth = (end - word_first[end]).astype(np.int32)
        order = np.argsort((depth.astype(np.int64) * (n + 1) + end) << 5 | size)  # longest pieces have under 32 characters
        del size, word_first, word_end
        start, end, piece, weight, depth = start[order], end[order], piece[order], weight[order], depth[order]
        begins = np.isin(start, first, kind="table")
        del order
        forward = np.zeros(n + 1)  # entry e + 1: log weight of all segmentations up to character e
        edges = np.searchsorted(depth, np.arange(int(depth[-1]) + 2 if len(depth) else 1))
        score = np.empty(len(start))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            s = weight[a:b] + np.where(begins[a:b], 0.0, forward[start[a:b]])
            e = end[a:b]
            group = np.flatnonzero(np.diff(e, prepend=-1))
            top = np.maximum.reduceat(s, group)
            count = np.diff(np.append(group, len(e)))
            total = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, count)), group))
            forward[e[group] + 1] = total
            score[a:b] = s - np.repeat(total, count)
        self.total = forward[self.stop + 1]  # log weight of all segmentations of each word
        by = np.argsort(end.astype(np.int64) << 5 | (end - start))
        self.piece, end = piece[by], end[by]
        self.before = np.where(begins[by], -1, start[by] - 1)  # where the walk goes on; -1: the word's start
        self.first = np.searchsorted(end, np.arange(n + 1))
        chance = np.exp(score[by])
        running = np.cumsum(chance)
        floor = np.concatenate([[0.0], running])[self.first[:-1]]
        self.upto = running - floor[end]
        if len(end):
            self.upto[self.first[1:] - 1] = np.inf

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the given words one after the other, and how many each has."""
        n = len(words)
        place = self.stop[words]
        live = np.arange(n)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            u = (mix(seeds[live] + U64(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[place]
            go = np.flatnonzero(u >= self.upto[edge])
            while len(go):
                edge[go] += 1
                go = go[u[go] >= self.upto[edge[go]]]
            taken.append((live, self.piece[edge].astype(np.int32)))
            place = self.before[edge]
            on = place >= 0
            live, place = live[on], place[on]
            step += 1
        count = np.zeros(n, np.int64)
        for k, (who, _) in enumerate(taken):
            count[who] = k + 1
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, piece) in enumerate(taken):
            out[last[who] - k] = piece
        return out, count


def encode_block(vocabulary: Vocabulary, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the n + 1 offsets of the texts. An empty text is the space in front."""
    table: dict[str, int] = {}
    number = table.setdefault
    places, counts = [], []
    for text in texts:
        words = _WORD.findall(" " + text)
        counts.append(len(words))
        places += [number(w, len(table)) for w in words]
    lattice = Lattice(vocabulary, list(table))
    words, n_words = np.array(places, np.int64), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), n_words)
    turn = np.arange(len(words)) - (np.cumsum(n_words) - n_words)[owner]
    ids, count = lattice.sample(words, mix(seeds[owner] ^ mix(turn.astype(U64))))
    owner = np.repeat(owner, count)
    if lattice.odd:  # byte pieces for characters without one
        sizes = np.array([len(b) for b in lattice.odd], np.int64)
        pool = vocabulary.byte_ids[np.frombuffer(b"".join(lattice.odd), np.uint8)]
        pool_first = np.cumsum(sizes) - sizes
        odd = ids >= vocabulary.size
        size = np.ones(len(ids), np.int64)
        size[odd] = sizes[ids[odd] - vocabulary.size]
        flat = np.repeat(ids, size)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        wide = flat >= vocabulary.size
        flat[wide] = pool[pool_first[flat[wide] - vocabulary.size] + inside[wide]]
        ids, owner = flat, np.repeat(owner, size)
    return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(texts) + 1))


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """Seeds of rows from their keys; null keys share one."""
    return mix(np.array([hash_key(k, seed) for k in keys], U64))


def hash_key(key: object, seed: int) -> int:
    if isinstance(key, int):
        return (key * 0x9E3779B97F4A7C15 + seed) & (2**64 - 1)
    return zlib.crc32(repr(key).encode()) << 32 | (seed & 0xFFFFFFFF)


def encode(docs: DataFrame, model: str, *, seed: int = 0, temper: float = 0.5, key: str = "doc_id") -> DataFrame:
    """key, ids, n_ids, ids_crc32, lossless for each row; null texts are empty.

    ``lossless`` says that decoding the ids gave the text's bytes. Rows that repeat a key and a
    text repeat their ids.
    """
    kept = docs.select(key, "text")
    schema = kept.drop("text").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long").add("ids_crc32", "long").add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, temper)
        for whole in batches:
            for batch in blocks(whole, limit=BLOCK):
                data, offs = text_buffer(batch.column(1))
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                ids, edges = encode_block(vocabulary, texts, row_seeds(batch.column(0).to_pylist(), seed))
                n = len(texts)
                back = vocabulary.decode_all(ids)
                want = np.full(len(data) + n, 32, np.uint8)
                shift = offs + np.arange(n + 1)
                keep = np.ones(len(want), bool)
                keep[shift[:-1]] = False
                want[keep] = data
                byte_edges = np.concatenate([[0], np.cumsum(np.diff(vocabulary.byte_first)[ids])])[edges]
                if np.array_equal(byte_edges, shift):
                    wrong = np.add.reduceat((back != want).astype(np.int32), shift[:-1])
                    same = wrong == 0
                else:
                    same = np.array([back[a:b].tobytes() == want[c:d].tobytes() for a, b, c, d in zip(byte_edges[:-1], byte_edges[1:], shift[:-1], shift[1:], strict=True)])
                view = memoryview(ids.astype("<i4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(edges)), pa.array(crc, pa.int64()), pa.array(same)], names=schema.names)

    return kept.mapInArrow(frugal(run), schema)


def decode(rows: DataFrame, model: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the texts of their ids; null ids give null."""
    if into in rows.columns:
        raise ValueError(f"there is a column {into!r} already")
    schema = T.StructType([*rows.schema, T.StructField(into, T.StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, 0.5)
        for batch in batches:
            texts = [None if v is None else vocabulary.decode(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)


def op5_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document, seeded by doc_id."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
