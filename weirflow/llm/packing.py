"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised once; what is longer than a sequence is cut into full pieces and a rest.
Pieces are dealt at random into groups of bounded size, and each group is packed on its own: by
falling length, a piece goes into the first bin that has room, which a tournament (maximum) tree
over the bins' free space finds in logarithmic time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, WHITE, blocks, frugal, materialise, mix, mix1, text_buffer

SEQUENCE = 2048
#: Bytes of text that are encoded at once.
BLOCK = 2 << 20


class TournamentTree:
    """The leftmost of n bins whose free space is at least a given size."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.width)
        for leaf in range(self.width + bins, 2 * self.width):
            self.tree[leaf] = -1
        for node in range(self.width - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])

    def place(self, size: int) -> tuple[int, int] | None:
        """Takes ``size`` from the first bin with room; its number and its free space before."""
        tree = self.tree
        if tree[1] < size:
            return None
        node = 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        free = tree[node]
        tree[node] = free - size
        found = node - self.width
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] > tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return found, free


def first_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; equal lengths keep their order. Empty pieces aren't allowed."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        if not 0 < lengths[i] <= capacity:
            raise ValueError(f"a piece of {lengths[i]} doesn't fit a sequence of {capacity}")
        placed = tree.place(lengths[i])
        bins[i], offsets[i] = placed[0], capacity - placed[1]
    return bins, offsets


_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
#: Letters that the tokenizer's normalisation leaves as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: What byte-level tokenizers show bytes as: printable ones as themselves, others from 256 on.
_SHOWN = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SHOWN |= {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Normalisation and splitting of the tokenizers whose texts can be cut into chunks (fixed values).
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Words whose ids a worker keeps; beyond them it begins anew.
KEPT_WORDS = 300_000


class ChunkEncoder:
    """Token ids of texts, from the ids of their chunks.

    The tokenizer drops white space, keeps case of no letter, and never merges across white space
    or between an ASCII letter and an ASCII mark (but the apostrophe, which begins contractions).
    So a text's ids are those of its chunks in order, and each distinct chunk is encoded once.
    ASCII capitals are lowered beforehand, but not where a mark may follow: composition comes
    before lowering in the tokenizer, and some marks compose with the small letter alone.
    Texts that could hold a control token are encoded whole, and so is every text with a
    tokenizer of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.chunked = all(settings[k] == v for k, v in _CHUNKED.items()) and not settings["model"].get("dropout")
        self._reset()

    def _reset(self) -> None:
        self.table: dict[bytes, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, column: pa.Array, end_id: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end_id`` after each row's, and the n + 1 offsets of the rows; nulls are empty."""
        data, offs = text_buffer(column)
        n = len(offs) - 1
        odd = np.arange(n) if not self.chunked else np.unique(np.searchsorted(offs, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1)
        whole = [self.tokenizer.encode(data[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids for d in odd.tolist()]
        low = LOWER[data]
        composes = np.flatnonzero((data[:-1] >= 65) & (data[:-1] <= 90) & (data[1:] >= 128))
        low[composes] = data[composes]
        for d in odd.tolist():
            low[offs[d] : offs[d + 1]] = 32
        inside = ~WHITE[low]
        begins = inside.copy()  # starts of chunks: after white space, at cuts, and where a row begins
        begins[1:] &= WHITE[low[:-1]] | (_SMALL[low[:-1]] & _MARKS[low[1:]]) | (_MARKS[low[:-1]] & _SMALL[low[1:]])
        edge = offs[:-1][offs[:-1] < len(low)]
        begins[edge] = inside[edge]
        place = np.cumsum(inside) - 1
        bounds = np.append(place[begins], len(place) and place[-1] + 1).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
        counts = np.diff(np.concatenate([[0], np.cumsum(begins)])[offs])
        words = self._numbers(chunks)
        size = np.diff(self.first)[words]
        per_doc = np.zeros(n, np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            per_doc[full] = np.add.reduceat(size, (np.cumsum(counts) - counts)[full])
        per_doc[odd] = [len(w) for w in whole]
        total = int(size.sum())
        base = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.first[:-1][words] - base, size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        for d, found in zip(odd.tolist(), whole, strict=True):
            out[offsets[d] : offsets[d + 1] - 1] = found
            keep[offsets[d] : offsets[d + 1]] = False
        out[keep] = ids
        return out, offsets

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Places of chunks in the table, which gets those that it lacks; each distinct one is looked up once."""
        if len(self.table) > KEPT_WORDS:
            self._reset()
        table, coded = self.table, chunks.dictionary_encode()
        _, ends, raw = coded.dictionary.buffers()
        ends, raw = np.frombuffer(ends, np.int32, len(coded.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
        words = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        fresh = [w for w in words if w not in table]
        if fresh:
            texts = [w.decode() for w in fresh]
            plain = self.tokenizer.model.tokenize
            ids: list = [[t.id for t in plain(w.decode("latin-1").translate(_SHOWN))] if _PLAIN.fullmatch(x) else None for w, x in zip(fresh, texts, strict=True)]
            rest = [k for k, i in enumerate(ids) if i is None]
            for low in range(0, len(rest), 10_000):
                part = rest[low : low + 10_000]
                for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                    ids[k] = e.ids
            start = len(table)
            table.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
        places = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        return places[coded.indices.to_numpy()] if words else places


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of a file, made once in each worker process."""
    return ChunkEncoder(path)


#: Pieces that are put out at once.
PUT = 2048


def pieces(docs: DataFrame, tokenizer: str, *, length: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, lot, ids for each piece of each document.

    ``ids`` has the piece's token ids, as unsigned little-endian numbers of four bytes. ``lot`` is
    a random number from the place of the row in its input partition, which is the same if a task
    runs again; repeated rows so spread over the groups.
    """
    kept = docs.select("doc_id", "text")
    schema = kept.drop("text").schema
    for name in ("start", "length", "doc_tokens", "lot"):
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        lot = mix1((task.partitionId() if task else 0) + 1)
        encoder, row = encoder_of(tokenizer), 0
        for whole in batches:
            for batch in blocks(whole, limit=BLOCK):
                ids, offs = encoder.encode(batch.column(1), end_id)
                total = np.diff(offs)
                cuts = -(-total // length)
                source = np.repeat(np.arange(len(total)), cuts)
                start = (np.arange(len(source)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
                size = np.minimum(length, total[source] - start)
                with np.errstate(over="ignore"):
                    lots = (mix(np.arange(row, row + len(source), dtype=U64) + U64(lot)) >> U64(1)).astype(np.int64)
                row += len(source)
                ids = ids.astype("<u4", copy=False)
                edges = np.append(0, np.cumsum(size))
                for a in range(0, len(source), PUT):
                    b = min(len(source), a + PUT)
                    own = pa.py_buffer((4 * (edges[a : b + 1] - edges[a])).astype(np.int32)), pa.py_buffer(ids[edges[a] : edges[b]])
                    numbers = (pa.array(x[a:b].astype(np.int64)) for x in (start, size, total[source], lots))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source[a:b])), *numbers, pa.Array.from_buffers(pa.binary(), b - a, [None, *own])], names=schema.names)

    made = kept.mapInArrow(frugal(run), schema)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "lot", "ids")


def pack(cut: DataFrame, *, length: int = SEQUENCE, group_pieces: int = 8192) -> DataFrame:
    """``cut`` with sequence_id and offset instead of lot; ids_crc32 is made of the packed ids.

    Groups hold about ``group_pieces`` pieces each, at random. Ids of sequences are the group's
    number times 2**32 plus the bin. An empty table gives no row.
    """
    cut = materialise(cut.drop("ids_crc32"), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    schema = cut.drop("lot").schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        size, lot = (group.column(c).to_numpy() for c in ("length", "lot"))
        by = np.lexsort((lot, -size))
        bins, offsets = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        bins[by], offsets[by] = first_fit_decreasing(size[by].tolist(), length)
        out = group.drop_columns(["lot", "__g"])
        return out.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    made = cut.withColumn("__g", F.pmod(F.col("lot"), F.lit(groups))).groupBy("__g").applyInArrow(run, schema)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(pieces(docs, tokenizer))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, pieces, ids for each packed sequence.

    ``ids`` are those of its pieces in order of offset, in the form of ``pieces``; ``pieces`` says
    which range of which document stands where.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("__p"))
    places = F.transform("__p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length")))
    joined = F.unhex(F.array_join(F.transform("__p", lambda p: F.hex(p["ids"])), ""))
    return made.select("sequence_id", "length", places.alias("pieces"), joined.alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences, and checksums of the packed ids.

    Null and empty texts are one id each; repeated rows are packed each; pieces of equal length go by
    their random number; an empty table gives no row; only doc_id and text are read.
    """
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
