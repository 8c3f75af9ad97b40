"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled
rows. A text is encoded, in blocks, with each of the dictionaries; the language whose dictionary
gives the fewest bytes is chosen. Where the runner-up is nearly as short the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, frugal, in_class

UNKNOWN = "und"
#: Bytes of text that are encoded at once.
PART = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")


def fit(labelled: DataFrame, *, dict_bytes: int = 96 << 10, snippets: int = 64, snippet_chars: int = 1024, max_languages: int = 512) -> dict[str, bytes]:
    """Dictionaries by language from ``labelled`` (text, lang).

    The sample is bounded: ``snippets`` rows of each language, the smallest by a hash of id and
    text, ``snippet_chars`` characters from a place that the same hash chooses; a dictionary has
    those of them, whole and in that order, that fit into ``dict_bytes``. Map-side limits keep that
    many rows of a language in each task, so a frequent language isn't gathered.
    Rows with a null language or text are left out; more than ``max_languages`` is an error.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = [F.col(c) for c in ("doc_id",) if c in rows.columns]
    rows = rows.withColumn("__h", F.xxhash64(*keys, F.col("text")))
    start = F.pmod(F.col("__h"), F.greatest(F.length("text") - snippet_chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "__h", F.col("text").substr(start, F.lit(snippet_chars)).alias("text"))
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "text"))).where(F.col("__r") <= snippets)
    taken: dict[str, list[tuple[int, str]]] = {}
    for row in best.limit(max_languages * snippets + 1).collect():
        taken.setdefault(row["lang"], []).append((row["__r"], row["text"]))
    if len(taken) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = {}
    for lang, parts in sorted(taken.items()):
        held = b""
        for text in dict.fromkeys(text.lower() for _, text in sorted(parts)):
            more = text.encode() + b"\n"
            held += more if len(held) + len(more) <= dict_bytes else b""
        out[lang] = held
    return out


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], *, level: int = 6, block_chars: int = 4096):
        self.languages = list(dictionaries)
        self.block_chars = block_chars
        self.coders = []
        for content in dictionaries.values():
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, texts: list[str]) -> np.ndarray:
        """Encoded bytes, one row for each text and one column for each language."""
        parts, owner = [], []
        step = self.block_chars
        for k, text in enumerate(texts):
            for at in range(0, len(text), step):
                parts.append(text[at : at + step].lower().encode())
                owner.append(k)
        out = np.zeros((len(texts), len(self.coders)), np.int64)
        owners = np.array(owner, np.int64)
        for j, coder in enumerate(self.coders):
            compress = coder.compress
            got = np.fromiter((len(compress(p)) for p in parts), np.int64, len(parts))
            out[:, j] = np.bincount(owners, got, len(texts))[: len(texts)] if len(parts) else 0
        return out

    def predict(self, texts: list[str | None], *, min_margin: float = 0.005) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, for each text.

        Null, letterless texts and a model without languages give ``und``, 0.0 and rejection.
        Equal sizes go to the language that sorts first. The score is the softmax of the code
        lengths; a text is rejected if the runner-up is under ``min_margin`` longer, relatively.
        """
        n = len(texts)
        langs, score, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        at = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        if not at or not self.coders:
            return langs, score, accepted
        sizes = self.sizes([texts[k] for k in at])
        best = sizes.argmin(1)
        least = sizes[np.arange(len(at)), best]
        weight = np.exp2(-np.minimum(np.maximum(sizes - least[:, None], 0) / 2.0, 200))
        if sizes.shape[1] > 1:
            second = np.partition(sizes, 1, 1)[:, 1]
            ok = (second - least) >= min_margin * second
        else:
            ok = np.ones(len(at), bool)
        for k, b in zip(at, best, strict=True):
            langs[k] = self.languages[b]
        score[at] = 1 / weight.sum(1)
        accepted[at] = ok & (second > least if sizes.shape[1] > 1 else True)
        return langs, score, accepted


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_columns: tuple[str, ...] = ("doc_id",), min_margin: float = 0.005) -> DataFrame:
    """id columns, lang_pred, score, accepted for each row of ``docs``; whole texts are read."""
    kept = docs.select(*id_columns, "text")
    schema = kept.drop("text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for whole in batches:
            for batch in blocks(whole, limit=PART):
                langs, score, ok = model.predict(batch.column(batch.num_columns - 1).to_pylist(), min_margin=min_margin)
                cols = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score), pa.array(ok)], names=[*id_columns, "lang_pred", "score", "accepted"])

    return kept.mapInArrow(frugal(run), schema)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], *, min_margin: float = 0.005) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for whole in batches:
            for batch in blocks(whole, limit=PART):
                yield batch.filter(pa.array(model.predict(batch.column(at).to_pylist(), min_margin=min_margin)[2]))

    return docs.mapInArrow(frugal(run), docs.schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and accepted) of all documents.

    It learns from rows with crc32(doc_id) mod 3 other than 1 and a language. Null and letterless
    texts are ``und`` with score 0; repeated rows repeat; an empty table gives no row.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = in_class("doc_id", 3, 1)
    model = fit(docs.where(~held))
    out = identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
