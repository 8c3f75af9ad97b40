import math
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest

from weirflow.llm import pieces

DATA = "/root/testdata"

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary_of(MODEL, 0.5)


def names(vocabulary):
    return {b.decode().replace(" ", "▁"): i for i, b in enumerate(vocabulary.bytes) if b and i > 258}


def segmentations(vocabulary, word):
    """Every segmentation of a word with its probability."""
    known = names(vocabulary)

    @cache
    def weights(text):
        if not text:
            return [((), 0.0)]
        return [((known[text[:k]], *rest), vocabulary.weight[known[text[:k]]] + w) for k in range(1, len(text) + 1) if text[:k] in known for rest, w in weights(text[k:])]

    found = weights(word.replace(" ", "▁"))
    total = math.log(sum(math.exp(w) for _, w in found))
    return {s: math.exp(w - total) for s, w in found}


@pytest.mark.parametrize("word", [" the", " house", " a"])
def test_samples_follow_the_exact_distribution(vocabulary, word):
    n = 20_000
    ids, edges = pieces.encode_block(vocabulary, [word[1:]] * n, pieces.row_seeds(list(range(n)), 7))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True))
    want = segmentations(vocabulary, word)
    assert set(got) <= set(want)
    chi = sum((got[s] - n * p) ** 2 / (n * p) for s, p in want.items() if n * p >= 5)
    free = sum(n * p >= 5 for p in want.values())
    assert chi < free + 5 * math.sqrt(2 * free) + 5


def test_forward_sums_are_those_of_all_segmentations(vocabulary):
    known = names(vocabulary)
    words = [" the", " cat", "  ", " x1"]
    lattice = pieces.Lattice(vocabulary, words)
    for word, total in zip(words, lattice.total, strict=True):
        text = word.replace(" ", "▁")

        @cache
        def weight(k, text=text):
            return 1.0 if k == 0 else sum(weight(j, text) * math.exp(vocabulary.weight[known[text[j:k]]]) for j in range(k) if text[j:k] in known)

        assert total == pytest.approx(math.log(weight(len(text))))


def test_round_trip_of_any_text(vocabulary):
    texts = ["", " ", "a", "  two  spaces ", "line\nbreak\ttab", "naïve café", "▁literal▁marks", "漢字 and 🎉 and \u0000", "x" * 5000, "<s> </s> <0x41>"]
    ids, edges = pieces.encode_block(vocabulary, texts, pieces.row_seeds(list(range(len(texts))), 1))
    for k, text in enumerate(texts):
        assert vocabulary.decode(ids[edges[k] : edges[k + 1]].tolist()) == text
    assert ids.min() >= 3  # no control pieces


def test_rows_are_reproducible(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    sums = [{(r["doc_id"], r["ids_crc32"], r["lossless"]) for r in pieces.encode(df, MODEL, seed=s).collect()} for df, s in ((rows, 0), (rows.repartition(5), 0), (rows, 1))]
    assert sums[0] == sums[1] and all(x[2] for x in sums[0]) and len(sums[0] & sums[2]) < 0.2 * len(sums[0])


def test_query_decodes_to_the_documents(spark):
    out = pieces.decode(pieces.op5_sampled_pieces(spark, f"{DATA}/sf0.001"), MODEL, into="back")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    joined = out.join(docs, "doc_id")
    assert joined.count() == docs.count() and joined.where("back <> text or not lossless or n_ids <> size(ids)").count() == 0


def test_edge_rows(spark, docs):
    df = docs((1, None), (2, ""), (None, "abc"), (3, "abc def"), (3, "abc def"), (4, "ü " * 100_000), clash=("ids", "lossless"))
    out = pieces.encode(df, MODEL)
    rows = out.collect()
    assert len(rows) == 6 and all(r["lossless"] for r in rows)
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 3}) == 1
    empty = [r["n_ids"] for r in rows if r["doc_id"] in (1, 2)]
    assert empty == [1, 1]  # the space in front
    assert pieces.encode(df.limit(0), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nulls, MODEL).first()["text"] is None
    with pytest.raises(ValueError, match="already"):
        pieces.decode(out.withColumnRenamed("n_ids", "text"), MODEL)


def test_seeds():
    a = pieces.row_seeds([1, 2, None, "x", "x"], 0)
    assert len(set(a.tolist())) == 4 and (a != pieces.row_seeds([1, 2, None, "x", "x"], 1)).all()
    assert a.dtype == np.uint64
