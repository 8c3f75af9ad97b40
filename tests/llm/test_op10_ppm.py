import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import ppm
from weirflow.llm.common import LOWER

DATA = "/root/testdata"


def lower(text):
    return (text or "").encode().translate(bytes(LOWER))


def brute_model(texts, order=5):
    """Counts of the symbol after each context, with marks before and one after the text."""
    counts = defaultdict(Counter)
    for t in texts:
        row = [ppm.BEFORE] * order + [*t, ppm.END]
        for k in range(order, len(row)):
            for n in range(order + 1):
                counts[tuple(row[k - n : k])][row[k]] += 1
    return counts


def brute_probability(counts, context, symbol, order=5):
    p, excluded = Fraction(1), set()
    for n in range(order, -1, -1):
        seen = counts.get(tuple(context[len(context) - n :]))
        if not seen:
            continue
        left = {s: c for s, c in seen.items() if s not in excluded}
        total, d = sum(left.values()), len(left)
        if symbol in left:
            return p * Fraction(2 * left[symbol] - 1, 2 * total)
        if left:
            p *= Fraction(d, 2 * total)
        excluded |= set(seen)
    return p / (256 - len(excluded))


def brute_score(counts, text, order=5):
    row = [ppm.BEFORE] * order + [*text, ppm.END]
    return sum(math.log10(brute_probability(counts, row[k - order : k], row[k], order)) for k in range(order, len(row)))


TEXTS = ["the cat sat on the mat", "The cat ate the rat", "a dog", "", "été à la plage", "the the the"]


def test_trie_against_brute_force():
    train = [lower(t) for t in TEXTS]
    trie, counts = ppm.train_local(train), brute_model(train)
    for t in [*train, b"zebra the cab", b"cat\xc3\xa9", b"e"]:
        offs = np.array([0, len(t)])
        assert trie.score(np.frombuffer(t, np.uint8), offs)[0] == pytest.approx(brute_score(counts, t))


def test_probabilities_sum_to_one():
    counts = brute_model([lower(t) for t in TEXTS])
    trie = ppm.train_local([lower(t) for t in TEXTS])
    for context in (b"the c", b"zzzzz", b"\xff\xff\xff\xffa", b"a dog", b"zze c"):
        base = int.from_bytes(context, "big") << 8
        codes = np.arange(base, base + 256, dtype=np.uint64)
        assert np.exp2(trie.log2(codes)).sum() == pytest.approx(1)
        assert sum(brute_probability(counts, list(context), s) for s in range(256)) == 1


def _base(rows):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t)
    count, ends = Counter(), 0
    for t, held in rows:
        if not held:
            count.update(words(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    for t, _ in rows:
        yield len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + (ends > 0), n, sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in words(t)), ends])


def test_query_against_one_process(spark):
    out = ppm.op10_ppm_score(spark, f"{DATA}/sf0.001").toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", ppm.in_class("doc_id", 7, 2).alias("held")).toPandas().sort_values("doc_id")
    low = [lower(t) for t in docs.text]
    assert out.doc_id.tolist() == docs.doc_id.tolist() and out.held_out.tolist() == docs.held.tolist()
    trie = ppm.train_local([t for t, h in zip(low, docs.held, strict=True) if not h])
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    assert np.allclose(trie.score(np.frombuffer(b"".join(low), np.uint8), offs), out.score, rtol=1e-6)
    for got, want in zip(out.itertuples(), _base(list(zip(low, docs.held, strict=True))), strict=True):
        assert (got.n_tokens, got.n_known, got.train_tokens) == want[:3] and got.base_score == pytest.approx(want[3])
    size = sum(len(t) + 1 for t, h in zip(low, docs.held, strict=True) if h)
    assert -out[out.held_out].score.sum() / size < math.log10(2**4)  # under 4 bits a byte on unseen texts


def test_small_blocks_and_many_rounds(spark, docs, monkeypatch):
    """Many blocks, whose lists meet two at a time, give what one gives."""
    df = docs(*((k, t * (1 + k % 3)) for k, t in enumerate(TEXTS * 6))).withColumn("held", F.col("doc_id") % 5 == 1)
    plain = {(r["doc_id"], r["n_known"]): (r["score"], r["base_score"]) for r in ppm.score_corpus(df).collect()}
    for name, value in (("PART", 30), ("BLOCK", 120), ("FAN", 2), ("BITS", 1), ("FINER", 1)):
        monkeypatch.setattr(ppm, name, value)
    again = {(r["doc_id"], r["n_known"]): (r["score"], r["base_score"]) for r in ppm.score_corpus(df.repartition(3)).collect()}
    assert set(plain) == set(again) and len(plain) == 36
    for k, v in plain.items():
        assert again[k] == pytest.approx(v, rel=1e-6)


def test_texts_are_not_shuffled_again(spark, docs):
    """Answers go to where texts were written: only they are exchanged."""
    df = docs(*enumerate(TEXTS)).withColumn("held", F.lit(False))
    plan = ppm.score_corpus(df)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "text#" in x)
    assert "Bucketed: true" in scan
    assert not any("hashpartitioning(block" in x and "text" in x for x in plan.split("\n"))


def test_slices_hold_whole_contexts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**48, 5000, dtype=np.uint64))
    for bits in (1, 6, 9):
        lot = ppm.slice_of(ppm.GRAM, keys, bits)
        context = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
        assert lot.max() < 2**bits and all(len(set(lot[context == c])) == 1 for c in context[:50])
        assert (lot == ppm.slice_of(ppm.GRAM, keys, bits + 3) >> 3).all()


def test_edge_rows(docs):
    df = docs((1, None), (2, ""), (None, "abc"), (3, "abc"), (3, "abc"), (4, "ab " * 100_000), clash=("score", "block", "kind")).withColumn("held", F.col("doc_id") == 3)
    out = ppm.score_corpus(df).collect()
    assert len(out) == 6 and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert ppm.score_corpus(df.limit(0)).count() == 0


def test_without_training_rows_all_symbols_are_alike(docs):
    out = ppm.score_corpus(docs("abc").withColumn("held", F.lit(True))).first()
    assert out["score"] == pytest.approx(-4 * math.log10(256)) and out["train_tokens"] == 0 and out["n_known"] == 0
    assert out["base_score"] == 0.0


def test_lists_are_packed_and_summed():
    keys, counts = np.array([3, 9, 2**63], np.uint64), np.array([1, 0, 5])
    a, b = ppm.unpack(*ppm.pack(keys, counts))
    assert a.tolist() == keys.tolist() and b.tolist() == counts.tolist()
    got = ppm.add_lists([(keys, counts), (np.array([9, 1], np.uint64), np.array([4, 2]))])
    assert got[0].tolist() == [1, 3, 9, 2**63] and got[1].tolist() == [2, 1, 4, 5]
    assert [len(x) for x in ppm.add_lists([(keys[:0], counts[:0])])] == [0, 0]
