import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weirflow.llm import packing

DATA = "/root/testdata"

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=40))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 10)
    free: list[int] = []
    want = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if at is None:
            at = len(free)
            free.append(10)
        want[i] = (at, 10 - free[at])
        free[at] -= lengths[i]
    assert [want[i] for i in range(len(lengths))] == list(zip(bins, offsets, strict=True))


def test_pieces_that_do_not_fit():
    for lengths in ([11], [0]):
        with pytest.raises(ValueError, match="doesn't fit"):
            packing.first_fit_decreasing(lengths, 10)


def test_ids_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "It's a test", "éa ́b", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "a b\x85c", "x<|endoftext|>y <|startoftext|> z", "İstanbul ǅ ﬁ", "don't 'll we've", "1234 5", "🎉🎉 漢字"]
    ids, offs = packing.ChunkEncoder(PATH).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_capitals_with_marks():
    """NFC comes before lowering: J and a caron stay two characters, j and a caron become one."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"{a}x {c}{chr(m)}{b}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in range(0x300, 0x370) for a, b in (("", ""), ("(", "A-b"))]
    texts += ["J\u0323\u030c", "AJ\u030cJ", "T\u0344", "H", "\u0331h"]
    ids, offs = packing.ChunkEncoder(PATH).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], ascii(text)


def check(out, docs):
    """The contract of a packing: every id once, sequences gapless, little padding."""
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    used = 0
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 2048
        used += 1
    return out.length.sum() / (used * 2048)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = packing.op6_packing(spark, f"{DATA}/sf0.001").toPandas()
    assert check(out, docs) > 0.95


def test_small_groups_and_partitions(spark, docs):
    texts = [(k, "word " * (k * 37 % 3000)) for k in range(60)]
    df = docs(*texts).repartition(3)
    out = packing.pack(packing.pieces(df, PATH), group_pieces=10).toPandas()
    check(out, texts)
    assert out.sequence_id.nunique() > 5


def test_edge_rows(docs):
    df = docs((1, None), (2, ""), (None, "abc"), (3, "abc"), (3, "abc"), (4, "w " * 100_000), clash=("start", "lot", "__g"))
    out = packing.pack_documents(df, PATH).toPandas()
    assert len(out[out.doc_id == 3]) == 2 and len(out[out.doc_id.isna()]) == 1 and out[out.doc_id == 4].length.sum() == 100_001
    assert out[out.doc_id.isin([1, 2])].length.tolist() == [1, 1] and not out.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_packed_ids_are_put_out(docs):
    """Pieces and sequences hold the tokenizer's ids."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = [(k, f"Word {k} " * (k * 53 % 1900)) for k in range(40)]
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts}
    packed = packing.pack(packing.pieces(docs(*texts).repartition(3), PATH), group_pieces=16)
    for r in packed.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    seen = 0
    for r in packing.sequences(packed).collect():
        ids, at = np.frombuffer(r["ids"], "<u4").tolist(), 0
        assert len(ids) == r["length"] <= 2048
        for p in r["pieces"]:
            assert p["offset"] == at and ids[at : at + p["length"]] == want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            at += p["length"]
        assert at == len(ids)
        seen += at
    assert seen == sum(map(len, want.values()))


def test_ids_of_many_odd_texts():
    """Capitals before marks, case pairs, Unicode spaces and control tokens: the tokenizer's own ids."""
    rng = np.random.default_rng(6)
    encoder = packing.encoder_of(PATH)
    marks = [chr(c) for c in range(0x300, 0x370)]
    odd = ["İ", "ß", "ẞ", "Σ", "ς", "Å", "Å", "Ǆ", " ", " ", "　", "\x85", "​", "'", "’s", "'S", "'re", "é", "é", "가", "가", "٣", "½", "_", "ª"]
    added = [t.content for t in encoder.tokenizer.get_added_tokens_decoder().values()]
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + list(" \n\t0.,-#")
    texts = []
    for _ in range(10_000):
        parts = []
        for _ in range(rng.integers(1, 9)):
            kind = rng.integers(20)
            parts.append(str(rng.choice(letters)) + (str(rng.choice(marks)) if kind < 7 else "") if kind < 15 else str(rng.choice(odd)) if kind < 19 else str(rng.choice(added or ["<|x|>"])))
        texts.append("".join(parts))
    ids, offs = encoder.encode(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1] - 1].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)
