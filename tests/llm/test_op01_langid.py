import struct
import zlib

import pytest
import xxhash
import zstandard

from weirflow.llm import langid

DATA = "/root/testdata"

SF = f"{DATA}/sf0.01"
LATIN = {"aa": ("the house and the garden of the old man " * 40).encode(), "bb": ("das haus und der garten des alten mannes " * 40).encode()}


def test_held_out_accuracy(spark):
    out = langid.op1_language_id(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = out.merge(truth, on="doc_id")
    assert len(out) == len(truth) and set(out.lang_pred) <= {*truth.lang, "und"} and out.score.between(0, 1).all()
    held = both[both.held_out & (both.text.str.split().str.len() >= 20)]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.98
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))


def hashed(doc_id, text):
    """Spark's xxhash64 of (id, text)."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), seed=first)))[0]


def brute_dictionaries(rows, snippets=64, chars=1024, most=96 << 10):
    """From (doc_id, text, lang): the first snippets by hash that fit, whole."""
    out, by = {}, {}
    for i, t, lang in rows:
        if lang is not None and t and any(c.isalpha() for c in t):
            by.setdefault(lang, []).append((hashed(i, t), t))
    for lang, found in by.items():
        parts, size = [], 0
        for h, t in sorted(found)[:snippets]:
            at = h % (max(len(t) - chars, 0) + 1)
            part = t[at : at + chars].lower().encode() + b"\n"
            if part not in parts and size + len(part) <= most:
                parts.append(part)
                size += len(part)
        out[lang] = b"".join(parts)
    return out


def brute_language(text, dictionaries):
    """(language, score, accepted) by coding each block with each dictionary."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    size = {}
    for lang, content in sorted(dictionaries.items()):
        coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        size[lang] = sum(len(coder.compress(text[k : k + 4096].lower().encode())) for k in range(0, len(text), 4096))
    best = min(size, key=lambda x: (size[x], x))
    second = sorted(size.values())[1]
    score = 1 / sum(2.0 ** -min((n - size[best]) / 2, 200) for n in size.values())
    return best, score, second > size[best] and second - size[best] >= 0.005 * second


def test_query_by_brute_force(spark):
    """Dictionaries and code lengths are made anew for each document."""
    small = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    made = brute_dictionaries([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1])
    got = {r["doc_id"]: r for r in langid.op1_language_id(spark, small).collect()}
    assert len(got) == len(rows) and len(made) == 4
    for i, t, _ in rows:
        lang, score, accepted = brute_language(t, made)
        assert (got[i]["lang_pred"], bool(got[i]["accepted"])) == (lang, accepted) and got[i]["score"] == pytest.approx(score)


def test_dictionaries_hold_whole_snippets():
    assert brute_dictionaries([(1, "é" * 30, "xx"), (2, "ü" * 30, "xx")], chars=30, most=70)["xx"] in {("é" * 30 + "\n").encode(), ("ü" * 30 + "\n").encode()}


def test_sizes_are_those_of_the_coder():
    model = langid.Classifier(LATIN, block_chars=100)
    texts = ["The garden " * 30, "der garten", ""]
    for text, row in zip(texts, model.sizes(texts), strict=True):
        for content, got in zip(LATIN.values(), row, strict=True):
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            assert got == sum(len(coder.compress(text[k : k + 100].lower().encode())) for k in range(0, len(text), 100))


def test_rejection_and_empty_texts():
    model = langid.Classifier(LATIN)
    langs, score, ok = model.predict(["the garden of the old man", "der garten des alten mannes", None, "", " 12 !? ", "zzz"])
    assert langs[:5] == ["aa", "bb", "und", "und", "und"] and list(ok[:5]) == [True, True, False, False, False]
    assert list(score[2:5]) == [0, 0, 0] and langs[5] == "aa" and not ok[5]  # equal sizes: the first, and rejected
    assert langid.Classifier({}).predict(["abc"])[0] == ["und"]
    one = langid.Classifier({"aa": LATIN["aa"]}).predict(["the garden"])
    assert one[0] == ["aa"] and one[1][0] == 1 and one[2][0]


def test_edge_rows(spark, docs):
    df = docs((1, None), (1, None), (None, "the house"), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), clash=("score", "accepted"))
    out = langid.identify(df, LATIN).collect()
    assert len(out) == 6 and [r["lang_pred"] for r in out].count("und") == 3
    kept = langid.keep_identified(df, LATIN)
    assert kept.columns == df.columns and all(r["text"] for r in kept.collect())
    none = df.limit(0)
    assert langid.fit(none) == {} and langid.identify(none, LATIN).count() == 0


def test_the_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (langid.fit(r, snippets=5, snippet_chars=100, dict_bytes=400) for r in (rows, rows.repartition(7)))
    assert a == b and set(a) == {"de", "en", "es", "fr"} and all(len(v) <= 400 for v in a.values())
