import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_op01_langid import brute_dictionaries, brute_language
from test_op03_quality import brute, slow_features
from test_op07_neardup import bag, brute_classes
from tokenizers import Tokenizer

from weirflow.llm import neardup, packing, quality, secret_scan

DATA = "/root/testdata"

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    """Each stage works on what the one before it kept, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, seen[-1], SF), name.replace(" ", "-"))
        seen.append(out)
    assert len(corpus_pipeline.STAGES) == 5 and all(d.columns == columns for d in seen[:-1])
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] > 0 and counts[1] > counts[2] > counts[3] == counts[4]
    judged = quality.assess(seen[1], quality.fit(seen[1], spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").count()
    assert counts[2] == judged
    assert neardup.classes(seen[3]).where("class_size > 1").count() == 0
    assert secret_scan.scan(seen[4]).where("spans <> ''").count() == 0
    packed = seen[5].toPandas()
    assert set(packed.doc_id) == {r["doc_id"] for r in seen[4].select("doc_id").collect()}
    again = packing.pieces(seen[4], public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert sorted(packed.ids_crc32) == sorted(again.ids_crc32)


def test_run_by_brute_force(spark):
    """The rows that run() gives, made anew from the documents text by text."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()]
    made = brute_dictionaries([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1])
    rows = [(i, t) for i, t, _ in rows if brute_language(t, made)[2]]
    left = frame.where(frame.doc_id.isin([i for i, _ in rows]))
    chain = quality.fit(left, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text):
        n_words, *_, n_repeat = brute(text)[:5]
        if n_words < 50 or 100 * n_repeat > 50 * n_words:
            return False
        lines = quality.lines_of(pa.array([text], pa.large_string()))
        lines.features = slow_features(text)
        sizes = np.array([len(x) for x in text.split("\n")])
        return sizes[chain.viterbi(lines)].sum() >= quality.MIN_SHARE * sizes.sum() > 0

    rows = [(i, t) for i, t in rows if good(t)]
    least = dict(brute_classes(rows))
    rows = [(i, secret_scan.redact(t)) for i, t in rows if least[i] == i or not bag(t)]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = np.array(ids[at : at + 2048], "<u4")
            want[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want and want
    ends = Counter()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def test_edge_rows(spark, docs):
    """Null ids and texts, repeated rows and clashing columns go through every stage."""
    text = "\n".join(f"some plain words of line {k} that are not like those of other lines" for k in range(12))
    frame = docs((None, text), (1, text), (1, text), (90_002, None), (90_003, ""), (4, text + " end"), clash=("node", "label", "ids", "kept"))
    frame = frame.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60), allowMissingColumns=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, frame, SF), f"edge{k}")
        assert k == 4 or out.columns == frame.columns
        frame = out
    assert frame.where("doc_id in (90002, 90003)").count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_the_last_stage_gives_training_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.packing_stage(spark, docs, SF)
    ids = [r["ids"] for r in packing.sequences(out).collect()]
    assert ids and sum(map(len, ids)) == 4 * out.agg({"length": "sum"}).first()[0]
