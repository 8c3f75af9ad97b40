import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weirflow.llm import neardup

DATA = "/root/testdata"

WHITE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def bag(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.translate(WHITE).split(" ") if w]
    return Counter([tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else []))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_classes(rows):
    """Class of each row position: least id of the component."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    where: dict = {}
    for k, b in enumerate(bags):
        for w in b:
            where.setdefault(w, []).append(k)
    pairs = {p for ks in where.values() for p in itertools.combinations(ks, 2)}
    for x, y in pairs:
        if jaccard(bags[x], bags[y]) >= 0.8:
            parent[root(max(x, y))] = root(min(x, y))
    for (i, (_, s)), (j, (_, t)) in itertools.combinations(enumerate(rows), 2):
        if s == t and s is not None and bag(s):
            parent[root(j)] = root(i)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return [(i, least[root(k)]) for k, (i, _) in enumerate(rows)]


def test_classes_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.op7_near_duplicates(spark, f"{DATA}/sf0.001").collect())
    assert got == sorted(brute_classes(rows)) and any(i != c for i, c in got)


def _edited(rng, words, share):
    out = list(words)
    for k in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[k] = f"new{rng.integers(10**6)}"
    return " ".join(out)


def test_planted_copies(docs):
    """Copies near and far from the threshold, chains of copies, and a large group."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        words = [f"w{rng.integers(5000)}" for _ in range(rng.integers(60, 300))]
        texts.append(" ".join(words))
        texts += [_edited(rng, words, s) for s in (0.005, 0.015, 0.03, 0.06)]
    words = [f"c{rng.integers(5000)}" for _ in range(400)]
    for _ in range(12):  # each one changed from the one before
        texts.append(" ".join(words))
        words = _edited(rng, words, 0.01).split(" ")
    base = [f"g{rng.integers(5000)}" for _ in range(200)]
    texts += [_edited(rng, base, 0.004) for _ in range(150)] + [" ".join(base)] * 50
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(docs(*rows).repartition(6)).collect())
    want = sorted(brute_classes(rows))
    sizes = Counter(c for _, c in want)
    assert got == [(i, c, sizes[c]) for i, c in want]


def test_multiplicities_count(docs):
    many, few = "a b c d e " * 30 + " ".join(f"x{k}" for k in range(20)), "a b c d e " * 4 + " ".join(f"x{k}" for k in range(20))
    assert jaccard(bag(many), bag(few)) < 0.8
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(many, few, many + " tail")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    for repeat in (1, 3):
        words = [f"w{rng.integers(40)}" for _ in range(150)]
        a, b = " ".join(words * repeat), " ".join((words[:110] + [f"v{k}" for k in range(40)]) * repeat)
        want = jaccard(bag(a), bag(b))
        doc, key = neardup.shingles(pa.array([a, b]))
        times = neardup.bag_minhash(*neardup.bags(doc, key), 2, 4096)
        got = (times[0] == times[1]).mean()
        assert abs(got - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_overlap_is_that_of_multisets():
    texts = ["a b c d e f " * 5, "a b c d e f " * 3 + "g h", "x y", "", None, "X  y"]
    arrays = [np.frombuffer(b, np.uint64) for b in neardup.bag_arrays(pa.array(texts))[0]]
    for i, j in itertools.combinations(range(3), 2):
        assert neardup.overlap(arrays[i], arrays[j]) == jaccard(bag(texts[i]), bag(texts[j]))
    assert neardup.overlap(arrays[2], arrays[5]) == 1.0 and neardup.overlap(arrays[3], arrays[4]) == 0.0


def test_components(spark):
    def node(k):
        return bytes([k // 256, k % 256])

    edges = [(k, k + 1) for k in range(40)] + [(100, 120), (120, 110), (7, 7), (200, 201), (201, 202), (202, 200)]
    frame = spark.createDataFrame([(bytearray(node(a)), bytearray(node(b))) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(frame).collect()}
    want = {node(k): node(0) for k in range(41)} | {node(k): node(100) for k in (100, 110, 120)} | {node(k): node(200) for k in (200, 201, 202)}
    assert got == want


def test_stars_in_blocks(docs, monkeypatch):
    """A star that is compared in several blocks gives what one block gives."""
    monkeypatch.setattr(neardup, "STAR_BYTES", 4000)
    test_planted_copies(docs)


def test_keep_one(docs):
    text = " ".join(f"w{k}" for k in range(50))
    df = docs((5, text), (3, text), (3, text), (4, text + " x"), (None, text), (8, None), (9, None), (9, ""), (10, "other words here"), clash=("node", "label", "__n"))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.fillna("null", "text").collect()) == sorted([("3", text), ("8", "null"), ("9", "null"), ("9", ""), ("10", "other words here")])


def test_edge_rows(docs):
    long = " ".join(f"w{k}" for k in range(100_000))
    df = docs((1, None), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"), clash=("class_id", "band"))
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 4, 2), (6, 6, 1), (7, 7, 2), (8, 7, 2)]
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0
    assert neardup.classes(df.where(F.col("doc_id") <= 2)).count() == 3


def test_a_large_star_of_strays_is_parted(docs, monkeypatch):
    """Documents with one passage in common share buckets; few of their pairs are compared."""
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(120)]
    texts = [" ".join(passage + [f"w{rng.integers(10**6)}" for _ in range(180)]) for _ in range(240)]
    texts += [_edited(rng, texts[k].split(" "), 0.012) for k in range(0, 240, 10)]
    rows = list(enumerate(texts))
    compared, deeper = [], neardup._deeper

    def counted(large):
        entries = deeper(large)
        compared.append((large.select("node").distinct().count(), entries.groupBy("band").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]))
        return entries

    monkeypatch.setattr(neardup, "STAR_BYTES", 40_000)
    monkeypatch.setattr(neardup, "_deeper", counted)
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(docs(*rows).repartition(4)).collect())
    assert got == sorted(brute_classes(rows))
    (nodes, pairs), = compared
    assert nodes > 30 and (pairs or 0) < nodes * (nodes - 1) / 2 / 5


def test_hot_texts_and_repeated_rows(docs, spark):
    """Copies that are half of all rows, with ids that repeat and are null."""
    text, near = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(79)) + " other"
    rows = [(k % 90, text) for k in range(300)] + [(None, text)] * 5 + [(500 + k, f"{k} some words of its own {k} and {k}") for k in range(200)] + [(900, near)]
    df = docs(*rows).repartition(6)
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(df).collect())
    assert got == Counter([(i, 0, 306) if t in (text, near) else (i, i, 1) for i, t in rows])
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(500, 700)]
