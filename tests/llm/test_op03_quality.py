import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import quality

DATA = "/root/testdata"

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(text):
    text = text or ""
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_of_all_documents(spark):
    out = quality.op3_quality_rules(spark, f"{DATA}/sf0.01").toPandas()
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    for r in both.itertuples():
        assert tuple(getattr(r, n) for n in NAMES) == brute(r.text), r.doc_id
    assert not (both.kept & both.base_failed).any()
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").toPandas()
    judged = both.merge(labels, on="doc_id")
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good[~good.base_failed].kept.mean() >= 0.97 and bad.kept.mean() <= 0.2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t\x0b\x85 #%|"), max_size=40)), min_size=1, max_size=5))
def test_counts_of_any_texts(texts):
    counts = quality.lines_of(pa.array(texts, pa.string())).counts
    for k, text in enumerate(texts):
        assert tuple(int(counts[n][k]) for n in NAMES[:5]) == brute(text)[:5]


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    texts = ["\n".join("".join(rng.choice(list("ab A#.1")) for _ in range(rng.integers(0, 12))) for _ in range(rng.integers(1, 7))) for _ in range(20)]
    lines = quality.lines_of(pa.array(texts))
    for _ in range(3):
        chain = quality.Chain(rng.normal(size=(2, quality.N_FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
        got = chain.viterbi(lines).astype(int)
        scores = lines.features @ chain.emit.T
        for a, b in itertools.pairwise(lines.first):
            value = lambda y: chain.start[y[0]] + sum(scores[a + k, s] for k, s in enumerate(y)) + sum(chain.move[x, z] for x, z in itertools.pairwise(y))  # noqa: B023, E731
            best = max(value(y) for y in itertools.product((0, 1), repeat=b - a))
            assert value(tuple(got[a:b])) == pytest.approx(best)


def test_training_climbs_the_likelihood():
    good = ["plain words in a row\nand more of them here"] * 4 + ["a line of words"]
    bad = ["### $$$ ***\n||| %%% <<<"] * 4 + ["&& ## $$"]
    chain = quality.train(good + bad, [1] * 5 + [0] * 5)
    share = chain.share(quality.lines_of(pa.array([*good, *bad])))
    assert (share[:5] == 1).all() and (share[5:] == 0).all()
    assert quality.train(good, [1] * 5) is quality.DEFAULT_CHAIN


def test_verdicts_of_edge_texts():
    clean = " ".join(f"word{k}" for k in range(60))
    out = quality.verdicts(pa.array([None, "", clean, clean + "\n" + clean, "x " * 80, "\n" * 500]), quality.DEFAULT_CHAIN)
    assert out["kept"].tolist() == [False, False, True, False, False, False]
    assert out["base_failed"].tolist() == [True, True, False, True, True, True]


def test_edge_rows(spark, docs):
    clean = " ".join(f"word{k}" for k in range(60))
    long = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(200_000))
    df = docs((1, None), (2, ""), (None, clean), (3, clean), (3, clean), (4, long), clash=("kept", "n_words"))
    out = quality.assess(df, quality.DEFAULT_CHAIN).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in out) == [("1", 0), ("2", 0), ("3", 60), ("3", 60), ("4", 200_000), ("None", 60)]
    kept = quality.keep_good(df, quality.DEFAULT_CHAIN)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "4", "None"]
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(df, labels).emit.shape == (2, quality.N_FEATURES)
    assert quality.fit(df.limit(0), labels) is quality.DEFAULT_CHAIN and quality.assess(df.limit(0), quality.DEFAULT_CHAIN).count() == 0


def test_training_covers_all_lines():
    """Documents that differ after their first 40 lines only are told apart."""
    head = "\n".join(f"plain words here {k}" for k in range(40))
    good = [head + "\n" + "\n".join(f"and more {d} them {k}" for k in range(80)) for d in range(5)]
    bad = [head + "\n" + "\n".join(f"### $$$ {d} *** {k}" for k in range(80)) for d in range(5)]
    chain = quality.train(good + bad, [1] * 5 + [0] * 5)
    share = chain.share(quality.lines_of(pa.array([*good, *bad])))
    assert (share[:5] > 0.9).all() and (share[5:] < 0.5).all()


def test_likelihood_and_gradient_by_brute_force():
    texts, good, noise = ["a b\n## 1\nC", "$$ %\nx", "word and word\n!!\n\n&& 12\nend"], [1, 0, 1], (0.1, 0.3)
    lines, weight = quality.lines_of(pa.array(texts)), [0.25, 0.5, 0.25]

    def likelihood(theta):
        emit, move, start = theta[: 2 * quality.N_FEATURES].reshape(2, -1), theta[2 * quality.N_FEATURES : -2].reshape(2, 2), theta[-2:]
        s, out = lines.features @ emit.T, 0.0
        for (a, b), y, w in zip(itertools.pairwise(lines.first), good, weight, strict=True):
            value = lambda z: start[z[0]] + sum(s[a + k, q] for k, q in enumerate(z)) + sum(move[p, q] for p, q in itertools.pairwise(z))  # noqa: B023, E731
            channel = lambda z: sum(np.log({(1, 0): 0.1, (0, 0): 0.9, (1, 1): 0.7, (0, 1): 0.3}[y, q]) for q in z)  # noqa: B023, E731
            every = list(itertools.product((0, 1), repeat=b - a))
            out += w * (np.logaddexp.reduce([value(z) + channel(z) for z in every]) - np.logaddexp.reduce([value(z) for z in every]))
        return out

    theta = np.random.default_rng(1).normal(size=2 * quality.N_FEATURES + 6) / 2
    value, gradient = quality.likelihood(theta, quality._laid(texts, good), noise)
    assert value == pytest.approx(likelihood(theta))
    unit = np.eye(len(theta)) * 1e-5
    assert gradient == pytest.approx(np.array([likelihood(theta + u) - likelihood(theta - u) for u in unit]) / 2e-5, abs=1e-6)


def test_planted_boilerplate_is_told_apart_by_lines(spark):
    """Documents of half content and half boilerplate, of lines that no training document holds."""
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{DATA}/sf0.1/documents.parquet' JOIN '{DATA}/sf0.1/labels.parquet' USING (doc_id) WHERE length(text) BETWEEN 200 AND 8000 ORDER BY doc_id").fetchall()
    chain = quality.train([t for i, t, _ in rows if i % 3][:1000], [q for i, _, q in rows if i % 3][:1000])
    lines = lambda q: [x for i, t, k in rows if not i % 3 and k == q for x in t.split("\n") if len(x) > 40]
    content = lines(1)
    junk = [x for x in lines(0) if sum(c in "#$%&*|!" for c in x) > len(x.split()) / 2]
    rng, texts, truth = np.random.default_rng(5), [], []
    for _ in range(300):
        parts = [(x, 1) for x in rng.choice(content, 3)] + [(x, 0) for x in rng.choice(junk, 3)]
        parts = parts if rng.integers(2) else parts[::-1]
        texts.append("\n".join(x for x, _ in parts))
        truth += [y for _, y in parts]
    got, truth = chain.viterbi(quality.lines_of(pa.array(texts, pa.large_string()))), np.array(truth, bool)
    precision, recall = (~got & ~truth).sum() / (~got).sum(), (~got & ~truth).sum() / (~truth).sum()
    assert precision > 0.95 and recall > 0.95, (precision, recall)


def test_documents_of_the_table_hold_both_states(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    chain = quality.fit(docs, spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    lines = quality.lines_of(pa.array([r["text"] for r in docs.select("text").collect()], pa.large_string()))
    content, n = np.bincount(lines.doc, chain.viterbi(lines), len(lines.first) - 1), np.diff(lines.first)
    assert ((content > 0) & (content < n)).sum() >= 20


def slow_features(text):
    """Features of each line, by words and characters."""
    words = re.compile(r"[^\x20\x09-\x0D]+")
    every = words.findall(text)
    triples = [tuple(every[k : k + 3]) for k in range(len(every) - 2)]
    times = Counter(triples)
    repeated = {k + j for k, t in enumerate(triples) if times[t] > 1 for j in range(3)}
    out, seen = [], set()
    for line in text.split("\n"):
        own = words.findall(line)
        n, size = max(len(own), 1), max(len(line), 1)
        marks = [sum(c in group for c in line) for group in ("#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?;:_=+~^/\\{}[]()\"'@`", ".,")]
        dup = bool(own) and line in seen
        if own:
            seen.add(line)
        again = sum(a == b for a, b in itertools.pairwise(own))
        out.append([1, min(marks[0] / n, 1.5), marks[1] / size, marks[2] / size, min(marks[3] / n, 1.5), min(marks[4] / n, 1.5), np.log1p(len(own)) / 5, min(len(line) / n, 20) / 10, 1 - len(set(own)) / n, again / n, dup, len(repeated) / max(len(every), 1)])
    return np.array(out, float)


def test_kept_of_the_query_by_brute_force(spark):
    """Counts, Viterbi and share are made anew for each document, from its characters."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    chain = quality.fit(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    checked = 0
    for r in quality.op3_quality_rules(spark, f"{DATA}/sf0.001").collect():
        text = texts[r["doc_id"]]
        n_words, *_, n_repeat = brute(text)[:5]
        failed = n_words < 50 or 100 * n_repeat > 50 * n_words
        s = slow_features(text) @ chain.emit.T
        best = [{k: (chain.start[k] + s[0, k], (k,)) for k in (0, 1)}]
        for row in s[1:]:
            best.append({k: max((best[-1][j][0] + chain.move[j, k] + row[k], (*best[-1][j][1], k)) for j in (0, 1)) for k in (0, 1)})
        path = max(best[-1].values())[1]
        sizes = [len(x) for x in text.split("\n")]
        share = sum(c for c, k in zip(sizes, path, strict=True) if k) / sum(sizes) if sum(sizes) else 0.0
        assert r["content_share"] == pytest.approx(share) and r["base_failed"] == failed
        assert r["kept"] == (not failed and share >= quality.MIN_SHARE)
        checked += 1
    assert checked > 150


def test_repeated_ids_give_one_model(spark, docs):
    df = docs((1, "plain words in a row"), (1, "### $$$ ***"), (2, "### $$$ *** ##"), (2, "more of the words"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    first = quality.fit(df.repartition(3), labels)
    again = quality.fit(df.orderBy("text").repartition(2), labels.orderBy(F.desc("quality")))
    assert (first.emit == again.emit).all() and (first.move == again.move).all()


def test_the_sample_is_of_documents_that_are_there(spark, docs):
    df = docs((1, "plain words in a row"), (2, "### $$$ ***"), (3, None))
    labels = spark.createDataFrame([(k, int(k != 2), 0) for k in range(1, 200)], "doc_id long, quality int, toxic int")
    assert quality.fit(df, labels, sample=2) is not quality.DEFAULT_CHAIN
