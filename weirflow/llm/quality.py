"""Quality rules and a linear-chain conditional random field over lines.

Each line of a document gets features; a two-state chain (boilerplate 0, content 1) is decoded by
Viterbi. A document is kept if the share of characters in content lines reaches a threshold and
the counting rules don't fail it. Only documents are labelled, so the states of lines are hidden
in training: a good document may hold boilerplate and a bad one content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, frugal, mix, scan_words, windows

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASSES = np.zeros((6, 256), np.uint8)
_CLASSES[0] = _SYMBOL
_CLASSES[1, [ord(c) for c in "0123456789"]] = 1
_CLASSES[2, 65:91] = 1
_CLASSES[3, [ord(c) for c in "!?;:_=+~^/\\{}[]()\"'@`"]] = 1
_CLASSES[4, [ord(c) for c in ".,"]] = 1
_CLASSES[5, :] = 1
_CLASSES[5, 0x80:0xC0] = 0  # starts of code points
_INK = _CLASSES[5].copy()  # of those, the ones that stand in words
_INK[[32, 9, 10, 11, 12, 13]] = 0
N_FEATURES = 12
#: Bytes of text that are worked on at once.
PART = 2 << 20


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive edges (empty ranges are 0)."""
    if not len(values):
        return np.zeros(len(edges) - 1, np.int64)
    total = np.zeros(len(edges) - 1, np.int64)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, edges[full], dtype=np.int64)
    return total


@dataclass
class Lines:
    """Line features and counts of a block of documents."""

    features: np.ndarray
    chars: np.ndarray  # code points of each line
    doc: np.ndarray
    first: np.ndarray  # each document's first line; n + 1 entries
    counts: dict[str, np.ndarray] = field(default_factory=dict)


def lines_of(column: pa.Array) -> Lines:
    """Features of each \\n-split line and the base counts of each document; nulls are empty."""
    words = scan_words(column)
    data, offs, n = words.data, words.doc_offsets, len(words.doc_offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # a line begins at each document's start and after each \n
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offs)) + 1)
    first = np.searchsorted(doc, np.arange(n + 1))
    edges = np.append(starts, offs[-1])
    per = np.stack([_sums(c[data], edges) for c in _CLASSES])
    ends = edges[1:].copy()
    ended = np.zeros(len(starts), bool)
    if len(breaks):
        at = np.searchsorted(starts, breaks, "right") - 1
        ended[at[(breaks >= starts[at])]] = True
    chars = per[5] - ended
    # words of each line
    word_first = np.searchsorted(words.start, edges)
    n_words = np.diff(word_first)
    hashes = words.hashes()
    # distinct words of each line
    line_of_word = np.repeat(np.arange(len(starts)), n_words)
    distinct = np.zeros(len(starts), np.int64)
    repeats = np.zeros(len(starts), np.int64)
    if len(hashes):
        keyed = mix(hashes ^ mix(line_of_word.astype(U64)))
        _, at = np.unique(keyed, return_index=True)
        distinct = np.bincount(line_of_word[at], minlength=len(starts))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        repeats = np.bincount(line_of_word[again], minlength=len(starts))
    # lines equal to an earlier line of the document; equality is by the text between breaks
    dup = np.zeros(len(starts), bool)
    seen: set[bytes] = set()
    view, current = data.tobytes(), -1
    has = np.flatnonzero(n_words > 0)
    for k, owner, a, b in zip(has.tolist(), doc[has].tolist(), starts[has].tolist(), (ends - ended)[has].tolist(), strict=True):
        if owner != current:
            current, seen = owner, set()
        line = view[a:b]
        if line in seen:
            dup[k] = True
        else:
            seen.add(line)
    word_chars = _sums(_INK[data], offs)
    at, key = windows(words, hashes, 3)
    covered = np.zeros(len(hashes) + 1, bool)
    if len(at):
        keyed = mix(key ^ mix(words.doc[at].astype(U64) + U64(7)))
        _, inverse, count = np.unique(keyed, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        for k in range(3):
            covered[twice + k] = True
    n_doc_words = np.diff(words.first)
    counts = {
        "n_words": n_doc_words,
        "word_chars": word_chars,
        "n_symbols": _sums(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(doc[dup], minlength=n)[:n] if n else np.zeros(0, np.int64),
        "n_repeat_words": _sums(covered[:-1].astype(np.uint8), words.first),
    }
    size = np.maximum(chars, 1).astype(np.float64)
    many = np.maximum(n_words, 1).astype(np.float64)
    doc_dup = counts["n_repeat_words"] / np.maximum(n_doc_words, 1)
    features = np.stack(
        [
            np.ones(len(starts)),
            np.minimum(per[0] / many, 1.5),
            per[1] / size,
            per[2] / size,
            np.minimum(per[3] / many, 1.5),
            np.minimum(per[4] / many, 1.5),
            np.log1p(n_words) / 5,
            np.minimum(chars / many, 20) / 10,
            1 - distinct / many,
            repeats / many,
            dup.astype(np.float64),
            doc_dup[doc] if n else np.zeros(0),
        ],
        axis=1,
    )
    return Lines(features, chars, doc, first, counts)


# ---------------------------------------------------------------- the chain
@dataclass
class Chain:
    """Weights of a two-state linear chain: emissions (2, features), transitions (2, 2), start (2)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, lines: Lines) -> np.ndarray:
        """The best state of each line; a tie goes to content."""
        scores = lines.features @ self.emit.T
        n = len(scores)
        out = np.ones(n, bool)
        s0, s1 = scores[:, 0].tolist(), scores[:, 1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        start0, start1 = self.start.tolist()
        first = lines.first.tolist()
        back = [(True, True)] * n
        for d in range(len(first) - 1):
            a, b = first[d], first[d + 1]
            if a == b:
                continue
            v0, v1 = start0 + s0[a], start1 + s1[a]
            for k in range(a + 1, b):
                x00, x10, x01, x11 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
                back[k] = (x10 >= x00, x11 >= x01)
                v0, v1 = (x10 if x10 >= x00 else x00) + s0[k], (x11 if x11 >= x01 else x01) + s1[k]
            state = v1 >= v0
            for k in range(b - 1, a, -1):
                out[k] = state
                state = back[k][1] if state else back[k][0]
            out[a] = state
        return out

    def share(self, lines: Lines) -> np.ndarray:
        """The share of each document's characters in content lines; 0 without characters."""
        content = self.viterbi(lines)
        n = len(lines.first) - 1
        total = np.bincount(lines.doc, lines.chars, n)[:n] if n else np.zeros(0)
        good = np.bincount(lines.doc[content], lines.chars[content], n)[:n] if n else np.zeros(0)
        return np.where(total > 0, good / np.maximum(total, 1), 0.0)


#: Used where no labels are given: symbols, capitals and repetition speak for boilerplate.
DEFAULT_CHAIN = Chain(np.stack([np.array([-2.5, 4, 4, 5, 4, 0, 0, 0, 2, 4, 1.5, 4]) / 2, -np.array([-2.5, 4, 4, 5, 4, 0, 0, 0, 2, 4, 1.5, 4]) / 2]), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


@dataclass
class _Laid:
    """Lines of several documents, laid by their number and then by document, longest first."""

    x: np.ndarray
    owner: np.ndarray
    last: np.ndarray
    ranges: list[slice]
    good: np.ndarray  # label of each document
    weight: np.ndarray
    scale: float


def _laid(texts: list[str], good: list[int]) -> _Laid:
    lines = lines_of(pa.array(texts, pa.large_string()))
    y_doc = np.array(good)
    lengths, starts = np.diff(lines.first), lines.first[:-1]
    longest_first = np.argsort(-lengths, kind="stable")
    lengths, starts, y = lengths[longest_first], starts[longest_first], y_doc[longest_first]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # a text has one line at least
    edge = np.append(0, np.cumsum(active))
    x = lines.features[np.concatenate([starts[:m] + k for k, m in enumerate(active.tolist())])]
    owner = np.concatenate([np.arange(m) for m in active.tolist()])
    last = edge[lengths - 1] + np.arange(len(lengths))
    ranges = [slice(i, j) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # classes weigh the same
    return _Laid(x, owner, last, ranges, y, weight, max(1.0, lengths.mean()))


def _expected(s: np.ndarray, move: np.ndarray, start: np.ndarray, laid: _Laid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z of each document, probabilities of each line's states, and weighted expected moves."""
    ranges, weight = laid.ranges, laid.weight
    alpha = s.copy()
    alpha[ranges[0]] += start
    for before, at in zip(ranges, ranges[1:], strict=False):
        old = alpha[before][: at.stop - at.start]
        alpha[at] += np.logaddexp(old[:, :1] + move[0], old[:, 1:] + move[1])
    log_z = np.logaddexp(alpha[laid.last, 0], alpha[laid.last, 1])
    beta, moves = np.zeros_like(alpha), np.zeros_like(move)
    for before, at in zip(ranges[-2::-1], ranges[:0:-1], strict=True):
        n = at.stop - at.start
        old, into = alpha[before][:n], s[at] + beta[at]
        pair = np.exp(old[:, :, None] + move + into[:, None, :] - log_z[:n, None, None])
        moves += (pair * weight[:n, None, None]).sum(0)
        beta[before][:n] = np.logaddexp(move[:, 0] + into[:, :1], move[:, 1] + into[:, 1:])
    return log_z, np.exp(alpha + beta - log_z[laid.owner, None]), moves


def likelihood(theta: np.ndarray, laid: _Laid, noise: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Weighted log likelihood of the labels and its gradient.

    States of lines are hidden. A document's label is seen at each line through a noisy channel:
    ``noise`` are the chances that a boilerplate line stands in a good document, and that a content
    line stands in a bad one. The likelihood is log Z with the channel less log Z without.
    """
    emit, move, start = theta[: 2 * N_FEATURES].reshape(2, -1), theta[2 * N_FEATURES : -2].reshape(2, 2), theta[-2:]
    stray, lost = noise
    channel = np.log(np.array([[1 - stray, lost], [stray, 1 - lost]]))  # by label, then state
    s = laid.x @ emit.T
    free, free_state, free_move = _expected(s, move, start, laid)
    seen, seen_state, seen_move = _expected(s + channel[laid.good[laid.owner]], move, start, laid)
    diff = (seen_state - free_state) * laid.weight[laid.owner, None]
    gradient = np.concatenate([(diff.T @ laid.x).ravel(), (seen_move - free_move).ravel(), diff[laid.ranges[0]].sum(0)])
    return float(((seen - free) * laid.weight).sum()), gradient


#: Chances of a boilerplate line in a good document, and of a content line in a bad one.
NOISE = (0.1, 0.3)


def train(texts: list[str], good: list[int], *, rounds: int = 100, rate: float = 0.5, decay: float = 1e-4, move_decay: float = 0.1, noise: tuple[float, float] = NOISE) -> Chain:
    """Maximum marginal likelihood of the documents' labels by full-batch Adam over all lines of all
    texts; states of lines are hidden (``likelihood``). One class alone gives ``DEFAULT_CHAIN``.

    All lines of a document see the same label, which moves alone could explain: their prior
    (``move_decay``) is the stronger one, so that a line's own features tell it apart.
    """
    if len(set(good)) < 2:
        return DEFAULT_CHAIN
    laid = _laid(texts, good)
    theta = np.zeros(2 * N_FEATURES + 6)
    pull = np.append(np.full(2 * N_FEATURES, decay), np.full(6, move_decay))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        gradient = likelihood(theta, laid, noise)[1] / laid.scale - pull * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / (1 + t / 25)
    return Chain(theta[: 2 * N_FEATURES].reshape(2, -1).copy(), theta[2 * N_FEATURES : -2].reshape(2, 2).copy(), theta[-2:].copy())


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 1500, most_chars: int = 20000) -> Chain:
    """A chain from a bounded sample of labelled documents that ``docs`` has with a text.

    The sample is the ``sample`` smallest by a hash of the id among labelled texts of at most
    ``most_chars`` characters, whole; longer texts aren't learned from. Both bounds are for the
    driver, which the sample reaches. Of repeated ids the least text and the least label count;
    null ids, texts and labels are left out.
    """
    texts = docs.where(F.length("text") <= most_chars).select("doc_id", "text")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") != 0).cast("int").alias("good"))
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["good"] for r in rows])


#: Documents below this share of content characters are rejected.
MIN_SHARE = 0.5


def verdicts(column: pa.Array, chain: Chain, *, min_words: int = 50, max_repeat: int = 50, min_share: float = MIN_SHARE) -> dict[str, np.ndarray]:
    """Counts, base_failed, content share and kept of each row; null and empty texts fail."""
    lines = lines_of(column)
    out = dict(lines.counts)
    out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat * out["n_words"])
    out["content_share"] = chain.share(lines)
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= min_share)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, counts, base_failed, kept, content_share for each row of ``docs``."""
    kept = docs.select("doc_id", "text")
    schema = kept.drop("text").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("content_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, limit=PART):
                got = verdicts(batch.column(1), chain)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c].astype(np.int64)) for c in _COUNTS), pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["content_share"].astype(float))], names=schema.names)

    return kept.mapInArrow(frugal(run), schema)


def keep_good(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, limit=PART):
                yield batch.filter(pa.array(verdicts(batch.column(at), chain)["kept"]))

    return docs.mapInArrow(frugal(run), docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents; the chain is fitted on rows of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assess(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
