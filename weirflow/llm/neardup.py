"""Near duplicates by BagMinHash, banding and verified multiset overlap.

A document is the multiset of its windows of five words (lower case). For each window and each
doubling block of multiplicities, (0, 1], (1, 2], (2, 4] ..., a Poisson process whose rate is the
block's width throws points at random registers; a point counts if its unit lies within the
window's multiplicity. The earliest point of a register agrees between two documents with the
probability of their weighted Jaccard similarity. Blocks share points between documents, and a
document stops once no further point can be the earliest.

Signatures are cut into bands; documents that share a band are candidates. Each bucket of a band
has a hub, the document that meets most others; all are compared with it, so that a large group
of copies is joined without pairing all with all. What is then still apart within a hub's star is
compared inside a task, registers first; a star that is too large for one is banded again by more
registers, so that documents with one passage in common part. Links are those whose exact multiset overlap reaches the
threshold, and classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, blocks, frugal, materialise, mix, scan_words, unused, windows

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: Bytes of text that are worked on at once.
PART = 2 << 20
REGISTERS = BANDS * ROWS
_GOLD = U64(0x9E3779B97F4A7C15)


def _times_gold(k: int) -> np.uint64:
    return U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))

#: Registers of which one bit is kept beside each band entry. At a similarity of 0.8 a bit agrees
#: with probability 0.9; fewer than LEAST_BITS of 64 then have a chance of under 1e-7.
LEAST_BITS = 43


def shingles(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of ``width`` lower-cased words; a shorter text with a word is
    one window, one without words has none."""
    words = scan_words(column)
    hashes = words.hashes(LOWER[words.data])
    at, key = windows(words, hashes, width)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        use = np.isin(words.doc, short)
        place = np.arange(len(hashes)) - words.first[words.doc]
        each = mix(hashes[use] + (place[use].astype(U64) + U64(1)) * _GOLD)
        first = np.flatnonzero(place[use] == 0)
        key = np.concatenate([key, mix(np.add.reduceat(each, first) ^ count[short].astype(U64))])
        doc = np.concatenate([doc, short])
    return doc, key


def bags(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, window hash) by row and hash, with multiplicities."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    if not len(doc):
        return doc, key, np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) times of the earliest points; rows without windows are infinite."""
    best = np.full(n * registers, np.inf)
    # one process for each block of multiplicities that the weight reaches into
    parts = [(doc, key, np.ones(len(doc)), np.zeros(len(doc)), weight)]
    low = 1
    while True:
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        parts.append((doc[at], mix(key[at] + _times_gold(low)), np.full(len(at), float(low)), np.full(len(at), float(low)), weight[at]))
        low *= 2
    d, seed, rate, base, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, step = np.zeros(len(d)), 0
    while len(d):
        step += 1
        r = mix(seed + _times_gold(step))
        u = ((r >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53
        time = time - np.log(u) / rate
        r2 = mix(r + U64(0x632BE59BD9B4E019))
        register = (r2 % U64(registers)).astype(np.int64)
        slot = d * registers + register
        inside = rate == 1.0
        wide = np.flatnonzero(~inside)
        if len(wide):  # the unit of the block that the point falls in
            unit = np.floor((r2[wide] >> U64(20)).astype(np.float64) * 2.0**-44 * rate[wide])
            inside[wide] = base[wide] + unit < w[wide]
        use = np.flatnonzero(inside & (time < best[slot]))
        np.minimum.at(best, slot[use], time[use])
        limit = best.reshape(n, registers).max(1)
        live = time < limit[d]
        d, seed, rate, base, w, time = d[live], seed[live], rate[live], base[live], w[live], time[live]
    return best.reshape(n, registers)


def signature(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of windows, band keys (n, BANDS) and 64 bits of each row."""
    n = len(column)
    doc, key = shingles(column)
    count = np.bincount(doc, minlength=n)
    times = bag_minhash(*bags(doc, key), n)
    bits = mix(times.view(U64))
    bands = np.zeros((n, BANDS), U64)
    grouped = bits.reshape(n, BANDS, ROWS)
    for k in range(ROWS):
        bands = mix(bands * U64(0xD6E8FEB86659FD93) + grouped[:, :, k])
    bands = mix(bands + np.arange(1, BANDS + 1, dtype=U64) * _GOLD)
    packed = np.bitwise_or.reduce((bits[:, :64] & U64(1)) << np.arange(64, dtype=U64), axis=1)
    return count, bands, packed


def bag_arrays(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """Of each row the sorted window hashes and the registers, 16 bits of each.

    The k-th repetition of a window gets a hash of its own, so that the overlap of multisets is
    that of sets.
    """
    n = len(column)
    doc, key = shingles(column)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    again = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    each = np.where(again > 0, mix(key + again.astype(U64) * _GOLD), key)
    order = np.lexsort((each, doc))
    each = each[order]
    edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
    times = bag_minhash(doc[first], key[first], np.diff(np.append(first, len(doc))), n)
    registers = (mix(times.view(U64)) >> U64(48)).astype("<u2")
    return [each[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], [r.tobytes() for r in registers]


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of ``bag_arrays``."""
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


# ---------------------------------------------------------------- stages
_SIGNED = "node binary, n int, bands array<long>, bits long, copies long, seed long"


def _signatures(rows: DataFrame) -> DataFrame:
    """node, n, bands, bits of the distinct texts of each task; and without these a row for each text
    that the task saw several times: how often, and the least ``seed`` of those rows."""
    names = [c.split(" ")[0] for c in _SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}  # the least seed of each text
        again: dict[bytes, int] = {}
        for whole in batches:
            for part in blocks(whole, limit=PART):
                fresh = []
                for k, (x, seed) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if x in first:
                        again[x] = again.get(x, 1) + 1
                        first[x] = min(first[x], seed)
                    else:
                        first[x] = seed
                        fresh.append(k)
                if not fresh:
                    continue
                batch = part.take(pa.array(fresh))
                count, bands, bits = signature(batch.column(1))
                keep = np.flatnonzero(count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BANDS), pa.array(bands[keep].ravel().view(np.int64)))
                ones = pa.array(np.ones(len(keep), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(count[keep].astype(np.int32)), lists, pa.array(bits[keep].view(np.int64)), ones, pa.nulls(len(keep), pa.int64())], names=names)
        if again:
            nothing = (pa.nulls(len(again), t) for t in (pa.int32(), pa.list_(pa.int64()), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(again), pa.binary()), *nothing, pa.array([n - 1 for n in again.values()], pa.int64()), pa.array([first[x] for x in again], pa.int64())], names=names)

    return rows.select("node", "text", "seed").mapInArrow(frugal(run), _SIGNED)


def _hot(signed: DataFrame) -> DataFrame:
    """node, copies, seed of texts that are those of very many rows: over 1 / (4 * partitions) of
    all rows each, so there are at most 4 * partitions of them."""
    lanes = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signed.agg(F.sum("copies")).first()[0] or 0
    many = signed.where("n is null").groupBy("node").agg((F.sum("copies") + 1).alias("copies"), F.min("seed").alias("seed"))
    return materialise(many.where(F.col("copies") * 4 * lanes > rows), "hot")


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A left join with ``right`` (one row a key) for keys that may be those of very many rows.

    ``hot`` has the rows of ``right`` for these, few by its maker's bound: they are broadcast, and
    rows of ``left`` that they serve are dealt by ``seed`` in the join with the others.
    """
    values = [c for c in right.columns if c != key]
    near = F.broadcast(hot.select(F.col(key).alias("__hk"), *(F.col(c).alias(f"__h_{c}") for c in values)))
    far = right.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__c_{c}") for c in values))
    met = left.join(near, F.col(key) == F.col("__hk"), "left")
    met = met.withColumn("__at", F.when(F.col("__hk").isNull(), F.col(key)).otherwise(F.concat(key, F.encode(F.col("seed").cast("string"), "utf-8"))))
    met = met.join(far, F.col("__at") == F.col("__k"), "left")
    return met.select(*left.columns, *(F.coalesce(f"__h_{c}", f"__c_{c}").alias(c) for c in values))


def join_spread(left: DataFrame, right: DataFrame, key: str, counted: DataFrame, seed: Column) -> DataFrame:
    """An inner join with ``right`` where a key may be that of very many rows of ``left``.

    ``counted`` has how often each key is there (key, k). Rows of a key with over
    1 / (4 * partitions) of them are dealt by ``seed``, and its rows of ``right`` go to each of these
    parts; at most 4 * partitions such keys are broadcast, with a number each.
    """
    lanes = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum("k")).first()[0] or 0
    hot = counted.where(F.col("k") * 4 * lanes > total).select(F.col(key).alias("__h"), F.ceil(F.col("k") * 4 * lanes / max(total, 1)).cast("int").alias("__ways"))
    of = lambda frame: frame.join(F.broadcast(hot), F.col(key) == F.col("__h"), "left")
    dealt = of(left).withColumn("__part", F.coalesce(F.pmod(seed, F.col("__ways")), F.lit(0)).cast("int")).drop("__h", "__ways")
    copied = of(right).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1))).drop("__h", "__ways")
    return dealt.join(copied, [key, "__part"]).drop("__part")


def _bagged(rows: DataFrame, wanted: DataFrame, hot: DataFrame) -> DataFrame:
    """node, bag, registers of the nodes that are wanted.

    Copies of a text are worth one: of a hot one only the rows of its ``seed`` are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for part in blocks(whole, limit=PART):
                nodes = part.column(0).to_pylist()
                fresh = [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]
                if fresh:
                    batch = part.take(pa.array(fresh))
                    arrays, registers = bag_arrays(batch.column(1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.binary()), pa.array(registers, pa.binary())], names=["node", "bag", "registers"])

    few = rows.join(F.broadcast(hot.select(F.col("node").alias("__h"), F.col("seed").alias("__s"))), F.col("node") == F.col("__h"), "left").where("__h is null or seed = __s")
    found = few.select("node", "text").join(wanted, "node", "left_semi").mapInArrow(frugal(run), "node binary, bag binary, registers binary")
    return materialise(found.groupBy("node").agg(F.first("bag").alias("bag"), F.first("registers").alias("registers")), "bags")


def _stars(entries: DataFrame) -> DataFrame:
    """hub, node, near: each node with the hub of each bucket that it is in.

    A bucket's hub is its node that shares most band entries with others: what a group of copies
    was made from meets all of them. ``near``: sizes and bits don't rule a link out.
    """
    degree = entries.groupBy("node").agg(F.sum("k").alias("degree"))
    ranked = entries.join(degree, "node")
    hub = materialise(ranked.groupBy("band").agg(F.max(F.struct("degree", "node", "n", "bits")).alias("h"), F.count(F.lit(1)).alias("k")), "hubs")
    pairs = join_spread(entries.drop("k"), hub.drop("k"), "band", hub, F.xxhash64("node")).select(F.col("h.node").alias("hub"), "node", "n", "bits", F.col("h.n").alias("m"), F.col("h.bits").alias("bits2"))
    near = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    near &= 64 - F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) >= LEAST_BITS
    return materialise(pairs.groupBy("hub", "node").agg(F.max(near).alias("near")), "stars")


def _hub_links(stars: DataFrame, bags: DataFrame, threshold: float, labels: DataFrame | None = None) -> DataFrame:
    """a, b: the nodes whose overlap with their hub reaches the threshold. With ``labels``, only
    nodes that its label doesn't join to the hub yet are compared."""
    pairs = stars.where("near and hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    if labels is not None:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    joined = join_spread(pairs, bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a", counted, F.xxhash64("b")).join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [overlap(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(joined.select("a", "b", "x", "y").mapInArrow(frugal(check), "a binary, b binary"), "links")


def link_apart(nodes: list[bytes], labels: list[bytes], bags: list[np.ndarray], registers: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between nodes of different labels, until no two labels with a link are left apart.

    ``side``: nodes of side 1 aren't compared with each other, nor are those of side 2; those of
    side 0 are compared with all. The registers'
    agreement rules pairs out at six standard deviations below the threshold.
    """
    parent = {x: x for x in labels}

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(b) for b in bags])
    count: dict[bytes, int] = {}
    for x in labels:
        count[x] = count.get(x, 0) + 1
    number = {x: k for k, x in enumerate(count)}
    group = np.array([number[x] for x in labels])
    least = threshold - 6 * np.sqrt(threshold * (1 - threshold) / registers.shape[1])
    out = []
    # small labels first, against everything that isn't joined to them yet
    order = sorted(range(len(nodes)), key=lambda k: (count[labels[k]], nodes[k]))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    for k in order:
        fits = (group != group[k]) & (rank > rank[k]) & (size >= threshold * size[k]) & (size <= size[k] / threshold) & ((side == 0) | (side != side[k]))
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        agree = (registers[at] == registers[k]).mean(1)
        close = agree >= least
        for j in at[close][np.argsort(-agree[close], kind="stable")].tolist():
            a, b = root(labels[k]), root(labels[j])
            if a != b and overlap(bags[k], bags[j]) >= threshold:
                parent[max(a, b)] = min(a, b)
                out.append((nodes[k], nodes[j]))
    return out


#: A star with more bytes than this isn't compared by one task.
STAR_BYTES = 32 << 20
#: Bands of a star that is too large: at a similarity of 0.8 none agrees with probability 1e-5.
DEEP_BANDS, DEEP_ROWS = 64, 8


def _mixed(stars: DataFrame, labels: DataFrame, bags: DataFrame) -> DataFrame:
    """hub, node, label, stray, bag, registers of stars whose nodes have several labels.

    Nodes that share a band share that bucket's hub, so every candidate pair is in a star. Most
    nodes of a star have one label, and needn't be compared with each other; the others are
    strays. ``bytes`` are those of the whole star, ``m`` and ``s`` the blocks of most and of strays.
    """
    named = stars.select("hub", "node").join(labels, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label"))
    named = materialise(named, "named")
    each = named.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("hub").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("k"))
    most = materialise(most.where("labels > 1").select("hub", "most", "k"), "most")
    found = join_spread(named, most.drop("k"), "hub", most, F.xxhash64("node"))
    kept = found.join(bags, "node").select("hub", "node", "label", (F.col("label") != F.col("most")).alias("stray"), (F.octet_length("bag") + 256).alias("size"), "bag", "registers")
    kept = materialise(kept, "mixed")
    blocks_of = lambda which: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, F.col("size"))) / STAR_BYTES)).cast("int")
    shape = kept.groupBy("hub").agg(F.sum("size").alias("bytes"), blocks_of(~F.col("stray")).alias("m"), blocks_of(F.col("stray")).alias("s"), F.count(F.lit(1)).alias("k"))
    shape = materialise(shape, "shape")
    return join_spread(kept, shape.drop("k"), "hub", shape, F.xxhash64("node"))


def _star_links(kept: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between nodes of different labels of the stars in ``kept``.

    A star of up to ``STAR_BYTES`` is one task's group. Of a larger one the nodes of most and the
    strays are dealt into blocks; strays are compared with each block and among themselves. Pairs
    are compared inside a task and never made rows.
    """
    dealt = kept.withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("s")).otherwise(F.col("m"))).cast("int"))
    # a group is (i, j): block i of the most, block j of the strays; or (-1 - i, j): two of strays
    number = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    at = F.col("at")
    with_most = F.transform(number("m"), lambda i: place(i, at, F.when(i == 0, 0).otherwise(2)))
    with_strays = F.transform(F.filter(number("s"), lambda o: o != at), lambda o: place(-1 - F.least(at, o), F.greatest(at, o), F.when(at < o, 1).otherwise(2)))
    of_most = F.transform(number("s"), lambda j: place(at, j, F.lit(1)))
    dealt = dealt.withColumn("p", F.explode(F.when(F.col("stray"), F.concat(with_most, with_strays)).otherwise(of_most))).select("hub", "p.i", "p.j", "p.side", "node", "label", "bag", "registers")

    def run(table: pa.Table) -> pa.Table:
        nodes, labels_ = table.column("node").to_pylist(), table.column("label").to_pylist()
        arrays = [np.frombuffer(b, U64) for b in table.column("bag").to_pylist()]
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(len(nodes), -1)
        side = table.column("side").to_numpy().astype(np.int64)
        found = link_apart(nodes, labels_, arrays, registers, side, threshold)
        return pa.table([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    return materialise(dealt.groupBy("hub", "i", "j").applyInArrow(run, "a binary, b binary"), "links")


def deep_bands(registers: np.ndarray) -> np.ndarray:
    """(n, DEEP_BANDS) keys, each of DEEP_ROWS registers that a fixed shuffle chooses."""
    n, width = registers.shape
    dealt = np.random.default_rng(7)
    out = np.zeros((n, DEEP_BANDS), U64)
    for j in range(DEEP_BANDS):
        for k in dealt.choice(width, DEEP_ROWS, replace=False):
            out[:, j] = mix(out[:, j] * U64(0xD6E8FEB86659FD93) + registers[:, k].astype(U64) + U64(j + 1))
    return out


def _deeper(large: DataFrame) -> DataFrame:
    """band, node, n, bits, k: entries of finer buckets for the nodes of stars that are too large.

    Nodes with little in common but a passage meet in few of them; buckets whose nodes all have one
    label are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                registers = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u2").reshape(part.num_rows, -1)
                bits = np.bitwise_or.reduce((registers[:, :64].astype(U64) & U64(1)) << np.arange(64, dtype=U64), axis=1)
                hubs = np.array([int.from_bytes(h[:8], "little") for h in part.column(0).to_pylist()], U64)
                bands = mix(deep_bands(registers) + hubs[:, None])
                who = pa.array(np.repeat(np.arange(part.num_rows), DEEP_BANDS))
                of = part.select(["node", "label", "n"]).take(who)
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), of.column(0), of.column(1), of.column(2), pa.array(bits.view(np.int64)).take(who)], names=["band", "node", "label", "n", "bits"])

    found = large.select("hub", "node", "label", "registers", (F.octet_length("bag") / 8).cast("int").alias("n")).select("hub", "node", "label", "registers", "n")
    dealt = materialise(found.mapInArrow(frugal(run), "band long, node binary, label binary, n int, bits long"), "deep")
    several = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "k")
    return materialise(dealt.join(several, "band").select("band", "node", "n", "bits", "k"), "entries")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's least node) by alternating large and small stars.

    Each round is written to the shared folder; nothing but a count comes to the driver.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = materialise(small, "stars")
        # done when every node has one parent, and no parent has one
        same = small.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() == 0
        if same and small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0:
            return small.select(F.col("u").alias("node"), F.col("v").alias("label")).union(small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        now = small


def _linked(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, label of the nodes that have a near duplicate; the hot nodes) of (node, text, seed)."""
    signed = materialise(_signatures(rows), "signatures")
    hot = _hot(signed)
    once = signed.where("n is not null").select(F.explode("bands").alias("band"), "node", "n", "bits").groupBy("band", "node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    shared = materialise(once.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")  # counted before it is dealt: a band may be that of a third of all rows
    entries = materialise(join_spread(once, shared, "band", shared, F.xxhash64("node")), "entries")
    bags = _bagged(rows, entries.select("node").distinct(), hot)
    links, labels = None, None
    for last in (False, True):
        stars = _stars(entries)
        found = _hub_links(stars, bags, threshold, labels)
        links = found if links is None else links.union(found)
        labels = components(links)
        kept = _mixed(stars, labels, bags)
        # stars that are too large for a task are banded again once; what still is gets blocks
        large = kept.where(F.col("bytes") > STAR_BYTES)
        rest = _star_links(kept if last else kept.where(F.col("bytes") <= STAR_BYTES), threshold)
        again = not last and large.limit(1).count() > 0
        if rest.limit(1).count():
            links = links.union(rest)
            labels = components(links)
        if not again:
            return labels, hot
        entries = _deeper(large)


def link(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, label for the nodes of ``rows`` (node, text) that have a near duplicate."""
    return _linked(rows.select("node", "text", F.xxhash64("node").alias("seed")), threshold)[0]


#: Of a text with a word, what tells it from others; null for texts without.
def _node() -> Column:
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.encode("text", "utf-8"))))


def _labelled(rows: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the label of their nodes, which is the node itself where it has no link."""
    known = hot.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return join_hot(rows, labels, "node", known).withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the class' least doc_id), class_size of each row.

    Equal texts are in a class, whatever they hold; null texts and texts without words are each
    on their own (class_id is their doc_id). Null ids are never a class_id if another id is there.
    Repeated rows are counted and put out each. An empty table gives no row. Of the columns only
    doc_id and text are read, so others may have any name.
    """
    rows = docs.select("doc_id", _node().alias("node"), "text", F.xxhash64("doc_id").alias("seed"))
    labels, hot = _linked(rows.where("node is not null").select("node", "text", "seed"), threshold)
    tagged = materialise(_labelled(rows.select("doc_id", "node", "seed"), labels, hot), "tagged")
    least = materialise(tagged.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "least")
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = least.agg(F.sum("class_size")).first()[0] or 0
    out = join_hot(tagged, least, "label", least.where(F.col("class_size") * 4 * lanes > total))  # at most 4 * partitions classes
    return out.select("doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that with the least doc_id, with its columns as they are.

    Rows that repeat an id belong to one class or are told apart by their texts; the row of the
    least id with the smallest hash of the text stays. Null ids come last.
    """
    key = _node()
    rows = docs.select(F.col("doc_id").alias("__d"), key.alias("node"), "text", F.xxhash64("doc_id").alias("seed")).where("node is not null")
    labels, hot = _linked(rows.select("node", "text", "seed"), threshold)
    each = rows.groupBy("__d", "node", "seed").agg(F.count(F.lit(1)).alias("k"))
    counted = materialise(_labelled(each, labels, hot).select("label", "__d", "node", "k"), "tagged")
    order = F.struct(F.col("__d").isNull().alias("x"), F.coalesce("__d", F.lit(0)).alias("d"), "node")
    first = counted.groupBy("label").agg(F.min_by(F.struct("__d", "node"), order).alias("w")).select(F.col("w.node").alias("__wn"), F.col("w.__d").alias("__wd"))
    match = (F.col("node") == F.col("__wn")) & F.col("__d").eqNullSafe(F.col("__wd"))
    by_node, by_id = unused(docs, "n"), unused(docs, "i")
    named = F.col("node").alias(by_node), F.col("__d").alias(by_id)
    dropped = materialise(counted.join(first, match, "left_anti").select(*named), "dropped")
    again = materialise(counted.where("k > 1").join(first, match, "left_semi").select(*named), "again")
    at = unused(docs, "node")
    full = docs.withColumn(at, key)
    on = (F.col(at) == F.col(by_node)) & F.col("doc_id").eqNullSafe(F.col(by_id))
    if not again.limit(1).count():  # no row repeats another: one reading of the texts is enough
        return full.join(dropped.hint("merge"), on, "left_anti").drop(at)  # the list grows with the data, so it is never sent whole
    left = full.join(dropped.union(again).hint("merge"), on, "left_anti")
    once = full.join(again, on, "left_semi").dropDuplicates([at, "doc_id"])
    return left.unionByName(once).drop(at)


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size of each document (``classes`` says what edge cases give)."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
