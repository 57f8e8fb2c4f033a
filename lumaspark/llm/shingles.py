"""Near copies by their shared shingles: candidates from an index of fingerprints and, beyond its reach, from bands of
minhashes; links from the shingles themselves.

A text is the multiset of its word shingles: the n-th repeat of one is an element of its own, so the
similarity of multisets is that of sets. Candidates are what the index of SimHash fingerprints (``simhash.BitIndex``) finds.
Fingerprints scatter, so those of some texts of the least similarity lie farther apart than an index can look: beside it,
BANDS keys of ROWS minhashes each are made per text, and two texts are candidates where a key is equal. Texts of similarity
s miss each other there with (1 - s ** ROWS) ** BANDS: 7 in 100,000 at 0.8, fewer above. A link counts only if the
shingles of both texts, told apart by 64 bits of hash, have the least similarity, so that no text goes for a likeness below it.

Links are found in two steps. First each bucket pairs its members with its smallest one, each pair once.
Then the index looks up what lies within its distance in another component; buckets where such nodes meet compare those at
home with those that look them up, and buckets of bands of three or more that still hold different components compare all their
members. Both do so in blocks of a bounded number of texts and return one link per merged component: no table of all pairs exists.

Texts of equal words are one node. Null texts are empty; texts without words are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.components import components
from lumaspark.llm.tables import Steps, small_batches, text_of

SEED = 42
BANDS, ROWS = 24, 5
LEAST = (4, 5)  # similarity of a link as a fraction, so that it is compared in whole numbers
WORDS = ["fp0", "fp1"]  # of the fingerprint
BLOCK = 256  # texts of a bucket that meet as one side of a task

_RNG = np.random.default_rng(7)
_FLIPS = _RNG.integers(0, (1 << 64) - 1, (BANDS * ROWS, 1), np.uint64, endpoint=True)
_FACTORS = _RNG.integers(0, (1 << 64) - 1, (BANDS * ROWS, 1), np.uint64, endpoint=True) | np.uint64(1)
_REPEAT = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a lower-cased text: fewer words make one shingle, no words none."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist(), strict=True)), np.uint64, n - width + 1)


def elements(text: bytes, width: int) -> np.ndarray:
    """The multiset of shingles as different numbers."""
    return numbered(shingle_hashes(text, width))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes as different numbers, each repeat one of its own."""
    found = np.sort(hashes)
    starts = np.flatnonzero(np.diff(found, prepend=~found[:1]))
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(starts, append=len(found)))
    return found + nth.astype(np.uint64) * _REPEAT


def fingerprint(hashes: np.ndarray) -> int:
    """Counts the set bits of each position, block by block, so long texts need little memory."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits: those of the hashes and those of the hashes mixed anew."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _REPEAT
    return fingerprint(hashes), fingerprint((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[0])


def band_keys(found: np.ndarray, bands: int = BANDS) -> list[int]:
    """A key per band, block by block, so long texts need little memory; none for a text without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(found), 1 << 11):
        np.minimum(least, ((found[i:i + (1 << 11)] ^ _FLIPS) * _FACTORS).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), b) for b, band in enumerate(least.reshape(BANDS, ROWS)[:bands])]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(shared, n, m, least: tuple[int, int] = LEAST):
    """Whether multisets of n and m elements, of which some are shared, have the least similarity."""
    return shared * (least[0] + least[1]) >= least[0] * (n + m)


def _words_key(text: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(text.lower().split())), np.int64).tolist()
    return a, b


def _sketches(width: int, bands: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("body").to_pylist():
                found = shingle_hashes(text, width)
                rows.append((*_words_key(text), *wide_fingerprint(found), band_keys(numbered(found), bands)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.list_(pa.int64())], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "k0", "k1", *WORDS, "bands"])

    return run


def _keyed(batches):
    for batch in batches:
        keys = [_words_key(t) for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column("body")], names=["k0", "k1", "body"])


def _alike_pairs(width: int, least: tuple[int, int]):
    def run(batches):
        last, left = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for i, (x, y) in enumerate(zip(batch.column("a_body"), batch.column("b_body"), strict=True)):
                if a[i] != last:
                    last, left = a[i], elements(x.as_py(), width)
                right = elements(y.as_py(), width)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                if alike(shared, len(left), len(right), least):
                    out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]
    order = np.argsort(column, kind="stable")
    owner, (_, column) = owner[order], np.unique(column[order], return_inverse=True)
    out, width = np.zeros((len(sets), len(sets)), np.int64), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _merging(roots: list[int], pairs: np.ndarray, linked) -> pa.Table:
    """One link per merged component of members with these roots, whose pairs, given by position, count where linked(i, j)."""
    parent = {r: r for r in roots}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, j in pairs.tolist():
        a, b = sorted((find(roots[i]), find(roots[j])))
        if a != b and linked(i, j):
            parent[b] = a
            links.append((a, b))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _alike_members(width: int, least: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        sets = [elements(t, width) for t in group.column("body").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        near = alike(shared_counts(sets), sizes[:, None], sizes[None, :], least)
        return _merging(group.column("root").to_pylist(), np.argwhere(np.triu(near, 1)), lambda i, j: True)

    return run


def _alike_sides(index, width: int, least: tuple[int, int]):
    def run(group: pa.Table) -> pa.Table:
        home, node = group.column("home").to_numpy(), group.column("node").to_numpy()
        words = [group.column(w).to_numpy().view(np.uint64) for w in WORDS]
        at_home, finding = np.flatnonzero(home), np.flatnonzero(~home)
        near, own = index.meet(group.column("seg")[0].as_py(), [w[at_home] for w in words], [w[finding] for w in words])
        near &= ~own | (node[finding][None, :] > node[at_home][:, None])
        pairs = np.argwhere(near)
        sets, bodies = {}, group.column("body")

        def linked(i, j):
            one, two = (sets[k] if k in sets else sets.setdefault(k, elements(bodies[k].as_py(), width)) for k in (i, j))
            n, m = len(one), len(two)
            return alike(min(n, m), n, m, least) and alike(len(np.intersect1d(one, two, assume_unique=True)), n, m, least)

        return _merging(group.column("root").to_pylist(), np.stack([at_home[pairs[:, 0]], finding[pairs[:, 1]]], 1), linked)

    return run


def similar_components(docs: DataFrame, index, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       least: tuple[int, int] = LEAST, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id and component_id, the smallest id reachable over links of the least similarity.
    ``index`` is a ``simhash.BitIndex`` over WORDS."""
    small_batches(docs.sparkSession)
    steps = Steps(docs.sparkSession, "shingles")
    bodies = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.encode(text_of(text_col), "utf-8").alias("body"))
    rows = steps.write(bodies.mapInArrow(_sketches(width, bands), "doc_id long, k0 long, k1 long, fp0 long, fp1 long, bands array<long>"), "sketches")
    nodes = rows.groupBy("k0", "k1").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in (*WORDS, "bands"))).withColumn("node", F.monotonically_increasing_id())
    nodes = steps.write(nodes, "nodes")  # pins the numbers

    tables = nodes.select("node", F.explode("bands").alias("key"))
    buckets = tables.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).filter("m > 1")
    shared = steps.write(tables.join(buckets, "key"), "shared")
    pairs = index.stars(nodes.select("node", *WORDS)).unionByName(shared.filter("a <> node").select("a", F.col("node").alias("b")))
    pairs = steps.write(pairs.distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))

    def texts_of(asked: DataFrame) -> DataFrame:
        asked = nodes.join(asked, "node", "left_semi").select("node", "k0", "k1")
        found = bodies.select("body").mapInArrow(_keyed, "k0 long, k1 long, body binary").join(asked, ["k0", "k1"])
        return steps.write(found.groupBy("node").agg(F.first("body").alias("body")), "texts")

    def alike_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("body").alias("a_body")), "a")
        pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("b_body")), "b")
        return pairs.select("a", "b", "a_body", "b_body").mapInArrow(_alike_pairs(width, least), "a long, b long")

    texts = texts_of(ends.unionByName(shared.select("node")).distinct())
    near = components(alike_of(pairs, texts), steps)
    known = steps.write(near.select("node", "root"), "known")

    met = index.meetings(nodes.select("node", *WORDS).join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), steps)
    met = steps.write(met, "met")
    fresh = steps.write(met.select("node").distinct().join(texts, "node", "left_anti"), "fresh")
    more = texts if fresh.isEmpty() else texts.unionByName(texts_of(fresh))
    sizes = met.groupBy("seg", "key").agg(F.ceil(F.count_if("home") / BLOCK).alias("xs"), F.ceil(F.count_if(~F.col("home")) / BLOCK).alias("ys"))
    sides = met.join(sizes, ["seg", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("xs")).otherwise(F.col("ys"))))
    sides = sides.withColumn("other", F.explode(F.expr("sequence(0L, IF(home, ys, xs) - 1)")))
    sides = sides.select("seg", "key", "node", "root", "home", *WORDS, F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("x"),
                         F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("y")).join(more, "node")
    links = sides.groupBy("seg", "key", "x", "y").applyInArrow(_alike_sides(index, width, least), "a long, b long")

    rooted = shared.filter("m > 2").join(known, "node", "left").select("key", "node", "m", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    dealt = rooted.join(mixed, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)"))).filter("x <> y OR blocks = 1")
    dealt = dealt.select("node", "root", "key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).join(texts, "node")
    found = dealt.groupBy("key", "x", "y").applyInArrow(_alike_members(width, least), "a long, b long")
    merged = components(found.unionByName(links), steps).select(F.col("node").alias("root"), F.col("root").alias("top"))

    tops = nodes.select("node", "k0", "k1", "low").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = steps.write(tops.join(merged, "root", "left").select("k0", "k1", "low", F.coalesce("top", "root").alias("root")), "tops")
    lows = tops.groupBy("root").agg(F.min("low").alias("component_id"))
    named = tops.join(lows, "root").select("k0", "k1", "component_id")
    return rows.select("doc_id", "k0", "k1").join(named, ["k0", "k1"]).select("doc_id", "component_id")
