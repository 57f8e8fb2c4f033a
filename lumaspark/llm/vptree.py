"""Nearest neighbours by inner product: vantage-point trees per shard.

Inner product is no metric, so a vector x gets one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and a query a zero there: their Euclidean distance falls as the inner product
grows. The top of the tree is built on a bounded sample and deals all vectors to shards; each
shard builds its own tree over every one of its vectors. A query first searches its home shard;
the distance of its k-th neighbour there then selects the other shards it must visit, by the
triangle inequality along the top tree, and the same test prunes inside each tree. The test is
relaxed by `factor`: a side is passed over if factor times its least possible distance exceeds
the k-th distance. Factor one is exact; larger ones visit less.

Ties go to the smaller id: candidates are compared by their products in component order, then by id, in the trees too.

Equal vectors are one entry that keeps its k + 1 smallest ids, which is all that any query can
use, so a vector held by a third of all rows stays small.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
whose length is not the commonest one (ties: the longest). Null ids take no part. Rows that repeat an id count as one if their vectors are
equal, else as several candidates of that id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import Steps

SAMPLE_ROWS = 16_384  # rows that the top tree is fitted on, at most
SHARD_ROWS = 8_192
MAX_SHARDS = 4096  # leaves of the top tree; beyond, a leaf's vectors are cut into trees of their own
LEAF_ROWS = 256
QUERY_BLOCK = 2_048
FACTOR = 1.5
PAIRS = 1 << 16  # pairs whose exact products are taken together


def slack(norm2: float) -> float:
    """What distances may be off by: they are roots of differences that rounding leaves."""
    return 1e-7 * norm2 ** 0.5


@dataclass
class Node:
    point: np.ndarray | None = None
    radius: float = 0.0
    inner: object = None
    outer: object = None
    rows: np.ndarray | None = None  # of a leaf; the number of the shard in a top tree


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - point) ** 2).sum(1), 0.0))


def build(points: np.ndarray, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Node:
    """The vantage point is, of a few rows, the one whose distances spread most; the median splits the rest."""
    if len(rows) <= leaf_rows:
        return Node(rows=rows)
    tries = rng.choice(rows, min(8, len(rows)), replace=False)
    seen = points[rng.choice(rows, min(256, len(rows)), replace=False)]
    point = points[max(tries, key=lambda r: _distances(seen, points[r]).std())]
    d = _distances(points[rows], point)
    radius = float(np.median(d))
    near = d <= radius
    if near.all():  # a tie at the median holds everything
        near = d < radius
        if not near.any():
            return Node(rows=rows)
        radius = float(d[near].max())
    return Node(point, radius, build(points, rows[near], leaf_rows, rng), build(points, rows[~near], leaf_rows, rng))


def build_top(points: np.ndarray, levels: int, rng: np.random.Generator, first: int = 0) -> Node:
    """A tree of `levels` splits whose leaves are shard numbers."""
    if levels == 0 or len(points) < 4:
        return Node(rows=np.array([first]))
    node = build(points, np.arange(len(points)), len(points) - 1, rng)
    if node.point is None:
        return Node(rows=np.array([first]))
    d = _distances(points, node.point)
    half = 1 << (levels - 1)
    return Node(node.point, node.radius, build_top(points[d <= node.radius], levels - 1, rng, first),
                build_top(points[d > node.radius], levels - 1, rng, first + half))


def descend(node: Node, points: np.ndarray) -> np.ndarray:
    """The shard of each point."""
    if node.point is None:
        return np.full(len(points), node.rows[0])
    d = _distances(points, node.point)
    out = np.empty(len(points), np.int64)
    near = d <= node.radius
    out[near], out[~near] = descend(node.inner, points[near]), descend(node.outer, points[~near])
    return out


def reachable(node: Node, queries: np.ndarray, tau: np.ndarray, factor: float, index: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, queries that must visit it)."""
    if not len(index):
        return []
    if node.point is None:
        return [(int(node.rows[0]), index)]
    d = _distances(queries[index], node.point)
    inner = index[(d - node.radius) * factor <= tau[index]]
    outer = index[(node.radius - d) * factor <= tau[index]]
    return reachable(node.inner, queries, tau, factor, inner) + reachable(node.outer, queries, tau, factor, outer)


class Best:
    """The `keep` best rows so far of each query, by exact inner product, ties to the smaller id; tau is the distance of the last of them.

    Block products, which round differently, only say which rows cannot be among these."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, norm2: float, keep: int, tau: np.ndarray | None):
        self.queries, self.vectors, self.ids, self.keep, self.base = queries, vectors, ids, keep, (queries ** 2).sum(1) + norm2
        self.scores = np.full((len(queries), keep), -np.inf)
        self.rows = np.full((len(queries), keep), -1, np.int64)
        self.start = np.full(len(queries), np.inf) if tau is None else tau
        self.doubt = 1e-12 * max(norm2, 1e-300) * queries.shape[1]
        self.slack = slack(norm2)

    def tau(self, index: np.ndarray) -> np.ndarray:
        kth = self.scores[index, -1]
        known = np.isfinite(kth)
        own = np.where(known, np.sqrt(np.maximum(self.base[index] - 2 * np.where(known, kth, 0.0), 0.0)), np.inf)
        return np.minimum(own, self.start[index]) + self.slack

    def add(self, index: np.ndarray, rows: np.ndarray) -> None:
        about = self.queries[index] @ self.vectors[rows].T
        floor = self.scores[index, -1]
        if len(rows) > self.keep:
            floor = np.maximum(floor, -np.partition(-about, self.keep - 1, axis=1)[:, self.keep - 1])
        at, col = np.nonzero(about >= floor[:, None] - self.doubt)
        exact = np.concatenate([_exact(self.queries[index[at[i:i + PAIRS]]], self.vectors[rows[col[i:i + PAIRS]]]) for i in range(0, max(1, len(at)), PAIRS)])
        held, place = np.nonzero(self.rows[index] >= 0)
        which = np.concatenate([held, at])
        scores = np.concatenate([self.scores[index[held], place], exact])
        found = np.concatenate([self.rows[index[held], place], rows[col]])
        order = np.lexsort((self.ids[found], -scores, which))
        which, scores, found = which[order], scores[order], found[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which, "left")
        top = rank < self.keep
        self.scores[index[which[top]], rank[top]], self.rows[index[which[top]], rank[top]] = scores[top], found[top]


def search(node: Node, wide: np.ndarray, best: Best, factor: float, index: np.ndarray) -> None:
    """Visits the nearer side first, the other one only where it may hold something closer than tau."""
    if not len(index):
        return
    if node.point is None:
        if len(node.rows):
            best.add(index, node.rows)
        return
    d = _distances(wide[index], node.point)
    inside = d <= node.radius
    for first, second, mask, sign in ((node.inner, node.outer, inside, 1), (node.outer, node.inner, ~inside, -1)):
        some, gap = index[mask], sign * (node.radius - d[mask])
        search(first, wide, best, factor, some)
        search(second, wide, best, factor, some[gap * factor <= best.tau(some)])


def _widened(vectors: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(norm2 - (vectors ** 2).sum(1, keepdims=True), 0.0))])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, in double precision."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


_FOUND = "query long, entry long, score double"


def _search_shard(norm2: float, keep: int, factor: float):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        vectors = np.stack(shard["vector"].to_numpy()).astype(np.float64)
        tree = build(_widened(vectors, norm2), np.arange(len(vectors)), LEAF_ROWS, np.random.default_rng(len(vectors)))
        entries, out = shard["node"].to_numpy(), []
        for i in range(0, len(queries), QUERY_BLOCK):
            part = queries.iloc[i:i + QUERY_BLOCK]
            q = np.stack(part["vector"].to_numpy()).astype(np.float64)
            best = Best(q, vectors, shard["least"].to_numpy(), norm2, min(keep, len(vectors)), part["tau"].to_numpy())
            search(tree, np.hstack([q, np.zeros((len(q), 1))]), best, factor, np.arange(len(q)))
            at, col = np.nonzero(best.rows >= 0)
            rows = best.rows[at, col]
            out.append(pd.DataFrame({"query": part["node"].to_numpy()[at], "entry": entries[rows], "score": best.scores[at, col]}))
        return pd.concat(out)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector")).filter(
        F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which is_query(id column) holds, by
    inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    steps = Steps(spark, "vptree")
    rows = steps.write(usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]), "rows")
    limit = k + 1
    small = rows.withColumn("n", F.row_number().over(_by_id())).filter(F.col("n") <= limit)
    entries = small.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(is_query(F.col("id")))
    entries = entries.join(asked.select("vector").distinct().withColumn("asks", F.lit(True)), "vector", "left")
    entries = entries.withColumn("node", F.monotonically_increasing_id()).withColumn("norm2", F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    entries = steps.write(entries, "entries")
    stats = entries.agg(F.count("*").alias("n"), F.max("norm2").alias("norm2")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm2 = float(stats["norm2"]) * (1 + 1e-12)

    share = min(1.0, 1.2 * sample_rows / stats["n"])
    sample = entries.select("vector").sample(fraction=share, seed=7).limit(sample_rows).toPandas()
    levels = max(0, min(int(np.ceil(np.log2(max(1, stats["n"] / shard_rows)))), MAX_SHARDS.bit_length() - 1))
    points = np.stack(sample["vector"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 1))
    top = build_top(_widened(points, norm2), levels, np.random.default_rng(7)) if len(sample) else Node(rows=np.array([0]))

    def place(batches):
        for b in batches:
            if len(b):
                wide = _widened(np.stack(b["vector"].to_numpy()).astype(np.float64), norm2)
                yield pd.DataFrame({"node": b["node"], "least": b["least"], "vector": b["vector"], "shard": descend(top, wide)})

    def visit(home: bool):
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                q = np.stack(b["vector"].to_numpy()).astype(np.float64)
                wide, every = np.hstack([q, np.zeros((len(q), 1))]), np.arange(len(q))
                own = descend(top, wide)
                tau = np.full(len(q), np.inf) if home else b["tau"].to_numpy()
                visits = [(s, own == s) for s in np.unique(own)] if home else reachable(top, wide, tau + slack(norm2), factor, every)
                for s, index in visits:
                    index = every[index] if home else index[own[index] != s]
                    part = b.iloc[index]
                    yield pd.DataFrame({"node": part["node"], "vector": part["vector"], "tau": tau[index], "shard": s})

        return run

    kind = entries.schema["vector"].dataType.simpleString()
    shards = steps.write(entries.select("node", F.get("ids", 0).alias("least"), "vector").mapInPandas(place, f"node long, least long, vector {kind}, shard long"), "shards")
    find = _search_shard(norm2, limit, factor)
    queries = entries.filter("asks").select("node", "vector")
    visits = f"node long, vector {kind}, tau double, shard long"

    sizes = shards.groupBy("shard").agg(F.ceil(F.count("*") / (2.0 * shard_rows)).alias("parts"))  # a row per shard of the top tree

    def searched(wanted: DataFrame) -> DataFrame:
        """Blocks of a shard's queries meet its vectors, which are cut as well where the top tree left too many."""
        wanted = steps.write(wanted, "wanted")
        loads = wanted.groupBy("shard").agg(F.ceil(F.count("*") / (2.0 * QUERY_BLOCK)).alias("blocks"))
        cuts = steps.write(sizes.join(loads, "shard"), "cuts")  # at most MAX_SHARDS rows
        again = steps.read(cuts)

        def every(n):
            return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

        def one(n):
            return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

        left = wanted.join(F.broadcast(cuts), "shard").withColumn("block", one("blocks")).withColumn("part", every("parts"))
        right = shards.join(F.broadcast(again), "shard").withColumn("part", one("parts")).withColumn("block", every("blocks"))
        by = ["shard", "part", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(find, _FOUND)

    first = steps.write(searched(queries.mapInPandas(visit(True), visits)), "home")
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("s"))
    kth = kth.select(F.col("query").alias("node"), F.when(F.col("n") >= limit, F.get("s", limit - 1)).alias("s"))
    with_tau = queries.join(entries.select("node", "norm2"), "node").join(kth, "node", "left").select("node", "vector", F.coalesce(
        F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + norm2 - 2 * F.col("s"))), F.lit(float("inf"))).alias("tau"))
    others = steps.write(searched(with_tau.mapInPandas(visit(False), visits)), "others")

    hits = first.union(others).join(entries.select(F.col("node").alias("entry"), "ids"), "entry")
    hits = hits.withColumn("n", F.row_number().over(_best())).filter(F.col("n") <= limit)
    found = hits.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    named = asked.join(entries.filter("asks").select("vector", "node"), "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query")).distinct()
    out = named.join(found, "query").withColumn("near", F.filter("near", lambda h: h["vec_id"] != F.col("query_id")))
    return out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("p", "h")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.minus")).alias("score"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("vector").orderBy("id")


def _best():
    from pyspark.sql import Window

    return Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", 0))
