"""Operators against brute force on small fixtures, skewed ones included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.operators import blocks, cluster, knn, layout, navigate, ordering, sampling, search, spread

RNG = np.random.default_rng(7)


def vec_df(spark, m, name="media_id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{name} long, vector array<double>")


def pts_df(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "media_id long, x double, y double")


def test_rank_in_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 50) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r["id"]: (r["rn"], r["n"]) for r in ordering.ordered_rank(df, ["g"], ["v", "id"], "rn", "n").collect()}
    for g in {r[1] for r in rows}:
        members = sorted((v, i) for i, gg, v in rows if gg == g)
        for rank, (_, i) in enumerate(members, 1):
            assert got[i] == (rank, len(members))
    assert ordering.slices(df, "g", "v", "id").select("_slice").distinct().count() > 2


def test_neighbours_wrap_and_groups(spark):
    df = spark.createDataFrame([(i, (i * 17) % 101) for i in range(101)], "id long, v long")
    order = sorted(range(101), key=lambda i: (i * 17) % 101)
    got = {r["id"]: (r["prev"], r["next"]) for r in ordering.ordered_neighbours(df, [], ["v", "id"], "id", wrap=True).collect()}
    for p, i in enumerate(order):
        assert got[i] == (order[p - 1], order[(p + 1) % 101])
    one = ordering.ordered_neighbours(df.limit(1), [], ["v", "id"], "id", wrap=True).first()
    assert (one["prev"], one["next"]) == (one["id"], one["id"])


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "media_id long, g string")
    a = {r[0] for r in sampling.sample_n(df, 20, 1).select("media_id").collect()}
    b = {r[0] for r in sampling.sample_n(df.repartition(7), 20, 1).select("media_id").collect()}
    assert a == b and len(a) == 20 and a != {r[0] for r in sampling.sample_n(df, 20, 2).select("media_id").collect()}
    assert sampling.sample_n(df, 0).count() == 300 and sampling.sample_n(df, 1000).count() == 300
    per = sampling.sample_per_group(df, "g", 3).groupBy("g").count().collect()
    assert {r["count"] for r in per} == {3}


def test_sample_beyond_top_n(spark, monkeypatch):
    df = spark.range(200).withColumnRenamed("id", "media_id")
    want = {r[0] for r in sampling.sample_n(df, 50, 3).collect()}
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 10)
    assert {r[0] for r in sampling.sample_n(df, 50, 3).collect()} == want


def brute_top(q, c, k):
    with np.errstate(invalid="ignore"):
        s = np.round((q / np.linalg.norm(q)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9)
    ok = [i for i in range(len(c)) if np.isfinite(s[i])]
    return sorted(ok, key=lambda i: (-s[i], i))[:k]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_search_many_both_ways(spark, limit):
    c = RNG.normal(size=(120, 6))
    c[5] = 0
    c[40:80] = c[40]  # a third are copies
    q = RNG.normal(size=(9, 6))
    q[3] = c[40]
    got = search.search_many(vec_df(spark, q, "query_id"), vec_df(spark, c), 7, broadcast_bytes=limit, block_rows=16).collect()
    for i in range(9):
        mine = [r["media_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert mine == brute_top(q[i], c, 7)


def test_search_ranks_everything(spark):
    c = RNG.normal(size=(50, 4))
    c[10] = 0
    out = search.search(vec_df(spark, c), list(c[3])).collect()
    ranked = [r["media_id"] for r in sorted(out, key=lambda r: r["rank"])]
    assert ranked == brute_top(c[3], c, 50) + [10]
    assert search.search_text(vec_df(spark, c), "  ", lambda t: []) is None
    assert search.search_text(vec_df(spark, c).where("false"), "x", lambda t: []) is None


def test_cell_index_is_exact_with_all_cells(spark):
    c = RNG.normal(size=(150, 5))
    index = search.CellIndex(vec_df(spark, c), centres=6, seed=2)
    q = vec_df(spark, c[:12], "query_id")
    got = index.search_many(q, 5, probes=99, block_rows=20).collect()
    for i in range(12):
        assert [r["media_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == brute_top(c[i], c, 5)
    part = index.search_many(q, 5, probes=3).collect()
    hits = sum(r["media_id"] in brute_top(c[r["query_id"]], c, 5) for r in part)
    assert hits >= 0.6 * 12 * 5


def test_lsh_finds_most(spark):
    c = RNG.normal(size=(200, 5))
    got = {r["media_id"] for r in search.search_lsh(vec_df(spark, c), list(c[0]), 10, tables=10, bucket=1.0).collect()}
    assert len(got & set(brute_top(c[0], c, 10))) >= 7


@pytest.mark.parametrize("metric,limit", [("cosine", 1 << 20), ("cosine", 1), ("euclidean", 1 << 20), ("euclidean", 1)])
def test_knn_with_copies(spark, metric, limit):
    c = RNG.normal(size=(90, 4))
    c[30:60] = c[30]  # one third are copies of one vector
    got = knn.knn_graph(vec_df(spark, c), 5, metric, broadcast_bytes=limit, block_rows=16).collect()
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    d = np.round(1 - np.round(u @ u.T, 9), 9) if metric == "cosine" else np.round(np.linalg.norm(c[:, None] - c[None], axis=2), 6)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i), key=lambda j: (max(d[i, j], 0), j))[:5]
        assert [r["dst"] for r in sorted((r for r in got if r["src"] == i), key=lambda r: r["rank"])] == want, i


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_of_many_vectors_goes_to_no_task_whole(spark, monkeypatch, metric):
    """Blocks that all vectors stream past, with ties, a zero vector and several batches, give what all vectors at once give."""
    c = RNG.integers(0, 3, size=(1_500, 4)).astype(float)
    c[5] = 0
    few = {tuple(r) for r in knn.knn_graph(vec_df(spark, c), 6, metric).collect()}

    def never(*args, **options):
        raise AssertionError("all vectors in one task")

    monkeypatch.setattr(knn, "_euclidean_reps", never)
    monkeypatch.setattr(knn, "search_many", never)
    assert {tuple(r) for r in knn.knn_graph(vec_df(spark, c), 6, metric, broadcast_bytes=1_000, block_rows=30).collect()} == few
    wide = RNG.normal(size=(1_200, 512))  # more than FEW_BYTES
    assert knn.knn_graph(vec_df(spark, wide), 3, metric).count() == 3_600


def test_all_pairs_until_descent_takes_less_time(spark):
    assert knn.DENSE * knn.comparisons(15) > 700_000


def test_block_join_meets_every_pair_once(spark):
    import pandas as pd

    left = spark.range(70).select(F.col("id").alias("a"), F.when(F.col("id") < 50, 1).otherwise(F.col("id") % 5).alias("_cell"))
    right = spark.range(60).select(F.col("id").alias("b"), F.when(F.col("id") < 40, 1).otherwise(F.col("id") % 4).alias("_cell"))

    def kernel(x, y):
        return pd.DataFrame({"a": x["a"].tolist(), "n": [len(y)] * len(x)})

    got = blocks.block_join(left, right, kernel, "a long, n long", F.col("a"), F.col("b"), 8).groupBy("a").agg(F.sum("n").alias("n"))
    want = left.join(right, "_cell").groupBy("a").count()
    assert {tuple(r) for r in got.where("n > 0").collect()} == {tuple(r) for r in want.collect()}


# ---- navigation -----------------------------------------------------------------------

def brute_step(pts, i, d):
    dx, dy = {"left": (-1, 0), "right": (1, 0), "up": (0, -1), "down": (0, 1)}[d]
    ahead, wrap = [], []
    for j, (x, y) in enumerate(pts):
        if j == i:
            continue
        vx, vy = x - pts[i][0], y - pts[i][1]
        proj, orth = vx * dx + vy * dy, abs(vx * dy - vy * dx)
        if proj > 0:
            ahead.append((proj * proj + orth * orth * 5, j))
        wrap.append((proj + orth * 2, j))
    return min(ahead)[1] if ahead else min(wrap)[1] if wrap else i


GRID = [(0, 0), (10, 0), (20, 0), (0, 10), (10, 10), (20, 10)]
GOLDEN = [([(0, 0)], 0, "right", 0), (GRID, 0, "right", 1), (GRID, 1, "right", 2), (GRID, 1, "down", 4),
          ([(0, 0), (10, 10), (20, 0)], 0, "right", 2), (GRID, 2, "right", 0), (GRID, 3, "left", 5), (GRID, 4, "down", 1),
          ([(0, 2), (10, 0), (20, 1), (0, 100), (20, 100)], 2, "right", 0)]


@pytest.mark.parametrize("pts,start,direction,want", GOLDEN)
def test_step_examples(spark, pts, start, direction, want):
    got = navigate.next_in_direction(pts_df(spark, pts), start, (direction,)).first()
    assert (got["direction"], got["next_id"]) == (direction, want)


def test_small_tiles_ask_many_others_at_once(spark, monkeypatch):
    """Calls of the comparing function are bounded by rows, not by pairs of small tiles."""
    calls, groups = [], navigate.pair_groups

    def counted(left, right, keys, *rest):
        calls.append(left.select(*keys).distinct().count())
        return groups(left, right, keys, *rest)

    monkeypatch.setattr(navigate, "pair_groups", counted)
    pts = [(float(i % 40 * 3), float(i // 40 * 2)) for i in range(1600)]
    got = {r["media_id"]: r for r in navigate.nav_graph(pts_df(spark, pts), tile_rows=16).collect()}
    assert len(got) == 1600 and calls[0] <= 8  # 100 tiles or more, each asking dozens of others
    for i in (0, 39, 819, 1599):
        assert [got[i][d] for d in ("left", "right", "up", "down")] == [brute_step(pts, i, d) for d in ("left", "right", "up", "down")]


@pytest.mark.parametrize("case,few", [("random", 32), ("random", 0), ("grid", 0), ("stacked", 32), ("stacked", 0), ("golden", 32)])
def test_nav_graph(spark, case, few):
    pts = {"random": [tuple(p) for p in RNG.normal(size=(150, 2))],
           "grid": [(float(x), float(y)) for x in range(9) for y in range(7)],
           "stacked": [(1.0, 1.0)] * 30 + [(float(a), float(b)) for a, b in RNG.integers(0, 6, size=(60, 2))],
           "golden": GRID}[case]
    got = {r["media_id"]: r for r in navigate.nav_graph(pts_df(spark, pts), tile_rows=16, few_edges=few).collect()}
    assert len(got) == len(pts)
    for i in range(len(pts)):
        for d in navigate.DIRECTIONS:
            assert got[i][d] == brute_step(pts, i, d), (i, d)


# ---- layout ---------------------------------------------------------------------------

def test_spread_removes_overlaps(spark):
    pts = RNG.normal(size=(120, 2))
    out = spread.spread(pts_df(spark, pts), density=1.5, max_rounds=40).toPandas()
    xy = out[["x", "y"]].to_numpy()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) + np.eye(len(xy)) * 1e9
    before = layout.normalize_layout(pts_df(spark, pts), 1.5).toPandas()[["x", "y"]].to_numpy()
    d0 = np.sqrt(((before[:, None] - before[None]) ** 2).sum(2)) + np.eye(len(xy)) * 1e9
    assert len(out) == 120 and (d < 47).sum() < 0.2 * (d0 < 47).sum()


def test_spread_two_points_and_a_stack(spark):
    two = spread.one_round(spread.to_stacks(pts_df(spark, [(0, 0), (20, 0)])).withColumn("deg", F.lit(0)), 96.0)
    assert sorted(r["x"] for r in two.collect()) == pytest.approx([-14.1, 34.1])
    stack = spread.overlap_degree(pts_df(spark, [(0, 0)] * 5 + [(10, 0), (500, 500)])).collect()
    assert {r["media_id"]: r["n_close"] for r in stack} == {**dict.fromkeys(range(5), 1), 5: 5, 6: 0}


def test_crowded_tile_is_split(spark):
    pts = pts_df(spark, RNG.uniform(0, 60, size=(90, 2)))
    whole = spread.overlap_pushes(spread.to_stacks(pts), 96.0)
    split = spread.overlap_pushes(spread.to_stacks(pts), 96.0, block_rows=10)
    a, b = ({r["gid"]: (round(r["px"], 6), round(r["py"], 6), r["deg"]) for r in d.collect()} for d in (whole, split))
    assert a == b and len(a) == 90


def test_layout_edges(spark):
    same = layout.normalize_layout(pts_df(spark, [(3, 3), (3, 3)])).collect()
    assert {(r["x"], r["y"]) for r in same} == {(0.0, 0.0)}
    cam = layout.fit_camera(pts_df(spark, [(0, 0), (0, 0)]), 800, 600).first()
    assert cam["scale"] == pytest.approx(600 - 128)
    hits = layout.hit_test(spark.createDataFrame([(1, 400.0, 300.0), (2, 700.0, 300.0)], "tap_id long, px double, py double"),
                           pts_df(spark, [(10, 0), (5, 5)]), {"x": 0, "y": 0, "scale": 1}, 800, 600)
    assert {tuple(r) for r in hits.collect()} == {(1, 1), (2, None)}


def test_kmeans(spark):
    pts = [(0, 0), (0, 1), (10, 10), (10, 11), (50, 50)]
    out, cs = cluster.kmeans_from(pts_df(spark, pts), [(0, 0), (10, 10), (999, 999)])
    assert [r["cluster"] for r in out.orderBy("media_id").collect()] == [0, 0, 0, 0, 1] and cs[2] == (999.0, 999.0)
    labels, cs = cluster.kmeans(pts_df(spark, pts), 9, seed=1)
    assert len(cs) == 5 and labels.select("cluster").distinct().count() == 5
    assert [cluster.choose_k(n) for n in (1, 8, 50, 1000)] == [2, 2, 5, 8]
    assert [knn.neighbour_count(n) for n in (1, 2, 3, 10, 100)] == [0, 1, 2, 9, 15]
