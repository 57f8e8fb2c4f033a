"""Sources, cache, sessions, models, projections, whole jobs and streams."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.functions import keys
from lumaspark.operators import embed, pixels
from lumaspark.operators.project import METHODS, ProjectionError, forces, graph, project
from lumaspark.plans import maps as plans
from lumaspark.sources import assets, cache, media, sessions
from lumaspark.streaming import media as streams

RNG = np.random.default_rng(11)
TS = datetime(2024, 5, 1, 12)
FILES = "media_id long, name string, size long, last_modified timestamp"


def files_df(spark, names):
    return spark.createDataFrame([(i, n, 100 + i, TS) for i, n in enumerate(names)], FILES)


def tree(root, names):
    for n in names:
        path = root / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(n.encode())


TREE = ("a.JPG", "sub/b.mp4", "sub/deep/c.png", "sub/.d.png", ".hid/e.png", "notes.txt", "jpg")


def test_scan(spark, tmp_path):
    tree(tmp_path, TREE)
    got = media.scan_media(spark, str(tmp_path))
    assert {r["name"] for r in got.collect()} == {"a.JPG", "sub/b.mp4", "sub/deep/c.png", "jpg"}
    assert "content" not in got.columns and got.select("media_id").distinct().count() == 4
    below = media.scan_media(spark, str(tmp_path), "sub", with_content=True).collect()
    assert {(r["name"], bytes(r["content"])) for r in below} == {(n, n.encode()) for n in ("sub/b.mp4", "sub/deep/c.png")}
    assert media.scope_to_folder(got, "sub/deep").count() == 1 and media.scope_to_folder(got, "").count() == 4


def test_assets(spark):
    files = spark.createDataFrame([("vision-v1.5/config.json", 0), ("vision-v1.5/onnx/model.onnx", 1), ("onnx/model.onnx", 2)], "rel_path string, ord int")
    ask = spark.createDataFrame([(1, "https://h/o/vision-v1.5/resolve/main/onnx/model.onnx?x=1"), (2, "https://h/o/r/resolve/main/config.json"),
                                 (3, "https://h/o/r/resolve/main/other.bin")], "id int, url string")
    best = {r["id"]: (r["rel_path"], r["match"]) for r in assets.resolve_assets(ask, files).collect()}
    assert best == {1: ("onnx/model.onnx", "exact"), 2: ("vision-v1.5/config.json", "suffix"), 3: (None, None)}
    first = {r["id"]: r["rel_path"] for r in assets.resolve_assets(ask, files, first_match=True).collect()}
    assert first[1] == "vision-v1.5/onnx/model.onnx"


def vec(*x):
    return [float(v) for v in x]


def test_stored_cache(spark, tmp_path):
    store = cache.StoredCache(spark, str(tmp_path / "c"))
    assert store.read().count() == 0
    store.put(spark.createDataFrame([("", "a", vec(1)), ("@m/", "a", vec(2))], cache.CACHE_SCHEMA), 0, "w", 1)
    store.put(spark.createDataFrame([("", "a", vec(3)), ("", "b", vec(4))], cache.CACHE_SCHEMA), 1, "w", 2)
    store.put(spark.createDataFrame([("", "a", vec(3)), ("", "b", vec(4))], cache.CACHE_SCHEMA), 1, "w", 2)  # a repeated batch
    want = {("", "a", 3.0), ("@m/", "a", 2.0), ("", "b", 4.0)}
    assert {(r[0], r[1], r[2][0]) for r in store.read().collect()} == want
    assert store.read("@m/").count() == 1
    small = store.compact(str(tmp_path / "d"))
    assert {(r[0], r[1], r[2][0]) for r in small.read().collect()} == want
    assert tuple(cache.cache_stats(store.read(), "@m/").first()) == (1, 8)
    assert tuple(cache.cache_stats(store.read().where("false")).first()) == (0, 0)


def test_embed_with_cache(spark):
    files = files_df(spark, ["x/a.jpg", "b.jpg", "x/c.jpg", "bad.jpg", "x/new.jpg"])
    ks = {r["name"]: (r["k"], r["p"]) for r in files.select("name", keys.cache_key().alias("k"), keys.path_key().alias("p")).collect()}
    stored = spark.createDataFrame([("", ks["x/a.jpg"][0], vec(1)), ("", ks["x/c.jpg"][1], vec(2)), ("@m/", ks["b.jpg"][0], vec(9))], cache.CACHE_SCHEMA)

    def infer(rows):
        ok = F.col("name") != "bad.jpg"
        return rows.select("media_id", F.array(F.when(ok, 5.0).otherwise(0.0).cast("float")).alias("vector"), ok.alias("ok"))

    got, writes = cache.embed_with_cache(files, stored, "", infer)
    rows = {r["name"]: (r["vector"][0], r["from_cache"], r["ok"]) for r in got.collect()}
    assert rows == {"x/a.jpg": (1.0, True, True), "x/c.jpg": (2.0, True, True), "b.jpg": (5.0, False, True),
                    "x/new.jpg": (5.0, False, True), "bad.jpg": (0.0, False, False)}
    assert {(r["cache_key"], r["vector"][0]) for r in writes.collect()} == {(ks["x/c.jpg"][0], 2.0), (ks["b.jpg"][0], 5.0), (ks["x/new.jpg"][0], 5.0)}


def test_media_model_failures(spark):
    df = spark.createDataFrame([(i, bytearray([i])) for i in range(6)], "media_id long, content binary").coalesce(1)

    def model():
        def infer(batch):
            if any(b[0] == 2 for b in batch):
                raise RuntimeError("device lost")
            return [None if b[0] == 5 else [3.0, 4.0] for b in batch]
        return infer

    got = {r["media_id"]: (r["ok"], r["vector"][0]) for r in embed.embed_media(df, model, batch_size=2, dims=2).collect()}
    assert [got[i][0] for i in range(6)] == [True, True, False, False, True, False]
    assert got[0][1] == pytest.approx(0.6) and got[2][1] == 0.0


def test_text_model_and_captions(spark):
    q = embed.embed_text(spark.createDataFrame([("red dog",), ("blue cat",), ("red dog runs",)], "text string"), "query").collect()
    dots = [sum(a * b for a, b in zip(q[0]["vector"], r["vector"])) for r in q]
    assert dots[0] == pytest.approx(1, abs=1e-5) and dots[2] > dots[1]
    assert embed.embed_one("search_query: red dog") == pytest.approx(q[0]["vector"], abs=1e-6)
    files = files_df(spark, ["a.jpg", "b.jpg"]).withColumn("content", F.col("name"))
    have = files.where("media_id = 0").select(keys.caption_key().alias("caption_key"), F.lit("a stored one").alias("caption"))
    out, fresh = embed.caption_and_embed(files, have, lambda: (lambda xs: [f"  seen {x} " for x in xs]))
    assert {r["name"]: r["caption"] for r in out.collect()} == {"a.jpg": "a stored one", "b.jpg": "seen b.jpg"}
    assert fresh.count() == 1


def test_pixels(spark):
    data = bytearray([10, 20, 30, 255, 40, 50, 60, 255])  # two pixels, blue green red alpha
    df = spark.createDataFrame([("x", 1, 2, 4, data)], "origin string, height int, width int, channels int, data binary")
    got = pixels.normalize_pixels(df).first()["planes"]
    want = [(v / 255 - m) / d for c, m, d in zip(((30, 60), (20, 50), (10, 40)), pixels.MEAN, pixels.DEVIATION) for v in c]
    assert got == pytest.approx(want, abs=1e-5)


# ---- projections ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def clusters(spark):
    centres = RNG.normal(size=(4, 12)) * 5
    m = np.concatenate([c + RNG.normal(size=(25, 12)) * 0.5 for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "media_id long, vector array<double>")
    return m, np.repeat(range(4), 25), df


OPTIONS = {"TSNE": {"epochs": 40}, "TriMap": {"epochs": 4, "inliers": 4, "outliers": 3},
           "LLE": {"tolerance": 0.1}, "SAMMON": {"steps": 40}}


def agreement(y, labels, k=5):
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return (labels[np.argsort(d, axis=1)[:, :k]] == labels[:, None]).mean()


@pytest.mark.parametrize("method", METHODS)
def test_projection_keeps_neighbourhoods(spark, clusters, method):
    m, labels, df = clusters
    out = project(df, method, **OPTIONS.get(method, {})).toPandas().sort_values("media_id")
    y = out[["x", "y"]].to_numpy()
    assert len(y) == 100 and np.isfinite(y).all() and y.std() > 0
    if method != "LLE":  # its few test iterations only prove that it runs; see the eigenvector test
        assert agreement(y, labels) > 0.8


def test_pca_and_mds_exactly(spark, clusters):
    m, _, df = clusters
    c = m - m.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    for method in ("PCA", "MDS"):
        got = project(df, method).toPandas().sort_values("media_id")[["x", "y"]].to_numpy()
        assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_geodesics_and_weights(spark):
    ids = spark.range(6).select(F.col("id").alias("media_id"))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, dist double")
    got = {r["media_id"]: (r["d0"], r["d1"]) for r in graph.geodesics(ids, graph.both_ways(edges), [0, 5]).collect()}
    assert got == {0: (0, None), 1: (1, None), 2: (2, None), 3: (3, None), 4: (None, 1), 5: (None, 0)}
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [9.0, 9.0])], "media_id long, vector array<double>")
    w = {(r["src"], r["dst"]): r["w"] for r in graph.reconstruction_weights(rows, 2).collect()}
    assert w[0, 1] == pytest.approx(0.5, abs=1e-6) and w[0, 2] == pytest.approx(0.5, abs=1e-6)


def floyd(edges, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1])
    return d


def rolled(n, rng):
    t, h = 4 + 9 * rng.random(n), 12 * rng.random(n)
    return np.stack([t * np.cos(t), h, t * np.sin(t)], 1)


@pytest.mark.parametrize("reach", [None, 0.05, 1000.0])
def test_path_lengths_equal_all_pairs(spark, reach):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 80, 150), rng.integers(0, 80, 150), np.round(rng.random(150), 2)) if a != b]
    edges = graph.both_ways(spark.createDataFrame(pairs, "src long, dst long, dist double")).cache()
    want = floyd([(r["src"], r["dst"], r["dist"]) for r in edges.collect()], 80)
    got = {(r["s"], r["media_id"]): r["d"] for r in graph.path_lengths(edges, [5, 17, 40], reach).collect()}
    assert set(got) == {(s, i) for s, src in enumerate((5, 17, 40)) for i in range(80) if np.isfinite(want[src, i])}
    assert all(d == pytest.approx(want[(5, 17, 40)[s], i]) for (s, i), d in got.items())


def test_isomap_unrolls_and_keeps_exact_distances(spark):
    m = rolled(400, np.random.default_rng(5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "media_id long, vector array<double>")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    near = [(i, int(j), float(d[i, j])) for i in range(400) for j in np.argsort(d[i], kind="stable")[1:11]]
    exact = floyd(near + [(b, a, w) for a, b, w in near], 400)
    got = graph.isomap(df, 10).toPandas().sort_values("media_id")[["x", "y"]].to_numpy()
    placed = np.sqrt(((got[:, None] - got[None]) ** 2).sum(2))
    assert np.isfinite(exact).all()
    assert np.sqrt(((placed - exact) ** 2).sum() / (exact ** 2).sum()) < 0.12  # stress against the exact path lengths
    assert graph.landmark_count(20) == 20 and graph.landmark_count(1000) == 32 and graph.landmark_count(10 ** 6) == 200
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], df.schema)
    assert graph.far_apart(same, 4) == [0]
    flat = graph.isomap(same, 2).toPandas()
    assert len(flat) == 6 and np.isfinite(flat[["x", "y"]].to_numpy()).all()


def test_lle_finds_the_smallest_eigenvectors(spark):
    m = np.random.default_rng(6).normal(size=(50, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "media_id long, vector array<double>").cache()
    w = graph.reconstruction_weights(df, 10).cache()
    dense = np.eye(50)
    for r in w.collect():
        dense[r["src"], r["dst"]] -= r["w"]
    values, vecs = np.linalg.eigh(dense.T @ dense)
    plane, found, residual = graph.flattest(df.select("media_id"), w, 50, tolerance=2e-3)
    got = plane.toPandas().sort_values("media_id")[["v0", "v1"]].to_numpy()
    assert found == pytest.approx(values[1:3], rel=1e-3) and residual.max() <= 2e-3
    assert got.T @ got == pytest.approx(np.eye(2), abs=1e-9) and got.sum(0) == pytest.approx([0, 0], abs=1e-9)
    assert np.linalg.norm((dense.T @ dense) @ got - got * found, axis=0) == pytest.approx(residual, abs=1e-9)
    three = spark.createDataFrame([(i, [float(i * i)]) for i in range(3)], df.schema)
    assert np.isfinite(graph.lle(three, 2).toPandas().to_numpy()).all()


def test_affinities_and_fuzzy_union(spark, clusters):
    _, _, df = clusters
    p = forces.affinities(df, 100, 10)
    assert p.agg(F.sum("w")).first()[0] == pytest.approx(1, abs=1e-6)
    back = p.join(p.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v")), ["src", "dst"])
    assert back.count() == p.count() and back.agg(F.max(F.abs(F.col("w") - F.col("v")))).first()[0] < 1e-12
    top = forces.fuzzy_edges(df, 10).agg(F.max("w"), F.min("w")).first()
    assert top[0] == pytest.approx(1) and top[1] >= 0


def test_projection_edges(spark):
    one = spark.createDataFrame([(7, [1.0, 2.0])], "media_id long, vector array<double>")
    assert project(one, "TSNE").count() == 1 and project(one.where("false"), "UMAP").count() == 0
    with pytest.raises(ProjectionError, match="PCA"):
        project(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0])], "media_id long, vector array<double>"), "PCA").count()


# ---- jobs -----------------------------------------------------------------------------

def test_map_session_and_resume(spark, tmp_path):
    names = [f"{'ab'[i % 2]}/p{i}.jpg" for i in range(20)]
    files = files_df(spark, names)

    def infer(rows):
        v = F.array(*(((F.col("media_id") * m) % 7 + 1).cast("float") for m in (1, 2, 3)))
        return rows.select("media_id", v.alias("vector"), F.lit(True).alias("ok"))

    empty = spark.createDataFrame([], cache.CACHE_SCHEMA)
    built = plans.build_map(files, empty, "nomic", infer, method="PCA", max_rounds=2)
    assert built.n_files == 20 and built.n_clusters == 4 and "20 media files" in built.status()
    assert built.cache_writes.count() == 20
    sessions.session_save(built.items, str(tmp_path), "s1", built.mode)
    saved = sessions.session_load(spark, str(tmp_path), "s1")
    assert saved.columns == list(sessions.SESSION_COLUMNS)

    def rebuild(rows):
        return plans.Map(rows, "rebuilt", rows.count(), 0)

    sixteen = files.where(~F.col("media_id").isin(3, 4, 5, 6))  # exactly 80 % are left, gaps in the middle
    back = plans.resume_map(saved, sixteen, rebuild, built.cache_writes)
    want = {r["media_id"]: (r["x"], r["cluster"]) for r in built.items.collect()}
    got = {r["media_id"]: (r["x"], r["cluster"]) for r in back.items.collect()}
    assert got == {i: want[i] for i in want if i not in (3, 4, 5, 6)}
    assert [r["ord"] for r in back.items.orderBy("ord").collect()] == list(range(16))
    assert back.vectors.where(F.size("vector") == 3).count() == 16
    assert plans.resume_map(saved, files.where("media_id >= 5"), rebuild).mode == "rebuilt"

    found = plans.search_map(built, "anything", lambda t: [1.0, 2.0, 3.0], selected=2)
    assert found.count() == 20 and found.where("media_id = 2").first()["color"] == "#fff"
    assert plans.search_map(built, " ", lambda t: []) is None


def test_viewer_and_drill_down(spark):
    files = files_df(spark, [f"{'ab'[i % 2]}/p{i}.jpg" for i in range(12)])
    view = plans.build_viewer(files, max_rounds=1)
    order = [r["media_id"] for r in view.items.orderBy("ord").collect()]
    assert order == [0, 2, 4, 6, 8, 10, 1, 3, 5, 7, 9, 11] and view.status() == "12 media files · viewer mode"
    with pytest.raises(ValueError):
        plans.search_map(view, "x", lambda t: [])
    rows, note = plans.drill_down(files, "#folder:a", sample=4, seed=1)
    assert rows.count() == 4 and note == "sampled 4 of 6"
    assert plans.drill_down(files, "#dt:2024-05-01T12")[0].count() == 12
    assert plans.drill_down(files, "#dt:2023-05-01")[0] is None
    assert plans.drill_down(files, "#dt:2024-13-01")[0] is None
    assert plans.drill_down(files, "#")[0].count() == 12


# ---- streams --------------------------------------------------------------------------

def test_stream_embeds_new_files_and_refreshes_the_map(spark, tmp_path):
    root = tmp_path / "media"
    tree(root, ("a.jpg", "skip.txt"))
    store = cache.StoredCache(spark, str(tmp_path / "cache"))
    progress = streams.ProgressiveMap(str(tmp_path / "seen"), max_rounds=1)

    def infer(rows):
        v = F.array((F.col("size") % 5 + 1).cast("float"), (F.pmod("media_id", F.lit(7)) + 1).cast("float"), F.lit(1.0).cast("float"))
        return rows.select("media_id", v.alias("vector"), F.lit(True).alias("ok"))

    def run():
        q = streams.stream_embed(streams.stream_media(spark, str(root)), store, "", infer, str(tmp_path / "ckpt"), progress)
        q.awaitTermination(120)

    run()
    assert store.read().count() == 1 and progress.refreshes == 0 and progress.points.count() == 1
    tree(root, ("sub/b.png", "c.mp4", "d.gif", ".h/e.png"))
    run()
    assert store.read().count() == 4 and progress.refreshes == 1 and progress.points.count() == 4


def test_the_map_of_a_stream_outlives_its_driver(spark, tmp_path):
    def batch(*ids):
        return spark.createDataFrame([(i, vec(i % 5, i % 3, 1)) for i in ids], "media_id long, vector array<float>")

    def grow(batch_id, *ids):  # each batch by a driver of its own
        streams.ProgressiveMap(str(tmp_path / "seen"), max_rounds=1)(batch(*ids), batch_id)
        now = streams.ProgressiveMap(str(tmp_path / "seen"))
        return now.refreshes, {r["media_id"] for r in now.points.collect()}

    new = streams.ProgressiveMap(str(tmp_path / "seen"))
    assert new.refreshes == 0 and new.points is None
    assert grow(0, 1, 2) == (0, {1, 2})
    assert grow(1, 2, 3, 4) == (1, {1, 2, 3, 4})
    assert grow(2, 4, 5, 6) == (1, {1, 2, 3, 4})  # two new ids, one less than the interval
    assert grow(2, 4, 5, 6) == (1, {1, 2, 3, 4})  # the same batch again
    assert grow(3, 7) == (2, {1, 2, 3, 4, 5, 6, 7})
    assert grow(1, 2, 3, 4) == (2, {1, 2, 3, 4, 5, 6, 7})
    before = streams.ProgressiveMap(str(tmp_path / "seen"))._growth(spark, 3)
    assert (before["n"], before["last_count"], before["refreshes"]) == (6, 4, 1)


def test_debounce_stream(spark, tmp_path):
    rows = [("u", 0, "a"), ("u", 100, "ab"), ("v", 0, "x"), ("v", 400, " "), ("w", 0, "q")]
    df = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, ms // 1000, (ms % 1000) * 1000), v) for k, ms, v in rows],
                               "k string, ts timestamp, value string")
    want = {("u", "ab", False), ("v", "x", False), ("v", " ", True), ("w", "q", False)}
    assert {(r["k"], r["value"], r["cleared"]) for r in streams.debounce(df, ["k"], "ts", "value").collect()} == want
    src = tmp_path / "in"
    df.coalesce(1).write.parquet(str(src))
    late = spark.createDataFrame([("z", datetime(2024, 1, 1, 0, 5), "end")], df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streams.debounce_stream(stream, ["k"], "ts", "value").writeStream.format("memory").queryName("bursts").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        late.coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        spark.createDataFrame([("u", datetime(2024, 1, 1), "too late")], df.schema).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        got = {(r["k"], r["value"], r["cleared"]) for r in spark.table("bursts").collect()}
    finally:
        q.stop()
    assert got == want
    assert os.path.isdir(str(tmp_path / "ck"))


def test_cache_writers_do_not_overwrite_each_other(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([("", k, vec(v)) for k, v in pairs], cache.CACHE_SCHEMA)

    store = cache.StoredCache(spark, str(tmp_path / "c"))
    store.put(rows(("a", 1), ("b", 2)), 0, "batch", 10)
    small = store.compact(str(tmp_path / "d"))
    small.put(rows(("z", 3), ("a", 4)), 0, "stream-1", 20)  # the first batch of a new stream
    small.put(rows(("z", 3), ("a", 4)), 0, "stream-1", 20)  # replayed
    small.put(rows(("a", 5)), 0, "stream-2", 15)  # another writer's earlier value
    assert {(r[1], r[2][0]) for r in small.read().collect()} == {("a", 4.0), ("b", 2.0), ("z", 3.0)}
    with pytest.raises(ValueError):
        store.compact(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        store.put(rows(("a", 1)), 0, "no/such")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises; it must not read as an empty cache
        cache.StoredCache(spark, str(tmp_path / "broken")).read().collect()


def test_geodesics_follow_long_chains(spark):
    n = 60
    ids = spark.range(n).withColumnRenamed("id", "media_id")
    edges = spark.createDataFrame([(i, i + 3, 1.0) for i in range(0, n - 3, 3)], "src long, dst long, dist double")
    got = {r["media_id"]: r["d0"] for r in graph.geodesics(ids, graph.both_ways(edges), [0]).collect()}
    assert all(got[i] == (i / 3 if i % 3 == 0 else None) for i in range(n))


def test_written_rounds_are_dropped(spark):
    from lumaspark.operators.spread import spread
    from lumaspark.session import checkpoint_dir

    def tables():
        top = checkpoint_dir(spark).removeprefix("file:") + "/lumaspark"
        return len(os.listdir(top)) if os.path.isdir(top) else 0

    pts = spark.range(60).selectExpr("id AS media_id", "CAST(id % 8 AS DOUBLE) / 100 AS x", "CAST(id % 5 AS DOUBLE) / 100 AS y")
    before = tables()
    spread(pts, max_rounds=3).collect()
    few = tables() - before
    spread(pts, max_rounds=6).collect()
    assert tables() - before - few <= few


def test_walk_keeps_underscore_names_and_reads_bytes_late(spark, tmp_path):
    tree(tmp_path / "m", ("a.jpg", "_b.png", "_d/c.mp4", "_d/e/f.jpg", ".h/g.jpg", "x.txt", ".k.jpg"))
    files = media.walk_media(spark, str(tmp_path / "m"))
    assert {r["name"] for r in files.collect()} == {"a.jpg", "_b.png", "_d/c.mp4", "_d/e/f.jpg"}
    assert {r["name"] for r in media.walk_media(spark, str(tmp_path / "m"), "_d").collect()} == {"_d/c.mp4", "_d/e/f.jpg"}
    scanned = {r["name"]: (r["media_id"], r["size"]) for r in media.scan_media(spark, str(tmp_path / "m")).collect()}
    walked = {r["name"]: (r["media_id"], r["size"]) for r in files.collect()}
    assert scanned.items() <= walked.items() and "a.jpg" in scanned
    gone = spark.createDataFrame([("no.jpg", 0)], "name string, size bigint")
    got = {r["name"]: r["content"] for r in media.read_content(files.select("name", "size").unionByName(gone), str(tmp_path / "m")).collect()}
    assert got.pop("no.jpg") is None and all(bytes(v) == (tmp_path / "m" / n).read_bytes() for n, v in got.items())


def test_replay_keeps_rows_and_places(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([("", k, vec(v)) for k, v in pairs], cache.CACHE_SCHEMA)

    def held():
        return {(r[1], r[2][0]) for r in store.read().collect()}

    store = cache.StoredCache(spark, str(tmp_path / "c"))
    calls, got = [], []

    def infer(files):
        calls.append(1)
        return files.select("media_id", F.array(F.col("size").cast("float")).alias("vector"), F.lit(True).alias("ok"))

    files = files_df(spark, [f"a/p{i}.jpg" for i in range(5)])
    step = streams.embed_batch(store, "", infer, lambda done, n: got.append({(r["media_id"], tuple(r["vector"])) for r in done.collect()}), "s")
    for _ in range(3):
        step(files, 0)
        assert store.read().count() == 5
    assert got[0] == got[1] == got[2] and len(got[0]) == 5
    place = store.begin("s", 1)
    assert store.begin("t", 0) > place and store.begin("s", 1) == place
    store.put(rows(("z", 1)), 0, "t")
    store.put(rows(("z", 2)), 1, "s")  # begun before the other
    assert ("z", 1.0) in held()
    assert not store.put(rows(("z", 9)), 0, "t") and ("z", 1.0) in held()
    rows(("y", 1)).drop("model").withColumn("put_at", F.lit(10**15)).write.parquet(str(tmp_path / "c/writer=u/seq=0/model="))  # not complete
    assert not any(k == "y" for k, _ in held())
    assert {r[1] for r in store.read(as_of=store.begin("t", 0)).collect()} == {r[1] for r in store.read().collect()}
    assert store.read(as_of=store.begin("s", 0)).count() == 0 and store.read(as_of=store.begin("s", 0), own=("s", 0)).count() == 5


def test_caches_from_before_records_are_taken_over(spark, tmp_path):
    old = spark.createDataFrame([("", "a", vec(1), 5)], cache.CACHE_SCHEMA + ", put_at bigint")
    old.write.partitionBy("model").parquet(str(tmp_path / "c/writer=w/seq=0"))
    store = cache.StoredCache(spark, str(tmp_path / "c"))
    assert store.read().count() == 1
    store.put(spark.createDataFrame([("", "b", vec(1))], cache.CACHE_SCHEMA), 1, "w")
    assert {r[1] for r in store.read().collect()} == {"a", "b"}


def test_folder_stream_sees_each_file_once(spark, tmp_path):
    root, seen = tmp_path / "m", []

    def run():
        files = streams.stream_media(spark, str(root), with_content=True, log=str(tmp_path / "log"))
        files.writeStream.foreachBatch(lambda b, n: seen.append({(r["name"], bytes(r["content"])) for r in b.collect()})).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return {name for name, _ in seen[-1]}

    tree(root, ("a.jpg", "_b.png", "_d/c.mp4", ".h/g.jpg", "x.txt"))
    assert run() == {"a.jpg", "_b.png", "_d/c.mp4"}
    tree(root, ("_d/e/f.jpg",))
    (root / "a.jpg").write_bytes(b"changed")
    assert run() == {"_d/e/f.jpg", "a.jpg"} and ("a.jpg", b"changed") in seen[-1]
    assert all(bytes(c) == (root / n).read_bytes() for n, c in seen[-1])


def test_rounds_on_moving_tiles_are_the_same(spark):
    from lumaspark.operators import spread

    pts = spark.range(300).selectExpr("id AS media_id", "CAST(id % 20 AS DOUBLE) * CASE WHEN id % 20 < 5 THEN 30 ELSE 200 END AS x", "CAST(id DIV 20 AS DOUBLE) * CASE WHEN id % 20 < 5 THEN 30 ELSE 200 END AS y")
    stacks = spread.to_stacks(pts).withColumn("deg", F.lit(0).cast("bigint"))
    for _ in range(3):
        after = spread.materialize(spread.one_round(stacks, 300.0))
        some = after.where("deg > 0")
        whole, part = ({r["gid"]: (round(r["px"], 9), round(r["py"], 9), r["deg"]) for r in spread.overlap_pushes(after, side, rows, moving).collect()}
                       for side, rows, moving in ((300.0, 4096, None), (400.0, 8, some)))
        assert whole == part and 0 < some.count() < 300
        stacks = after


def test_large_samples_are_those_of_the_order(spark):
    from lumaspark.operators.sampling import sample_n, sample_order

    df = spark.range(30_000).withColumnRenamed("id", "media_id")
    order = [r["media_id"] for r in df.orderBy(sample_order("media_id", 3), "media_id").collect()]
    for n in (900, 1_500, 12_000, 29_999, 40_000):
        assert {r["media_id"] for r in sample_n(df, n, 3).collect()} == set(order[:n])


def _crowd(spark, n=260):
    """Clumps of a few items' width, not all in reach of each other, and a stack of three."""
    rng = np.random.default_rng(11)
    xy = rng.uniform(-260, 260, size=(n // 10, 2)).repeat(10, axis=0) + rng.normal(size=(n // 10 * 10, 2)) * 9
    xy[:3] = xy[0]
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "media_id long, x double, y double")


def test_rounds_of_tiles_alone_are_rounds_of_all_tiles(spark):
    from lumaspark.operators import spread

    stacks = spread.materialize(spread.to_stacks(_crowd(spark)).withColumn("deg", F.lit(0).cast("bigint")))
    for side, rounds in ((90.0, 4), (130.0, 5), (60.0, 2)):
        alone = spread.rounds_alone(stacks, side, rounds, side == 90.0).toPandas().sort_values("gid")
        for _ in range(rounds):
            stacks = spread.materialize(spread.one_round(stacks, 400.0))
        whole = stacks.toPandas().sort_values("gid")
        assert alone["gid"].tolist() == whole["gid"].tolist() and alone["deg"].tolist() == whole["deg"].tolist() and whole["deg"].max() > 0
        assert np.allclose(alone[["x", "y"]], whole[["x", "y"]], rtol=0, atol=1e-9)


@pytest.mark.parametrize("ids, crowd", [("media_id", 1 << 28), ("media_id", 1), ("media_id DIV 2", 1 << 28), ("IF(media_id = 7, NULL, media_id)", 1 << 28)])
def test_many_rounds_are_one_step_unless_tiles_are_crowded_or_ids_repeat(spark, monkeypatch, ids, crowd):
    from lumaspark.operators import spread

    steps = []
    monkeypatch.setattr(spread, "_CROWD", crowd)
    monkeypatch.setattr(spread, "next_round", lambda before, df, kept=spread.next_round: steps.append(1) or kept(before, df))
    pts = _crowd(spark, 80).selectExpr(f"{ids} AS media_id", "x", "y")

    def rows():
        steps.clear()
        out = spread.spread(pts, density=0.4, max_rounds=4, rows_per_tile=64).collect()
        return sorted((r["media_id"] or -1, round(r["x"], 6), round(r["y"], 6)) for r in out), len(steps)

    got, taken = rows()
    monkeypatch.setattr(spread, "AT_ONCE", ())
    assert rows() == (got, 4) and taken == (1 if ids == "media_id" and crowd > 1 else 4)


@pytest.mark.parametrize("block", [1, 100, 1 << 12])
def test_pushes_are_those_of_all_pairs(monkeypatch, block):
    from lumaspark.operators import spread

    monkeypatch.setattr(spread, "_PAIRS", 50)
    monkeypatch.setattr(spread, "_BLOCK", block)
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-300, 300, 150), rng.uniform(-80, 500, 150)
    x[4:40], y[4:40] = rng.uniform(0, 60, 36), rng.uniform(0, 60, 36)
    x[:4], y[:4] = 10.0, 20.0
    weight, moved = rng.integers(1, 4, 150).astype(float), rng.random(150) < 0.6
    sums = np.zeros((3, 150))
    spread._add_pushes(x, y, weight, moved, np.flatnonzero(moved), sums)
    dx, dy = x - x[:, None], y - y[:, None]
    d = np.hypot(dx, dy)
    met = (d > 0) & (d < spread.ITEM) & (moved | moved[:, None])
    f = np.where(met, ((spread.ITEM - d) / 2 + spread.NUDGE) / np.where(d > 0, d, 1), 0) * weight
    assert np.allclose(sums, [-(f * dx).sum(1), -(f * dy).sum(1), (met * weight).sum(1)], rtol=0, atol=1e-9)
