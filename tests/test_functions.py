"""Expressions, on the worked examples each of them is defined by."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaspark.functions import exif, keys, paths, text, timeparts, vectors, viewstate


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name,ext,kind,hidden,folder,base", [
    ("a/b/c.JPG", "jpg", "image", False, "a/b", "c.JPG"),
    ("clip.webm", "webm", "video", False, "(root)", "clip.webm"),
    ("x.jpg/readme", "readme", None, False, "x.jpg", "readme"),
    ("jpg", "jpg", "image", False, "(root)", "jpg"),
    ("a/.git/x.png", "png", "image", True, "a/.git", "x.png"),
    (".hidden.png", "png", "image", True, "(root)", ".hidden.png"),
    ("/top.png", "png", "image", False, "(root)", "top.png"),
    ("a/b/", "", None, False, "a/b", "a/b/"),
])
def test_paths(spark, name, ext, kind, hidden, folder, base):
    r = spark.createDataFrame([(name,)], "n string").select(
        paths.media_ext("n"), paths.media_kind("n"), paths.is_hidden("n"), paths.folder_of("n"), paths.basename_of("n")).first()
    assert tuple(r) == (ext, kind, hidden, folder, base)


def test_breadcrumbs(spark):
    rows = paths.path_prefixes(spark.createDataFrame([(1, "a/b/c.jpg"), (2, "r.jpg")], "media_id long, name string")).collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, 1, "a", "a", ""), (1, 2, "b", "a/b", "a"), (2, 0, "(root)", "", None)]


def test_cache_key_ignores_folders(spark):
    ts = datetime(2023, 11, 14, 22, 13, 20)
    rows = [(n, 12345, ts) for n in ("photos/trip/a.jpg", "trip/a.jpg", "a.jpg")] + [("x/a.jpg", 100, ts), ("y/a.jpg", 200, ts)]
    got = [r[0] for r in spark.createDataFrame(rows, "name string, size long, last_modified timestamp").select(keys.cache_key()).collect()]
    assert set(got[:3]) == {"a.jpg:12345:1700000000000"} and got[3] != got[4]


def test_namespaces(spark):
    v = ["nomic", "chrome-ai", "sapiens2-fp16", "sapiens2-int8"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(keys.model_namespace("v")).collect()]
    assert got == ["", "@chrome-ai/", "@sapiens2/", "@sapiens2-int8/"]


def test_hosts_and_errors(spark):
    hosts = spark.createDataFrame([("  https://h.co/  ",), ("https://h.co///",), ("   ",), (None,)], "h string")
    assert [r[0] for r in hosts.select(text.normalize_host("h")).collect()] == ["https://h.co", "https://h.co", "", ""]
    cases = [("TypeError", "Failed to fetch", True), ("TypeError", "Load failed", True), ("Error", "model download failed: 404", True),
             ("Error", "Could not locate file: config.json", True), ("AbortError", "download failed", False),
             ("Error", "WebGPU device lost", False), ("TypeError", "foo.bar is not a function", False), (None, None, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "n string, m string")
    assert [r[0] for r in df.select(text.is_download_error(F.col("n"), F.col("m"))).collect()] == [c[2] for c in cases]


def test_sizes(spark):
    df = spark.createDataFrame([(512,), (1048575,), (1048576,), (1310720,), (None,)], "s long")
    assert [r[0] for r in df.select(text.format_size("s")).collect()] == ["1 KB", "1024 KB", "1.0 MB", "1.3 MB", None]
    big = spark.createDataFrame([(1610612736,), (3145728,), (2048,)], "s long")
    assert [r[0] for r in big.select(text.format_bytes("s")).collect()] == ["1.5 GB", "3 MB", "2 KB"]


def test_colors(spark):
    df = spark.createDataFrame([(0,), (9,), (None,)], "c int")
    assert [r[0] for r in df.select(text.cluster_color("c")).collect()] == [text.CLUSTER_COLORS[0], text.CLUSTER_COLORS[1], "#6b7280"]


FRAGMENTS = [
    ("#folder:a/b", ("folder", "a/b", None, None, None, None, None, None)),
    ("#folder:", ("folder", "", None, None, None, None, None, None)),
    ("#dt:2025-01-15", ("datetime", None, "day", 2025, 1, 15, None, None)),
    ("#dt:2025-01-15T14", ("datetime", None, "hour", 2025, 1, 15, 14, None)),
    ("#dt:2025-01-15T14:30", ("datetime", None, "minute", 2025, 1, 15, 14, 30)),
    ("#dt:2025-01-15:30", ("datetime", None, "minute", 2025, 1, 15, None, 30)),
    ("#dt:2025-13-40", ("datetime", None, "day", 2025, None, None, None, None)),
    ("#dt:2025-1-15", None), ("#dt:2025-01-15T14:3", None), ("#", None), ("", None), (None, None), ("#x", None),
]


def test_view_state(spark):
    df = spark.createDataFrame([(f[0],) for f in FRAGMENTS], "f string").select("f", viewstate.parse_view_state("f").alias("s"))
    got = df.withColumn("back", viewstate.format_view_state("s")).collect()
    for r, (fragment, want) in zip(got, FRAGMENTS):
        assert (tuple(r["s"]) if r["s"] else None) == want, fragment
    assert [r["back"] for r in got[:5]] == [f[0] for f in FRAGMENTS[:5]] and got[-1]["back"] == "#"


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1000, 9999), st.integers(1, 12), st.integers(1, 28), st.integers(0, 23), st.integers(0, 59)), min_size=1, max_size=20))
def test_view_state_round_trip(spark, parts):
    rows = [(f"#dt:{y:04d}-{m:02d}-{d:02d}T{h:02d}:{n:02d}",) for y, m, d, h, n in parts]
    df = spark.createDataFrame(rows, "f string").select("f", viewstate.parse_view_state("f").alias("s"))
    got = df.select("f", viewstate.format_view_state("s").alias("g")).collect()
    assert all(r["f"] == r["g"] for r in got)


def test_datetime_filter_prunes_and_matches(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + i % 12, 1 + i % 28, i % 24, i % 60)) for i in range(500)]
    spark.createDataFrame(rows, "media_id long, last_modified timestamp").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for args in ((2024,), (2024, 12), (2024, 2, 6), (2024, 5, 5, 4), (2024, 5, 5, 4, 4)):
        want = {i for i, t in rows if (t.year, t.month, t.day, t.hour, t.minute)[:len(args)] == args}
        got = timeparts.filter_datetime(df, *args)
        assert {r["media_id"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(last_modified" in plan and "LessThan(" in plan
    scattered = timeparts.filter_datetime(df, 2024, hour=3)
    assert {r["media_id"] for r in scattered.collect()} == {i for i, t in rows if t.hour == 3}
    assert timeparts.filter_datetime(df, 2024, 13).count() == 0


def test_exif(spark):
    rows = [(1, None), (2, {}), (3, {"FNumber": "2.8", "ExposureTime": "0.005", "FocalLength": "50", "Other": "x", "Make": ""}),
            (4, {"ExposureTime": "2", "latitude": "1.5"}), (5, {"latitude": "48.2", "longitude": "16.123456"}), (6, {"ExposureTime": "0"})]
    df = spark.createDataFrame(rows, "media_id long, exif map<string,string>")
    got = {(r["media_id"], r["label"]): r["value"] for r in exif.exif_rows(df).collect()}
    assert got == {(3, "Aperture"): "f/2.8", (3, "Shutter Speed"): "1/200s", (3, "Focal Length"): "50mm", (4, "Shutter Speed"): "2s",
                   (4, "Latitude"): "1.500000", (5, "Latitude"): "48.200000", (5, "Longitude"): "16.123456"}
    gps = {r[0]: (r[1], r[2]) for r in df.select("media_id", exif.gps_text(exif.gps_of("exif")), exif.has_exif("exif")).collect()}
    assert gps[5] == ("48.20000, 16.12346", True) and gps[4] == (None, True) and gps[1] == (None, False) and gps[2] == (None, False)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=8))
def test_unit_length(spark, v):
    got = spark.createDataFrame([([float(x) for x in v],)], "v array<float>").select(vectors.l2_normalize("v")).first()[0]
    total = sum(x * x for x in got)
    assert total == 0 if all(x * x < 1e-38 for x in v) and total == 0 else abs(total - 1) < 1e-4 or max(abs(x) for x in v) < 1e-18


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0], [0.0] * 4)], "a array<double>, z array<double>")
    r = df.select(vectors.l2_normalize("a"), vectors.l2_normalize("z"), vectors.cosine("a", "a"), vectors.cosine("a", "z")).first()
    assert r[0] == [0.5] * 4 and r[1] == [0.0] * 4 and abs(r[2] - 1) < 1e-12 and r[3] is None
    tokens = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], "item_id long, hidden array<float>")
    got = {r["item_id"]: r["vector"] for r in vectors.mean_pool(tokens).collect()}
    assert got[2] == pytest.approx([0.6, 0.8], abs=1e-6) and got[1] == pytest.approx([0.7071068] * 2, abs=1e-6)
    m = spark.createDataFrame([({"pooler_output": [1.0], "x": [2.0]},), ({"x": [2.0]},)], "m map<string,array<double>>")
    assert [r[0] for r in m.select(vectors.pick_output("m")).collect()] == [[1.0], [2.0]]


def test_prefixes(spark):
    df = spark.createDataFrame([("ball",), ("",)], "t string")
    assert [r[0] for r in df.select(text.prefix_text("t", "query")).collect()] == ["search_query: ball", "search_query: "]
    assert [r[0] for r in df.select(text.is_blank("t")).collect()] == [False, True]


def test_long_vectors_take_linear_time(spark):
    import time

    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: (i + F.col("id") % 7).cast("float")).alias("v"))
    df = spark.createDataFrame(df.toArrow())
    vectors_of = df.select(vectors.l2_normalize("v").alias("u"))
    vectors_of.limit(10).collect()
    t = time.perf_counter()
    total = vectors_of.agg(F.sum(vectors.dot("u", "u"))).first()[0]
    assert abs(total - 2000) < 1e-2 and time.perf_counter() - t < 15  # the quadratic form took more than a minute


def test_edges_of_time_filters(spark):
    df = spark.createDataFrame([("0999-06-01 00:00:00",), ("9999-12-31 23:59:59",), ("2024-01-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("last_modified"))
    assert timeparts.filter_datetime(df, 999).count() == 1 and timeparts.filter_datetime(df, 9999).count() == 1
    assert timeparts.filter_datetime(df, 9999, 12, 31).count() == 1 and timeparts.filter_datetime(df, 2024, 13).count() == 0


def test_fragment_with_a_newline_is_malformed(spark):
    df = spark.createDataFrame([("#dt:2025-01-15T14:30\n",), ("#dt:2025-01-15T14:30",)], "f string").select(viewstate.parse_view_state("f").alias("s"))
    assert [r["s"] and r["s"]["granularity"] for r in df.collect()] == [None, "minute"]
