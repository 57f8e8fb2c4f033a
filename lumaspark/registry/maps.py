"""Registered queries over whole maps: clusters, projections, end-to-end jobs, bursts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumaspark.functions.keys import path_key
from lumaspark.operators import cluster, embed, layout, search, summary
from lumaspark.operators.knn import knn_graph, neighbour_count
from lumaspark.operators.project import graph, linear, project
from lumaspark.plans import maps as plans
from lumaspark.registry.data import (
    CACHE_KEY_SQL, CATALOGUE_SQL, MEDIA_SQL, PATH_KEY_SQL, POINTS_SQL, as_catalogue, catalogue, media, points, table, vectors,
)
from lumaspark.registry.layout import _FOLDERS_SQL
from lumaspark.registry.vectors import (
    _BOTH_SQL, SCORED, VEC, _cache, _size_model, query_vector,
)
from lumaspark.operators.spread import overlap_degree
from lumaspark.session import checkpoint_dir, materialize
from lumaspark.sources import cache, sessions
from lumaspark.sources.media import _file_system, catalogue_from_tree, scan_media
from lumaspark.streaming import media as streams
from lumaspark.streaming.media import debounce

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# Fixed start of the k-means checks.
START = ((0.1, 0.1), (-0.1, 0.1), (0.1, -0.1), (-0.1, -0.1), (0.0, 0.2))
ROUNDS = 60  # as many as the operator takes at most; past the fixed point a round changes nothing


def kmeans_sql(rounds: int = ROUNDS, start: str | None = None) -> str:
    """k-means as one CTE per round: assign, average, keep the centroid of an empty cluster."""
    values = ", ".join(f"({j}, {x}::DOUBLE, {y}::DOUBLE)" for j, (x, y) in enumerate(START))
    parts = [POINTS_SQL, f"c0(j, cx, cy) AS ({start or 'VALUES ' + values})"]
    for r in range(rounds):
        parts.append(f"l{r} AS MATERIALIZED (SELECT media_id, x, y, arg_min(j, ((x - cx) * (x - cx) + (y - cy) * (y - cy), j)) AS cluster FROM pts, c{r} GROUP BY ALL)")
        if r < rounds - 1:
            parts.append(f"m{r} AS (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM l{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(mx, cx) AS cx, coalesce(my, cy) AS cy FROM c{r} LEFT JOIN m{r} ON cluster = j)")
    return ", ".join(parts)


KM = f"{kmeans_sql()}, km AS (SELECT media_id, x, y, cluster FROM l{ROUNDS - 1})"
PALETTE = "['#f87171','#fb923c','#facc15','#4ade80','#38bdf8','#818cf8','#f472b6','#a78bfa']"


def _labels(spark, sf):
    return cluster.kmeans_from(points(spark, sf), list(START), ROUNDS)[0]


@query("kmeans_labels", f"WITH {KM} SELECT media_id, CAST(cluster AS INTEGER) AS cluster FROM km")
def kmeans_labels(spark, sf):
    return _labels(spark, sf).select("media_id", "cluster")


@query("cluster_sizes", f"WITH {KM} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM km GROUP BY 1")
def cluster_sizes(spark, sf):
    s = summary.cluster_summary(_labels(spark, sf))
    return s.select("cluster", "n", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query("cluster_colors", f"""SELECT vec_id AS media_id, CASE WHEN label = 9 THEN '#6b7280' ELSE list_extract({PALETTE}, label % 8 + 1) END AS color FROM embeddings""")
def cluster_colors(spark, sf):
    from lumaspark.functions.text import cluster_color

    c = F.when(F.col("label") != 9, F.col("label"))
    return vectors(spark, sf).select("media_id", cluster_color(c).alias("color"))


_SAMPLED = """SELECT row_number() OVER (ORDER BY h, media_id) - 1 AS j, x AS cx, y AS cy FROM
  (SELECT *, md5('1:' || CAST(media_id AS VARCHAR)) AS h FROM pts)
  QUALIFY j < (SELECT least(8, greatest(2, ceil(sqrt(count(*) / 2.0::DOUBLE)))) FROM pts)"""


@query("kmeans_sampled_start", f"WITH {kmeans_sql(ROUNDS, _SAMPLED)} SELECT media_id, CAST(cluster AS INTEGER) AS cluster FROM l{ROUNDS - 1}")
def kmeans_sampled_start(spark, sf):
    p = points(spark, sf)
    return cluster.kmeans(p, cluster.choose_k(p.count()), seed=1)[0].select("media_id", "cluster")


@query("kmeans_converged", f"""WITH {KM}, m AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM km GROUP BY cluster), d AS (SELECT media_id, km.cluster, m.cluster AS other,
  (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM km, m) SELECT media_id, CAST(any_value(cluster) AS INTEGER) AS cluster,
  TRUE AS nearest FROM d GROUP BY media_id""")
def kmeans_converged(spark, sf):
    """The fixed point: labels, and whether each point's cluster is that of the nearest mean of the clusters."""
    got = materialize(_labels(spark, sf).select("media_id", "x", "y", "cluster"))
    means = [(r["cluster"], r["x"], r["y"]) for r in got.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("cluster").collect()]
    d = F.array(*((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) for _, x, y in means))
    own = F.get(d, F.array_position(F.array(*(F.lit(j) for j, _, _ in means)), F.col("cluster")).cast("int") - 1)
    return got.select("media_id", "cluster", (own <= F.array_min(d) + 1e-9).alias("nearest"))


@query("cluster_count", """WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, CAST(least(8, greatest(2, ceil(sqrt(n / 2.0::DOUBLE)))) AS BIGINT) AS k,
  CAST(least(greatest(2, least(15, n - 1)), n - 1) AS BIGINT) AS neighbours FROM g""")
def cluster_count(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(8), F.greatest(F.lit(2), F.ceil(F.sqrt(F.col("n") / 2))))
    m = F.least(F.greatest(F.lit(2), F.least(F.lit(15), F.col("n") - 1)), F.col("n") - 1)
    return g.select("event_type", "n", k.cast("bigint").alias("k"), m.cast("bigint").alias("neighbours"))


@query("similar_with_map", f"""WITH {KM}, {SCORED},
b AS (SELECT count(*) AS n, (min(x) + max(x)) / 2 AS bx, (min(y) + max(y)) / 2 AS by_, greatest(max(x) - (min(x) + max(x)) / 2, max(y) - (min(y) + max(y)) / 2) AS r FROM km)
SELECT ranked.media_id, score, CAST(cluster AS INTEGER) AS cluster, round((x - bx) / r * (sqrt(n) * 48 * 1.4::DOUBLE), 6) AS x,
  round((y - by_) / r * (sqrt(n) * 48 * 1.4::DOUBLE), 6) AS y FROM ranked JOIN km ON km.media_id = ranked.media_id, b WHERE rank < 10""")
def similar_with_map(spark, sf):
    """The ten vectors most similar to vector 0, with cluster and place on the map."""
    top = search.search(vectors(spark, sf), query_vector(spark, sf), k=10).select("media_id", "score")
    placed = layout.normalize_layout(points(spark, sf))
    labels = _labels(spark, sf).select("media_id", "cluster")
    return top.join(labels, "media_id").join(placed, "media_id").select(
        "media_id", "score", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# ---- projections ----------------------------------------------------------------------

def _projected(method, **options):
    def run(spark, sf):
        return project(vectors(spark, sf), method, **options).select("media_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    return run


query("projection_pca")(_projected("PCA"))
query("projection_mds")(_projected("MDS"))
query("projection_sammon")(_projected("SAMMON"))
query("projection_isomap")(_projected("ISOMAP"))
query("projection_lle")(_projected("LLE"))
query("projection_tsne")(_projected("TSNE"))
query("projection_umap")(_projected("UMAP"))
query("projection_trimap")(_projected("TriMap"))


@query("projections_kept", "SELECT unnest(['TSNE', 'UMAP']) AS method, (SELECT count(*) FROM embeddings) AS n, TRUE AS better")
def projections_kept(spark, sf):
    """Whether a map keeps more of the ten nearest neighbours of each vector than its start, the principal components, does."""
    v = vectors(spark, sf).select("media_id", "vector")
    near = materialize(knn_graph(v, 10, metric="euclidean").select("src", "dst"))

    def kept(method):
        places = materialize(project(v, method).select("media_id", F.array("x", "y").alias("vector")))
        found = knn_graph(places, 10, metric="euclidean").select("src", "dst")
        return places.count(), found.join(near, ["src", "dst"]).count()

    _, start = kept("PCA")
    rows = [(method, *kept(method)) for method in ("TSNE", "UMAP")]
    return v.sparkSession.createDataFrame([(m, n, hits > start) for m, n, hits in rows], "method string, n long, better boolean")


@query("projection_variance", f"""WITH {VEC}, e AS (SELECT media_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM vec),
m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), c AS (SELECT media_id, e.i, x - m AS x FROM e JOIN m ON m.i = e.i)
SELECT round(sum(x * x) / (SELECT count(*) FROM vec), 6) AS total_variance FROM c""")
def projection_variance(spark, sf):
    """Total variance that all principal axes together keep; it equals that of the vectors."""
    rows = vectors(spark, sf).selectExpr("media_id", "cast(vector AS array<double>) AS vector")
    d = rows.select(F.size("vector").alias("d")).first()["d"]
    axes, mean = linear.fit_axes(rows, d)
    kept = [F.avg(c * c) for c in linear.project_on(axes, mean)]
    return rows.agg(F.round(sum(kept[1:], kept[0]), 6).alias("total_variance"))


_HOPS = 12


def _geodesic_sql() -> str:
    """Shortest paths from vector 0 along the neighbour graph, one CTE per hop."""
    parts = [VEC, """near AS (SELECT a.media_id AS src, b.media_id AS dst, round(list_distance(a.v, b.v), 6) AS dist
      FROM vec a JOIN vec b ON a.media_id <> b.media_id QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 5)""",
             "e AS MATERIALIZED (SELECT src, dst, min(dist) AS dist FROM (SELECT * FROM near UNION ALL SELECT dst, src, dist FROM near) GROUP BY src, dst)",
             "h0 AS (SELECT 0::BIGINT AS id, 0::DOUBLE AS d)"]
    for i in range(_HOPS):
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM h{i} UNION ALL SELECT src, d + dist FROM h{i} JOIN e ON e.dst = h{i}.id) GROUP BY id)")
    return f"WITH {', '.join(parts)} SELECT id AS media_id, round(d, 6) AS dist FROM h{_HOPS}"


@query("geodesic_distances", _geodesic_sql())
def geodesic_distances(spark, sf):
    v = vectors(spark, sf)
    edges = materialize(graph.both_ways(knn_graph(v, 5, metric="euclidean")))
    state = graph.geodesics(v.select("media_id"), edges, [0])
    return state.where(F.col("d0").isNotNull()).select("media_id", F.round("d0", 6).alias("dist"))


@query("reconstruction_weight_sums", "SELECT vec_id AS media_id, 1.0::DOUBLE AS total, 10::BIGINT AS n FROM embeddings")
def reconstruction_weight_sums(spark, sf):
    rows = vectors(spark, sf).selectExpr("media_id", "cast(vector AS array<double>) AS vector")
    w = graph.reconstruction_weights(rows, 10)
    return w.groupBy(F.col("src").alias("media_id")).agg(F.round(F.sum("w"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("lle_eigenpairs", "SELECT unnest([0, 1]) AS axis, (SELECT count(*) FROM embeddings) AS n, TRUE AS settled, TRUE AS unit")
def lle_eigenpairs(spark, sf):
    """Whether the two columns of locally linear embedding are eigenvectors: the residual of a product taken anew is below 1e-4."""
    rows = materialize(vectors(spark, sf).selectExpr("media_id", "cast(vector AS array<double>) AS vector"))
    n = rows.count()
    w = materialize(graph.reconstruction_weights(rows, neighbour_count(n)))
    plane, values, _ = graph.flattest(rows.select("media_id"), w, n)
    plane = materialize(plane)
    again = graph.unexplained(w)(plane, ["v0", "v1"]).withColumnsRenamed({"v0": "m0", "v1": "m1"})
    both = plane.join(again, "media_id")
    parts = [both.agg(F.lit(i).alias("axis"), F.count(F.lit(1)).alias("n"),
                      (F.sqrt(F.sum(F.pow(F.col(f"m{i}") - F.col(f"v{i}") * float(values[i]), F.lit(2)))) < 1e-4).alias("settled"),
                      (F.abs(F.sum(F.col(f"v{i}") * F.col(f"v{i}")) - 1) < 1e-6).alias("unit")) for i in (0, 1)]
    return parts[0].unionByName(parts[1])


# ---- sessions -------------------------------------------------------------------------

_SESSION = f"""keys AS (SELECT media_id, name, size, last_modified, {PATH_KEY_SQL} AS file_key FROM cat),
saved AS (SELECT file_key, row_number() OVER (ORDER BY size, media_id) - 1 AS ord, media_id / 2.0::DOUBLE AS x, media_id % 8 AS cluster FROM keys),
today AS (SELECT * FROM keys WHERE media_id % 7 <> 3),
kept AS (SELECT t.*, x, cluster, row_number() OVER (ORDER BY ord) - 1 AS ord FROM saved s JOIN today t ON s.file_key = t.file_key)"""


def _session(spark, sf):
    from lumaspark.operators.ordering import ordered_rank

    c = catalogue(spark, sf)
    saved = ordered_rank(c, [], ["size", "media_id"], "_rn").select(
        F.lit("map").alias("mode"), (F.col("_rn") - 1).alias("ord"), path_key().alias("file_key"),
        (F.col("media_id") / 2).alias("x"), F.lit(0.0).alias("y"), (F.col("media_id") % 8).cast("int").alias("cluster"))
    return saved, c.where(F.col("media_id") % 7 != 3)


@query("resumed_session", f"""WITH {_BOTH_SQL}, {_SESSION}
SELECT k.media_id, k.ord, k.x, CAST(cluster AS INTEGER) AS cluster, round(coalesce(CAST(coalesce(nv, ov)[1] AS DOUBLE), 0), 6) AS v1
FROM kept k JOIN found f ON f.media_id = k.media_id""")
def resumed_session(spark, sf):
    saved, today = _session(spark, sf)
    rows, _ = sessions.session_resume(saved, today, _cache(spark, sf), "", dims=64)
    return rows.select("media_id", "ord", "x", "cluster", F.round(F.get("vector", 0).cast("double"), 6).alias("v1"))


# ---- jobs -----------------------------------------------------------------------------

@query("viewer_map", f"""WITH {_FOLDERS_SQL}, o AS (SELECT media_id, row_number() OVER (ORDER BY folder, last_modified, media_id) - 1 AS ord FROM f),
b AS (SELECT count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - (min(x) + max(x)) / 2, max(y) - (min(y) + max(y)) / 2) AS r FROM fl),
norm AS (SELECT media_id, (x - cx) / r * (sqrt(n) * 48 * 1.4::DOUBLE) AS x, (y - cy) / r * (sqrt(n) * 48 * 1.4::DOUBLE) AS y FROM fl, b)
SELECT media_id, ord, round(x, 4) AS x, round(y, 4) AS y FROM norm JOIN o USING (media_id)""")
def viewer_map(spark, sf):
    """The layout part of viewer_map_spread, before overlaps are removed, which SQL cannot express."""
    m = plans.build_viewer(catalogue(spark, sf), locale=None, max_rounds=0)
    return m.items.select("media_id", "ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("viewer_map_spread")
def viewer_map_spread(spark, sf):
    """The whole viewer job: overlaps are removed by the job's own stopping rule."""
    m = plans.build_viewer(media(spark, sf))
    return m.items.select("media_id", "ord", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("viewer_map_apart", f"WITH {CATALOGUE_SQL}, {MEDIA_SQL} SELECT count(*) AS n_items, 0::BIGINT AS n_overlapping FROM media")
def viewer_map_apart(spark, sf):
    """How many items of the whole viewer job still overlap another one."""
    items = materialize(plans.build_viewer(media(spark, sf)).items.select("media_id", "x", "y"))
    return overlap_degree(items).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n_close") > 0).alias("n_overlapping"))


def _built(spark, sf):
    return plans.build_map(media(spark, sf), spark.createDataFrame([], "model string, cache_key string, vector array<float>"),
                           "nomic", _size_model)


@query("built_map")
def built_map(spark, sf):
    return _built(spark, sf).items.select("media_id", "ord", "cluster", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("searched_map", f"""WITH {SCORED}, r AS (SELECT media_id, label, rank, score FROM ranked)
SELECT media_id, CAST(rank AS INTEGER) AS rank, score, CASE WHEN rank < 20 THEN '#facc15' ELSE list_extract({PALETTE}, label % 8 + 1) END AS color,
  CASE WHEN rank < 20 THEN 1.0 WHEN rank < 100 THEN 0.4 ELSE 0.1 END::DOUBLE AS alpha FROM r""")
def searched_map(spark, sf):
    v = vectors(spark, sf)
    items = v.select("media_id", F.col("label").alias("cluster"))
    built = plans.Map(items, "map", 0, 0, v)
    q = query_vector(spark, sf)
    return plans.search_map(built, "like vector 0", lambda _: q).select("media_id", "rank", "score", "color", "alpha")


@query("drill_down_hour", f"WITH {CATALOGUE_SQL}, {MEDIA_SQL} SELECT media_id FROM media WHERE strftime(last_modified, '%Y-%m-%dT%H') = '2024-01-12T09'")
def drill_down_hour(spark, sf):
    rows, _ = plans.drill_down(media(spark, sf), "#dt:2024-01-12T09")
    return (rows if rows is not None else media(spark, sf).where(F.lit(False))).select("media_id")


@query("drill_down_folder", f"""WITH {CATALOGUE_SQL}, {MEDIA_SQL} SELECT media_id FROM media WHERE starts_with(name, 'view/')
  ORDER BY md5('5:' || CAST(media_id AS VARCHAR)), media_id LIMIT 200""")
def drill_down_folder(spark, sf):
    rows, _ = plans.drill_down(media(spark, sf), "#folder:view", sample=200, seed=5)
    return (rows if rows is not None else media(spark, sf).where(F.lit(False))).select("media_id")


@query("debounced_input", """WITH n AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT user_id, epoch_us(ts) + 1800000000 AS emit_us, event_type AS "value", regexp_replace(event_type, '\\s', '', 'g') = '' AS cleared
FROM n WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 1800000000""")
def debounced_input(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return debounce(e, ["user_id"], "ts", "event_type", 1_800_000, tie="event_id").select("user_id", "emit_us", "value", "cleared")


@query("captions_embedded", """SELECT doc_id AS media_id, text AS caption FROM documents""")
def captions_embedded(spark, sf):
    """Labelled documents keep a stored caption; the others are described by a stand-in
    that returns their text."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("media_id"), F.col("doc_id").cast("string").alias("name"), F.lit(1).alias("size"),
        F.lit("2024-01-01").cast("timestamp").alias("last_modified"), F.col("text").alias("content"))
    from lumaspark.functions.keys import caption_key

    stored = d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("media_id")), "media_id", "left_semi")
    stored = stored.select(caption_key().alias("caption_key"), F.col("content").alias("caption"))
    out, _ = embed.caption_and_embed(d, stored, lambda: (lambda texts: texts))
    return out.where(F.size("vector") == embed.DIMS).select("media_id", "caption")


# ---- streams: the event file arrives as a stream --------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _scratch(spark):
    return f"{checkpoint_dir(spark)}/lumaspark/stream-{uuid.uuid4().hex}"


# a burst is out once the watermark, an hour behind the last event, has passed its end
@query("debounced_stream", """WITH n AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT user_id, epoch_us(ts) + 1800000000 AS emit_us, event_type AS "value", FALSE AS cleared FROM n
WHERE (nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 1800000000)
  AND epoch_us(ts) + 1800000000 <= (SELECT epoch_us(max(ts)) FROM events) // 1000 * 1000 - 3600000000""")
def debounced_stream(spark, sf):
    events = _event_stream(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    bursts = streams.debounce_stream(events, ["user_id"], "ts", "event_type", "30 minutes", "1 hour", tie="event_id")
    out = _scratch(spark)
    run = bursts.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(bursts.schema).parquet(f"{out}/rows")
    return rows.select("user_id", F.unix_micros("emit_ts").alias("emit_us"), "value", "cleared")


_SIZE_VECTORS_SQL = f"""WITH {CATALOGUE_SQL}, {MEDIA_SQL}, k AS (SELECT {CACHE_KEY_SQL} AS cache_key, size FROM media WHERE size % 700 <> 0),
f AS (SELECT cache_key, list_transform([(size % 7) / 7.0::DOUBLE, (size % 11) / 11.0::DOUBLE, (size % 13) / 13.0::DOUBLE, (size % 17) / 17.0::DOUBLE], lambda x: CAST(x AS FLOAT)) AS f FROM k),
n AS (SELECT cache_key, f, sqrt(list_sum(list_transform(f, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM f)
SELECT cache_key, """ + ", ".join(
    f"round(CAST(CAST(CAST(f[{i}] AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT) AS DOUBLE), 5) AS v{i}" for i in range(1, 5)) + " FROM n"


def _cached(store):
    return store.read("").select("cache_key", *(F.round(F.get("vector", i).cast("double"), 5).alias(f"v{i + 1}") for i in range(4)))


def _event_parts(spark, sf, n: int = 3):
    """The folder of the events dealt over several files, and their names, for streams of several batches."""
    out = f"{_scratch(spark)}/events"
    table(spark, sf, "events").repartition(n, "event_id").write.parquet(out)
    return out


def _streamed_store(spark, sf):
    """A cache that a stream filled, a file a batch; and the last batch with the step that took it."""
    out = _scratch(spark)
    store, last = cache.StoredCache(spark, f"{out}/cache"), {}
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(_event_parts(spark, sf))
    step = streams.embed_batch(store, "", _size_model, writer="stream")

    def keep(batch, batch_id):
        step(batch, batch_id)
        last["batch"] = batch_id, batch.schema
        batch.write.mode("overwrite").parquet(f"{out}/batch")

    catalogue_from_tree(as_catalogue(events)).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(
        availableNow=True).start().awaitTermination()
    batch_id, schema = last["batch"]
    return store, step, spark.read.schema(schema).parquet(f"{out}/batch"), batch_id, out


@query("streamed_cache", _SIZE_VECTORS_SQL)
def streamed_cache(spark, sf):
    """Files arrive as a stream of several batches; the cache holds a vector for each that the model could read."""
    out = _scratch(spark)
    store = cache.StoredCache(spark, f"{out}/cache")
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(_event_parts(spark, sf))
    files = catalogue_from_tree(as_catalogue(events))
    streams.stream_embed(files, store, "", _size_model, f"{out}/state").awaitTermination()
    return _cached(store)


@query("replayed_cache", _SIZE_VECTORS_SQL)
def replayed_cache(spark, sf):
    """The last batch of a stream comes again, as after a failure: before its write was complete, and after."""
    store, step, batch, batch_id, out = _streamed_store(spark, sf)
    step(batch, batch_id)
    half = cache.StoredCache(spark, f"{out}/half")  # a driver was lost while it wrote its only batch
    files = catalogue_from_tree(as_catalogue(table(spark, sf, "events")))
    half.begin("stream", 0)
    half.read().limit(0).write.parquet(f"{half.path}/writer=stream/seq=0/model=x")
    streams.embed_batch(half, "", _size_model, writer="stream")(files, 0)
    both = _cached(store).unionByName(_cached(half)).groupBy("cache_key", "v1", "v2", "v3", "v4").count()
    return both.where("count = 2").drop("count")


@query("shared_cache", _SIZE_VECTORS_SQL)
def shared_cache(spark, sf):
    """Two writers: a stream's values, older ones of another writer that arrive late, and a late replay of the stream's first
    write, which must not overtake the other writer's newest ones (right, after wrong ones)."""
    out = _scratch(spark)
    store = cache.StoredCache(spark, f"{out}/cache")
    files = catalogue_from_tree(as_catalogue(table(spark, sf, "events")))
    step = streams.embed_batch(store, "", _size_model, writer="stream")
    early = store.begin("nightly", 0)  # begins first, ends last
    step(files, 0)
    right = materialize(store.read(""))
    wrong = right.withColumn("vector", F.transform("vector", lambda x: x + 1))
    store.put(materialize(wrong), 0, "nightly")  # older than the stream's
    store.put(materialize(wrong), 1, "nightly")
    store.put(materialize(right), 2, "nightly")
    store.put(materialize(wrong), 0, "stream")  # a write that is complete
    step(files, 0)
    if store.begin("nightly", 0) != early:
        raise AssertionError("a write lost its place")
    return _cached(store)


@query("compacted_cache", _SIZE_VECTORS_SQL)
def compacted_cache(spark, sf):
    """A stream goes on in the compacted form of its cache."""
    store, _, batch, batch_id, out = _streamed_store(spark, sf)
    small = store.compact(f"{out}/small")
    stale = small.read("").withColumn("vector", F.transform("vector", lambda x: x * 0))
    small.put(materialize(stale), 7, "other", put_at=1)  # older than what was compacted
    streams.embed_batch(small, "", _size_model, writer="stream")(batch, batch_id + 1)
    return _cached(small)


# ---- files on disk: each page is a file, some below folders that a listing may hide -----------------

_PAGE_NAME = {0: ("_a/_p", ".jpg"), 1: ("b/p", ".png"), 2: ("b/.h/p", ".jpg"), 3: ("c/d/p", ".TXT"), 4: ("_q", ".mp4")}
_PAGE_FILES_SQL = "SELECT CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{a}' || page_id || '{b}'" for k, (a, b) in _PAGE_NAME.items()) + """ END AS name,
  strlen(html) AS size, md5(html) AS digest FROM pages WHERE page_id % 5 NOT IN (2, 3)"""


def _page_files(spark, sf):
    name = F.lit(None).cast("string")
    for k, (a, b) in _PAGE_NAME.items():
        name = F.when(F.col("page_id") % 5 == k, F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b))).otherwise(name)
    return table(spark, sf, "pages").select("page_id", name.alias("name"), F.encode("html", "utf-8").alias("content"))


def _write_files(files, root: str) -> None:
    """Writes (name, content) as files, from the tasks that hold them."""
    def write(batches):
        fs, top = _file_system(root)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                fs.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(content)
            yield pdf[["name"]]

    files.select("name", "content").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


@query("scanned_files", _PAGE_FILES_SQL)
def scanned_files(spark, sf):
    """A folder tree of files, scanned with their bytes."""
    root = f"{_scratch(spark)}/tree"
    _write_files(_page_files(spark, sf), root)
    return scan_media(spark, root, with_content=True).select("name", "size", F.md5("content").alias("digest"))


@query("streamed_files", _PAGE_FILES_SQL)
def streamed_files(spark, sf):
    """The same tree as a stream: a part of the files, then the rest, in runs of one checkpoint."""
    out = _scratch(spark)
    pages = _page_files(spark, sf)
    for part in (F.col("page_id") % 3 == 0, F.col("page_id") % 3 != 0):
        _write_files(pages.where(part), f"{out}/tree")
        files = streams.stream_media(spark, f"{out}/tree", with_content=True, log=f"{out}/log").select("name", "size", F.md5("content").alias("digest"))
        files.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, size long, digest string").parquet(f"{out}/rows")
