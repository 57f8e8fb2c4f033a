"""Registered queries over vectors: expressions, search, neighbours, cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspark.functions import keys
from lumaspark.functions import vectors as V
from lumaspark.operators.descent import descend
from lumaspark.operators import embed, knn, search
from lumaspark.registry.catalog import _VARIANT_SQL
from lumaspark.registry.data import (
    CACHE_KEY_SQL, CATALOGUE_SQL, PATH_KEY_SQL, catalogue, table, vectors,
)
from lumaspark.session import widen
from lumaspark.sources import cache as C

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def dsql(v: str) -> str:
    return f"CAST({v} AS DOUBLE[])"


VEC = "vec AS (SELECT vec_id AS media_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


# vectors of varied length, one label all zeros
def _scaled(spark, sf):
    v = vectors(spark, sf)
    return v.select("media_id", F.transform("vector", lambda x: (x * F.col("label")).cast("float")).alias("vector"))


_SCALED_SQL = "sc AS (SELECT vec_id AS media_id, list_transform(embedding, lambda x: CAST(x * label AS FLOAT)) AS f FROM embeddings)"


@query("unit_vectors", f"""WITH {_SCALED_SQL}, d AS (SELECT media_id, CAST(f AS DOUBLE[]) AS v FROM sc),
n AS (SELECT media_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM d),
u AS (SELECT media_id, list_transform(v, lambda x: CAST(x / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT)) AS u FROM n),
p AS (SELECT media_id, unnest(range(0, len(u))) AS pos, unnest(u) AS val FROM u)
SELECT media_id, CAST(pos AS INTEGER) AS pos, round(CAST(val AS DOUBLE), 5) AS val FROM p""")
def unit_vectors(spark, sf):
    u = _scaled(spark, sf).select("media_id", F.posexplode(V.l2_normalize("vector")).alias("pos", "val"))
    return u.withColumn("val", F.round(F.col("val").cast("double"), 5))


@query("picked_outputs", """WITH o AS (SELECT vec_id AS media_id, label, embedding FROM embeddings)
SELECT media_id, CASE WHEN label < 3 THEN 'last_hidden_state' WHEN label < 6 THEN 'pooler_output' ELSE 'other' END AS source,
  round(CAST(embedding[CASE WHEN label < 3 THEN 1 WHEN label < 6 THEN 2 ELSE 3 END] AS DOUBLE), 6) AS val FROM o""")
def picked_outputs(spark, sf):
    e = table(spark, sf, "embeddings")

    def tensor(i):
        return F.array(F.get("embedding", i).cast("double"))

    name = F.when(F.col("label") < 3, "last_hidden_state").when(F.col("label") < 6, "pooler_output").otherwise("other")
    full = F.create_map(F.lit("zz"), tensor(5), F.lit("pooler_output"), tensor(1), F.lit("last_hidden_state"), tensor(0))
    pooled = F.create_map(F.lit("zz"), tensor(5), F.lit("pooler_output"), tensor(1))
    outputs = F.when(F.col("label") < 3, full).when(F.col("label") < 6, pooled).otherwise(F.create_map(F.lit("zz"), tensor(2)))
    return e.select(F.col("vec_id").alias("media_id"), name.alias("source"), F.round(F.get(V.pick_output(outputs), 0), 6).alias("val"))


@query("pooled_sequences", f"""WITH {VEC}, e AS (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM vec),
m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY label, pos),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT m.label, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(m / n AS FLOAT) AS DOUBLE), 5) AS val FROM m JOIN n ON m.label = n.label""")
def pooled_sequences(spark, sf):
    p = V.mean_pool(vectors(spark, sf), "label", "vector")
    return p.select("label", F.posexplode("vector").alias("pos", "val")).withColumn("val", F.round(F.col("val").cast("double"), 5))


@query("split_batches", f"""WITH {VEC}, b AS (SELECT media_id, unnest(range(0, 4)) AS item, v FROM vec),
s AS (SELECT media_id, item, v[item * 16 + 1 : item * 16 + 16] AS w FROM b),
n AS (SELECT media_id, item, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) AS n FROM s)
SELECT media_id, CAST(item AS INTEGER) AS item, round(CAST(CAST(w[1] / n AS FLOAT) AS DOUBLE), 5) AS first_val,
  round(CAST(CAST(w[16] / n AS FLOAT) AS DOUBLE), 5) AS last_val FROM n""")
def split_batches(spark, sf):
    s = vectors(spark, sf).select("media_id", F.posexplode(V.split_batch("vector", 16)).alias("item", "w"))
    return s.select("media_id", "item", F.round(F.get("w", 0).cast("double"), 5).alias("first_val"),
                    F.round(F.get("w", 15).cast("double"), 5).alias("last_val"))


@query("split_sequence_batches", f"""WITH {VEC}, e AS (SELECT media_id, unnest(range(0, 64)) AS p, unnest(v) AS x FROM vec),
m AS (SELECT media_id, p // 32 AS item, p % 8 AS pos, avg(x) AS m FROM e GROUP BY ALL),
n AS (SELECT media_id, item, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL)
SELECT m.media_id, CAST(m.item AS INTEGER) AS item, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(m / n AS FLOAT) AS DOUBLE), 5) AS val
FROM m JOIN n ON m.media_id = n.media_id AND m.item = n.item""")
def split_sequence_batches(spark, sf):
    s = vectors(spark, sf).select("media_id", F.posexplode(V.split_sequence_batch("vector", 4, 8)).alias("item", "w"))
    p = s.select("media_id", "item", F.posexplode("w").alias("pos", "val"))
    return p.withColumn("val", F.round(F.col("val").cast("double"), 5))


# ---- search ---------------------------------------------------------------------------

def query_vector(spark, sf) -> list[float]:
    """Vector 0, the query of the single-query searches: one row by key."""
    return [float(x) for x in vectors(spark, sf).where(F.col("media_id") == 0).first()["vector"]]


SCORED = f"""{VEC}, q AS (SELECT v AS qv FROM vec WHERE media_id = 0),
dots AS (SELECT media_id, label, list_dot_product(v, qv) AS d, sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)) AS n FROM vec, q),
scored AS (SELECT media_id, label, round(d / nullif(n, 0), 9) AS score FROM dots),
ranked AS (SELECT media_id, label, score, row_number() OVER (ORDER BY score DESC NULLS LAST, media_id) - 1 AS rank FROM scored)"""


@query("search_all", f"WITH {SCORED} SELECT media_id, CAST(rank AS INTEGER) AS rank, score FROM ranked")
def search_all(spark, sf):
    r = search.search(vectors(spark, sf), query_vector(spark, sf))
    return r.select("media_id", "rank", "score")


@query("search_top", f"WITH {SCORED} SELECT media_id, score FROM ranked WHERE rank < 10")
def search_top(spark, sf):
    return search.search(vectors(spark, sf), query_vector(spark, sf), k=10).select("media_id", "score")


@query("search_angular", f"WITH {SCORED} SELECT media_id, round(acos(greatest(-1, least(1, d / n))), 5) AS distance FROM dots")
def search_angular(spark, sf):
    r = search.search(vectors(spark, sf), query_vector(spark, sf), angular=True)
    return r.select("media_id", F.round("distance", 5).alias("distance"))


@query("search_status", f"""WITH {SCORED} SELECT count(*) AS n_files, max(score) AS top_score,
  CAST(round(max(score) * 100) AS INTEGER) AS top_percent FROM scored""")
def search_status(spark, sf):
    return search.search_summary(search.score_against(vectors(spark, sf), query_vector(spark, sf)))


@query("search_emphasis", f"""WITH {SCORED}, hits AS (SELECT media_id, rank FROM ranked WHERE rank < 150),
r AS (SELECT vec_id AS media_id, label, coalesce(rank, (SELECT count(*) FROM embeddings)) AS rank FROM embeddings LEFT JOIN hits ON vec_id = media_id)
SELECT media_id, CAST(rank AS INTEGER) AS rank, CASE WHEN media_id = 5 THEN '#fff' WHEN rank < 20 THEN '#facc15'
  ELSE list_extract(['#f87171','#fb923c','#facc15','#4ade80','#38bdf8','#818cf8','#f472b6','#a78bfa'], label % 8 + 1) END AS color,
  CASE WHEN media_id = 5 OR rank < 20 THEN 1.0 WHEN rank < 100 THEN 0.4 ELSE 0.1 END::DOUBLE AS alpha FROM r""")
def search_emphasis(spark, sf):
    v = vectors(spark, sf)
    ranks = search.search(v, query_vector(spark, sf)).where(F.col("rank") < 150)
    files = v.select("media_id", F.col("label").alias("cluster"))
    return search.emphasis(files, ranks, selected=5).select("media_id", "rank", "color", "alpha")


@query("search_many_top", f"""WITH {VEC}, q AS (SELECT label AS query_id, min(media_id) AS mid FROM vec GROUP BY label),
s AS (SELECT query_id, c.media_id, round(list_dot_product(c.v, b.v) / sqrt(list_dot_product(c.v, c.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS score
  FROM q JOIN vec b ON b.media_id = q.mid CROSS JOIN vec c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, media_id) - 1 AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, media_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank < 10""")
def search_many_top(spark, sf):
    v = vectors(spark, sf)
    q = v.groupBy("label").agg(F.min_by("vector", "media_id").alias("vector"))
    q = q.select(F.col("label").cast("bigint").alias("query_id"), "vector")
    return search.search_many(q, v, 10)


_WORDS = "regexp_extract_all(lower({p} || text), '[a-z0-9]+')"


def _text_vectors(cte: str, source: str, key: str, prefix: str) -> str:
    words = f"regexp_extract_all(lower('{prefix}' || text), '[a-z0-9]+')"
    return f"""{cte}_t AS (SELECT {key} AS id, CAST(('0x' || left(md5(w), 8)) AS BIGINT) % 768 AS b FROM (SELECT {key}, unnest({words}) AS w FROM {source})),
{cte}_c AS (SELECT id, b, CAST(count(*) AS DOUBLE) AS c FROM {cte}_t GROUP BY id, b),
{cte}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {cte}_c GROUP BY id),
{cte} AS (SELECT {cte}_c.id, b, CAST(CAST(c / n AS FLOAT) AS DOUBLE) AS w FROM {cte}_c JOIN {cte}_n ON {cte}_c.id = {cte}_n.id)"""


@query("text_search_documents", f"""WITH {_text_vectors('qv', 'benchmark', 'item_id', 'search_query: ')},
{_text_vectors('dv', 'documents', 'doc_id', 'search_document: ')},
qs AS (SELECT id, sqrt(sum(w * w)) AS n FROM qv GROUP BY id), ds AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv GROUP BY id),
s AS (SELECT qv.id AS query_id, dv.id AS media_id, sum(qv.w * dv.w) AS d FROM qv JOIN dv ON qv.b = dv.b GROUP BY 1, 2),
z AS (SELECT query_id, media_id, round(d / qs.n / ds.n, 9) AS score FROM s JOIN qs ON qs.id = query_id JOIN ds ON ds.id = media_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, media_id) - 1 AS rank FROM z)
SELECT query_id, media_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank < 5""")
def text_search_documents(spark, sf):
    q = search.non_blank(table(spark, sf, "benchmark")).select(F.col("item_id").alias("query_id"), "text")
    d = widen(table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "text"))
    hits = search.search_many(embed.embed_text(q, "query"), embed.embed_text(d, "document"), 5)
    return hits


@query("knn_cosine", f"""WITH {VEC}, s AS (SELECT a.media_id AS src, b.media_id AS dst,
  round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 9) AS score FROM vec a JOIN vec b ON a.media_id <> b.media_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) - 1 AS rank FROM s)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, greatest(round(1 - score, 9), 0) AS dist FROM r WHERE rank < 10""")
def knn_cosine(spark, sf):
    return knn.knn_graph(vectors(spark, sf), 10)


@query("knn_descent_recall", "SELECT unnest(['cosine', 'euclidean']) AS metric, count(*) AS n, count(*) * 10 AS n_edges, TRUE AS enough FROM embeddings")
def knn_descent_recall(spark, sf):
    """Whether descent finds 95 % of the ten nearest neighbours, from blocks far smaller than its default."""
    v = vectors(spark, sf).selectExpr("media_id", "cast(vector AS array<double>) AS vector")

    def row(metric):
        want = knn.knn_graph(v, 10, metric).select("src", "dst", F.lit(1).alias("hit"))
        got = descend(v, 10, metric, block_rows=32).join(want, ["src", "dst"], "left")
        return got.agg(F.lit(metric).alias("metric"), F.count_distinct("src").alias("n"), F.count(F.lit(1)).alias("n_edges"),
                       (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("enough"))

    return row("cosine").unionByName(row("euclidean"))


@query("knn_euclidean", f"""WITH {VEC}, s AS (SELECT a.media_id AS src, b.media_id AS dst, round(list_distance(a.v, b.v), 6) AS dist
  FROM vec a JOIN vec b ON a.media_id <> b.media_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS rank FROM s)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM r WHERE rank < 5""")
def knn_euclidean(spark, sf):
    return knn.knn_graph(vectors(spark, sf), 5, metric="euclidean")


@query("cell_index_exact", SQL["search_many_top"])
def cell_index_exact(spark, sf):
    """The cell index asked for every cell gives what the exact search gives."""
    v = vectors(spark, sf)
    q = v.groupBy("label").agg(F.min_by("vector", "media_id").alias("vector"))
    index = search.CellIndex(v, centres=16, seed=1)
    return index.search_many(q.select(F.col("label").cast("bigint").alias("query_id"), "vector"), 10, probes=16)


@query("cell_index_search")
def cell_index_search(spark, sf):
    v = vectors(spark, sf)
    q = v.groupBy("label").agg(F.min_by("vector", "media_id").alias("vector"))
    index = search.CellIndex(v, seed=1)
    return index.search_many(q.select(F.col("label").cast("bigint").alias("query_id"), "vector"), 10, probes=4)


@query("lsh_search")
def lsh_search(spark, sf):
    return search.search_lsh(vectors(spark, sf), query_vector(spark, sf), 10)


# ---- cache ----------------------------------------------------------------------------

# every vector belongs to the file of its number; its label decides how it is cached
_CACHED_SQL = f"""{CATALOGUE_SQL}, lib AS (SELECT cat.*, embedding, label, {CACHE_KEY_SQL} AS new_key, {PATH_KEY_SQL} AS old_key
  FROM cat JOIN embeddings ON vec_id = media_id),
cache AS (SELECT CASE WHEN label = 9 THEN '@sapiens2/' ELSE '' END AS model,
  CASE WHEN label BETWEEN 4 AND 6 THEN old_key ELSE new_key END AS cache_key, embedding AS vector FROM lib WHERE label NOT IN (7, 8))"""


def _library(spark, sf):
    return catalogue(spark, sf).join(vectors(spark, sf), "media_id")


def _cache(spark, sf):
    lib = _library(spark, sf).where(~F.col("label").isin(7, 8))
    return lib.select(
        F.when(F.col("label") == 9, "@sapiens2/").otherwise("").alias("model"),
        F.when(F.col("label").between(4, 6), keys.path_key()).otherwise(keys.cache_key()).alias("cache_key"), "vector",
    )


def _v1(c="vector", digits=4):
    """A digest of all components: the sum of each times its place."""
    return F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), digits)


def _V1_SQL(c, digits=4):
    return f"round(list_sum(list_transform({c}, lambda x, i: CAST(x AS DOUBLE) * i)), {digits})"


@query("cache_reads", f"""WITH {_CACHED_SQL}, r AS (SELECT media_id, '' AS model, {CACHE_KEY_SQL} AS cache_key FROM cat)
SELECT media_id, vector IS NOT NULL AS hit, {_V1_SQL("vector")} AS v1 FROM r LEFT JOIN cache USING (model, cache_key)""")
def cache_reads(spark, sf):
    asks = catalogue(spark, sf).select("media_id", F.lit("").alias("model"), keys.cache_key().alias("cache_key"))
    got = C.cache_lookup(asks, _cache(spark, sf))
    return got.select("media_id", F.col("vector").isNotNull().alias("hit"), _v1().alias("v1"))


_BOTH_SQL = f"""{_CACHED_SQL}, keyed AS (SELECT media_id, name, size, last_modified, {CACHE_KEY_SQL} AS new_key, {PATH_KEY_SQL} AS old_key FROM cat),
own AS (SELECT cache_key, vector FROM cache WHERE model = ''),
found AS (SELECT k.*, n.vector AS nv, o.vector AS ov FROM keyed k LEFT JOIN own n ON n.cache_key = k.new_key LEFT JOIN own o ON o.cache_key = k.old_key)"""


@query("cache_reads_legacy", f"WITH {_BOTH_SQL} SELECT media_id, coalesce(nv, ov) IS NOT NULL AS from_cache, {_V1_SQL('coalesce(nv, ov)')} AS v1 FROM found")
def cache_reads_legacy(spark, sf):
    hits, _ = C.cache_lookup_with_legacy(catalogue(spark, sf), _cache(spark, sf), "")
    return hits.select("media_id", "from_cache", _v1().alias("v1"))


@query("cache_migrations", f"WITH {_BOTH_SQL} SELECT '' AS model, new_key AS cache_key, {_V1_SQL('ov')} AS v1 FROM found WHERE nv IS NULL AND ov IS NOT NULL")
def cache_migrations(spark, sf):
    _, migrate = C.cache_lookup_with_legacy(catalogue(spark, sf), _cache(spark, sf), "")
    return migrate.select("model", "cache_key", _v1().alias("v1"))


@query("cache_puts", f"""WITH {_CACHED_SQL}, new AS (SELECT '' AS model, new_key AS cache_key, list_transform(embedding, lambda x: x + 1) AS vector, 1 AS seq FROM lib WHERE label < 8
  UNION ALL SELECT '', new_key, list_transform(embedding, lambda x: x + 2), 2 FROM lib WHERE label < 2),
last AS (SELECT model, cache_key, arg_max(vector, seq) AS vector FROM new GROUP BY 1, 2),
merged AS (SELECT model, cache_key, vector FROM cache ANTI JOIN last USING (model, cache_key) UNION ALL SELECT * FROM last)
SELECT model, cache_key, {_V1_SQL("vector", 2)} AS v1 FROM merged""")
def cache_puts(spark, sf):
    lib = _library(spark, sf)

    def rows(top, add):
        moved = F.transform("vector", lambda x: (x + add).cast("float"))
        return lib.where(F.col("label") < top).select(
            F.lit("").alias("model"), keys.cache_key().alias("cache_key"), moved.alias("vector"), F.lit(add).alias("seq"))

    merged = C.cache_upsert(_cache(spark, sf), rows(8, 1).unionByName(rows(2, 2)), "seq")
    return merged.select("model", "cache_key", _v1(digits=2).alias("v1"))


@query("cache_sizes", f"""WITH {_CACHED_SQL} SELECT '' AS prefix, count(*) AS n, CAST(sum(len(vector)) * 8 AS BIGINT) AS bytes FROM cache
  UNION ALL SELECT '@sapiens2/', count(*), CAST(coalesce(sum(len(vector)), 0) * 8 AS BIGINT) FROM cache WHERE starts_with(model || cache_key, '@sapiens2/')""")
def cache_sizes(spark, sf):
    c = _cache(spark, sf)
    parts = [C.cache_stats(c, p or None).select(F.lit(p).alias("prefix"), "n", "bytes") for p in ("", "@sapiens2/")]
    return parts[0].unionByName(parts[1])


def _size_model(files):
    """Deterministic stand-in model: a vector from size and id; some files cannot be read."""
    v = F.array(*(((F.col("size") % m) / m).cast("float") for m in (7.0, 11.0, 13.0, 17.0)))
    ok = F.col("size") % 700 != 0
    zero = F.array_repeat(F.lit(0.0).cast("float"), 4)
    return files.select("media_id", F.when(ok, V.l2_normalize(v)).otherwise(zero).alias("vector"), ok.alias("ok"))


_MODEL_SQL = """raw AS (SELECT *, [(size % 7) / 7.0::DOUBLE, (size % 11) / 11.0::DOUBLE, (size % 13) / 13.0::DOUBLE, (size % 17) / 17.0::DOUBLE] AS m FROM found),
fresh AS (SELECT *, list_transform(m, lambda x: CAST(x AS FLOAT)) AS f FROM raw),
inferred AS (SELECT *, sqrt(list_sum(list_transform(f, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM fresh)"""


@query("embedding_with_cache", f"""WITH {_BOTH_SQL}, {_MODEL_SQL} SELECT media_id, coalesce(nv, ov) IS NOT NULL AS from_cache,
  coalesce(nv, ov) IS NOT NULL OR size % 700 <> 0 AS ok,
  round(CASE WHEN coalesce(nv, ov) IS NOT NULL THEN CAST(coalesce(nv, ov)[1] AS DOUBLE) WHEN size % 700 = 0 THEN 0
    ELSE CAST(CAST(CAST(f[1] AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT) AS DOUBLE) END, 5) AS v1 FROM inferred""")
def embedding_with_cache(spark, sf):
    got, _ = C.embed_with_cache(catalogue(spark, sf), _cache(spark, sf), "", _size_model)
    return got.select("media_id", "from_cache", "ok", F.round(F.get("vector", 0).cast("double"), 5).alias("v1"))


@query("embedding_writes", f"""WITH {_BOTH_SQL} SELECT new_key AS cache_key FROM found
  WHERE (nv IS NULL AND ov IS NOT NULL) OR (nv IS NULL AND ov IS NULL AND size % 700 <> 0)""")
def embedding_writes(spark, sf):
    _, writes = C.embed_with_cache(catalogue(spark, sf), _cache(spark, sf), "", _size_model)
    return writes.select("cache_key")


# captions: documents are the stored captions of the files with their numbers
@query("stored_captions", f"""WITH {CATALOGUE_SQL} SELECT media_id, d.text AS caption FROM cat LEFT JOIN documents d ON d.doc_id = media_id""")
def stored_captions(spark, sf):
    c = catalogue(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), F.col("text").alias("caption"))
    stored = c.join(docs, "media_id").select(keys.caption_key().alias("caption_key"), "caption")
    return embed.caption_lookup(c, stored).select("media_id", "caption")


@query("status_counts", f"""WITH {_BOTH_SQL} SELECT (SELECT count(*) FROM cat) AS n_files, (SELECT count(*) FROM found WHERE coalesce(nv, ov) IS NOT NULL) AS n_vectors,
  (SELECT count(*) FROM found WHERE coalesce(nv, ov) IS NOT NULL) AS n_cache_hits, (SELECT count(*) FROM embeddings) AS n_points,
  0::BIGINT AS n_results, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_captions""")
def status_counts(spark, sf):
    from lumaspark.operators.summary import pipeline_status

    hits, _ = C.cache_lookup_with_legacy(catalogue(spark, sf), _cache(spark, sf), "")
    captions = table(spark, sf, "documents").select(F.col("text").alias("caption"))
    return pipeline_status(catalogue(spark, sf), hits.where("from_cache"), vectors(spark, sf), None, captions).select(
        *(F.col(c).cast("bigint").alias(c) for c in ("n_files", "n_vectors", "n_cache_hits", "n_points", "n_results", "n_captions"))
    )
