"""Similarity search: exact for one query, exact for many, and approximate by cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.functions.text import SELECTED_COLOR, TOP_COLOR, cluster_color, is_blank
from lumaspark.functions.vectors import SCORE_DECIMALS, angular_distance, as_doubles, cosine, norm
from lumaspark.operators.blocks import BLOCK_ROWS, block_join
from lumaspark.operators.ordering import ordered_rank
from lumaspark.session import materialize

BROADCAST_BYTES = 64 << 20  # query matrices up to this size go to every executor


def score_against(corpus: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Adds the similarity of each row to one query vector; null for a zero vector.

    The query is a literal, so this is a projection: no join and no shuffle.
    """
    q = F.array(*(F.lit(float(v)) for v in query))
    return corpus.withColumn("score", F.round(cosine(vector, q), SCORE_DECIMALS))


def search(
    corpus: DataFrame, query: list[float], k: int | None = None, angular: bool = False, key: str = "media_id"
) -> DataFrame:
    """Ranks a corpus by cosine similarity to one query vector, best first.

    With ``k`` it is a top-k, of which each task sends k rows. Without, every file gets
    its rank from a range-partitioned sort. Zero vectors have no score and come last.
    """
    scored = score_against(corpus, query)
    if angular:
        scored = scored.withColumn("distance", angular_distance("vector", F.array(*(F.lit(float(v)) for v in query))))
    scored = scored.drop("vector")
    order = [F.col("score").desc_nulls_last(), F.col(key).asc()]
    if k is not None:
        return scored.orderBy(*order).limit(k)
    ranked = scored.withColumn("_o", -F.coalesce("score", F.lit(-2.0)))
    return ordered_rank(ranked, [], ["_o", key], "_rn").withColumn("rank", (F.col("_rn") - 1).cast("int")).drop("_o", "_rn")


def search_text(
    corpus: DataFrame, query: str, embed, k: int | None = None, model: str | None = None
) -> DataFrame | None:
    """Text search: blank text or an empty corpus gives None, not an empty ranking.

    ``embed`` turns one text into a vector. Given a model name, only vectors of that
    model are compared, since vectors of different models share no space.
    """
    if model is not None and "model" in corpus.columns:
        corpus = corpus.where(F.col("model") == model)
    if not query.strip() or corpus.isEmpty():
        return None
    return search(corpus, embed(f"search_query: {query}"), k)


def search_summary(results: DataFrame) -> DataFrame:
    """One row: number of files, best score and that score as a whole percentage."""
    best = F.max("score")
    return results.agg(
        F.count(F.lit(1)).alias("n_files"), best.alias("top_score"),
        F.round(F.coalesce(best, F.lit(0.0)) * 100).cast("int").alias("top_percent"),
    )


def emphasis(files: DataFrame, ranks: DataFrame, selected: int | None = None, key: str = "media_id") -> DataFrame:
    """How each file is drawn during a search: rank, border colour and opacity.

    A file the search did not return ranks after all others.
    """
    n = files.count()
    joined = files.join(ranks.select(key, "rank"), key, "left")
    rank = F.coalesce(F.col("rank"), F.lit(n)).cast("int")
    chosen = F.col(key).eqNullSafe(F.lit(selected))
    base = cluster_color("cluster") if "cluster" in files.columns else cluster_color(F.lit(None).cast("int"))
    color = F.when(chosen, F.lit(SELECTED_COLOR)).when(rank < 20, F.lit(TOP_COLOR)).otherwise(base)
    alpha = F.when(chosen | (rank < 20), 1.0).when(rank < 100, 0.4).otherwise(0.1)
    return joined.withColumn("rank", rank).withColumn("color", color).withColumn("alpha", alpha)


# ---- many queries ----------------------------------------------------------------------

def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; a zero row becomes NaN, which no score survives."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, np.nan, n)


TILE_CELLS = 4 << 20  # scores a task holds at once


def top_of_block(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int):
    """Best k of a block for each query, ties to the lower id: (query row, id, score). Queries go
    in tiles, so that the table of scores stays small."""
    step = max(1, TILE_CELLS // max(1, len(c)))
    tiles = [(at, _top_of_tile(q[at:at + step], c, ids, k)) for at in range(0, max(1, len(q)), step)]
    return np.concatenate([rows + at for at, (rows, _, _) in tiles]), *(np.concatenate([t[i] for _, t in tiles]) for i in (1, 2))


def _top_of_tile(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int):
    s = np.round(q @ c.T, SCORE_DECIMALS)
    s = np.where(np.isnan(s), -np.inf, s)
    k = min(k, s.shape[1])
    if k == 0 or not s.shape[0]:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    rows, cols = [], []
    for i in range(s.shape[0]):
        near = np.flatnonzero((s[i] >= cut[i]) & np.isfinite(s[i]))
        near = near[np.lexsort((ids[near], -s[i][near]))][:k]
        rows.append(np.full(len(near), i))
        cols.append(near)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    return rows, ids[cols], s[rows, cols]


def _best_k(found: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """Merge of per-block winners; the rank filter limits each task before the shuffle."""
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key).asc())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(query_key, key, (F.col("rank") - 1).cast("int").alias("rank"), "score")


def _fits_broadcast(queries: DataFrame, limit: int) -> bool:
    size = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()["n"] * 8
    return size <= limit


def search_many(
    queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "query_id", key: str = "media_id",
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top k of a corpus for every query vector.

    Query matrices below ``broadcast_bytes`` (measured first) visit the corpus where it
    lies: each task keeps the best k per query and sends only those. Larger query sets
    meet the corpus in blocks. A zero vector on either side has no score and no place in
    the result. Blank queries should be removed before (``non_blank``).
    """
    queries = materialize(queries.select(query_key, "vector"))  # measured and then used
    corpus = corpus.select(key, "vector")
    schema = f"{query_key} bigint, {key} bigint, score double"
    if _fits_broadcast(queries, broadcast_bytes):
        found = _search_broadcast(queries, corpus, k, query_key, key, schema)
    else:
        found = _search_blocks(
            queries.withColumn("_cell", F.lit(0)), corpus.withColumn("_cell", F.lit(0)), k, query_key, key, schema, block_rows
        )
    return _best_k(found, k, query_key, key)


def _search_broadcast(queries, corpus, k, query_key, key, schema):
    rows = queries.toPandas()  # size checked by the caller
    if rows.empty:
        return corpus.sparkSession.createDataFrame([], schema)
    shared = corpus.sparkSession.sparkContext.broadcast((rows[query_key].to_numpy(np.int64), unit(_matrix(rows["vector"]))))

    def visit(batches):
        qids, q = shared.value
        kept = None
        for pdf in batches:
            if pdf.empty:
                continue
            r, ids, s = top_of_block(q, unit(_matrix(pdf["vector"])), pdf[key].to_numpy(np.int64), k)
            now = pd.DataFrame({"r": r, key: ids, "score": s})
            kept = now if kept is None else pd.concat([kept, now])
            kept = kept.sort_values(["r", "score", key], ascending=[True, False, True]).groupby("r", sort=False).head(k)
        if kept is not None:
            yield pd.DataFrame({query_key: qids[kept["r"].to_numpy(int)], key: kept[key], "score": kept["score"]})

    return corpus.mapInPandas(visit, schema)


def _search_blocks(queries, corpus, k, query_key, key, schema, block_rows):
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_key: [], key: [], "score": []})
        r, ids, s = top_of_block(unit(_matrix(left["vector"])), unit(_matrix(right["vector"])),
                                 right[key].to_numpy(np.int64), k)
        return pd.DataFrame({query_key: left[query_key].to_numpy(np.int64)[r], key: ids, "score": s})

    return block_join(queries, corpus, kernel, schema, F.col(query_key), F.col(key), block_rows)


def non_blank(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.where(~is_blank(text))


def score_columns(a: str | Column, b: str | Column) -> Column:
    """Similarity of two vector columns of one row."""
    return F.round(cosine(a, b), SCORE_DECIMALS)


# ---- approximate -----------------------------------------------------------------------

class CellIndex:
    """Approximate index: vectors grouped around trained centres, a search probes the nearest few.

    The number of centres is bounded (``MAX_CENTRES``), so the centre table is safe to
    ship. A crowded cell is split in blocks like any other large group.
    """

    MAX_CENTRES = 1024

    def __init__(self, corpus: DataFrame, centres: int | None = None, seed: int = 0, key: str = "media_id"):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.key = key
        self.corpus = corpus.select(key, "vector").where(norm("vector") > 0)
        n = self.corpus.count()
        wanted = centres or int(max(1, min(self.MAX_CENTRES, np.sqrt(n))))
        train = self.corpus.select(array_to_vector(as_doubles("vector")).alias("features"))
        fitted = KMeans(k=max(2, min(wanted, self.MAX_CENTRES)), seed=seed, maxIter=10, distanceMeasure="cosine").fit(train)
        self.centres = unit(np.array(fitted.clusterCenters()))
        self.celled = materialize(self._with_cells(self.corpus, 1))

    def _with_cells(self, df: DataFrame, probes: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<int>")
        def nearest_cells(vs: pd.Series) -> pd.Series:
            s = unit(_matrix(vs)) @ shared.value.T
            p = min(probes, s.shape[1])
            return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :p].astype(np.int32)))

        return df.withColumn("_cell", F.explode(nearest_cells(as_doubles("vector"))))

    def search_many(self, queries: DataFrame, k: int, probes: int = 4, query_key: str = "query_id",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Top k per query among the ``probes`` nearest cells; all cells gives the exact answer."""
        queries = queries.select(query_key, "vector")
        schema = f"{query_key} bigint, {self.key} bigint, score double"
        asked = materialize(self._with_cells(queries, probes))
        found = _search_blocks(asked, self.celled, k, query_key, self.key, schema, block_rows)
        return _best_k(found, k, query_key, self.key)


def search_lsh(corpus: DataFrame, query: list[float], k: int, seed: int = 0, tables: int = 8, bucket: float = 0.5,
               key: str = "media_id") -> DataFrame:
    """Approximate top k for one query by MLlib's random projections; on unit vectors
    Euclidean order is cosine order."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    from lumaspark.functions.vectors import l2_normalize

    data = corpus.where(norm("vector") > 0).select(key, array_to_vector(as_doubles(l2_normalize("vector"))).alias("features"))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", seed=seed, numHashTables=tables, bucketLength=bucket
    ).fit(data)
    q = unit(np.array([query], dtype=np.float64))[0]
    hits = model.approxNearestNeighbors(data, Vectors.dense(q), k, distCol="d")
    return hits.select(key, F.round(1 - F.col("d") * F.col("d") / 2, SCORE_DECIMALS).alias("score"))
