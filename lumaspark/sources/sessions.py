"""Saved maps: written once per session, resumed against the files of today."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.functions.keys import path_key
from lumaspark.operators.embed import DIMS
from lumaspark.operators.ordering import ordered_rank
from lumaspark.sources.cache import cache_lookup_with_legacy

SESSION_COLUMNS = ("mode", "ord", "file_key", "x", "y", "cluster")


def session_save(rows: DataFrame, path: str, session_id: str, mode: str) -> None:
    """Stores (ord, file_key, x, y, cluster) of a map under its session; replaces an older save."""
    out = rows.select(
        F.lit(mode).alias("mode"), F.col("ord").cast("bigint").alias("ord"), "file_key",
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("cluster").cast("int").alias("cluster"),
    )
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/session_id={session_id}")


def session_load(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/session_id={session_id}")


def session_match(session: DataFrame, files: DataFrame) -> DataFrame:
    """Saved rows whose file is still there, with that file; of equal keys the last file counts."""
    keyed = files.withColumn("file_key", path_key())
    last = keyed.groupBy("file_key").agg(F.max_by(F.struct(*files.columns), "media_id").alias("_f"))
    return session.join(last, "file_key").select("ord", "file_key", "x", "y", "cluster", "_f.*")


def session_resume(
    session: DataFrame, files: DataFrame, cache: DataFrame | None = None, model: str = "",
    min_match: float = 0.8, dims: int = DIMS,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Restores a saved map, or (None, None) when too few files are left and the whole
    map must be built again.

    Rows keep their saved order, place and cluster. Given a cache, each also gets its
    vector (zeros where none is cached), and the second result is the cache rows to migrate.
    """
    matched = session_match(session, files)
    if matched.count() < session.count() * min_match:
        return None, None
    out = ordered_rank(matched, [], ["ord"], "_rn").withColumn("ord", F.col("_rn") - 1).drop("_rn")
    if cache is None:
        return out, None
    found, migrate = cache_lookup_with_legacy(out, cache, model)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return found.withColumn("vector", F.coalesce("vector", zeros)), migrate
