"""Inputs of the registered queries, read from the given tables, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # table times carry no zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_catalogue(table(spark, sf_dir, "events"))


def as_catalogue(e: DataFrame) -> DataFrame:
    """events as a file listing: nested folders, hidden names, mixed and missing extensions."""
    suffix = F.get(
        F.array(*(F.lit(s) for s in (".JPG", ".png", ".heic", ".mp4", ".webm", ".txt", ".jpeg", ""))),
        F.pmod(F.col("event_id"), F.lit(8)).cast("int"),
    )
    dot = F.when(F.col("event_id") % 37 == 0, ".").otherwise("")
    name = F.concat(
        F.col("event_type"), F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"),
        dot, F.lit("IMG_"), F.col("event_id").cast("string"), suffix,
    )
    return e.select(
        F.col("event_id").alias("media_id"), name.alias("name"),
        F.round(F.col("value") * 10000).cast("bigint").alias("size"),
        F.col("ts").cast("timestamp").alias("last_modified"),
    )


CATALOGUE_SQL = """cat AS (
  SELECT event_id AS media_id,
         event_type || '/u' || CAST(user_id AS VARCHAR) || '/' ||
         CASE WHEN event_id % 37 = 0 THEN '.' ELSE '' END || 'IMG_' || CAST(event_id AS VARCHAR) ||
         CASE event_id % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.heic' WHEN 3 THEN '.mp4'
              WHEN 4 THEN '.webm' WHEN 5 THEN '.txt' WHEN 6 THEN '.jpeg' ELSE '' END AS name,
         CAST(round(value * 10000) AS BIGINT) AS size, ts AS last_modified
  FROM events)"""

IMAGE_LIST_SQL = "('jpg','jpeg','png','gif','webp','avif','bmp','tiff','tif','heic','heif')"
EXT_SQL = "lower(split_part(split_part(name, '/', -1), '.', -1))"
BASE_SQL = "split_part(name, '/', -1)"
FOLDER_SQL = "coalesce(nullif(regexp_replace(name, '/?[^/]*$', ''), ''), '(root)')"
MS_SQL = "CAST(epoch_us(last_modified) // 1000 AS VARCHAR)"
CACHE_KEY_SQL = f"concat_ws(':', {BASE_SQL}, CAST(size AS VARCHAR), {MS_SQL})"
PATH_KEY_SQL = f"concat_ws(':', name, CAST(size AS VARCHAR), {MS_SQL})"

# the media of the catalogue: what a folder walk keeps
MEDIA_SQL = f"""media AS (
  SELECT * FROM cat
  WHERE ({EXT_SQL} IN {IMAGE_LIST_SQL} OR {EXT_SQL} IN ('mp4','webm'))
    AND NOT regexp_matches(name, '(^|/)\\.'))"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumaspark.sources.media import catalogue_from_tree

    return catalogue_from_tree(catalogue(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("media_id"), F.col("embedding").alias("vector"), "label"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of each vector as map coordinates."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("media_id"),
        F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"),
    )


POINTS_SQL = """pts AS (
  SELECT vec_id AS media_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings)"""


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a map over every file of the catalogue: time across, size down."""
    c = catalogue(spark, sf_dir)
    return c.select(
        "media_id",
        (F.unix_millis("last_modified") / 100000.0 - 17040672.0).alias("x"),
        (F.col("size") / 100.0).alias("y"),
    )


MAP_POINTS_SQL = CATALOGUE_SQL + """, mp AS (
  SELECT media_id, (epoch_us(last_modified) // 1000) / 100000.0::DOUBLE - 17040672.0::DOUBLE AS x,
         size / 100.0::DOUBLE AS y FROM cat)"""
