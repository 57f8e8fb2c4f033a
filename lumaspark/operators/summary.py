"""Aggregates over a catalogue, a map or a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.keys import cache_key
from lumaspark.functions.paths import folder_of


def folder_summary(files: DataFrame) -> DataFrame:
    return files.groupBy(folder_of("name").alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min("last_modified").alias("first_modified"),
        F.max("last_modified").alias("last_modified"),
        F.sum("size").alias("total_size"),
    )


def widest_folder(files: DataFrame) -> DataFrame:
    """Largest number of columns any folder needs when its files form a square."""
    return (
        files.groupBy(folder_of("name").alias("folder")).count()
        .agg(F.count(F.lit(1)).alias("n_folders"), F.max(F.ceil(F.sqrt("count"))).alias("max_cols"))
    )


def bounds(points: DataFrame, *extra: Column) -> DataFrame:
    """One row: box, centre and half range of the points, and their number."""
    box = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        *extra,
    )
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    half = F.greatest(F.col("max_x") - cx, F.col("max_y") - cy)
    return box.withColumns({"cx": cx, "cy": cy, "half": half})


def cluster_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def pipeline_status(
    files: DataFrame, vectors: DataFrame | None = None, points: DataFrame | None = None,
    results: DataFrame | None = None, captions: DataFrame | None = None, key: str = "media_id",
) -> DataFrame:
    """One row of progress counts. Each input is reduced to counts before the union, so
    nothing but a few partial sums is shuffled."""
    def tally(df: DataFrame | None, name: str, test: Column = F.lit(True)) -> DataFrame | None:
        return None if df is None else df.select(F.lit(name).alias("what"), test.cast("int").alias("hit"))

    parts = [
        tally(files, "files"),
        tally(vectors, "vectors"),
        tally(vectors, "cache_hits", F.col("from_cache")) if vectors is not None and "from_cache" in vectors.columns else None,
        tally(points, "points"),
        tally(results, "results"),
        tally(captions, "captions", F.col("caption").isNotNull()) if captions is not None else None,
    ]
    rows = None
    for p in parts:
        if p is not None:
            rows = p if rows is None else rows.unionByName(p)
    return rows.agg(*(
        F.coalesce(F.sum(F.when(F.col("what") == w, F.col("hit"))), F.lit(0)).alias(f"n_{w}")
        for w in ("files", "vectors", "cache_hits", "points", "results", "captions")
    ))


def distinct_media(files: DataFrame) -> DataFrame:
    """One row per distinct content (same basename, size and time): the lowest id stays."""
    cols = files.columns
    packed = files.groupBy(cache_key().alias("cache_key")).agg(
        F.min_by(F.struct(*cols), "media_id").alias("_row"), F.count(F.lit(1)).alias("copies")
    )
    return packed.select(*(F.col("_row")[c].alias(c) for c in cols), "cache_key", "copies")


def viewer_order(files: DataFrame, locale: str | None = "UNICODE") -> DataFrame:
    """Folder in locale order, then time; a distributed sort. None sorts folders by bytes."""
    folder = folder_of("name")
    lead = F.collate(folder, locale) if locale else folder
    return files.withColumn("folder", folder).orderBy(lead, "folder", "last_modified", "media_id")


def chronological(files: DataFrame) -> DataFrame:
    return files.orderBy("last_modified", "media_id")
