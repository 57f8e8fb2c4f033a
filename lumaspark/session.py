"""Session helpers: lineage cuts that survive executor loss, and the default test session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lumaspark") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local master may fall back to /tmp."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        known = tempfile.mkdtemp(prefix="lumaspark-ckpt-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes rows to a table in the shared folder and reads it back.

    It cuts the lineage, pins values such as partition numbers, survives the loss of any
    executor, and gives the planner real sizes, so small tables join without a shuffle.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/lumaspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote and that nothing reads any more; other frames are left alone."""
    for df in tables:
        if getattr(df, "_written_at", None) is None:
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def next_round(before: DataFrame, df: DataFrame) -> DataFrame:
    """Writes a round of an iteration and deletes the round it came from."""
    out = materialize(df)
    release(before)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def widen(df: DataFrame) -> DataFrame:
    """Spreads the rows of a file scan before costly Python work when the scan has fewer
    parts than the session's shuffles: one small file with long texts, say. Scans of many
    files stay as they are. For scans only, since it asks the plan for its partitions."""
    width = shuffle_width(df.sparkSession)
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches for Python workers are cut by bytes, so that rows with long lists do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
