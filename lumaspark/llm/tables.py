"""Tables written between the steps of an operator, and column helpers they share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.session import checkpoint_dir


class Steps:
    """Parquet tables below the shared checkpoint folder, dropped once no later step reads them.

    A written table cuts the lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/lumaspark-llm/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._serial = 0

    def path(self, name: str) -> str:
        self._serial += 1
        return f"{self.root}/{name}-{self._serial}"

    def write(self, df: DataFrame, name: str = "step", partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self.path(name)
        df.write.partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._llm_step = self  # keeps the id of the frame from being used again
        return out

    def read(self, df: DataFrame) -> DataFrame:
        """The same table as another frame, for a second use in one plan."""
        return self.spark.read.schema(df.schema).parquet(self._paths[id(df)])

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete_path(self.spark, self._paths.pop(id(df)))


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, size: str = "4m", rows: int = 10_000) -> None:
    """Batches for Python workers are cut by bytes, so that very long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def give_back() -> None:
    """Memory that this worker freed goes back to the system, where the C library can do that: workers live on through many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
