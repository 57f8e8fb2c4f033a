"""Streams: new files become catalogue rows, get vectors, and refresh the map."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.functions.paths import MEDIA_EXTS, is_hidden, is_media
from lumaspark.operators.layout import grid_layout
from lumaspark.operators.ordering import ordered_neighbours
from lumaspark.operators.project import project
from lumaspark.operators.spread import MAX_ROUNDS, spread
from lumaspark.session import materialize
from lumaspark.sources.cache import StoredCache, embed_with_cache
from lumaspark.sources.media import _below

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_media(spark: SparkSession, root: str, exts=MEDIA_EXTS, with_content: bool = False,
                 files_per_batch: int | None = None, log: str | None = None) -> DataFrame:
    """Catalogue rows of files as they appear below a folder.

    With ``log``, a folder beside the checkpoint, the tree is listed as ``walk_media`` does it, names that
    start with an underscore included. Without one Spark lists, which hides these.
    """
    if log is not None:
        from lumaspark.streaming.folders import FolderSource

        spark.dataSource.register(FolderSource)
        rows = spark.readStream.format("media_folder").option("log", log).option("content", str(with_content).lower()).load(root)
    else:
        reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = reader.load(root).select(
            _below(F.col("path"), root).alias("name"), F.col("length").alias("size"),
            F.col("modificationTime").alias("last_modified"), *(["content"] if with_content else []),
        )
    return rows.where(is_media("name", exts) & ~is_hidden("name")).withColumn("media_id", F.xxhash64("name"))


def embed_batch(cache: StoredCache, model: str, infer: Callable[[DataFrame], DataFrame],
                then: Callable[[DataFrame, int], None] | None = None, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: vectors for the batch, new ones stored under the writer and batch number.

    A batch sees the cache as it was when the batch first began. Run again, it finds its own write if that was completed:
    nothing is inferred or stored anew and ``then`` gets the same vectors. Else it starts over, with its old place in the
    order of writes. Each stream needs a writer of its own; ``stream_embed`` takes one that its checkpoint keeps.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        begun = cache.begin(writer, batch_id)
        got, writes = embed_with_cache(batch, cache.read(model, begun, (writer, batch_id)), model, infer)
        done = materialize(got.select("media_id", "name", "vector", "from_cache", "ok")) if then else None
        if not cache.committed(writer, batch_id):
            cache.put(writes, batch_id, writer)
        if then:
            then(done, batch_id)

    return step


def checkpoint_writer(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a checkpoint's stream writes, made once and kept in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/cache-writer")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    source = fs.open(path)
    name = source.readUTF()
    source.close()
    return f"stream-{name}"


def stream_embed(stream: DataFrame, cache: StoredCache, model: str, infer: Callable[[DataFrame], DataFrame],
                 checkpoint: str, then=None, trigger: dict | None = None):
    """Starts a query that keeps the cache filled for a stream of files."""
    writer = checkpoint_writer(cache.spark, checkpoint)
    return (
        stream.writeStream.foreachBatch(embed_batch(cache, model, infer, then, writer))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


_GROWTH = "n long, last_count long, refreshes int, map string"


class ProgressiveMap:
    """Map that grows with a stream: a plain grid below ``minimum`` vectors, then a fresh
    linear projection once ``interval`` new vectors came in. Use as ``then`` of ``stream_embed``.

    Everything lies below ``path``: per batch its vectors, and a record of how many ids there are, how many the last
    projection had, and where the present map is written. The record comes last and says that the batch is done: another driver
    goes on from it, and a batch that comes again changes nothing. New ids are counted from the batch, not by counting all again.
    Batches of one stream come in order; each stream needs a path of its own.
    """

    def __init__(self, path: str, minimum: int = 3, interval: int = 3, total: int | None = None, max_rounds: int = MAX_ROUNDS):
        self.path, self.minimum, self.interval = path.rstrip("/"), minimum, interval
        self.total, self.max_rounds = total, max_rounds

    def _growth(self, spark: SparkSession, before: int | None = None):
        """The newest record, of batches before a number if one is given."""
        if not _exists(spark, f"{self.path}/growth"):
            return None
        rows = spark.read.schema(f"{_GROWTH}, batch long").parquet(f"{self.path}/growth")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.orderBy(F.desc("batch")).first()

    @property
    def refreshes(self) -> int:
        last = self._growth(SparkSession.active())
        return last["refreshes"] if last else 0

    @property
    def points(self) -> DataFrame | None:
        """The last map: (media_id, x, y)."""
        spark = SparkSession.active()
        last = self._growth(spark)
        return spark.read.parquet(f"{self.path}/maps/{last['map']}") if last and last["map"] else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{self.path}/growth/batch={batch_id}/_SUCCESS"):
            return
        last = self._growth(spark, batch_id)
        batch.select("media_id", "vector").write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch_id}")
        rows = spark.read.schema("media_id long, vector array<float>, batch long").parquet(f"{self.path}/vectors").where(F.col("batch") <= batch_id)
        now = rows.where(F.col("batch") == batch_id).select("media_id").distinct()
        earlier = rows.where(F.col("batch") < batch_id).select("media_id")
        n = (last["n"] if last else 0) + now.join(earlier, "media_id", "left_anti").count()
        seen = rows.groupBy("media_id").agg(F.max_by("vector", "batch").alias("vector"))
        shown, refreshes, name = (last["last_count"], last["refreshes"], last["map"]) if last else (0, 0, None)
        fresh = None
        if n < self.minimum:
            fresh = grid_layout(seen.select("media_id"), self.total or n)
        elif n - shown >= self.interval:
            shown, refreshes = n, refreshes + 1
            fresh = spread(project(seen, "PCA"), max_rounds=self.max_rounds)
        if fresh is not None:
            name = f"map-{batch_id}"
            fresh.write.mode("overwrite").parquet(f"{self.path}/maps/{name}")
        record = spark.createDataFrame([(n, shown, refreshes, name)], _GROWTH)
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/growth/batch={batch_id}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def debounce_stream(events: DataFrame, keys: list[str], ts: str, value: str, gap: str = "300 milliseconds",
                    watermark: str = "10 seconds", tie: str | None = None) -> DataFrame:
    """The last value of each burst of input: a burst ends after ``gap`` without events.
    A blank last value clears; ``tie`` orders events of one instant. Events later than
    the watermark are dropped."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    bursts = events.withWatermark(ts, watermark).groupBy(*keys, F.session_window(F.col(ts), gap).alias("burst"))
    out = bursts.agg(F.max_by(F.col(value), order).alias("value"), F.max(ts).alias("last_ts"))
    return out.select(*keys, "last_ts", F.col("burst.end").alias("emit_ts"), "value", _cleared(F.col("value")).alias("cleared"))


def _cleared(v: Column) -> Column:
    return F.regexp_replace(F.coalesce(v, F.lit("")), r"\s", "") == ""


def debounce(events: DataFrame, keys: list[str], ts: str, value: str, gap_ms: int = 300, tie: str | None = None) -> DataFrame:
    """The same for stored events: an event counts when the next one of its key comes later
    than the gap, or never. Keys may be of any size: neighbours come from range slices."""
    order = [ts, tie] if tie else [ts, value]
    nxt = ordered_neighbours(events, keys, order, ts, "_before", "_after")
    us, after = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(F.col("_after").cast("timestamp"))
    ends = nxt.where(F.col("_after").isNull() | (after - us > gap_ms * 1000))
    return ends.select(*keys, F.col(ts).alias("last_ts"), (us + gap_ms * 1000).alias("emit_us"),
                       F.col(value).alias("value"), _cleared(F.col(value)).alias("cleared"))
