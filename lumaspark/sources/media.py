"""Catalogues: from a folder tree, or from a flat listing table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.functions.paths import MEDIA_EXTS, is_hidden, is_media
from lumaspark.session import materialize


def _below(path: Column, root: str) -> Column:
    """Path relative to a root, whatever scheme prefix Spark puts before it."""
    tail = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return F.substring(path, F.locate(tail, path) + F.lit(len(tail)), F.length(path))


def scan_media(
    spark: SparkSession, root: str, base_path: str = "", exts=MEDIA_EXTS, with_content: bool = False, lister: str = "walk"
) -> DataFrame:
    """Media files below a folder, hidden files and hidden folders left out.

    File bytes are read only when asked for; ``read_content`` reads them later for chosen rows. ``lister="spark"`` is for file
    systems that only Spark can open: its listing leaves out names that start with an underscore.
    """
    root = root.rstrip("/")
    if lister == "walk":
        files = walk_media(spark, root, base_path, exts)
        return read_content(files, root) if with_content else files
    start = f"{root}/{base_path.strip('/')}" if base_path.strip("/") else root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(start)
    files = raw.select(
        _below(F.col("path"), root).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        *(["content"] if with_content else []),
    ).where(is_media("name", exts) & ~is_hidden("name"))
    return files.withColumn("media_id", F.xxhash64("name"))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path)


def walk_media(spark: SparkSession, root: str, base_path: str = "", exts=MEDIA_EXTS) -> DataFrame:
    """Media files below a folder, by a walk that hides no name but those that start with a dot: the
    folders of a level are listed by tasks, and each level is a written table. For file systems
    that pyarrow can open."""
    root = root.rstrip("/")
    start = f"{root}/{base_path.strip('/')}" if base_path.strip("/") else root
    _, top = _file_system(root)

    def children(batches):
        import pandas as pd
        from pyarrow.fs import FileSelector, FileType

        for pdf in batches:
            rows = []
            for folder in pdf["folder"]:
                fs, path = _file_system(folder)
                prefix = folder[: len(folder) - len(path)]
                for f in fs.get_file_info(FileSelector(path)):
                    rows.append((prefix + f.path, f.type == FileType.Directory, f.size or 0, pd.Timestamp((f.mtime_ns or 0) // 1000, unit="us", tz="UTC")))
            yield pd.DataFrame(rows, columns=["path", "is_folder", "size", "last_modified"])

    folders, levels = spark.createDataFrame([(start,)], "folder string"), []
    while True:
        level = folders.repartition("folder").mapInPandas(children, "path string, is_folder boolean, size bigint, last_modified timestamp")
        levels.append(materialize(level.where(~is_hidden(_below(F.col("path"), top)))))
        folders = levels[-1].where("is_folder").select(F.col("path").alias("folder"))
        if not folders.limit(1).count():
            break
    files = reduce(DataFrame.unionByName, levels).where("NOT is_folder")
    named = files.select(_below(F.col("path"), top).alias("name"), "size", "last_modified").where(is_media("name", exts))
    return named.withColumn("media_id", F.xxhash64("name"))


def read_content(files: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Adds the bytes of chosen files, read by name below the root; null for those that are gone. Use it behind
    sampling, filters and cache lookups, so that bytes of other files are never read or shuffled."""
    root = root.rstrip("/")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", `{content}` binary"

    def read(batches):
        import pyarrow as pa

        fs, top = _file_system(root)
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time is in memory
                row = batch.slice(at, 1)
                try:
                    with fs.open_input_stream(f"{top}/{row.column('name')[0].as_py()}", compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, content])

    return files.mapInArrow(read, schema)


def catalogue_from_tree(listing: DataFrame, exts=MEDIA_EXTS) -> DataFrame:
    """The rules of a folder walk, on a table of paths."""
    return listing.where(is_media("name", exts) & ~is_hidden("name"))


def catalogue_from_listing(listing: DataFrame, rel: str = "rel_path", name: str = "file_name") -> DataFrame:
    """Catalogue of a flat file list: by extension only, hidden names stay."""
    full = F.coalesce(F.nullif(F.col(rel), F.lit("")), F.col(name))
    rest = [c for c in listing.columns if c not in (rel, name)]
    return listing.select(*rest, full.alias("name")).where(is_media("name"))


def scope_to_folder(files: DataFrame, base_path: str) -> DataFrame:
    """Files at or below a folder; a prefix test, so Parquet can skip row groups."""
    base = base_path.strip("/")
    return files.where(F.col("name").startswith(base + "/")) if base else files
