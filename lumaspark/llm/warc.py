"""WARC archives as a Python data source, and pages written to them with revisit records.

Reading plans one partition per archive file. Comparisons on header columns (record_type,
record_id, target_uri, date, payload_digest, refers_to) are taken over from the filter; a record's header
is parsed first, and the block of a record that fails them, or whose payload no requested column needs, is
passed over: by a seek where the archive is plain or its gzip members carry their length, else unread in
chunks. A schema given to the reader chooses the columns: spark.read.format("warc").schema("record_id string, ...").

Writing makes one or more files per task below a staging folder, named at random, and the commit
moves those of successful tasks to the target; files of lost attempts vanish with the staging
folder. Files live on any file system that pyarrow knows, chosen by the path.

Null payloads are empty, null header values are left out. Line ends in header values become spaces.
An empty table writes one empty archive at most; reading a folder without archives gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from lumaspark.llm.tables import Steps, small_batches, text_of

# Fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
                  "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
          "headers map<string,string>, payload_length long, payload binary, file string, offset long")
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)


# ---------------------------------------------------------------- records

def encode_record(fields: dict[str, str | None], payload: bytes | None) -> bytes:
    """A record with an HTTP block; a payload of None gives the HTTP header alone, as revisits have it."""
    fields = dict(fields)
    length = fields.pop("payload-length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [VERSION]
    lines += [f"{k}: {' '.join(str(v).split()) if k != 'WARC-Target-URI' else str(v).translate({13: 32, 10: 32})}" for k, v in fields.items() if v is not None]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field says how long it is, so that a reader can pass over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Plain:
    """Records of an uncompressed archive."""

    def __init__(self, raw):
        self.raw = raw

    def next_header(self) -> tuple[int, bytes] | None:
        offset, head = self.raw.tell(), b""
        while not head.endswith(b"\r\n\r\n"):
            line = self.raw.readline()
            if not line:
                return None
            if not head and line in (b"\r\n", b"\n"):
                offset = self.raw.tell()
                continue
            head += line if line.endswith(b"\r\n") else line.rstrip(b"\n") + b"\r\n"
        return offset, head

    def block(self, length: int) -> bytes:
        return self.raw.read(length)

    def skip(self, length: int) -> None:
        self.raw.seek(length, io.SEEK_CUR)


class _Gzip:
    """Records of an archive of gzip members, one record each."""

    CHUNK = 64 << 10

    def __init__(self, raw):
        self.raw, self.end = raw, 0

    def next_header(self) -> tuple[int, bytes] | None:
        offset = self.end
        self.raw.seek(offset)
        start = self.raw.read(24)
        if not start:
            return None
        self.length = struct.unpack_from("<I", start, 16)[0] if start[3:4] == b"\x04" and start[12:14] == b"sl" else None
        self.end = offset + self.length if self.length else None
        self.raw.seek(offset)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in self.ready and self._more():
            pass
        head, _, self.ready = self.ready.partition(b"\r\n\r\n")
        return offset, head + b"\r\n\r\n"

    def _more(self) -> bool:
        data = self.raw.read(self.CHUNK)
        if not data or self.unpack.eof:
            return False
        self.ready += self.unpack.decompress(data)
        return True

    def _finish(self) -> None:
        while not self.unpack.eof:
            data = self.raw.read(self.CHUNK)
            if not data:
                break
            self.unpack.decompress(data)
        self.end = self.raw.tell() - len(self.unpack.unused_data)

    def block(self, length: int) -> bytes:
        parts, have = [self.ready], len(self.ready)
        while have < length and not self.unpack.eof:
            data = self.raw.read(self.CHUNK)
            if not data:
                break
            parts.append(self.unpack.decompress(data))
            have += len(parts[-1])
        if self.end is None:
            self._finish()
        return b"".join(parts)[:length]

    def skip(self, length: int) -> None:
        if self.end is None:
            self._finish()


def parse_header(head: bytes) -> dict[str, str]:
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


def _split_http(block: bytes) -> tuple[int | None, bytes]:
    """The HTTP header's content length, and the payload behind it."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), payload
    return None, payload


# ---------------------------------------------------------------- data source

@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list


def _test(flt):
    """A header test for a pushed filter, or None where the filter stays with Spark."""
    value = getattr(flt, "value", None)
    attribute = getattr(flt, "attribute", ("",))
    if len(attribute) != 1 or attribute[0] not in HEADER_COLUMNS:
        return None
    name = HEADER_COLUMNS[attribute[0]]
    checks = {
        EqualTo: lambda v: v is not None and v == value, EqualNullSafe: lambda v: v == value, In: lambda v: v is not None and v in value,
        IsNotNull: lambda v: v is not None, IsNull: lambda v: v is None,
        GreaterThan: lambda v: v is not None and v > value, GreaterThanOrEqual: lambda v: v is not None and v >= value,
        LessThan: lambda v: v is not None and v < value, LessThanOrEqual: lambda v: v is not None and v <= value,
        StringStartsWith: lambda v: v is not None and v.startswith(value),
    }
    check = checks.get(type(flt))
    return None if check is None or (value is None and type(flt) not in (IsNotNull, IsNull)) else (name, check)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], schema: pa.Schema):
        self.path, self.names, self.arrow, self.filters = path, names, schema, []

    def pushFilters(self, filters):
        for flt in filters:
            if _test(flt) is None:
                yield flt
            else:
                self.filters.append(flt)

    def partitions(self):
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_File(root)]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=False))
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")))
        return [_File(n) for n in names] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        tests = [_test(f) for f in self.filters]
        needs_block = {"payload", "payload_length"} & set(self.names)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as source:
            raw = io.BufferedReader(source, 1 << 20)
            records = _Gzip(raw) if partition.path.endswith(".gz") else _Plain(raw)
            while (found := records.next_header()) is not None:
                offset, head = found
                fields = parse_header(head)
                length = int(fields.get("Content-Length", 0))
                if not all(check(fields.get(name)) for name, check in tests):
                    records.skip(length)
                    continue
                stated, payload = None, None
                if needs_block:
                    stated, payload = _split_http(records.block(length))
                    if fields.get("WARC-Type") == "revisit":
                        payload = None
                else:
                    records.skip(length)
                row = {c: fields.get(h) for c, h in HEADER_COLUMNS.items()}
                row |= {"headers": list(fields.items()), "payload": payload, "file": partition.path, "offset": offset,
                        "payload_length": stated if payload is None else len(payload)}
                rows.append([row[n] for n in self.names])
                size += len(payload or b"") + 200
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, gzip: bool, file_bytes: int):
        self.path, self.gzip, self.file_bytes = path, gzip, file_bytes
        self.staging = f"_staging-{uuid.uuid4().hex}"
        fs, root = filesystem(path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator):
        fs, root = filesystem(self.path)
        names, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    payload = row["payload"] or b""
                    revisit = row["record_type"] == "revisit"
                    fields = {h: row.get(c) for c, h in HEADER_COLUMNS.items()}
                    digest = row.get("payload_digest")
                    fields["WARC-Payload-Digest"] = digest or "sha1:" + hashlib.sha1(payload).hexdigest()
                    fields["WARC-Profile"] = REVISIT_PROFILE if revisit else None
                    fields |= dict(row.get("headers") or [])
                    fields["payload-length"] = len(payload)
                    data = encode_record(fields, None if revisit else payload)
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}")
                        out = fs.open_output_stream(f"{root}/{self.staging}/{names[-1]}", compression=None)
                    out.write(gzip_member(data) if self.gzip else data)
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages):
        fs, root = filesystem(self.path)
        fs.delete_dir(f"{root}/{self.staging}")


class WarcSource(DataSource):
    """format("warc"): options path, and for writing compression ("gzip" or "none") and file_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        return WarcReader(self.options["path"], schema.names, to_arrow_schema(schema))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip",
                          int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages

REVISIT_FROM = 1000  # payloads of fewer bytes are always stored
_PAGE = "urn:page:"


def page_records(pages: DataFrame, steps: Steps, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = REVISIT_FROM, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of pages: of equal payloads of `least` bytes and more, the page with the largest id is the response
    and the others revisit it. Pages that repeat that id are responses too; null ids revisit, unless all are null."""
    body = F.encode(text_of(html_col), "utf-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload"))
    long = F.octet_length("payload") >= least
    rows = rows.withColumn("sha", F.when(long, F.sha2("payload", 256)))
    owners = rows.filter(long).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    owners = steps.write(owners, "owners")  # its written size decides how it is joined
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return rows.join(owners, "sha", "left").select(
        F.concat(F.lit(_PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit(_PAGE), F.col("owner").cast("string"))).alias("refers_to"), "payload",
    )


def archive_pages(pages: DataFrame, path: str, compression: str = "gzip", schema: str = SCHEMA, **columns) -> DataFrame:
    """Writes pages to archives below path and returns them read back (format "warc"), the columns of the schema."""
    spark = pages.sparkSession
    register(spark)
    steps = Steps(spark, "warc")
    records = page_records(pages, steps, **columns)
    records.write.format("warc").mode("append").option("compression", compression).save(path)
    return spark.read.format("warc").schema(schema).load(path)


def page_number(column: str):
    return F.regexp_extract(column, f"^{_PAGE}(-?[0-9]+)$", 1).try_cast("bigint")
