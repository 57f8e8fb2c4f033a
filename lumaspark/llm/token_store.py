"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of bits, lowest first. Level 0 of a file holds the first chunk of every id, level 1 the second
chunk of those ids that have one, and so on. A bitmap beside each level but the last says which ids go on, and a
directory holds the number of set bits before every 512th place. So the place of an id's next chunk is a rank, told from
one entry and at most 64 bytes of bitmap, and any id is read by a few reads of known places; no block is decoded. A range of
ids is the same with ranges. The widths of the chunks are those that make the file smallest, by its counts of bit lengths.

A file: levels (chunks, bitmap, directory), then document ids, flags of null ids and first places, then a JSON footer with places
and widths, its length and MAGIC; all numbers little-endian. Its name says its first place in the whole and its number of ids, so that
the files need no list beside them. Spark writes and reads the folder by the Python data source "token_store": rows keep
their order within and across tasks, each task fills files of about file_tokens ids below a staging folder, and the commit
names those of successful tasks. Reading plans a partition per file, decodes a few documents at a time, and takes over
comparisons of doc_id: directories are read first, and only documents that pass are decoded.

Null texts are empty: the end id alone. Null document ids come first; rows of one id lie in the order of a hash of their
text. An empty table writes no file, and a folder without files gives no rows. Texts are whole; a file holds at least one document.
"""

from __future__ import annotations

import json
import operator
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

from lumaspark.llm import packing
from lumaspark.llm.tables import Steps, small_batches, text_of
from lumaspark.llm.warc import filesystem

MAGIC = b"TOKDAC01"
END_ID = 2
FILE_TOKENS = 1 << 25
GROUP = 512  # places per entry of a rank directory
SLICE = 1 << 18  # ids handled together
BATCH_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_NAME = re.compile(r"tokens-(\d{20})-(\d+)\.dac")


# ---------------------------------------------------------------- codes

def best_widths(lengths: np.ndarray) -> list[int]:
    """Chunk widths of the smallest file, for lengths[b] ids of b bits."""
    top = max([1, *np.flatnonzero(lengths).tolist()])
    longer = [int(lengths[p + 1:].sum()) if p else int(lengths.sum()) for p in range(top + 1)]  # ids with bits from p on
    best, width = [0.0] * (top + 1), [0] * (top + 1)
    for p in range(top - 1, -1, -1):
        bits = {w: longer[p] * (w + (1 + 64 / GROUP if p + w < top else 0)) + best[p + w] for w in range(1, min(16, top - p) + 1)}
        width[p] = min(bits, key=bits.get)
        best[p] = bits[width[p]]
    out, p = [], 0
    while p < top:
        out.append(width[p])
        p += width[p]
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    parts = []
    for i in range(0, len(values), SLICE):  # a whole number of bytes each, but for the last
        bits = (values[i:i + SLICE, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        parts.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    return b"".join(parts)


def encode_ids(ids: np.ndarray) -> tuple[list[bytes], list[dict]]:
    """The sections of the levels of ids, and of each level its width, number of ids and sizes of sections."""
    ids = ids.astype(np.uint32)
    lengths = np.zeros(33, np.int64)
    for i in range(0, len(ids), SLICE):
        lengths += np.bincount(np.frexp(ids[i:i + SLICE].astype(np.float64))[1], minlength=33)
    sections, levels, widths = [], [], best_widths(lengths)
    for depth, width in enumerate(widths):
        parts = [_pack(ids & np.uint32((1 << width) - 1), width), b"", b""]
        count, ids = len(ids), ids >> np.uint32(width)
        if depth < len(widths) - 1:
            on = ids > 0
            bitmap = np.packbits(on, bitorder="little")
            sums = np.add.reduceat(on, np.arange(0, count, GROUP), dtype=np.int64) if count else np.empty(0, np.int64)
            parts[1:] = bitmap.tobytes(), (np.cumsum(sums) - sums).astype("<u8").tobytes()
            ids = ids[on]
        sections += parts
        levels.append({"width": width, "count": count, "sizes": [len(p) for p in parts]})
    return sections, levels


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """The bytes of a file, in parts."""
    sections, levels = encode_ids(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    places = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
    sections += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), places.astype("<i8").tobytes()]
    footer = json.dumps({"levels": levels, "documents": len(doc_ids), "tokens": len(ids)}).encode()
    return [*sections, footer, len(footer).to_bytes(8, "little"), MAGIC]


class TokenFile:
    """Reads ids of a file by their places in it; `source` is an open random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self._read(size - 16 - length, length))
        self.documents, self.tokens, self.levels, at = footer["documents"], footer["tokens"], [], 0
        for level in footer["levels"]:
            places = np.cumsum([at, *level["sizes"]]).tolist()
            self.levels.append((level["width"], *places[:3]))
            at = places[3]
        self._directory = at

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at) if size else b""

    def _bits(self, at: int, first: int, past: int) -> np.ndarray:
        """Bits first to past of a section."""
        data = self._read(at + first // 8, (past + 7) // 8 - first // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[first % 8:first % 8 + past - first]

    def _rank(self, bitmap: int, directory: int, place: int) -> int:
        group = place // GROUP
        before = int.from_bytes(self._read(directory + 8 * group, 8), "little")
        return before + int.from_bytes(self._read(bitmap + group * GROUP // 8, (place % GROUP + 7) // 8), "little").__and__((1 << place % GROUP) - 1).bit_count()

    def token(self, place: int) -> int:
        """The id at a place, by a few reads."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        value = shift = 0
        for depth, (width, chunks, bitmap, directory) in enumerate(self.levels):
            first = place * width
            data = int.from_bytes(self._read(chunks + first // 8, (first + width + 7) // 8 - first // 8), "little")
            value |= (data >> first % 8 & (1 << width) - 1) << shift
            shift += width
            if depth == len(self.levels) - 1 or not self._read(bitmap + place // 8, 1)[0] >> place % 8 & 1:
                return value
            place = self._rank(bitmap, directory, place)
        return value

    def range(self, first: int, past: int) -> np.ndarray:
        """The ids of places first to past, as unsigned 32-bit numbers; reads only what codes them."""
        out = np.empty(max(past - first, 0), np.uint32)
        for i in range(first, past, SLICE):
            end = min(i + SLICE, past)
            self._level(0, i, end, out[i - first:end - first], 0)
        return out

    def _level(self, depth: int, first: int, past: int, out: np.ndarray, shift: int) -> None:
        width, chunks, bitmap, directory = self.levels[depth]
        bits = self._bits(chunks, first * width, past * width).reshape(-1, width)
        out[:] = 0
        for i in range(width):
            out |= bits[:, i].astype(np.uint32) << np.uint32(shift + i)
        if depth < len(self.levels) - 1:
            on = np.flatnonzero(self._bits(bitmap, first, past))
            if len(on):
                more = np.empty(len(on), np.uint32)
                rank = self._rank(bitmap, directory, first)
                self._level(depth + 1, rank, rank + len(on), more, shift + width)
                out[on] |= more

    def directory(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, which of them are null, and the places where documents start, with the end."""
        n = self.documents
        data = self._read(self._directory, 17 * n + 8)
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool), np.frombuffer(data, "<i8", n + 1, 9 * n)


# ---------------------------------------------------------------- data source

@dataclass
class _Part(InputPartition):
    path: str
    start: int


@dataclass
class _Filled(WriterCommitMessage):
    task: int
    files: list[tuple[str, int]]


def _files(path: str) -> list[tuple[int, int, str]]:
    """(first place, ids, path) of the files of a folder, in order."""
    fs, root = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    named = ((_NAME.fullmatch(f.base_name), f.path) for f in found)
    return sorted((int(m[1]), int(m[2]), p) for m, p in named if m)


class TokenReader(DataSourceReader):
    _TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}

    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ in self._TESTS and f.attribute == ("doc_id",) and isinstance(f.value, int):
                self.tests.append((self._TESTS[type(f)], f.value))
            elif isinstance(f, In) and f.attribute == ("doc_id",) and all(isinstance(v, int) for v in f.value):
                self.tests.append((np.isin, list(f.value)))
            else:
                yield f

    def partitions(self):
        return [_Part(p, start) for start, _, p in _files(self.path)] or [_Part("", 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as source:
            file = TokenFile(source)
            ids, null, places = file.directory()
            wanted = np.ones(len(ids), bool)
            for test, value in self.tests:
                wanted &= test(ids, value) & ~null
            wanted, i = np.flatnonzero(wanted), 0
            while i < len(wanted):
                past = max(i + 1, int(np.searchsorted(places[wanted + 1], places[wanted[i]] + BATCH_TOKENS, "right")))
                yield self._batch(file, wanted[i:past], ids, null, places, partition.start)
                i = past

    def _batch(self, file, some, ids, null, places, start):
        def column(name):
            if name == "doc_id":
                return pa.array(ids[some], mask=null[some])
            if name == "start":
                return pa.array(places[some] + start)
            if name == "n_tokens":
                return pa.array(places[some + 1] - places[some])
            if some[-1] - some[0] == len(some) - 1:  # neighbours are decoded at once
                data = file.range(int(places[some[0]]), int(places[some[-1] + 1])).astype("<u4").tobytes()
                return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((places[some[0]:some[-1] + 2] - places[some[0]]) * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
            return pa.array([file.range(int(places[d]), int(places[d + 1])).astype("<u4").tobytes() for d in some], pa.binary())

        return pa.RecordBatch.from_arrays([column(f.name).cast(f.type) for f in self.schema], schema=self.schema)


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_tokens: int):
        self.path, self.file_tokens = path, file_tokens
        self.staging = f"_staging-{uuid.uuid4().hex}"
        fs, root = filesystem(path)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator):
        fs, root = filesystem(self.path)
        docs, ids, files, n = [], [], [], 0

        def close():
            name = uuid.uuid4().hex
            whole = np.frombuffer(b"".join(ids), "<u4")
            with fs.open_output_stream(f"{root}/{self.staging}/{name}", compression=None) as out:
                for part in encode_file(docs, [len(x) // 4 for x in ids], whole):
                    out.write(part)
            files.append((name, n))

        for batch in iterator:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                ids.append(data)
                n += len(data) // 4
                if n >= self.file_tokens:
                    close()
                    docs, ids, n = [], [], 0
        if docs:
            close()
        return _Filled(TaskContext.get().partitionId(), files)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        start = max([first + n for first, n, _ in _files(self.path)], default=0)
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for name, n in m.files:
                fs.move(f"{root}/{self.staging}/{name}", f"{root}/tokens-{start:020d}-{n}.dac")
                start += n
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages):
        fs, root = filesystem(self.path)
        fs.delete_dir(f"{root}/{self.staging}")


class TokenSource(DataSource):
    """format("token_store"): path, and for writing file_tokens. Written rows have doc_id and ids and come in order."""

    @classmethod
    def name(cls):
        return "token_store"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        return TokenReader(self.options["path"], to_arrow_schema(schema))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("token stores are appended to, or written to a new folder")
        return TokenWriter(self.options["path"], int(self.options.get("file_tokens", FILE_TOKENS)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)
    spark.dataSource.register(TokenSource)


# ---------------------------------------------------------------- documents

def _tokenise(paths: tuple[str, str], end: int):
    tail = np.asarray([end], dtype="<u4").tobytes()

    def run(batches):
        ids = packing._ids(*paths)
        for batch in batches:
            coded = [ids(text) + tail for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.binary())], names=["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None,
                 end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> None:
    """Writes the ids of all documents, each with the end id behind it, in ascending order of document ids. Texts are
    shuffled by ranges, once, and become ids where they are written."""
    register(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    # equal rows may lie in any order; the last key lets ranges cut through them
    keys = ["doc_id", F.xxhash64("text"), "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    coded = rows.select("doc_id", "text").mapInArrow(_tokenise(tokenizer or packing.default_tokenizer(), end_id), "doc_id long, ids binary")
    coded.write.format("token_store").mode("append").option("file_tokens", file_tokens).save(path)


def read_tokens(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    register(spark)
    return spark.read.format("token_store").schema(schema).load(path)


def tokens_at(positions: DataFrame, path: str, position_col: str = "position") -> DataFrame:
    """(position, token) for each row of positions, places in the whole store; null where the store has no such place. Each
    is read by its codes alone; positions are dealt by file and stretch, so a file in demand is read by many tasks."""
    files = _files(path)
    starts, ends = (np.array([f[0] + f[1] * i for f in files], np.int64) for i in (0, 1))  # a row of these per file

    def locate(batches):
        for batch in batches:
            at = batch.column("position").to_numpy(zero_copy_only=False).astype(np.float64) if batch.column("position").null_count else batch.column("position").to_numpy()
            file = np.searchsorted(starts, at, "right") - 1
            good = (file >= 0) & (at < ends[file]) if len(starts) else np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(np.where(good, file, -1).astype(np.int32))], names=["position", "file"])

    def read(batches):
        fs, _ = filesystem(path)
        opened, number = None, -1
        for batch in batches:
            tokens = []
            for at, file in zip(batch.column("position").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if file != number and file >= 0:
                    if opened is not None:
                        opened.source.close()
                    opened, number = TokenFile(fs.open_input_file(files[file][2])), file
                tokens.append(None if file < 0 else opened.token(at - files[file][0]))
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(tokens, pa.int64())], names=["position", "token"])

    rows = positions.select(F.col(position_col).cast("bigint").alias("position")).mapInArrow(locate, "position long, file int")
    salt = F.pmod(F.xxhash64("position"), F.lit(64))
    dealt = rows.repartition("file", F.when(F.col("file") < 0, salt).otherwise(F.shiftright("position", 20))).sortWithinPartitions("file", "position")
    return dealt.mapInArrow(read, "position long, token long")


def stored_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the ids of documents to a store and returns it read back."""
    spark = docs.sparkSession
    path = path or Steps(spark, "tokens").path("store")
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
