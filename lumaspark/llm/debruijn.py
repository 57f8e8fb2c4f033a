"""Repeated passages by a De Bruijn graph of tokens.

Windows of k words are the edges of the graph. Each task breaks its documents into short paths:
consecutive windows that share a minimizer (the five words among theirs that hash lowest, long
ones first) make one path, and only the path is shuffled, by its minimizer, so equal windows
meet whatever document they come from. Minimizers of very many paths, such as those of a line that
most documents hold, are counted first; their paths are cut into single windows that are dealt by
themselves, so no key gathers a large share of the rows. A path that several documents of one task hold leaves
it once, for the smallest id; the others know there that they repeat it. Where paths meet, every
window gets its first document and its place there. Windows that an earlier document holds go
on as pieces of path with both coordinates. Pieces that follow each other in the document and,
at the same distance, in the source compact into one span by joins on (document, source,
distance): a span's coordinates agree from end to end, or it is two spans.

A window is told by 48 bits of a hash of its words beside the 64 bits of its minimizer's: of two different windows with one
minimizer, one pair in 2.8e14 counts as equal. Words are runs of anything but the six ASCII
blanks; a window lies within one document. Null texts have no words. Rows of null id repeat
nothing and own nothing. Rows that share an id are one owner: they do not repeat each other.
An empty table gives an empty result. Very long texts are read in overlapping parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.llm.tables import Steps, small_batches, text_of

WINDOW = 13
MINIMIZER = 5
CHUNK_WORDS = 1 << 20  # words that a task looks at together
KNOWN_WORDS = 1 << 20  # hashes of words a task remembers
COMMON_BYTES = 20  # minimizers of fewer bytes come last: they are made of common words and would gather unrelated paths
HEAVY_SHARE = 100_000  # a minimizer of more than this part of all paths is heavy, so there are fewer heavy ones than this
HEAVY_PATHS = 2_000  # and it has more paths than this
WIDTH = 6  # bytes of a window's own hash, beside the 64 bits of its minimizer's

_U = np.uint64
_ODD = [_U(xxhash.xxh64_intdigest(f"factor {i}") | 1) for i in range(64)]
_FLOW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("more", pa.binary()), ("edges", pa.binary()),
                   ("owner", pa.int64()), ("owner_start", pa.int64()), ("n", pa.int32())])
_FLOW_SQL = "key long, doc long, text long, start long, more binary, edges binary, owner long, owner_start long, n int"
_PIECE = pa.schema([("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("owner", pa.int64()), ("owner_start", pa.int64())])
_PIECE_SQL = "doc long, text long, start long, n int, owner long, owner_start long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


class WordHashes:
    """64-bit hashes of words; those seen lately are remembered."""

    def __init__(self, limit: int = KNOWN_WORDS):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), _U, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), _U, len(words))


def _sums(hashes: np.ndarray, width: int, offset: int) -> np.ndarray:
    """A hash of each run of `width` items."""
    n = len(hashes) - width + 1
    total = np.zeros(max(0, n), _U)
    for j in range(width if n > 0 else 0):
        total += _mix(hashes[j:j + n] ^ _ODD[offset + j]) * _ODD[offset + j]
    return _mix(total)


def paths(hashes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple:
    """Short paths of the parts that end at `ends`: (key, first window, windows)."""
    n, none = len(hashes) - k + 1, (np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))
    if n <= 0:
        return none
    grams = _sums(hashes, m, 0)
    total = np.concatenate(([0], np.cumsum(sizes)))
    short = (total[m:] - total[:-m]) < COMMON_BYTES
    rank = (grams >> _U(1)) | (short.astype(_U) << _U(63))
    best, place = rank[:n].copy(), np.arange(n)
    for j in range(1, k - m + 1):
        other = rank[j:j + n]
        less = other < best
        best, place = np.where(less, other, best), np.where(less, np.arange(n) + j, place)
    part = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + k <= ends[np.minimum(part, len(ends) - 1)]
    at = np.nonzero(inside)[0]
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]])
    first = np.nonzero(new)[0]
    length = np.diff(np.append(first, len(at)))
    return _mix(grams[place[at[first]]]), at[first], length


def cut_heavy(key: np.ndarray, first: np.ndarray, length: np.ndarray, edge: np.ndarray, heavy: np.ndarray) -> tuple:
    """Paths with those of heavy keys cut into windows under keys of their own."""
    big = np.isin(key, heavy)
    if not big.any():
        return key, first, length
    n = length[big]
    at = np.repeat(first[big] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    alone = _mix(np.repeat(key[big], n) ^ edge[at])
    return np.concatenate([key[~big], alone]), np.concatenate([first[~big], at]), np.concatenate([length[~big], np.ones(len(at), np.int64)])


class _Chunk:
    """Parts of documents of about CHUNK_WORDS words."""

    def __init__(self):
        self.hashes, self.sizes, self.docs, self.texts, self.bases, self.lengths = [], [], [], [], [], []
        self.n = 0

    def add(self, doc: int, text: int, base: int, hashes: np.ndarray, sizes: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.sizes.append(sizes)
        self.docs.append(doc)
        self.texts.append(text)
        self.bases.append(base)
        self.lengths.append(len(hashes))
        self.n += len(hashes)

    def counts(self, k: int, m: int) -> pa.RecordBatch:
        """Minimizers of several paths in this chunk with the number of their paths; that of all paths has no key."""
        key, _, _ = paths(np.concatenate(self.hashes), np.concatenate(self.sizes), np.cumsum(self.lengths), k, m)
        keys, n = np.unique(key, return_counts=True)
        some = n >= 4
        return pa.RecordBatch.from_arrays([pa.array([None, *keys[some].view(np.int64).tolist()], pa.int64()),
                                           pa.array([len(key), *n[some].tolist()], pa.int64())], names=["key", "n"])

    def flow(self, k: int, m: int, heavy: np.ndarray) -> pa.RecordBatch:
        """Paths to shuffle, and pieces that repeat a path of a smaller id in the same chunk."""
        ends, hashes = np.cumsum(self.lengths), np.concatenate(self.hashes)
        edge = _sums(hashes, k, 16)
        key, first, length = cut_heavy(*paths(hashes, np.concatenate(self.sizes), ends, k, m), edge, heavy)
        part = np.searchsorted(ends, first, side="right")
        docs, texts = np.asarray(self.docs)[part], np.asarray(self.texts)[part]
        start = first - (ends - self.lengths)[part] + np.asarray(self.bases)[part]
        offsets = np.concatenate(([0], np.cumsum(length)))
        index = np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])
        edges = edge[index]
        salted = edges * np.asarray(_ODD, _U)[16 + np.arange(len(index)) - np.repeat(offsets[:-1], length)] if len(index) else edges
        whole = np.add.reduceat(salted, offsets[:-1]) ^ key if len(key) else key
        order = np.lexsort((start, texts, docs, whole))
        fresh = np.ones(len(order), bool)
        fresh[1:] = whole[order[1:]] != whole[order[:-1]]
        source = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]  # the path's first document in the chunk
        own = docs[source] == docs[order]
        fresh[1:] |= own[1:] & (texts[order[1:]] != texts[order[:-1]])  # another text of that id sends the path too
        sent, told, owner = order[fresh], order[~own], source[~own]
        line = np.argsort(sent, kind="stable")  # paths of one document next to each other: what they share is compressed in the shuffle
        again = own & ~fresh  # further places in that document travel with the first
        places = np.bincount(np.cumsum(fresh)[again] - 1, minlength=len(sent)) if len(sent) else np.empty(0, np.int64)
        more = pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer((np.concatenate(([0], np.cumsum(places))) * 8).astype(np.int32).tobytes()),
                                                              pa.py_buffer(start[order[again]].astype("<i8").tobytes())]).take(pa.array(line))
        sent = sent[line]
        data = np.ascontiguousarray(edges.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()
        binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((offsets * WIDTH).astype(np.int32).tobytes()), pa.py_buffer(data)])
        none, last = pa.nulls(len(sent), pa.int64()), pa.nulls(len(told), pa.binary())
        columns = [
            (key.view(np.int64)[sent], _mix(whole[told] ^ _mix(start[told].astype(_U)) ^ docs[told].astype(_U)).view(np.int64)), (docs[sent], docs[told]), (texts[sent], texts[told]), (start[sent], start[told]),
            (more, last), (binary.take(pa.array(sent)), last), (none, docs[owner]), (none, start[owner]), (length[sent].astype(np.int32), length[told].astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays([
            pa.chunked_array([pa.array(a, f.type), pa.array(b, f.type)]).combine_chunks() for (a, b), f in zip(columns, _FLOW, strict=True)], schema=_FLOW)


def _chunks(k: int, chunk_words: int, use):
    """Batches of rows as batches made from each chunk."""
    def run(batches):
        hashes_of, chunk = WordHashes(), _Chunk()
        for batch in batches:
            for doc, text, body in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = body.split()
                for base in range(0, max(1, len(words) - k + 1), chunk_words):
                    some = words[base:base + chunk_words + k - 1]
                    if len(some) < k:
                        continue
                    chunk.add(doc, text, base, hashes_of(some), np.fromiter(map(len, some), np.int64, len(some)))
                    if chunk.n >= chunk_words:
                        yield use(chunk)
                        chunk = _Chunk()
        if chunk.n:
            yield use(chunk)

    return run


def _first_places(table: pa.Table) -> pa.RecordBatch:
    """Pieces of the paths of whole keys that an earlier document holds."""
    told = table.filter(pa.compute.is_null(table["edges"]))
    table = table.filter(pa.compute.is_valid(table["edges"])).combine_chunks()
    out = [told.select(_PIECE.names)]
    if len(table):
        n = table["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(table)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        binary = table["edges"].combine_chunks()
        binary = binary.chunk(0) if isinstance(binary, pa.ChunkedArray) else binary
        data = np.frombuffer(b"".join(binary.to_pylist()), np.uint8).reshape(-1, WIDTH)
        edge = np.zeros((len(data), 8), np.uint8)
        edge[:, :WIDTH] = data
        edge = edge.view("<u8")[:, 0]
        key, doc, text, start = (table[c].to_numpy() for c in ("key", "doc", "text", "start"))
        place = start[row] + step
        order = np.lexsort((place, doc[row], edge, key[row]))
        k, e = key[row][order], edge[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        source = np.empty(len(order), np.int64)
        source[order] = lead
        owner, owner_place = doc[row][source], place[source]
        hit = np.nonzero(owner < doc[row])[0]
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]) | (owner[hit[1:]] != owner[hit[:-1]]) | (np.diff(owner_place[hit]) != 1)
            at = np.nonzero(new)[0]
            first, length = hit[at], np.diff(np.append(at, len(hit)))
            columns = [doc[row][first], text[row][first], place[first], length.astype(np.int32), owner[first], owner_place[first]]
            out.append(pa.table(columns, schema=_PIECE))
            more = [np.frombuffer(x or b"", "<i8") for x in table["more"].take(pa.array(row[first])).to_pylist()]
            times = np.array([len(x) for x in more])
            if times.sum():
                columns = [np.repeat(c, times) for c in columns]
                columns[2] = columns[2] + np.concatenate(more) - np.repeat(start[row[first]], times)
                out.append(pa.table(columns, schema=_PIECE))
    return pa.concat_tables(out).combine_chunks().to_batches()


def _meet(rows: int = 100_000):
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]).cast(_FLOW)
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) < rows:
                continue
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on in the next batch
            if cut:
                yield from _first_places(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from _first_places(held)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMIZER,
                   chunk_words: int = CHUNK_WORDS, heavy_paths: int = HEAVY_PATHS) -> DataFrame:
    """(doc, text, start, n, owner, owner_start): n words from word `start` on that stand in the document `owner`, the smallest id
    that holds their first window, from owner_start on. `text` is the XXH64 of the text for rows that share an id, else 0. Every
    window that an earlier document holds lies in a span. k is at most 32."""
    return _spans(_bodies(docs, id_col, text_col), k, m, chunk_words, heavy_paths)


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, body): `text` is the XXH64 of the text where other rows share the id, else 0, which takes no room in a shuffle."""
    steps = Steps(docs.sparkSession, "debruijn-ids")
    ids = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc")).count()
    shared = steps.write(ids.filter("count > 1").select("doc", F.lit(True).alias("shared")), "shared")  # mostly none, and a join without a shuffle
    body = F.encode(text_of(text_col), "utf-8")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), body.alias("body")).join(shared, "doc", "left")
    return rows.select("doc", F.when(F.col("shared"), F.xxhash64("body")).otherwise(F.lit(0).cast("bigint")).alias("text"), "body")


def _spans(rows: DataFrame, k: int, m: int = MINIMIZER, chunk_words: int = CHUNK_WORDS, heavy_paths: int = HEAVY_PATHS) -> DataFrame:
    small_batches(rows.sparkSession)
    steps = Steps(rows.sparkSession, "debruijn-counts")
    rows = rows.filter("doc IS NOT NULL")
    counts = rows.mapInArrow(_chunks(k, chunk_words, lambda c: c.counts(k, m)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = steps.write(counts, "counts")
    every = counts.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter(F.col("key").isNotNull() & (F.col("n") > max(heavy_paths, every // HEAVY_SHARE))).select("key")
    heavy = np.array([r["key"] for r in heavy.collect()], np.int64).view(_U)  # fewer than HEAVY_SHARE
    flow = rows.mapInArrow(_chunks(k, chunk_words, lambda c: c.flow(k, m, heavy)), _FLOW_SQL)
    pieces = flow.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(), _PIECE_SQL)
    pieces = pieces.withColumn("distance", F.col("start") - F.col("owner_start"))
    path = Window.partitionBy("doc", "text", "owner", "distance").orderBy("start")
    breaks = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("n")).over(path), F.lit(True))
    run = pieces.withColumn("fresh", breaks.cast("int")).withColumn("run", F.sum("fresh").over(path))
    spans = run.groupBy("doc", "text", "owner", "distance", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return spans.select("doc", "text", "start", (F.col("end") - F.col("start") + k - 1).alias("n"), "owner", (F.col("start") - F.col("distance")).alias("owner_start"))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n in spans:
        edge[start] += 1
        edge[start + n] -= 1
    return [w for w, depth in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not depth]


def _cut_out(batches):
    for batch in batches:
        rows = []
        for doc, body, spans in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = body.split()
            kept = kept_words(words, [(s["start"], s["n"]) for s in spans or []])
            text = b" ".join(kept)
            rows.append((doc, len(words), len(words) - len(kept), text.decode(), hashlib.sha256(text).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (
            pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (words joined by single spaces) and kept_sha256."""
    steps = Steps(docs.sparkSession, "debruijn")
    rows = _bodies(docs, id_col, text_col)
    spans = _spans(rows, k, **options)
    spans = steps.write(spans.groupBy("doc", "text").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")  # of one document each
    return rows.join(spans, ["doc", "text"], "left").select("doc", "body", "spans").mapInArrow(
        _cut_out, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
