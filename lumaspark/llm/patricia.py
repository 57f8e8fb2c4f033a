"""Exact duplicates: compressed radix tries over length-and-content-hash partitions.

Each task first inserts its own rows into a trie and sends one row per different text, so a
text held by a third of all rows leaves a task once. Those rows are dealt by content hash and
length, sorted by them inside a partition, and their whole byte strings are inserted into a
trie again; a subtree (one hash and length) is written out as soon as the sort has passed it,
so a task holds the strings of one subtree at a time. Terminal nodes store the owner's id.

Null texts count as empty. Null ids never own a group unless all its ids are null. Rows that
repeat an id with the same text are members of one group. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import small_batches, text_of

TRIE_BYTES = 64 << 20  # a task's first trie gives up its largest subtrees beyond this


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with a value each; equal strings combine their values."""

    def __init__(self, combine):
        self.root, self.combine = _Node(b""), combine
        self.sizes: dict[int, int] = {}  # bytes below each child of the root

    def insert(self, key: bytes, value) -> None:
        node, pos, n = self.root, 0, len(key)
        while True:
            child = node.children.get(key[pos]) if pos < n else None
            if pos == n:
                node.value = value if node.value is None else self.combine(node.value, value)
                return
            if child is None:
                node.children[key[pos]] = _Node(key[pos:], value)
                self.sizes[key[0]] = self.sizes.get(key[0], 0) + n - pos + 200
                return
            if key.startswith(child.label, pos):
                node, pos = child, pos + len(child.label)
                continue
            cut = _common(key[pos:pos + len(child.label)], child.label)
            middle = _Node(child.label[:cut])
            child.label = child.label[cut:]
            middle.children[child.label[0]] = child
            node.children[key[pos]] = middle
            node, pos = middle, pos + cut

    def bytes(self) -> int:
        return sum(self.sizes.values())

    def pop(self, first: int) -> Iterator[tuple[bytes, object]]:
        """Takes out the subtree below one child of the root: its strings with their values."""
        self.sizes.pop(first, None)
        stack = [(b"", self.root.children.pop(first))]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            stack.extend((key, c) for c in node.children.values())

    def pop_all(self) -> Iterator[tuple[bytes, object]]:
        for first in list(self.root.children):
            yield from self.pop(first)

    def largest(self) -> int:
        return max(self.sizes, key=self.sizes.get)


def _merge(keep: str):
    """Values are (owner id, rows, rows with the owner's id); an owner of None gives way to any id."""
    better = max if keep == "max" else min

    def combine(a, b):
        if a[0] == b[0]:
            return a[0], a[1] + b[1], a[2] + b[2]
        known = [x for x in (a, b) if x[0] is not None]
        best = better(known, key=lambda x: x[0])
        return best[0], a[1] + b[1], best[2]

    return combine


_HEAD = ">qq"  # content hash, length: the partition of a string is a prefix of its key
_HEAD_SIZE = struct.calcsize(_HEAD)
_LOCAL = pa.schema([("h", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()),
                    ("rows", pa.int64()), ("owner_rows", pa.int64())])
_OWNERS = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()),
                     ("group_size", pa.int64()), ("owner_rows", pa.int64())])


def _combine_rows(keep: str, limit: int):
    def run(batches):
        trie = PatriciaTrie(_merge(keep))

        def out(items):
            rows = []
            for key, (owner, n, own) in items:
                h, size = struct.unpack_from(_HEAD, key)
                rows.append((h, size, key[_HEAD_SIZE:], owner, n, own))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 6, _LOCAL, strict=True)], schema=_LOCAL)

        for batch in batches:
            for h, body, i in zip(*(batch.column(c).to_pylist() for c in ("h", "body", "id")), strict=True):
                trie.insert(struct.pack(_HEAD, h, len(body)) + body, (i, 1, 1))
            while trie.bytes() > limit:
                yield out(trie.pop(trie.largest()))
        for first in list(trie.root.children):
            yield out(trie.pop(first))

    return run


def _owner_rows(keep: str):
    def run(batches):
        trie, at, done = PatriciaTrie(_merge(keep)), None, []

        def flush():
            for key, (owner, n, own) in trie.pop_all():
                if n > 1:
                    body = key[_HEAD_SIZE:]
                    done.append((len(body), hashlib.sha256(body).hexdigest(), owner, n, own))

        def out():
            rows = list(zip(*done, strict=True)) if done else [[]] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _OWNERS, strict=True)], schema=_OWNERS)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in _LOCAL.names)
            for h, size, body, owner, n, own in zip(*columns, strict=True):
                if at != (h, size):
                    flush()
                    at = (h, size)
                trie.insert(struct.pack(_HEAD, h, size) + body, (owner, n, own))
            yield out()
        flush()
        yield out()

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                     trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Groups of two rows and more with one text: n_bytes, sha (SHA-256, hex), keep_id, group_size and
    owner_rows, the rows that carry the owner's id. `keep` says which id owns a group: "min" or "max"."""
    small_batches(docs.sparkSession)
    body = F.encode(text_of(text_col), "utf-8")
    rows = docs.select(F.xxhash64(body).alias("h"), body.alias("body"), F.col(id_col).cast("bigint").alias("id"))
    local = rows.mapInArrow(_combine_rows(keep, trie_bytes), "h long, n_bytes long, body binary, owner long, rows long, owner_rows long")
    dealt = local.repartition("h", "n_bytes").sortWithinPartitions("h", "n_bytes")
    return dealt.mapInArrow(_owner_rows(keep), "n_bytes long, sha string, keep_id long, group_size long, owner_rows long")


def _with_owner(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """Rows of docs under positional names, beside their group; extra columns may have any names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    body = F.encode(text_of(text_col), "utf-8")
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                        F.col(id_col).cast("bigint").alias("__id"), F.octet_length(body).cast("bigint").alias("n_bytes"),
                        F.sha2(body, 256).alias("sha"))
    return keyed.join(groups, ["n_bytes", "sha"], "left"), names


def duplicate_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Two texts are one when all their
    bytes are (the tries compare them); rows meet their group by length and SHA-256."""
    rows, _ = _with_owner(docs.select(id_col, text_col), duplicate_groups(docs, id_col, text_col, keep), id_col, text_col)
    alone = F.col("group_size").isNull()
    return rows.select(
        F.col("__id").alias("doc_id"), F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _kept_rows(keep: str, limit: int | None):
    """Rows of (h, n_bytes, body, id, rest), one for each text. Without a limit rows come sorted by h and n_bytes."""
    better = max if keep == "max" else min

    def owner(a, b):
        if a[0] is None or b[0] is None or a[0] == b[0]:
            return b if a[0] is None else a
        return better((a, b), key=lambda x: x[0])

    def run(batches):
        trie, at, schema = PatriciaTrie(owner), None, None

        def out(items):
            rows = [(*struct.unpack_from(_HEAD, key), key[_HEAD_SIZE:], *value) for key, value in items]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)

        for batch in batches:
            schema, done = batch.schema, []
            for h, _, body, i, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if limit is None and at != (h, len(body)):
                    done += trie.pop_all()
                    at = h, len(body)
                trie.insert(struct.pack(_HEAD, h, len(body)) + body, (i, rest))
            while limit is not None and trie.bytes() > limit:
                done += trie.pop(trie.largest())
            yield out(done)
        for first in list(trie.root.children):
            yield out(trie.pop(first))

    return run


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                          trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """docs with one row of each text, the owner's; of rows that repeat the owner's id, one. The tries carry the owner's
    other columns, so the rows that stay leave them as they are and nothing is joined."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = (names[docs.columns.index(c)] for c in (text_col, id_col))
    rows = docs.toDF(*names)
    kind = rows.schema[text].dataType
    body = F.encode(text_of(text), "utf-8")
    rows = rows.select(F.xxhash64(body).alias("h"), F.octet_length(body).cast("bigint").alias("n_bytes"), body.alias("body"), F.col(key).cast("bigint").alias("id"),
                       F.struct(*(c for c in names if c != text), F.col(text).isNull().alias("no_text")).alias("rest"))
    local = rows.mapInArrow(_kept_rows(keep, trie_bytes), rows.schema)
    kept = local.repartition("h", "n_bytes").sortWithinPartitions("h", "n_bytes").mapInArrow(_kept_rows(keep, None), rows.schema)
    back = F.when(~F.col("rest.no_text"), F.decode("body", "utf-8")).cast(kind)
    return kept.select(*(back if c == text else F.col(f"rest.{c}") for c in names)).toDF(*docs.columns)
