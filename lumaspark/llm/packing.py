"""Packing by powers of two: a document's tokens are cut into pieces of binary lengths.

A document of n tokens gives n // max_tokens full pieces, then one piece for each set bit of
the rest, longest first. Pieces of one length share a bucket and every piece is a sequence of
its own, so no sequence crosses documents and none needs padding: all lengths are powers of
two. One pass over the texts, no shuffle.

Ids are those of a tokenizer file; see TokenIds.

Null texts are empty: one piece with the end id. Repeated ids are packed like any other.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumaspark.llm.tables import small_batches, text_of

MAX_TOKENS = 2048
END_ID = 1
LONG_BLANK = 50_000
_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SPARK_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer file, and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer file defines them. A byte-level BPE's merges are its vocabulary in rank order, so the same ids
    come several times faster from the vocabulary as ranks. Texts that hold a special token go to the tokenizer, and so
    do those with a very long run of white space, on which the pattern of the ranks would exhaust its stack.
    With `plain`, the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, ranks_path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._load, self._tokenizer = lambda: Tokenizer.from_file(path), None
        self.plain = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks

    @property
    def tokenizer(self):
        """The tokenizer itself, loaded when it is needed."""
        if self._tokenizer is None:
            self._tokenizer = self._load()
            self._tokenizer.encode_special_tokens = self.plain
        return self._tokenizer

    def listed(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or (len(text) > LONG_BLANK and _BLANK.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        return np.asarray(self.listed(text), dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def _ids(path: str, ranks_path: str, plain: bool = False) -> TokenIds:
    return TokenIds(path, ranks_path, plain)


def binary_lengths(n: int, top: int = MAX_TOKENS) -> list[int]:
    """Full pieces, then the set bits of the rest from the highest."""
    rest = n % top
    return [top] * (n // top) + [1 << b for b in range(top.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pack(paths: tuple[str, str], top: int, end: int):
    tail = np.asarray([end], dtype="<u4").tobytes()

    def run(batches):
        ids, serial = _ids(*paths), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = ids(text) + tail
                n, start = len(data) // 4, 0
                for length in binary_lengths(n, top):
                    rows.append((doc, start, length, data[4 * start:4 * (start + length)], n, length.bit_length() - 1, serial, 0))
                    start, serial = start + length, serial + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None,
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (its
    length is 2 to this), sequence_id and offset in that sequence. `max_tokens` is a power of two; the tokenizer
    files must be at the same paths on every executor. Write the rows with partitionBy("bucket") to store buckets."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    small_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_pack(tokenizer or default_tokenizer(), max_tokens, end_id), SPARK_SCHEMA)
