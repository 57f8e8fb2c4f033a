"""Runs, alignment and token files against brute force and round trips, and on edge cases."""

import bisect
import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import pytest

from lumaspark.llm import packing, periodic_runs, queries, token_alignment, token_store
from lumaspark.llm.tables import Steps

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, block long, start long, token long, row long, collapsed string"
EDGES = [None, "", "▁a b", "a  b\n\nc \n d<|endoftext|> <s> ﬁ é\t\u0000", "  ", "\n", " " * 70_000 + "x", "a\n  b　　c \x1c d\x1c\xa0 e! \n\n! \t x y",
         "\n\n  x", "if (x);\r\n  {\r} y;\r z", "z" * 20_000, "a b " * 5_000]


def texts():
    return duckdb.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [*enumerate(EDGES), (0, "a b c"), (None, "x y"), (None, None), (3, "x y"), (3, "x y")]
    return spark.createDataFrame([(d, t, "r", 1, 2, 3, 4, None) for d, t in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- runs

def all_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            s = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s - q, i), q)
            i += i == s
    return sorted((a, b - a, q) for (a, b), q in found.items())


def planted(seed):
    rng = random.Random(seed)
    n, letters = rng.choice([5, 14, 30, 60, 120, 300, 700]), rng.choice([1, 2, 2, 3, 5, 40])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
        for i in range(a + p, min(n, a + rng.randrange(2 * p, 6 * p + 1))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(120))
def test_runs_against_all_periods(seed):
    words = planted(seed)
    want = all_runs(words)
    for piece in (None, 1 + seed % 50, 1 if len(words) < 100 else 300):  # appended at once, in pieces, word by word
        assert periodic_runs.runs_of(words, piece=piece) == want


def test_runs_inside_runs():
    words = ([b"a"] * 180 + [b"b"]) * 5 + [b"a"] * 400 + [b"c"] + [b"a"] * 390
    assert periodic_runs.runs_of(words) == all_runs(words)
    assert periodic_runs.runs_of([b"a"] * 200_000 + [b"b"] + [b"a"] * 150_000) == [(0, 200_000, 1), (200_001, 150_000, 1)]


def test_run_query_against_all_periods(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    docs = texts()
    assert len(got) == len(docs)
    for doc, text in docs:
        words = text.encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        if n > 2_500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[doc] == (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_edges(edges):
    rows = periodic_runs.find_runs(edges, batch_words=10).collect()
    assert len(rows) == edges.count()
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[11, 10_000]["runs"] == [(0, 10_000, 2)] and by[11, 10_000]["collapsed"] == "a b" and by[0, 0]["runs"] == [] and by[None, 2]["collapsed"] == "x y"
    assert periodic_runs.find_runs(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- alignment

def aligned(docs):
    """The contract word by word."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in kept} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in kept)}
    counts, links, out = Counter(), [], []
    for _, text in docs:
        text = text or ""
        mine = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = f" {text}".encode()
        if not text or any(b"".join(w for _, w in side) != whole for side in (mine, other)):
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [list(accumulate(len(w) for _, w in side)) for side in (mine, other)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for side, (tokens, places) in enumerate(zip((mine, other), ends, strict=True)):
            for (i, _), e in zip(tokens, places, strict=True):
                groups[bisect.bisect_left(both, e)][side].append(str(i))
        at = dict(zip(ends[1], (i for i, _ in other), strict=True))
        links.append([(i, at[e]) for (i, _), e in zip(mine, ends[0], strict=True) if e in at])
        counts.update(links[-1])
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        out.append((len(mine), len(other), len(both), len(links[-1]), hashlib.sha256(text.encode()).hexdigest()))
    most = Counter()
    for (_, i), n in counts.items():
        most[i] = max(most[i], n)
    return [(d, *o[:4], sum(counts[x] == most[x[1]] for x in some), sum(counts[x] for x in some), o[4]) for (d, _), o, some in zip(docs, out, links, strict=True)]


def key(row):
    return tuple((v is not None, v) for v in row)


def test_alignment_against_contract(spark, edges):
    for df, docs in ((spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3), texts()), (edges, [(r["doc_id"], r["text"]) for r in edges.collect()])):
        want = sorted(aligned(docs), key=key)
        for size in (3_000, token_alignment.BLOCK_BYTES):
            assert sorted((tuple(r) for r in token_alignment.aligned_documents(df, block_bytes=size).collect()), key=key) == want
    assert token_alignment.aligned_documents(edges.limit(0)).count() == 0


def test_alignment_forgets_stretches(spark, monkeypatch):
    docs = texts()[:40]
    aligner = token_alignment.Aligner(*token_alignment.default_tokenizers())
    whole = [token_alignment._block(aligner, docs, 0).to_pydict()["docs"][0]]
    monkeypatch.setattr(token_alignment, "KNOWN_STRETCHES", 100)
    for _ in range(3):
        whole += [token_alignment._block(aligner, docs, 0).to_pydict()["docs"][0]]
        assert len(aligner.known) <= 50
    assert all(w == whole[0] for w in whole)


def test_jumps_reach_the_last_token():
    a, b = np.array([2, 5, 6, 9, 14]), np.array([1, 3, 5, 8, 13, 14])
    assert token_alignment.terminals(a, b).tolist() == [1, 1, 4, 4, 4, 1, 1, 1, 4, 4, 4]
    a, b = np.arange(2, 20_001, 2), np.append(np.arange(1, 20_001, 2), 20_000)  # one chain
    assert set(token_alignment.terminals(a, b).tolist()) == {9_999}


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 20, 1 << 32])
def test_codes_round_trip(tmp_path, top):
    from pyarrow import fs

    rng = np.random.default_rng(top)
    ids = np.minimum(rng.geometric(1 / 900, 5_000) - 1 + (rng.random(5_000) < 0.1) * rng.integers(0, top, 5_000), top - 1).astype(np.uint32)
    (tmp_path / "x").write_bytes(b"".join(token_store.encode_file([5, None, 7], [0, 1_000, 4_000], ids)))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        file = token_store.TokenFile(source)
        assert np.array_equal(file.range(0, 5_000), ids)
        assert [file.token(i) for i in range(0, 5_000, 7)] == ids[::7].tolist()
        for first, past in ((0, 0), (511, 513), (4_999, 5_000), (1_023, 3_001)):
            assert np.array_equal(file.range(first, past), ids[first:past])
        docs, null, places = file.directory()
        assert docs.tolist() == [5, 0, 7] and null.tolist() == [False, True, False] and places.tolist() == [0, 0, 1_000, 5_000]


def test_reads_of_a_token_are_few(tmp_path):
    from pyarrow import fs

    class Counted:
        def __init__(self, source):
            self.source, self.size, self.n = source, source.size, 0

        def read_at(self, size, at):
            self.n += size
            return self.source.read_at(size, at)

    ids = np.random.default_rng(3).integers(0, 50_000, 200_000)
    (tmp_path / "x").write_bytes(b"".join(token_store.encode_file([1], [len(ids)], ids)))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        counted = Counted(source)
        file = token_store.TokenFile(counted)
        counted.n = 0
        assert file.token(123_457) == ids[123_457] and counted.n < 100 * len(file.levels)


def test_widths_are_the_best():
    lengths = np.zeros(33, np.int64)
    lengths[[1, 8, 9, 16]] = [50, 900, 100, 20]

    def size(widths):
        p = total = 0
        for w in widths:
            n = int(lengths[p + 1:].sum()) if p else int(lengths.sum())
            total, p = total + n * (w + (p + w < 16) * (1 + 64 / token_store.GROUP)), p + w
        return total

    def splits(n):
        return [[]] if n == 0 else [[w, *rest] for w in range(1, n + 1) for rest in splits(n - w)]

    assert size(token_store.best_widths(lengths)) == min(map(size, splits(16)))


def test_store_against_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer()[0])
    docs = [*texts(), (-1, "a  b <|endoftext|> c"), (-2, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    path = Steps(spark, "test").path("store")
    got = {r["doc_id"]: r for r in token_store.stored_documents(df, path, file_tokens=20_000).collect()}
    place, flat = 0, []
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc]["start"] == place and got[doc]["n_tokens"] == len(ids) and np.frombuffer(got[doc]["ids"], "<u4").tolist() == ids
        place, flat = place + len(ids), flat + ids
    assert len(token_store._files(path)) > 5
    asked = [0, 5, 5, place - 1, place, -1, None, *range(100, place, 9_999)]
    df = spark.createDataFrame([(p, 1) for p in asked], "position long, token long")
    assert sorted(map(tuple, token_store.tokens_at(df, path).collect()), key=key) == sorted(((p, flat[p] if p is not None and 0 <= p < place else None) for p in asked), key=key)
    back = token_store.read_tokens(spark, path)
    some = back.filter("doc_id IN (3, 150) OR doc_id = 7")
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 7, 150]
    one = back.filter("doc_id >= 20 AND doc_id < 23").select("start", "doc_id").collect()
    assert sorted(r["doc_id"] for r in one) == [20, 21, 22] and all(got[r["doc_id"]]["start"] == r["start"] for r in one)


def test_store_query(spark):
    rows = queries.QUERIES["op13_token_store"](spark, SMALL).orderBy("doc_id").collect()
    ids = packing._ids(*packing.default_tokenizer())
    place = 0
    for (doc, text), r in zip(texts(), rows, strict=True):
        data = ids(text) + b"\2\0\0\0"
        assert tuple(r) == (doc, place, len(data) // 4, zlib.crc32(data))
        place += len(data) // 4


def test_store_edges(spark, edges):
    rows = token_store.stored_documents(edges).orderBy("start").collect()
    assert len(rows) == edges.count() and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in edges.collect()), key=lambda d: (d is not None, d))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert min(r["n_tokens"] for r in rows) == 1
    assert token_store.stored_documents(edges.limit(0)).count() == 0
    path = Steps(spark, "test").path("twice")
    for _ in range(2):
        token_store.write_tokens(edges, path)
    assert token_store.read_tokens(spark, path).count() == 2 * edges.count()
