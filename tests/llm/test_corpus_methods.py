"""The methods against brute force, exact round trips and held-out accuracy; registered queries on the small tables."""

import gzip
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumaspark.llm import cotrain, debruijn, html_crf, packing, patricia, queries, raking, secret_scan, simhash, vptree, warc
from lumaspark.llm.tables import Steps
from tools.check_sql import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.execute(sql.replace("@", SMALL)).fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cur = db.execute(queries.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entropy_adds_spans_and_allows(spark):
    texts = ["x 4283FEFC63F0CD0E873A0000C6D07EF7B77E90D3 y", "élOU3shVv5UTG79BG16QmtsL4F28GzL2cEpVZzAQlxJ4SXRVx!", "123e4567-e89b-12d3-a456-426614174000",
             "/usr/local/lib/python/site-packages/foo12", 'password="fCQGgXkH1zxFUbEctT2NLLzPkkGoaXmI63JozGw8"', "ABABABABABABABABABABABABABABABAB0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in secret_scan.scan_secrets(df).select("doc_id", secret_scan.span_text(secret_scan.F.col("spans"))).collect()}
    assert got == {0: "entropy_hex:2:42", 1: "entropy_base64:1:49", 2: "", 3: "", 4: "assign:0:50", 5: ""}


def test_packed_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer()[0])
    texts = {i: t for i, t in rows("SELECT doc_id, text FROM '@/documents.parquet'")}
    texts |= {-1: "a  b <|endoftext|> c\n\n d  ", -2: " x 　 \t'll don't 123", -3: "z" * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = {}
    for r in packing.pack_documents(df, max_tokens=256).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256
    for i, t in texts.items():
        mine = sorted(pieces[i], key=lambda r: r["start"])
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == want
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and mine[0]["doc_tokens"] == len(want)


def test_quality_on_held_out_labels():
    got = duckdb.execute("""SELECT text, source, lang, n_chars, quality FROM '/root/testdata/sf0.01/documents.parquet'
                            JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)""").fetchall()
    pool = duckdb.execute("SELECT text, source, lang, n_chars, -1 FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id >= 1000 ORDER BY hash(doc_id) LIMIT 700").fetchall()
    fitted = got[:300] + pool
    model = cotrain.co_train([cotrain.content(r[0]) for r in fitted], np.stack([cotrain.metadata(*r[:4]) for r in fitted]), np.array([r[4] for r in fitted]))
    rest = got[300:]
    score = model.scores([cotrain.content(r[0]) for r in rest], np.stack([cotrain.metadata(*r[:4]) for r in rest]))[2]
    y = np.array([r[4] for r in rest])
    assert ((score >= cotrain.CUT) == (y == 1)).mean() > 0.9 and (score[y == 1] >= cotrain.CUT).mean() > 0.97


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, compression):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = Steps(spark, "test").path("archive")
    back = warc.archive_pages(pages, path, compression)
    html = {f"urn:page:{i}": h for i, h in rows("SELECT page_id, html FROM '@/pages.parquet'")}
    assert {r["record_id"]: bytes(r["payload"]).decode() for r in back.collect()} == html
    one = back.filter("record_id = 'urn:page:7' AND record_type = 'response'")
    assert "PushedFilters" not in one._jdf.queryExecution().executedPlan().toString() or one.count() == 1
    assert [r["payload_length"] for r in one.collect()] == [len(html["urn:page:7"].encode())]
    assert back.filter("record_type = 'revisit'").count() == 0


def test_pushed_filters_skip_blocks(tmp_path):
    import pyarrow as pa
    from pyspark.sql.datasource import EqualTo, GreaterThan

    plain = b"".join(warc.encode_record({"WARC-Type": "response", "WARC-Record-ID": str(i), "payload-length": 4}, b"abcd") for i in range(5))
    (tmp_path / "a.warc").write_bytes(plain)
    members = b"".join(gzip.compress(plain) if i == 2 else warc.gzip_member(plain) for i in range(1))
    assert gzip.decompress(members) == plain and zlib.decompressobj(31).decompress(members) == plain
    schema = pa.schema([("record_id", pa.string()), ("payload", pa.binary())])
    reader = warc.WarcReader(str(tmp_path), schema.names, schema)
    left = list(reader.pushFilters([EqualTo(("record_id",), "3"), GreaterThan(("offset",), 5)]))
    assert [type(f) for f in left] == [GreaterThan]
    got = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
    assert got == [{"record_id": "3", "payload": b"abcd"}]


def test_foreign_gzip_members(tmp_path):
    import pyarrow as pa

    records = [warc.encode_record({"WARC-Type": "response", "WARC-Record-ID": str(i), "payload-length": 200_000}, bytes([i]) * 200_000) for i in range(3)]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for names in (["record_id"], ["record_id", "payload_length"]):
        schema = pa.schema([(n, pa.string() if n == "record_id" else pa.int64()) for n in names])
        reader = warc.WarcReader(str(tmp_path), names, schema)
        got = [r for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()]
        assert [r["record_id"] for r in got] == ["0", "1", "2"] and all(r.get("payload_length", 200_000) == 200_000 for r in got)


def test_field_learns_pages():
    model = html_crf.train([])
    pages = [(labels, model.decode(html_crf.features(html_crf.blocks(page)))) for page, labels in html_crf.composed_pages(40, seed=77)]
    assert np.mean([a == b for want, got in pages for a, b in zip(want, got, strict=True)]) > 0.98
    text = html_crf.main_text(model, "<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p><b>One  two\nthree.<br><p>Four &eacute;.</article><footer>&copy; me</footer>")
    assert text == "A & B\nOne two three.\nFour é."


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(1)
    crf = html_crf.ChainField({"a": 0, "b": 1}, rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=2))
    names = [["a"], ["b"], ["a", "b"], []]
    unary = crf.unary(names)

    def score(y):
        return crf.first[y[0]] + sum(unary[i, v] for i, v in enumerate(y)) + sum(crf.pairs[a, b] for a, b in zip(y, y[1:], strict=False))

    every = [tuple(n >> i & 1 for i in range(4)) for n in range(16)]
    assert crf.decode(names) == list(max(every, key=score))
    value, *_ = crf.gradient(names, np.array([1, 0, 1, 1]))
    assert np.isclose(value, score((1, 0, 1, 1)) - np.log(sum(np.exp(score(y)) for y in every)))


def groups(prints, distance):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_groups_against_all_pairs(spark):
    texts = dict(rows("SELECT doc_id, text FROM '@/documents.parquet'"))
    base = "the quick brown fox jumps over a lazy dog near the old river bank while seven grey birds watch it from tall trees".split()
    for n in range(30):
        words = base * 8
        words[n * 5] = f"changed{n}"
        texts[1000 + n] = " ".join(words[: 150 + n % 3])
    prints = {i: (simhash.fingerprint(simhash.shingle_hashes(t.encode(), 4)) & (2**64 - 1),) for i, t in texts.items()}
    for distance, per_word in ((4, 3), (6, 2), (2, 5)):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df, distance=distance, per_word=per_word).collect()}
        assert got == groups(prints, distance)


def test_nearest_against_all(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    table = df.toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    for factor in (1.0, vptree.FACTOR):
        got = vptree.nearest(df, lambda i: i % 20 == 0, k=20, factor=factor, shard_rows=64).toPandas()  # hardly any structure
        found = total = 0
        for i in np.nonzero(ids % 20 == 0)[0]:
            scores = np.zeros(len(x))
            for j in range(x.shape[1]):
                scores += x[i, j] * x[:, j]
            want = [int(ids[k]) for k in np.lexsort((ids, -scores)) if k != i][:20]
            mine = got[got.query_id == ids[i]].sort_values("rank").vec_id.tolist()
            assert factor > 1 or mine == want
            found, total = found + len(set(mine) & set(want)), total + 20
        assert found / total >= 0.9


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_nearest_of_many_ties(spark, factor):
    rng = np.random.default_rng(4)
    rest = rng.normal(size=(399, 15))
    rest = np.round(rest / np.linalg.norm(rest, axis=1, keepdims=True), 6)
    rows = [(0, [1.0] + [0.0] * 15)] + [(i + 1, [0.5, *v.tolist()]) for i, v in enumerate(rest[rng.permutation(399)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vptree.nearest(df, lambda i: i == 0, k=40, factor=factor, shard_rows=64).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 0.5) for i in range(1, 41)]


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4_000)] + 0.25 * rng.normal(size=(4_000, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = vptree.nearest(df, lambda i: i % 20 == 0, k=20, shard_rows=128).toPandas().groupby("query_id").vec_id.apply(set)
    scores = x[::20] @ x.T
    hits = sum(len(got[i * 20] & set(np.argsort(-np.where(np.arange(4_000) == i * 20, -np.inf, s))[:20])) for i, s in enumerate(scores))
    assert hits / (200 * 20) >= 0.97


def test_owners_against_groups(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in patricia.duplicate_owners(spark.read.parquet(f"{SMALL}/documents.parquet"), keep="min").collect()}
    assert got == {i: (k, n) for i, k, n in rows("SELECT doc_id, min(doc_id) OVER (PARTITION BY text), count(*) OVER (PARTITION BY text) FROM '@/documents.parquet'")}


def test_trie_shares_prefixes():
    trie = patricia.PatriciaTrie(lambda a, b: a + b)
    for key in (b"romane", b"romanus", b"roman", b"romane", b"r", b"rubens", b"x"):
        trie.insert(key, 1)
    assert dict(trie.pop(ord("r"))) == {b"romane": 2, b"romanus": 1, b"roman": 1, b"r": 1, b"rubens": 1}
    assert dict(trie.pop_all()) == {b"x": 1}


def test_repeats_against_windows(spark):
    docs = rows("SELECT doc_id, text FROM '@/documents.parquet'")
    docs += [(5000, "x y " + " ".join(docs[0][1].split()[3:30]) + " z"), (5001, "k " * 60), (5002, "k " * 14)]
    first, want = {}, {}
    for i, t in sorted(docs):
        words = t.split()
        gone = set()
        for j in range(len(words) - 12):
            if first.setdefault(tuple(words[j:j + 13]), i) < i:
                gone.update(range(j, j + 13))
        want[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk, heavy in ((200, 2_000), (1 << 20, 6)):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in debruijn.remove_repeats(df, chunk_words=chunk, heavy_paths=heavy).collect()}
        assert got == want
    spans = debruijn.repeated_spans(df).collect()
    texts = {i: t.split() for i, t in docs}
    assert spans and all(texts[s["doc"]][s["start"]:s["start"] + s["n"]] == texts[s["owner"]][s["owner_start"]:s["owner_start"] + s["n"]] for s in spans)


def test_repeats_with_one_id_on_two_texts(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words)), (5, " ".join(["x", *words, "y"])), (5, " ".join(["p", "q", "r", *words[:30]])), (5, " ".join(["x", *words, "y"])), (7, " ".join(words[20:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = sorted([(1, 40, 0), (5, 42, 40), (5, 33, 30), (5, 42, 40), (7, 20, 20)])
    for chunk in (1 << 20, 60):
        for some in (df, df.repartition(4), df.orderBy(F.desc("doc_id")).coalesce(1)):
            assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.remove_repeats(some, chunk_words=chunk).collect()) == want
    later = spark.createDataFrame(docs[1:], "doc_id long, text string").coalesce(1).unionByName(df.filter("doc_id = 1"))  # the owner is in another chunk
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.remove_repeats(later).collect()) == want


def test_mixture_meets_its_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = raking.mix_documents(docs)
    rows = raking.margins(mixed).collect()
    assert len(rows) > 10 and all(abs(r["expected"] - r["target"]) <= 1e-6 * r["target"] for r in rows)
    top = mixed.filter("tokens > 0").agg(F.max("probability"), F.min("probability")).first()
    assert abs(top[0] - 1) < 1e-9 and top[1] > 0  # as much as needs no token twice
    twice = raking.mix_documents(docs, keep=0.9, repeats=True)
    assert all(abs(r["expected"] - r["target"]) <= 1e-6 * r["target"] for r in raking.margins(twice).collect())
    kept = twice.agg(F.sum(F.col("tokens") * F.col("copies")) / F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens"), F.max("copies")).first()
    assert abs(kept[1] - 0.9) < 1e-6 and abs(kept[0] - 0.9) < 0.1 and kept[2] >= 2
    given = {"lang": {"en": 0.5, "de": 0.3}}
    rows = raking.margins(raking.mix_documents(docs, targets=given), given).collect()
    assert {r["value"]: round(r["expected"], 6) for r in rows if r["dim"] == "lang" and r["value"] in ("en", "de")} == {"en": 0.5, "de": 0.3}
    again = raking.sample_mixture(docs, keep=0.9, repeats=True)
    assert again.columns == docs.columns and again.count() == twice.agg(F.sum("copies")).first()[0]


def test_contradicting_targets_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="missed"):
        _, off = raking.rake(cells, Steps(spark, "test"), {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert off > 0.5


def similar_groups(texts, width=5, least=0.8):
    """Components of all pairs whose multisets of word shingles have the least similarity."""
    bags = {}
    for i, t in texts.items():
        words = re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t))
        grams = [tuple(words)] if 0 < len(words) <= width else [tuple(words[j:j + width]) for j in range(len(words) - width + 1)]
        bags[i] = Counter(grams)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            small, large = sorted((bags[a].total(), bags[b].total()))
            if small < least * large:
                continue
            both = (bags[a] & bags[b]).total()
            if not large or both >= least * (small + large - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = dict(rows("SELECT doc_id, text FROM '@/documents.parquet'"))
    scores = {r["doc_id"]: r["score"] for r in cotrain.score_documents(docs, labels).collect()}
    good = sorted(i for i, s in scores.items() if s >= cotrain.CUT)
    single = sorted({texts[i]: i for i in reversed(good)}.values())
    near = sorted(set(similar_groups({i: texts[i] for i in single}).values()))
    steps, kept = Steps(spark, "test"), docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (good, single, near), strict=True):
        kept = steps.write(stage(spark, kept, SMALL), name)
        ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
        assert ids == want, name
    mixed = steps.write(corpus_pipeline.mixture(spark, kept, SMALL), "mixed")
    pieces = corpus_pipeline.pack(spark, mixed, SMALL).select("doc_id", "start", "length", "doc_tokens").collect()
    final = {r["doc_id"] for r in mixed.collect()}
    assert {r["doc_id"] for r in pieces} == final <= set(ids) and sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
