"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumaspark.llm import cotrain, debruijn, html_crf, packing, patricia, raking, secret_scan, simhash, vptree, warc
from lumaspark.llm.tables import Steps

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sha string, node long, c0 string"
LONG = "word " * 40_000 + "x" * 200_000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33, True, "s", 1, "c"),
    (2, "one two three four five six seven", None, None, None, None, None, None, None),
    (3, None, "en", "a", 0, None, None, None, None), (4, "", "en", "a", 0, None, None, None, None),
    (5, LONG, "en", "b", len(LONG), None, None, None, None), (6, "Ünï ﷽ \u0000 \U0001f600\n\t", "xx", "b", 9, None, None, None, None),
    (1, "one two three four five six seven", "en", "a", 33, True, "s", 1, "c"), (None, "no id here", "en", "a", 1, None, None, None, None),
    (None, None, None, None, None, None, None, None, None), (7, "no id here", "en", "a", 10, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")


def test_scan_edges(docs):
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(ROWS) and all(r["spans"] == [] for r in got)
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_scan_many_matches(spark):
    df = spark.createDataFrame([(1, "token=abcdef " * 3000)], "doc_id long, text string")
    spans = secret_scan.scan_secrets(df).first()["spans"]
    assert len(spans) == 3000 and [(s["start"], s["end"]) for s in spans[:2]] == [(0, 12), (13, 25)] and spans[-1]["end"] == 13 * 3000 - 1


def test_pack_edges(docs):
    rows = packing.pack_documents(docs).collect()
    tokens = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] == 2 ** r["bucket"] and r["offset"] == 0
        tokens.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert [n for _, n in sorted(tokens[3])] == [1] and sum(n for _, n in tokens[5]) == {r["doc_id"]: r["doc_tokens"] for r in rows}[5]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pack_long_white_space(spark):
    for blank in (" ", "\n", "\u3000"):
        rows = packing.pack_documents(spark.createDataFrame([(1, "a" + blank * 1_000_000 + "b")], "doc_id long, text string")).collect()
        want = packing._ids(*packing.default_tokenizer()).tokenizer.encode("a" + blank * 1_000_000 + "b", add_special_tokens=False).ids
        assert sum(r["length"] for r in rows) == len(want) + 1


def test_quality_edges(docs, labels, spark):
    assert cotrain.score_documents(docs, labels).count() == len(ROWS)
    assert cotrain.keep_good(docs, labels).columns == docs.columns
    none = cotrain.score_documents(docs, labels.limit(0)).collect()
    assert all(r["score"] == 1.0 and r["keep"] for r in none)
    assert cotrain.score_documents(docs.limit(0), labels).count() == 0


def test_near_edges(docs):
    rows = simhash.near_components(docs).collect()
    assert len(rows) == len(ROWS)
    group = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert group[1] == group[2] == 1 and group[3] == group[4] == 3 and group[7] == 7
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 5, 6, 7]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_exact_edges(docs):
    rows = patricia.duplicate_owners(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(2, 3, False)] * 2 and by[2] == [(2, 3, True)] and by[3] == [(4, 3, False)] and by[7] == [(7, 2, True)]
    assert sorted(by[None]) == [(4, 3, False), (7, 2, False)]
    kept = patricia.drop_exact_duplicates(docs, keep="min")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert patricia.duplicate_owners(docs.limit(0)).count() == 0 and patricia.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_trie_spills(docs):
    small = patricia.duplicate_groups(docs, trie_bytes=1).collect()
    assert sorted((r["keep_id"], r["group_size"], r["owner_rows"]) for r in small) == [(2, 3, 1), (4, 3, 1), (7, 2, 1)]


def test_mix_edges(docs):
    rows = raking.mix_documents(docs, rounds=3).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "(none)"} and {"probability", "kept", "copies"} <= set(rows[0].asDict())
    assert raking.sample_mixture(docs, rounds=2).columns == docs.columns
    assert raking.mix_documents(docs.limit(0), rounds=2).count() == 0


def test_repeat_edges(docs):
    rows = debruijn.remove_repeats(docs, k=3, m=2).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert by[1] == [(7, 0)] * 2 and by[2] == [(7, 7)] and by[3] == [(0, 0)] and by[7] == [(3, 0)] and sorted(by[None]) == [(0, 0), (3, 0)]
    assert by[5] == [(40_001, 0)]
    assert debruijn.remove_repeats(docs.limit(0)).count() == 0


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, [None, 1.0]),
            (120, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (140, [0.5, 0.5]), (160, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(df, lambda i: i % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 140, 0.5), (0, 3, 2, 0.0), (140, 1, 0, 0.5), (140, 2, 1, 0.5), (140, 3, 2, 0.5)]
    assert vptree.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_page_edges(spark):
    body = "<p>" + "same " * 300
    rows = [(1, "u\r\nx", body), (2, None, body), (3, "u", None), (None, "u", body), (2, "v", body), (4, "u", "<p>short"), (5, "u", "<p>short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_crf.extract_text(pages).collect()}
    assert texts[3] == "" and len(texts) == 6
    path = Steps(spark, "test").path("edges")
    got = warc.archive_pages(pages, path, compression="none").collect()
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_length"]) for r in got)
    n = len(body)
    assert kinds == [("urn:page:1", "revisit", "urn:page:2", n), ("urn:page:2", "response", "", n), ("urn:page:2", "response", "", n), ("urn:page:3", "response", "", 0),
                     ("urn:page:4", "response", "", 8), ("urn:page:5", "response", "", 8), ("urn:page:none", "revisit", "urn:page:2", n)]
    assert html_crf.extract_text(pages.limit(0)).count() == 0
    assert warc.archive_pages(pages.limit(0), path + "-none").count() == 0


def test_stages_keep_columns(docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark, now = docs.sparkSession, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    sha = [hashlib.sha256(r["ids"]).hexdigest() for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()]
    assert sha and now.select(F.count("*")).first()[0] >= 3
