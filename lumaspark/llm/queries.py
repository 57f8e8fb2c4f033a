"""The registered queries of the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.llm import cotrain, debruijn, html_crf, packing, patricia, periodic_runs, raking, secret_scan, simhash, token_alignment, token_store, vptree, warc
from lumaspark.llm.tables import Steps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"),
    )


SQL["op1_secret_scan"] = secret_scan.oracle()


@query
def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and lengths of responses come from the payloads read back, those of revisits from their headers."""
    records = warc.archive_pages(table(spark, sf_dir, "pages"), Steps(spark, "archive").path("pages"),
                                 schema="record_id string, record_type string, payload_digest string, refers_to string, payload_length long, payload binary")
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.regexp_extract("payload_digest", "^sha1:(.*)$", 1))
    return records.select(
        warc.page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", warc.page_number("refers_to").alias("refers_to"),
    )


SQL["op4_warc_source"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o"""


@query
def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op6_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


@query
def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


SQL["op8_raked_mixture"] = raking.oracle()


@query
def op9_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.duplicate_owners(table(spark, sf_dir, "documents"), keep="max")


SQL["op9_patricia_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query
def op10_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"), k=13).drop("kept_text")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = periodic_runs.with_periodic_tail(F.col("doc_id"), F.col("text"))
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), text_col=text).withColumn("top", periodic_runs.longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    length, period = F.col("top.length"), -F.col("top.shorter")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"))


@query
def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.stored_documents(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
