"""Model files: the URLs a variant needs, and the local file that answers a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.paths import basename_of
from lumaspark.functions.text import normalize_host

DEFAULT_HOST = "https://huggingface.co"


def manifest_urls(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per file a requested variant needs.

    requests: variant, host (null for the default), include_text; other columns are kept.
    manifest: family, ord, repo, path. A family is 'vision', 'text' or the name of a
    single-file variant, which is listed under its own name.
    """
    host = F.coalesce(F.nullif(normalize_host("host"), F.lit("")), F.lit(DEFAULT_HOST))
    v = F.col("variant")
    families = (
        F.when(v == "sapiens2", F.array(F.lit("sapiens2-fp16")))
        .when(v.startswith("sapiens2"), F.array(v))
        .when(v == "chrome-ai", F.array(F.lit("text")))
        .when(F.coalesce(F.col("include_text"), F.lit(False)), F.array(F.lit("vision"), F.lit("text")))
        .otherwise(F.array(F.lit("vision")))
    )
    wanted = requests.withColumn("_host", host).select("*", F.posexplode(families).alias("_step", "family"))
    url = F.concat_ws("/", "_host", "repo", F.lit("resolve/main"), "path")
    order = F.struct(F.col("_step"), F.col("ord"))
    return wanted.join(manifest, "family").select(
        *requests.columns, "family", order["ord"].alias("ord"), url.alias("url")
    )


_IN_REPO = r"^(?:.*/resolve/[^/]+/)?/*([^?#]*)"


def file_in_repo(url: str | Column) -> Column:
    """The file that a request names: what stands between the revision and a query or fragment."""
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, _IN_REPO, 1)


def _first_by(files: DataFrame, key: Column, name: str) -> DataFrame:
    """First file in list order for each key: one row per key, so no join can multiply rows."""
    first = F.min(F.struct("ord", "rel_path")).alias(name)
    return files.select(key.alias("_k"), "ord", "rel_path").groupBy("_k").agg(first)


def resolve_assets(requests: DataFrame, files: DataFrame, url: str = "url", first_match: bool = False) -> DataFrame:
    """Adds the local file for each request, null on a miss.

    An exact path beats a path suffix, which beats an equal basename; within a kind the
    first file in list order wins. ``first_match`` takes the first file that meets any
    of the tests instead. Files are reduced to one row per key before each join, so a
    name shared by very many files costs no more than any other.
    """
    files = files.withColumn("rel_path", F.regexp_replace("rel_path", r"^/+", ""))
    parts = F.split("rel_path", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )
    exact = _first_by(files, F.col("rel_path"), "_exact")
    suffix = _first_by(files.withColumn("_t", F.explode(tails)), F.col("_t"), "_suffix")
    base = _first_by(files, F.element_at(parts, -1), "_base")
    want = file_in_repo(url)
    asked = requests.withColumn("_want", want).withColumn("_name", F.substring_index(want, "/", -1))
    joined = (
        asked.join(exact.withColumnRenamed("_k", "_want"), "_want", "left")
        .join(suffix.withColumnRenamed("_k", "_want"), "_want", "left")
        .join(base.withColumnRenamed("_k", "_name"), "_name", "left")
    )
    if first_match:
        best = F.least("_exact", "_suffix", "_base")
        kind = F.when(best.isNotNull(), F.lit("first"))
    else:
        best = F.coalesce("_exact", "_suffix", "_base")
        kind = (
            F.when(F.col("_exact").isNotNull(), F.lit("exact"))
            .when(F.col("_suffix").isNotNull(), F.lit("suffix"))
            .when(F.col("_base").isNotNull(), F.lit("basename"))
        )
    return joined.select(*requests.columns, best["rel_path"].alias("rel_path"), kind.alias("match"))
