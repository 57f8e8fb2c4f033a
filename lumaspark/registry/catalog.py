"""Registered queries over the catalogue: sources, paths, keys, time, text, tags, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspark.functions import exif, keys, paths, text, timeparts, viewstate
from lumaspark.operators import ordering, sampling, summary
from lumaspark.registry.data import (
    BASE_SQL, CACHE_KEY_SQL, CATALOGUE_SQL, EXT_SQL, FOLDER_SQL, IMAGE_LIST_SQL, MEDIA_SQL, PATH_KEY_SQL,
    catalogue, media, table,
)
from lumaspark.sources import assets
from lumaspark.sources import media as sources

QUERIES: dict = {}
SQL: dict = {}

CAT = "WITH " + CATALOGUE_SQL
MEDIA = CAT + ", " + MEDIA_SQL


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _media_sql(where_hidden: bool) -> str:
    hidden = " AND NOT regexp_matches(name, '(^|/)\\.')" if where_hidden else ""
    return f"SELECT media_id, name, size FROM cat WHERE ({EXT_SQL} IN {IMAGE_LIST_SQL} OR {EXT_SQL} IN ('mp4','webm')){hidden}"


@query("media_tree_catalogue", f"{CAT} {_media_sql(True)}")
def media_tree_catalogue(spark, sf):
    return sources.catalogue_from_tree(catalogue(spark, sf)).select("media_id", "name", "size")


@query("flat_listing_catalogue", f"""{CAT}, listing AS (
  SELECT media_id, CASE WHEN size < 1048576 THEN '' ELSE name END AS rel_path, {BASE_SQL} AS file_name, size FROM cat),
full_names AS (SELECT media_id, size, CASE WHEN rel_path = '' THEN file_name ELSE rel_path END AS name FROM listing)
SELECT media_id, name, size FROM full_names WHERE {EXT_SQL} IN {IMAGE_LIST_SQL} OR {EXT_SQL} IN ('mp4','webm')""")
def flat_listing_catalogue(spark, sf):
    listing = catalogue(spark, sf).select(
        "media_id", F.when(F.col("size") >= 1048576, F.col("name")).otherwise("").alias("rel_path"),
        paths.basename_of("name").alias("file_name"), "size",
    )
    return sources.catalogue_from_listing(listing).select("media_id", "name", "size")


@query("folder_scope", f"{CAT} SELECT media_id, name FROM cat WHERE starts_with(name, 'click/')")
def folder_scope(spark, sf):
    return sources.scope_to_folder(catalogue(spark, sf), "click").select("media_id", "name")


@query("media_kinds", f"""{CAT} SELECT media_id, {EXT_SQL} AS ext,
  CASE WHEN {EXT_SQL} IN ('mp4','webm') THEN 'video' WHEN {EXT_SQL} IN {IMAGE_LIST_SQL} THEN 'image' END AS kind,
  regexp_matches(name, '(^|/)\\.') AS hidden FROM cat""")
def media_kinds(spark, sf):
    return catalogue(spark, sf).select(
        "media_id", paths.media_ext("name").alias("ext"), paths.media_kind("name").alias("kind"),
        paths.is_hidden("name").alias("hidden"),
    )


@query("path_parts", f"{CAT} SELECT media_id, {FOLDER_SQL} AS folder, {BASE_SQL} AS base FROM cat")
def path_parts(spark, sf):
    return catalogue(spark, sf).select(
        "media_id", paths.folder_of("name").alias("folder"), paths.basename_of("name").alias("base")
    )


@query("folder_breadcrumbs", f"""{CAT}, parts AS (
  SELECT media_id, string_split(name, '/') AS p FROM cat),
steps AS (SELECT media_id, p, unnest(range(1, len(p))) AS depth FROM parts)
SELECT media_id, CAST(depth AS INTEGER) AS depth, p[depth] AS label,
       array_to_string(p[1:depth], '/') AS target, array_to_string(p[1:depth-1], '/') AS parent
FROM steps
""")
def folder_breadcrumbs(spark, sf):
    return paths.path_prefixes(catalogue(spark, sf))


@query("identity_keys", f"""{CAT} SELECT media_id, {CACHE_KEY_SQL} AS cache_key, {PATH_KEY_SQL} AS path_key,
  '@caption/' || {PATH_KEY_SQL} AS caption_key FROM cat""")
def identity_keys(spark, sf):
    return catalogue(spark, sf).select(
        "media_id", keys.cache_key().alias("cache_key"), keys.path_key().alias("path_key"),
        keys.caption_key().alias("caption_key"),
    )


_VARIANT_SQL = """CASE media_id % 6 WHEN 0 THEN 'nomic' WHEN 1 THEN 'chrome-ai' WHEN 2 THEN 'sapiens2-fp16'
  WHEN 3 THEN 'sapiens2-int8' WHEN 4 THEN 'sapiens2-fp32' ELSE 'sapiens2' END"""


def _variant(c):
    names = ("nomic", "chrome-ai", "sapiens2-fp16", "sapiens2-int8", "sapiens2-fp32", "sapiens2")
    return F.get(F.array(*(F.lit(n) for n in names)), F.pmod(F.col(c), F.lit(6)).cast("int"))


@query("model_namespaces", f"""{CAT}, v AS (SELECT media_id, {_VARIANT_SQL} AS variant FROM cat)
SELECT media_id, variant, CASE WHEN variant = 'chrome-ai' THEN '@chrome-ai/' WHEN variant = 'sapiens2-fp16' THEN '@sapiens2/'
  WHEN starts_with(variant, 'sapiens2') THEN '@' || variant || '/' ELSE '' END AS namespace FROM v""")
def model_namespaces(spark, sf):
    v = catalogue(spark, sf).select("media_id", _variant("media_id").alias("variant"))
    return v.withColumn("namespace", keys.model_namespace("variant"))


@query("datetime_filter_day", f"{CAT} SELECT media_id FROM cat WHERE year(last_modified)=2024 AND month(last_modified)=1 AND day(last_modified)=15")
def datetime_filter_day(spark, sf):
    return timeparts.filter_datetime(catalogue(spark, sf), 2024, 1, 15).select("media_id")


@query("datetime_filter_scattered", f"{CAT} SELECT media_id FROM cat WHERE year(last_modified)=2024 AND hour(last_modified)=14")
def datetime_filter_scattered(spark, sf):
    return timeparts.filter_datetime(catalogue(spark, sf), 2024, hour=14).select("media_id")


@query("lineitem_month_filter", """SELECT l_orderkey, l_linenumber FROM lineitem
  WHERE year(l_shipdate) = 1995 AND month(l_shipdate) = 3""")
def lineitem_month_filter(spark, sf):
    rows = timeparts.filter_datetime(table(spark, sf, "lineitem"), 1995, 3, ts="l_shipdate")
    return rows.select("l_orderkey", "l_linenumber")


@query("datetime_breadcrumbs", f"""{CAT} SELECT media_id, strftime(last_modified, '%Y') AS "year", strftime(last_modified, '%m') AS "month",
  strftime(last_modified, '%d') AS "day", strftime(last_modified, '%H') AS "hour", strftime(last_modified, '%M') AS "minute" FROM cat""")
def datetime_breadcrumbs(spark, sf):
    return catalogue(spark, sf).select("media_id", timeparts.datetime_parts("last_modified").alias("p")).select("media_id", "p.*")


_LABEL_SQL = """CASE media_id % 5 WHEN 0 THEN strftime(last_modified, '%Y') WHEN 1 THEN strftime(last_modified, '%Y-%m')
  WHEN 2 THEN strftime(last_modified, '%Y-%m-%d') WHEN 3 THEN strftime(last_modified, '%Y-%m-%d %H:00')
  ELSE strftime(last_modified, '%Y-%m-%d %H:%M') END"""


@query("range_labels", f"{CAT} SELECT media_id, {_LABEL_SQL} AS label FROM cat")
def range_labels(spark, sf):
    g = F.get(F.array(*(F.lit(x) for x in timeparts.GRANULARITIES)), F.pmod(F.col("media_id"), F.lit(5)).cast("int"))
    return catalogue(spark, sf).select("media_id", timeparts.range_label("last_modified", g).alias("label"))


_HASH_SQL = """CASE media_id % 8 WHEN 0 THEN '#folder:' || regexp_replace(name, '/?[^/]*$', '')
  WHEN 1 THEN '#dt:' || strftime(last_modified, '%Y-%m-%d') WHEN 2 THEN '#dt:' || strftime(last_modified, '%Y-%m-%dT%H')
  WHEN 3 THEN '#dt:' || strftime(last_modified, '%Y-%m-%dT%H:%M') WHEN 4 THEN '#dt:' || strftime(last_modified, '%Y-%m-%d:%M')
  WHEN 5 THEN '#dt:' || strftime(last_modified, '%Y-') || CAST(10 + media_id % 90 AS VARCHAR) || strftime(last_modified, '-%d')
  WHEN 6 THEN '#' ELSE name END"""


def _fragments(spark, sf):
    t = F.col("last_modified")
    day, ts = F.date_format(t, "yyyy-MM-dd"), lambda f: F.date_format(t, f)
    kinds = F.array(
        F.concat(F.lit("#folder:"), F.regexp_replace("name", "/?[^/]*$", "")),
        F.concat(F.lit("#dt:"), day), F.concat(F.lit("#dt:"), day, F.lit("T"), ts("HH")),
        F.concat(F.lit("#dt:"), day, F.lit("T"), ts("HH:mm")), F.concat(F.lit("#dt:"), day, ts(":mm")),
        F.concat(F.lit("#dt:"), ts("yyyy-"), (F.col("media_id") % 90 + 10).cast("string"), ts("-dd")),
        F.lit("#"), F.col("name"),
    )
    return catalogue(spark, sf).select("media_id", F.get(kinds, F.pmod("media_id", F.lit(8)).cast("int")).alias("fragment"))


# Fixed value: the form of a time in a view state
_DT_RE = r"^#dt:(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}))?(?::(\d{2}))?$"


def _dt_part(i: int, lo: int, hi: int) -> str:
    v = f"TRY_CAST(nullif(regexp_extract(fragment, '{_DT_RE}', {i}), '') AS INTEGER)"
    return f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {v} END"


_PARSED_SQL = f"""{CAT}, f AS (SELECT media_id, {_HASH_SQL} AS fragment FROM cat),
parsed AS (SELECT media_id, fragment,
  CASE WHEN starts_with(fragment, '#folder:') THEN 'folder' WHEN regexp_matches(fragment, '{_DT_RE}') THEN 'datetime' END AS "type",
  CASE WHEN starts_with(fragment, '#folder:') THEN substr(fragment, 9) END AS path,
  CASE WHEN NOT regexp_matches(fragment, '{_DT_RE}') THEN NULL WHEN regexp_extract(fragment, '{_DT_RE}', 5) <> '' THEN 'minute'
       WHEN regexp_extract(fragment, '{_DT_RE}', 4) <> '' THEN 'hour' ELSE 'day' END AS granularity,
  {_dt_part(1, 1, 9999)} AS "year", {_dt_part(2, 1, 12)} AS "month", {_dt_part(3, 1, 31)} AS "day",
  {_dt_part(4, 0, 23)} AS "hour", {_dt_part(5, 0, 59)} AS "minute" FROM f)"""


@query("view_state_parse", f'{_PARSED_SQL} SELECT media_id, "type", path, granularity, "year", "month", "day", "hour", "minute" FROM parsed')
def view_state_parse(spark, sf):
    return _fragments(spark, sf).select("media_id", viewstate.parse_view_state("fragment").alias("s")).select("media_id", "s.*")


@query("view_state_format", f"""{_PARSED_SQL} SELECT media_id, CASE WHEN "type" = 'folder' THEN '#folder:' || path
  WHEN "type" = 'datetime' THEN '#dt:' || CAST("year" AS VARCHAR)
    || CASE WHEN "month" IS NULL THEN '' ELSE '-' || lpad(CAST("month" AS VARCHAR), 2, '0')
       || CASE WHEN "day" IS NULL THEN '' ELSE '-' || lpad(CAST("day" AS VARCHAR), 2, '0')
          || CASE WHEN "hour" IS NULL THEN '' ELSE 'T' || lpad(CAST("hour" AS VARCHAR), 2, '0')
             || CASE WHEN "minute" IS NULL THEN '' ELSE ':' || lpad(CAST("minute" AS VARCHAR), 2, '0') END END END END
  ELSE '#' END AS fragment FROM parsed""")
def view_state_format(spark, sf):
    s = _fragments(spark, sf).select("media_id", viewstate.parse_view_state("fragment").alias("s"))
    return s.select("media_id", viewstate.format_view_state("s").alias("fragment"))


@query("size_texts", f"""{CAT} SELECT media_id,
  CASE WHEN size < 1048576 THEN printf('%.0f', round(size / 1024.0::DOUBLE)) || ' KB'
       ELSE printf('%.1f', round(size / 1048576.0::DOUBLE, 1)) || ' MB' END AS size_text,
  CASE WHEN size * 997 >= 1073741824 THEN printf('%.1f', round(size * 997 / 1073741824.0::DOUBLE, 1)) || ' GB'
       WHEN size * 997 >= 1048576 THEN printf('%.0f', round(size * 997 / 1048576.0::DOUBLE)) || ' MB'
       ELSE printf('%.0f', round(size * 997 / 1024.0::DOUBLE)) || ' KB' END AS bytes_text FROM cat""")
def size_texts(spark, sf):
    return catalogue(spark, sf).select(
        "media_id", text.format_size("size").alias("size_text"), text.format_bytes(F.col("size") * 997).alias("bytes_text")
    )


# ---- tags: part as a table of tag maps -------------------------------------------------

_EXIF_TAGS = ("Make", "FNumber", "ExposureTime", "FocalLength", "Software", "latitude", "longitude", "Unlisted")


def _exif(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    has = F.when(k % 11 == 0, F.lit(None)).otherwise(F.map_filter(F.create_map(
        F.lit("Make"), F.col("p_brand"), F.lit("FNumber"), (F.col("p_size") % 22).cast("string"),
        F.lit("ExposureTime"), F.when(k % 7 == 0, "2").when(k % 7 == 1, "0").otherwise(F.concat(F.lit("0.00"), (k % 9 + 1).cast("string"))),
        F.lit("FocalLength"), F.col("p_size").cast("string"), F.lit("Software"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_type")),
        F.lit("latitude"), F.when(k % 5 == 0, F.lit(None)).otherwise((k % 180 - 90).cast("string")),
        F.lit("longitude"), F.when(k % 4 == 0, F.lit("unknown")).otherwise(F.concat((k % 360 - 180).cast("string"), F.lit(".25"))),
        F.lit("Unlisted"), F.col("p_name"),
    ), lambda _, v: v.isNotNull() & (k % 13 != 0)))
    return p.select(k.alias("media_id"), has.alias("exif"))


_EXIF_SQL = """WITH tags AS (SELECT p_partkey AS media_id, p_partkey % 11 = 0 AS no_map, p_partkey % 13 = 0 AS empty_map,
  p_brand AS make, CAST(p_size % 22 AS VARCHAR) AS fnumber,
  CASE WHEN p_partkey % 7 = 0 THEN '2' WHEN p_partkey % 7 = 1 THEN '0' ELSE '0.00' || CAST(p_partkey % 9 + 1 AS VARCHAR) END AS exposure,
  CAST(p_size AS VARCHAR) AS focal, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS software,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 180 - 90 AS VARCHAR) END AS lat,
  CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE CAST(p_partkey % 360 - 180 AS VARCHAR) || '.25' END AS lon
  FROM part), present AS (SELECT *, NOT no_map AND NOT empty_map AS filled FROM tags)"""


@query("exif_details", _EXIF_SQL + """, rows AS (
  SELECT media_id, 0 AS ord, 'Camera Make' AS label, make AS "value" FROM present WHERE filled
  UNION ALL SELECT media_id, 3, 'Aperture', 'f/' || fnumber FROM present WHERE filled
  UNION ALL SELECT media_id, 4, 'Shutter Speed', CASE WHEN TRY_CAST(exposure AS DOUBLE) < 1
      THEN '1/' || CAST(CAST(round(1.0::DOUBLE / nullif(TRY_CAST(exposure AS DOUBLE), 0)) AS BIGINT) AS VARCHAR) || 's' ELSE exposure || 's' END
    FROM present WHERE filled
  UNION ALL SELECT media_id, 6, 'Focal Length', focal || 'mm' FROM present WHERE filled
  UNION ALL SELECT media_id, 19, 'Software', software FROM present WHERE filled
  UNION ALL SELECT media_id, 22, 'Latitude', printf('%.6f', TRY_CAST(lat AS DOUBLE)) FROM present WHERE filled AND lat IS NOT NULL
  UNION ALL SELECT media_id, 23, 'Longitude', CASE WHEN TRY_CAST(lon AS DOUBLE) IS NOT NULL THEN printf('%.6f', TRY_CAST(lon AS DOUBLE)) END FROM present WHERE filled)
SELECT media_id, ord, label, "value" FROM rows WHERE coalesce("value", '') <> ''""")
def exif_details(spark, sf):
    return exif.exif_rows(_exif(spark, sf))


@query("gps_fields", _EXIF_SQL + """, g AS (SELECT media_id, coalesce(filled, FALSE) AS has_exif,
    CASE WHEN filled AND TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(lon AS DOUBLE) IS NOT NULL
         THEN printf('%.5f', CAST(lat AS DOUBLE)) END AS la,
    CASE WHEN filled AND TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(lon AS DOUBLE) IS NOT NULL
         THEN printf('%.5f', CAST(lon AS DOUBLE)) END AS lo FROM present)
SELECT media_id, has_exif, la || ', ' || lo AS gps_text,
  'https://www.openstreetmap.org/?mlat=' || la || '&mlon=' || lo || '&zoom=15' AS gps_link FROM g""")
def gps_fields(spark, sf):
    g = _exif(spark, sf).select("media_id", exif.has_exif("exif").alias("has_exif"), exif.gps_of("exif").alias("gps"))
    return g.select("media_id", "has_exif", exif.gps_text("gps").alias("gps_text"), exif.gps_link("gps").alias("gps_link"))


# ---- hosts, downloads, assets: pages as requests ---------------------------------------

_HOST_SQL = """CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '   '
  ELSE '  ' || regexp_extract(url, '^https?://[^/]+') || CASE page_id % 5 WHEN 2 THEN '/' WHEN 3 THEN '///' ELSE '' END || ' ' END"""


def _hosts(spark, sf):
    p, r = table(spark, sf, "pages"), F.col("page_id") % 5
    host = F.concat(F.lit("  "), F.regexp_extract("url", "^https?://[^/]+", 0),
                    F.when(r == 2, "/").when(r == 3, "///").otherwise(""), F.lit(" "))
    return p.select("page_id", F.when(r == 0, F.lit(None)).when(r == 1, F.lit("   ")).otherwise(host).alias("host"))


@query("normalized_hosts", f"""WITH h AS (SELECT page_id, {_HOST_SQL} AS host FROM pages)
SELECT page_id, regexp_replace(trim(coalesce(host, '')), '/+$', '') AS host FROM h""")
def normalized_hosts(spark, sf):
    return _hosts(spark, sf).select("page_id", text.normalize_host("host").alias("host"))


# The files of the two public model repositories.
_MANIFEST = (
    ("vision", 0, "nomic-ai/nomic-embed-vision-v1.5", "config.json"),
    ("vision", 1, "nomic-ai/nomic-embed-vision-v1.5", "preprocessor_config.json"),
    ("vision", 2, "nomic-ai/nomic-embed-vision-v1.5", "onnx/model.onnx"),
    ("text", 0, "nomic-ai/nomic-embed-text-v1.5", "config.json"),
    ("text", 1, "nomic-ai/nomic-embed-text-v1.5", "tokenizer.json"),
    ("text", 2, "nomic-ai/nomic-embed-text-v1.5", "tokenizer_config.json"),
    ("text", 3, "nomic-ai/nomic-embed-text-v1.5", "onnx/model.onnx"),
    ("sapiens2-int8", 0, "models/sapiens2", "sapiens2_0.1b_int8.onnx"),
    ("sapiens2-fp16", 0, "models/sapiens2", "sapiens2_0.1b_fp16.onnx"),
    ("sapiens2-fp32", 0, "models/sapiens2", "sapiens2_0.1b_fp32.onnx"),
)


@query("asset_manifest", f"""WITH manifest(family, ord, repo, path) AS (VALUES {", ".join(str(r) for r in _MANIFEST)}),
r AS (SELECT page_id, page_id AS media_id, {_HOST_SQL} AS host, page_id % 2 = 0 AS include_text FROM pages),
v AS (SELECT *, {_VARIANT_SQL} AS variant FROM r),
f AS (SELECT *, unnest(CASE WHEN variant = 'sapiens2' THEN ['sapiens2-fp16'] WHEN starts_with(variant, 'sapiens2') THEN [variant]
   WHEN variant = 'chrome-ai' THEN ['text'] WHEN include_text THEN ['vision', 'text'] ELSE ['vision'] END) AS family FROM v)
SELECT page_id, variant, f.family, ord, coalesce(nullif(regexp_replace(trim(coalesce(host, '')), '/+$', ''), ''), 'https://huggingface.co')
  || '/' || repo || '/resolve/main/' || path AS url FROM f JOIN manifest m ON f.family = m.family""")
def asset_manifest(spark, sf):
    manifest = spark.createDataFrame(_MANIFEST, "family string, ord int, repo string, path string")
    asks = _hosts(spark, sf).select(
        "page_id", _variant("page_id").alias("variant"), "host", (F.col("page_id") % 2 == 0).alias("include_text")
    )
    return assets.manifest_urls(asks, manifest).select("page_id", "variant", "family", "ord", "url")


_ASSET_SQL = f"""{CAT}, files AS (SELECT media_id AS ord, CASE WHEN media_id % 9 = 0 THEN '/' ELSE '' END || name AS rel_path FROM cat),
asked AS (SELECT media_id, 'https://h.example/org/repo/resolve/main/' || CASE media_id % 5
   WHEN 0 THEN name WHEN 1 THEN split_part(name, '/', 2) || '/' || split_part(name, '/', 3) WHEN 2 THEN {BASE_SQL}
   WHEN 3 THEN 'other/' || {BASE_SQL} ELSE 'missing.bin' END || CASE WHEN media_id % 2 = 0 THEN '?download=1#top' ELSE '' END AS url FROM cat),
want AS (SELECT media_id, regexp_extract(url, '^(?:.*/resolve/[^/]+/)?/*([^?#]*)', 1) AS w FROM asked),
clean AS (SELECT ord, ltrim(rel_path, '/') AS rel FROM files),
cand AS (SELECT media_id, rel, CASE WHEN rel = w THEN 0 WHEN ends_with(rel, '/' || w) THEN 1 ELSE 2 END AS kind, ord
  FROM want JOIN clean ON split_part(rel, '/', -1) = split_part(w, '/', -1)),
best AS (SELECT media_id, arg_min(rel, (kind, ord)) AS rel_path, min(kind) AS kind FROM cand GROUP BY media_id)
SELECT want.media_id, best.rel_path, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' WHEN 2 THEN 'basename' END AS "match"
FROM want LEFT JOIN best USING (media_id)"""


@query("asset_resolution", _ASSET_SQL)
def asset_resolution(spark, sf):
    c = catalogue(spark, sf)
    base, r = paths.basename_of("name"), F.col("media_id") % 5
    files = c.select(F.col("media_id").alias("ord"),
                     F.concat(F.when(F.col("media_id") % 9 == 0, "/").otherwise(""), "name").alias("rel_path"))
    tail = (F.when(r == 0, F.col("name")).when(r == 1, F.substring_index("name", "/", -2)).when(r == 2, base)
            .when(r == 3, F.concat(F.lit("other/"), base)).otherwise("missing.bin"))
    url = F.concat(F.lit("https://h.example/org/repo/resolve/main/"), tail,
                   F.when(F.col("media_id") % 2 == 0, "?download=1#top").otherwise(""))
    return assets.resolve_assets(c.select("media_id", url.alias("url")), files).select("media_id", "rel_path", "match")


_MESSAGE_SQL = """CASE event_id % 10 WHEN 0 THEN 'Failed to fetch' WHEN 1 THEN 'Load failed' WHEN 2 THEN 'download failed: ' || CAST(user_id AS VARCHAR)
  WHEN 3 THEN 'Could not locate file: ' || event_type WHEN 4 THEN 'GPU device lost' WHEN 5 THEN event_type || ' is not a function'
  WHEN 6 THEN 'code ' || CAST(400 + user_id % 110 AS VARCHAR) WHEN 7 THEN 'HTTP status ' || CAST(user_id % 6 AS VARCHAR) || '04 seen'
  WHEN 8 THEN 'getaddrinfo ENOTFOUND' ELSE NULL END"""


# Words and status codes that tell a failed download
_ERROR_WORDS = ("download failed", "failed to fetch", "load failed", "network error", "networkerror", "could not locate", "unauthorized", "err_", "http error",
                "status 4", "status 5", "getaddrinfo", "enotfound")
_ERROR_CODES = ("403", "404", "429", "500", "502", "503", "504")


@query("download_errors", f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'AbortError' ELSE 'Error' END AS name, {_MESSAGE_SQL} AS m FROM events)
SELECT event_id, name <> 'AbortError' AND m IS NOT NULL AND (""" + " OR ".join(f"contains(lower(m), '{w}')" for w in _ERROR_WORDS) + f"""
  OR list_has_any(string_split(m, ' '), {list(_ERROR_CODES)})) AS is_download_error FROM e""")
def download_errors(spark, sf):
    u, r = F.col("user_id"), F.col("event_id") % 10
    msg = (
        F.when(r == 0, "Failed to fetch").when(r == 1, "Load failed")
        .when(r == 2, F.concat(F.lit("download failed: "), u.cast("string")))
        .when(r == 3, F.concat(F.lit("Could not locate file: "), "event_type")).when(r == 4, "GPU device lost")
        .when(r == 5, F.concat("event_type", F.lit(" is not a function")))
        .when(r == 6, F.concat(F.lit("code "), (u % 110 + 400).cast("string")))
        .when(r == 7, F.concat(F.lit("HTTP status "), (u % 6).cast("string"), F.lit("04 seen")))
        .when(r == 8, "getaddrinfo ENOTFOUND")
    )
    name = F.when(F.col("event_id") % 3 == 0, "AbortError").otherwise("Error")
    return table(spark, sf, "events").select("event_id", text.is_download_error(name, msg).alias("is_download_error"))


@query("task_prefixes", """SELECT item_id, 'search_query: ' || text AS q, 'search_document: ' || text AS d,
  regexp_replace(text, '\\s', '', 'g') = '' AS blank FROM benchmark""")
def task_prefixes(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", text.prefix_text("text", "query").alias("q"), text.prefix_text("text", "document").alias("d"),
        text.is_blank("text").alias("blank"),
    )


# ---- aggregates and orders ------------------------------------------------------------

@query("folder_counts", f"""{CAT} SELECT {FOLDER_SQL} AS folder, count(*) AS n_files,
  epoch_us(min(last_modified)) AS first_us, epoch_us(max(last_modified)) AS last_us, CAST(sum(size) AS BIGINT) AS total_size
  FROM cat GROUP BY 1""")
def folder_counts(spark, sf):
    s = summary.folder_summary(catalogue(spark, sf))
    return s.select("folder", "n_files", F.unix_micros("first_modified").alias("first_us"),
                    F.unix_micros("last_modified").alias("last_us"), "total_size")


@query("widest_folder", f"""{CAT}, g AS (SELECT {FOLDER_SQL} AS folder, count(*) AS c FROM cat GROUP BY 1)
SELECT count(*) AS n_folders, CAST(max(ceil(sqrt(c))) AS BIGINT) AS max_cols FROM g""")
def widest_folder(spark, sf):
    return summary.widest_folder(catalogue(spark, sf))


@query("datetime_histogram_hour", f"{CAT} SELECT strftime(last_modified, '%Y-%m-%d %H:00') AS label, count(*) AS n FROM cat GROUP BY 1")
def datetime_histogram_hour(spark, sf):
    return timeparts.datetime_histogram(catalogue(spark, sf), "hour")


@query("lineitem_month_histogram", "SELECT strftime(l_shipdate, '%Y-%m') AS label, count(*) AS n FROM lineitem GROUP BY 1")
def lineitem_month_histogram(spark, sf):
    return timeparts.datetime_histogram(table(spark, sf, "lineitem"), "month", ts="l_shipdate")


# each conversation text is a file; equal texts of a role are copies of one content
_COPIES_SQL = """copies AS (SELECT conv_id * 1000 + turn AS media_id, CAST(conv_id AS VARCHAR) || '/' || role || '.png' AS name,
  CAST(length(text) AS BIGINT) AS size, TIMESTAMP '2024-01-01' AS last_modified FROM conversations)"""


@query("distinct_contents", f"""WITH {_COPIES_SQL}, k AS (SELECT *, {CACHE_KEY_SQL} AS cache_key FROM copies)
SELECT min(media_id) AS media_id, arg_min(name, media_id) AS name, cache_key, count(*) AS copies FROM k GROUP BY cache_key""")
def distinct_contents(spark, sf):
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("media_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), "role", F.lit(".png")).alias("name"),
        F.char_length("text").cast("bigint").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("last_modified"),
    )
    return summary.distinct_media(c).select("media_id", "name", "cache_key", "copies")


@query("viewer_ordering", f"""{CAT}, f AS (SELECT media_id, {FOLDER_SQL} AS folder, last_modified FROM cat)
SELECT media_id, folder, row_number() OVER (ORDER BY folder, last_modified, media_id) AS pos FROM f""")
def viewer_ordering(spark, sf):
    c = catalogue(spark, sf).withColumn("folder", paths.folder_of("name"))
    return ordering.ordered_rank(c, [], ["folder", "last_modified", "media_id"], "pos").select("media_id", "folder", "pos")


@query("viewer_sorted", f"{CAT} SELECT media_id, {FOLDER_SQL} AS folder FROM cat ORDER BY folder, last_modified, media_id")
def viewer_sorted(spark, sf):
    return summary.viewer_order(catalogue(spark, sf)).select("media_id", "folder")


@query("chronological_ordering", f"{CAT} SELECT media_id, row_number() OVER (ORDER BY last_modified, media_id) AS pos FROM cat")
def chronological_ordering(spark, sf):
    return ordering.ordered_rank(catalogue(spark, sf), [], ["last_modified", "media_id"], "pos").select("media_id", "pos")


@query("chronological_sorted", f"{CAT} SELECT media_id FROM cat ORDER BY last_modified, media_id")
def chronological_sorted(spark, sf):
    return summary.chronological(catalogue(spark, sf)).select("media_id")


# ---- samples --------------------------------------------------------------------------

@query("uniform_sample", f"""{MEDIA} SELECT media_id, name FROM media
  ORDER BY md5('7:' || CAST(media_id AS VARCHAR)), media_id LIMIT 100""")
def uniform_sample(spark, sf):
    return sampling.sample_n(media(spark, sf), 100, seed=7).select("media_id", "name")


@query("filtered_sample", f"""{MEDIA}, f AS (SELECT * FROM media WHERE year(last_modified)=2024 AND month(last_modified)=1 AND day(last_modified)=10)
SELECT media_id FROM f ORDER BY md5('3:' || CAST(media_id AS VARCHAR)), media_id LIMIT 50""")
def filtered_sample(spark, sf):
    day = timeparts.filter_datetime(media(spark, sf), 2024, 1, 10)
    return sampling.sample_n(day, 50, seed=3).select("media_id")


@query("filtered_sample_note", f"""{MEDIA}, f AS (SELECT count(*) AS matched FROM media WHERE year(last_modified)=2024 AND month(last_modified)=1 AND day(last_modified)=10)
SELECT matched, least(matched, 50) AS kept, CASE WHEN matched > 50 THEN 'sampled 50 of ' || CAST(matched AS VARCHAR) ELSE '' END AS note FROM f""")
def filtered_sample_note(spark, sf):
    return sampling.sample_note(timeparts.filter_datetime(media(spark, sf), 2024, 1, 10), 50)


@query("sample_per_type", """WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type
  ORDER BY md5('1:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS rn FROM part) SELECT p_partkey, p_type FROM r WHERE rn <= 3""")
def sample_per_type(spark, sf):
    return sampling.sample_per_group(table(spark, sf, "part"), "p_type", 3, seed=1, key="p_partkey").select("p_partkey", "p_type")
