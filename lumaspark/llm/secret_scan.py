"""Secrets in texts: fixed patterns, and windows of high Shannon entropy per character class.

Everything is DataFrame functions on one row: no shuffle, no Python. A pattern's matches are
placed by the lengths of the text between them. A candidate is a maximal run of one character
class; a window slides over it with one count per symbol, and each step changes the sum of
c * log2(c) by what enters and what leaves. Sums are whole numbers (scaled), so they do not
drift. A run with windows at the class's entropy gives one span, from the first such window
to the end of the last, unless an allow-list pattern matches the run or the span meets a
span found by a pattern or an earlier class.

Null texts are empty and give no span; ids may be null or repeat, rows are independent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import once, text_of

# The patterns the scan must use. kind: (pattern, group that must be long enough, its least length)
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones need not be listed
}


@dataclass(frozen=True)
class CharClass:
    """A class of symbols whose runs of `window` and more are candidates from `bits` of entropy on."""

    kind: str
    symbols: str
    pattern: str
    window: int
    bits: float

    @property
    def run_pattern(self) -> str:
        return f"{self.pattern}{{{self.window},}}"

    def limit(self) -> int:
        """The largest scaled sum of c * log2(c) that a window of enough entropy can have."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)


SCALE = 10**9
CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", "[0-9A-Fa-f]", 24, 3.05),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "[A-Za-z0-9+/_=-]", 32, 4.21),
)
ALLOWED = (
    r"^[A-Za-z_-]+$",  # words, with no digit at all
    r"^[0-9]+$",  # numbers
    r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefghij",
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",  # UUIDs
    r"^[A-Za-z/_-]+[0-9]{0,8}$",  # paths of words
)
CHUNK = 512
_SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern from the left without overlaps: array of (start, end, value of the group), code points."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.array().cast(_SPAN)

    def add(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["whole"])
        return F.when(p["whole"].isNull(), acc).otherwise(F.struct(
            end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out")))

    def add_chunk(acc, chunk):  # appending is quadratic in the length of the list, so lists stay short
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def run(parts):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), add_chunk, lambda acc: F.flatten(acc["out"]))

    return F.when(text.rlike(pattern), once(parts, run)).otherwise(none)


def hot_range(run: Column, cls: CharClass) -> Column:
    """(lo, hi) over the windows of a run whose entropy reaches the class's bits; null if none does."""
    table = F.array(*(F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("bigint") for c in range(cls.window + 2)))
    codes = F.transform(F.split(run, "", -1), lambda ch: F.instr(F.lit(cls.symbols), ch).cast("int"))
    codes = F.filter(codes, lambda c: c > 0)  # split by nothing may leave an empty end

    def walk(codes, table):
        pairs = F.arrays_zip(codes.alias("enters"), F.slice(F.concat(F.array_repeat(F.lit(0), cls.window), codes), 1, F.size(codes)).alias("leaves"))
        zero = F.struct(F.array_repeat(F.lit(0), len(cls.symbols) + 1).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
                        F.lit(0).alias("at"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

        def step(acc, p):
            n_in = F.get(acc["counts"], p["enters"])
            n_out = F.get(acc["counts"], p["leaves"]) + F.when(p["enters"] == p["leaves"], 1).otherwise(0)
            grown = acc["sum"] + F.get(table, n_in + 1) - F.get(table, n_in)
            total = F.when(p["leaves"] == 0, grown).otherwise(grown + F.get(table, n_out - 1) - F.get(table, n_out))
            counts = F.transform(acc["counts"], lambda c, i: c + F.when(i == p["enters"], 1).otherwise(0) - F.when((i == p["leaves"]) & (i > 0), 1).otherwise(0))
            return once(total, lambda total: once((acc["at"] >= cls.window - 1) & (total <= cls.limit()), lambda hot: F.struct(
                counts.alias("counts"), total.alias("sum"), (acc["at"] + 1).alias("at"),
                F.when(hot, F.coalesce(acc["lo"], acc["at"] - cls.window + 1)).otherwise(acc["lo"]).alias("lo"),
                F.when(hot, acc["at"] + 1).otherwise(acc["hi"]).alias("hi"))))

        return F.aggregate(pairs, zero, step, lambda acc: F.when(acc["lo"].isNotNull(), F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))

    return once(table, lambda table: once(codes, lambda codes: walk(codes, table)))


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _pattern_spans(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    found = located(F.col("text"), pattern, group)
    return _spans(F.filter(found, lambda m: F.length(m["value"]) >= least), kind, order)


def _entropy_spans(order: int, cls: CharClass, allowed: tuple[str, ...]) -> Column:
    found = located(F.col("text"), cls.run_pattern)
    if allowed:
        found = F.filter(found, lambda m: ~m["value"].rlike("|".join(f"(?:{a})" for a in allowed)))
    hot = F.transform(found, lambda m: F.struct(m["start"].alias("start"), hot_range(m["value"], cls).alias("hot")))
    hot = F.transform(F.filter(hot, lambda h: h["hot"].isNotNull()), lambda h: F.struct(
        (h["start"] + h["hot"]["lo"]).alias("start"), (h["start"] + h["hot"]["hi"]).alias("end")))
    return _spans(hot, cls.kind, order)


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the patterns) and spans (those and the method's), arrays of
    (start, order, end, kind) by start, then kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    columns = [_pattern_spans(order, *rule) for order, rule in enumerate((k, *v) for k, v in PATTERNS.items())]
    columns += [_entropy_spans(len(PATTERNS) + n, cls, allowed) for n, cls in enumerate(classes)]
    columns = [c.alias(f"k{i}") for i, c in enumerate(columns)]
    out = rows.select("doc_id", *columns)
    out = out.select("*", F.array_sort(F.concat(*(f"k{i}" for i in range(len(PATTERNS))))).alias("base"))
    spans = F.col("base")
    for n in range(len(classes)):
        out = out.withColumn(f"s{n}", F.concat(spans, _apart(F.col(f"k{len(PATTERNS) + n}"), spans)))
        spans = F.col(f"s{n}")
    return out.select("doc_id", "base", F.array_sort(spans).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The scan's digest as SQL: windows are scored one by one with an entropy aggregate."""
    parts = []
    for order, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        p = _quoted(pattern)
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, string_split_regex(t, {p}) AS gaps,
          regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS val, {least} AS least, 0 AS win, 0 AS bits FROM d""")
    for n, c in enumerate(CLASSES):
        p = _quoted(c.run_pattern)
        parts.append(f"""SELECT doc_id, '{c.kind}', {len(PATTERNS) + n}, string_split_regex(t, {p}), regexp_extract_all(t, {p}, 0),
          regexp_extract_all(t, {p}, 0), {c.window}, {c.window}, {c.bits} FROM d""")
    allow = " OR ".join(f"regexp_matches(v, {_quoted(a)})" for a in ALLOWED)
    extra, below = "", "base"
    for n, c in enumerate(CLASSES):
        extra += f""", s{n} AS (SELECT * FROM {below} UNION ALL SELECT * FROM hot h WHERE kind = '{c.kind}'
          AND NOT EXISTS (SELECT 1 FROM {below} o WHERE o.rid = h.rid AND o.s < h.e AND h.s < o.e))"""
        below = f"s{n}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM m),
f AS (SELECT doc_id AS rid, kind, ord, win, bits, val[i] AS v, least,
        coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS s,
        length(whole[i]) AS len FROM i),
base AS (SELECT rid, kind, ord, s, s + len AS e FROM f WHERE win = 0 AND length(v) >= least),
w AS (SELECT rid, kind, ord, s, v, win, bits, unnest(generate_series(0, length(v) - win)) AS j FROM f WHERE win > 0 AND NOT ({allow})),
hot AS (SELECT rid, kind, ord, s + min(j) AS s, s + max(j) + any_value(win) AS e FROM w
        WHERE list_aggregate(string_split(substr(v, j + 1, win), ''), 'entropy') >= bits GROUP BY rid, kind, ord, s){extra},
b AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS txt FROM base GROUP BY rid),
a AS (SELECT rid, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS txt FROM {below} GROUP BY rid)
SELECT doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.k, 0) AS n_access, coalesce(b.h, 0) AS n_hex,
       sha256(coalesce(b.txt, '')) AS base_sha256, coalesce(a.txt, '') AS spans
FROM d LEFT JOIN b ON b.rid = doc_id LEFT JOIN a ON a.rid = doc_id"""
