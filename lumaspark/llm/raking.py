"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells by source, language and topic. A cell's weight starts as its tokens; each round scales the
cells of every source, then language, then topic to that margin's target, until no margin is off by more than
TOLERANCE of itself. The weights' ratio to the tokens then says how often a token of each cell is taken: all by as
much as the mixture is to hold, `keep` of all tokens. By default that is the most that needs no token twice; with
`repeats` a document whose cell asks for more comes as several copies, the whole part of its probability for certain and the
rest by a hash of its id, which else alone decides. So the margins of what is expected are the targets, whatever is kept. Targets that contradict each
other, as cells without documents can make them, end the rounds when these gain no more, with a warning that says by
how much they are missed. Only DataFrame functions; documents are shuffled nowhere, cells are a table written every few rounds.

Topics come from the column given as `topic`; without one they are told by TOPICS, a few patterns.

Null sources and languages are the margin "(none)". Null texts have no tokens; cells without
tokens get the share that is kept overall. Rows that repeat an id stay or go together, null ids
as one. Targets name the margins they know; a margin without a target keeps its natural share
of what the named ones leave, and targets are scaled to sum to one. Empty tables stay empty.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.llm.tables import Steps, text_of

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 400  # a bound for targets that are met ever more slowly
AT_ONCE = 4  # rounds between written tables
TOLERANCE = 1e-9  # share of a margin that it may be off
POWER = 0.8  # natural shares to this power are the targets where none are given
SEED = 11
WORDS = r"[^\x20\x09-\x0D]+"
# first pattern that a text matches names its topic
TOPICS = (
    ("licensing", r"(?i)\blicen[cs]ed? "),
    ("credentials", r"(?i)\b(password|passwd|secret|token|api_?key)\b *[:=]"),
    ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("links", r"https?://"),
)


def topic_of(text: Column, topics=TOPICS) -> Column:
    return reduce(lambda rest, t: F.when(text.rlike(t[1]), t[0]).otherwise(rest), reversed(topics), F.lit("general"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """Rows under positional names, beside key, the three margins and tokens."""
    text = text_of(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    labels = {"source": F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")),
              "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("(none)")),
              "topic": F.coalesce(topic if topic is not None else topic_of(text), F.lit("(none)"))}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                       F.col(id_col).alias("key"), *(v.alias(k) for k, v in labels.items()),
                       F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("tokens"))


def margin_targets(cells: DataFrame, dim: str, given: dict[str, float] | None, power: float = POWER) -> DataFrame:
    """(dim, target): shares that sum to one."""
    margins = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
    if given is None:
        raw = F.pow(F.col("n"), F.lit(power))
    else:
        named = reduce(lambda rest, kv: F.when(F.col(dim) == kv[0], F.lit(float(kv[1]))).otherwise(rest), given.items(), F.lit(None).cast("double"))
        rest = max(0.0, 1.0 - sum(given.values()))
        margins = margins.withColumn("named", named)
        left = margins.filter("named IS NULL").agg(F.sum("n").alias("left_n"))
        margins = margins.join(F.broadcast(left))  # one row
        raw = F.coalesce("named", F.col("n") / F.nullif("left_n", F.lit(0.0)) * rest, F.lit(0.0))
    margins = margins.select(dim, raw.alias("raw"))
    total = margins.agg(F.sum("raw").alias("total"))
    return margins.join(F.broadcast(total)).select(dim, F.coalesce(F.col("raw") / F.nullif("total", F.lit(0.0)), F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, steps: Steps, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
         power: float = POWER, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(source, lang, topic, tokens, weight) from (source, lang, topic, tokens), weights adding up to all tokens, and by how much of itself
    the worst margin is off."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        state = state.join(margin_targets(cells, d, (targets or {}).get(d), power).withColumnRenamed("target", f"goal_{d}"), d)
    state = steps.write(state.withColumn("off", F.lit(0.0)), "weights")
    columns, off, done = state.columns, float("inf"), 0
    while done < rounds:
        before, last = state, off
        for _ in range(min(AT_ONCE, rounds - done)):
            found = F.lit(0.0)
            for dim in DIMENSIONS:
                have = F.sum("weight").over(Window.partitionBy(dim))
                goal = F.col(f"goal_{dim}") * total
                state = state.withColumn("scale", F.when(have > 0, goal / have).otherwise(F.when(goal > 0, F.lit(float("inf"))).otherwise(1.0)))
                state = state.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * F.col("scale")).otherwise(0.0)).withColumn(
                    f"off_{dim}", F.when(F.col("scale") > 0, F.abs(1 / F.col("scale") - 1)).otherwise(0.0))
            found = F.greatest(*(F.col(f"off_{d}") for d in DIMENSIONS))
            state, done = state.withColumn("off", found).select(*columns), done + 1
        state = steps.write(state, "weights")
        steps.drop(before)
        off = state.agg(F.max("off")).first()[0] or 0.0  # of the margins as the last round found them
        if off <= tolerance or off > 0.98 * last:
            break
    if off > max(tolerance, 1e-6) and done >= AT_ONCE:
        warnings.warn(f"targets of the mixture are missed by up to {off:.2%} of a margin", stacklevel=2)
    return state.select(*DIMENSIONS, "tokens", "weight"), off


def _mixed(rows, steps, targets, rounds, keep, power, seed, repeats) -> DataFrame:
    """Labelled rows with the probability of their cell, and how many copies are kept."""
    cells = steps.write(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    weights, _ = rake(cells, steps, targets, rounds, power)
    most = weights.filter("weight > 0").agg(F.min(F.col("tokens") / F.col("weight")).alias("most")).first()["most"]
    most = 1.0 if most is None else min(1.0, most)
    if keep is None or (keep > most and not repeats):
        if keep is not None:
            warnings.warn(f"without repeats the mixture holds {most:.3f} of all tokens, not {keep:.3f}", stacklevel=3)
        keep = most
    p = F.when(F.col("tokens") > 0, F.lit(float(keep)) * F.col("weight") / F.col("tokens")).otherwise(F.lit(float(keep)))
    p = p if repeats else F.least(p, F.lit(1.0))
    weights = weights.select(*DIMENSIONS, p.alias("probability"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256), 1, 13)
    uniform = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    # written cells have a known size: a small table is broadcast, a large one is a plain join
    whole = F.floor("probability").cast("int")
    return rows.join(weights, list(DIMENSIONS)).withColumn("copies", whole + (uniform < F.col("probability") - whole).cast("int"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
                  keep: float | None = None, power: float = POWER, seed: int = SEED, repeats: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, probability (above one only with repeats), kept and copies."""
    steps = Steps(docs.sparkSession, "raking")
    rows = _labelled(docs, id_col, text_col, source_col, lang_col, topic).select("key", *DIMENSIONS, "tokens")
    rows = steps.write(rows, "labelled")  # the texts are read once
    mixed = _mixed(rows, steps, targets, rounds, keep, power, seed, repeats)
    return mixed.select(F.col("key").alias("doc_id"), *DIMENSIONS, "tokens", "probability", (F.col("copies") > 0).alias("kept"), "copies")


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                   topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
                   keep: float | None = None, power: float = POWER, seed: int = SEED, repeats: bool = False) -> DataFrame:
    """The rows of docs that mix_documents keeps, with all their columns; with repeats as many times as it says."""
    rows = _labelled(docs, id_col, text_col, source_col, lang_col, topic)
    mixed = _mixed(rows, Steps(docs.sparkSession, "raking"), targets, rounds, keep, power, seed, repeats).filter("copies > 0")
    if repeats:
        mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def margins(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER) -> DataFrame:
    """(dim, value, target, expected): the share of each margin that is aimed at, and that rows of mix_documents are expected to have."""
    cells = mixed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("weight"))
    out = []
    for dim in DIMENSIONS:
        goal = margin_targets(cells, dim, (targets or {}).get(dim), power)
        have = cells.groupBy(dim).agg(F.sum("weight").alias("weight")).join(F.broadcast(cells.agg(F.sum("weight").alias("all"))))  # one row
        have = have.select(dim, (F.col("weight") / F.nullif("all", F.lit(0.0))).alias("expected"))
        out.append(goal.join(have, dim).select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), "target", "expected"))
    return reduce(DataFrame.unionByName, out)


def oracle(table: str = "documents", rounds: int = 200) -> str:
    """mix_documents with its defaults as SQL: the fit as a recursion of so many rounds, more than it takes to settle."""
    cases = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in TOPICS)
    goals = [f"""g_{d} AS (SELECT {d}, coalesce(raw / nullif(sum(raw) OVER (), 0), 0) * (SELECT sum(tokens) FROM cells) AS goal_{d} FROM
      (SELECT {d}, pow(sum(tokens)::DOUBLE, {POWER}) AS raw FROM cells GROUP BY {d}))""" for d in DIMENSIONS]
    scaled = "SELECT * FROM fit WHERE n < " + str(rounds)
    for d in DIMENSIONS:
        scaled = f"SELECT * REPLACE (CASE WHEN weight > 0 THEN weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END AS weight) FROM ({scaled})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM {table}),
l AS (SELECT doc_id, source, lang, CASE {cases} ELSE 'general' END AS topic, len(regexp_extract_all(text, '{WORDS}')) AS tokens FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM l GROUP BY ALL),
{', '.join(goals)},
fit AS (SELECT 0 AS n, *, tokens::DOUBLE AS weight FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)
  UNION ALL SELECT * REPLACE (n + 1 AS n) FROM ({scaled})),
last AS MATERIALIZED (SELECT source, lang, topic, tokens, weight FROM fit WHERE n = {rounds}),
k AS (SELECT least(1.0, coalesce(min(tokens / weight), 1.0)) AS keep FROM last WHERE weight > 0),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, (SELECT keep FROM k) * weight / tokens) ELSE (SELECT keep FROM k) END AS p FROM last),
u AS (SELECT l.*, p, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM l JOIN p USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, p >= 1 OR u < p AS kept, (p >= 1 OR u < p)::INTEGER AS copies FROM u"""
