"""Quality by co-training: a classifier of the text and one of its metadata teach each other.

The content view sees only vocabulary (hashed words and symbol runs) and is a naive Bayes
model. The metadata view sees only provenance and layout (source, language, lengths, lines,
shares of character classes and of repeated words) and is a logistic regression. Both start
from labelled documents; in each round a view's confident opinions on an unlabelled pool
become labels for the other view. At the end each view's log-odds are calibrated on labelled
documents that took no part in the fit, by a logistic regression over both, which gives every document's score.

The fit uses at most FIT_ROWS labelled documents and as many of the pool, of FIT_CHARS at most, those whose ids hash
lowest, and runs on the driver; scoring is one pass over all documents, whole texts, without a shuffle.

Null texts, sources and languages are empty, null lengths the text's own. Labels without a value or an id are ignored; where
an id is labelled twice the higher value holds. Without labels of both kinds every score is one.
Rows that repeat an id are scored each. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import small_batches, text_of

FIT_ROWS = 8_000
FIT_CHARS = 200_000  # longer documents are scored, but not fitted on
ROUNDS = 3
CONFIDENT = 0.98
CUT = 0.3
BUCKETS = 1 << 16
TAGS = 64  # hashed sources and languages
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + b".,;:'\"?-")


def content(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed vocabulary of a text: buckets, and 1 + log of their counts as shares."""
    counts = Counter(_TOKEN.findall(text.lower()))
    at = np.fromiter((xxhash.xxh32_intdigest(t) & (BUCKETS - 1) for t in counts), np.int64, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    return at, value / max(1.0, value.sum())


def metadata(text: str, source: str, lang: str, n_chars: int | None) -> np.ndarray:
    """Provenance and layout of a document as a fixed row of numbers."""
    data = text.encode()
    n = max(1, len(data))
    share = [1 - len(data.translate(None, c)) / n for c in (_UPPER, _DIGITS, _SYMBOLS, _LETTERS)]
    words = text.split()
    counts = Counter(words)
    lines = [len(x) for x in text.split("\n")]
    n_words = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words
    numbers = [
        *share, np.log1p(len(text) if n_chars is None else max(0, n_chars)), np.log1p(len(lines)), np.log1p(sum(lines) / len(lines)),
        len(counts) / n_words, max(counts.values(), default=0) / n_words, same, np.log1p(n / n_words), float(not words),
        np.log1p(sum(w.isupper() and len(w) > 1 for w in words)) / np.log1p(n_words),
    ]
    tags = np.zeros(TAGS)
    tags[xxhash.xxh32_intdigest("s:" + source) % TAGS] += 1
    tags[xxhash.xxh32_intdigest("l:" + lang) % TAGS] += 1
    return np.concatenate([numbers, np.square(numbers[:4]), tags])


@dataclass
class NaiveBayes:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0

    def fit(self, rows: list, labels: np.ndarray) -> NaiveBayes:
        totals = np.full((2, BUCKETS), 1e-4)
        for (at, value), y in zip(rows, labels, strict=True):
            np.add.at(totals[y], at, value)
        share = np.log(totals / totals.sum(1, keepdims=True))
        self.weights = (share[1] - share[0]) * 20.0  # log-odds of a document of twenty mean words: its length says nothing
        self.bias = float(np.log((labels == 1).sum() + 1) - np.log((labels == 0).sum() + 1))
        return self

    def log_odds(self, rows: list) -> np.ndarray:
        return np.array([self.bias + self.weights[at] @ value for at, value in rows])


@dataclass
class Logistic:
    """Regularised logistic regression by Newton steps on standardised columns."""

    penalty: float = 1.0
    coef: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        self.coef = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = sigmoid(z @ self.coef)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * self.coef)
            self.coef -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.coef


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    content: NaiveBayes
    meta: Logistic
    both: Logistic

    def scores(self, contents: list, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.log_odds(contents), self.meta.log_odds(metas)
        return sigmoid(a), sigmoid(b), sigmoid(self.both.log_odds(np.stack([np.clip(a, -20, 20), np.clip(b, -20, 20)], axis=1)))


def co_train(contents: list, metas: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model | None:
    """labels: 1, 0, or -1 for the pool. Every fifth labelled document is kept for the calibration."""
    known = np.nonzero(labels >= 0)[0]
    held, train, pool = known[::5], np.delete(known, np.s_[::5]), np.nonzero(labels < 0)[0]
    if any(len(set(labels[part].tolist())) < 2 for part in (held, train)):
        return None
    taught = [(train, labels[train])] * 2  # what the content and the metadata view learn from
    for n in range(rounds + 1):
        views = (NaiveBayes().fit([contents[i] for i in taught[0][0]], taught[0][1]), Logistic().fit(metas[taught[1][0]], taught[1][1]))
        if n == rounds or not len(pool):
            break
        odds = [views[0].log_odds([contents[i] for i in pool]), views[1].log_odds(metas[pool])]
        sure = [np.abs(o) > np.log(confident / (1 - confident)) for o in odds]
        taught = [(np.concatenate([train, pool[sure[1 - v]]]), np.concatenate([labels[train], (odds[1 - v][sure[1 - v]] > 0).astype(int)])) for v in (0, 1)]
    a, b = views[0].log_odds([contents[i] for i in held]), views[1].log_odds(metas[held])
    both = Logistic(penalty=0.1).fit(np.stack([np.clip(a, -20, 20), np.clip(b, -20, 20)], axis=1), labels[held])
    return Model(*views, both)


def _inputs(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str | None) -> list:
    chars = F.col(chars_col).cast("bigint") if chars_col else F.lit(None).cast("bigint")
    return [F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), chars.alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        chars_col: str | None = "n_chars", label_col: str = "quality", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model | None:
    by_hash = F.xxhash64("doc_id")
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(*_inputs(docs, id_col, text_col, source_col, lang_col, chars_col))
    short = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") <= FIT_CHARS))
    ids = short.select("doc_id").distinct()
    labelled = ids.join(known, "doc_id").orderBy(by_hash, "doc_id").limit(fit_rows)
    pool = ids.join(known, "doc_id", "left_anti").orderBy(by_hash, "doc_id").limit(fit_rows).withColumn("y", F.lit(-1))
    chosen = labelled.unionByName(pool)  # 2 * fit_rows rows at most

    def featurise(batches):
        for batch in batches:
            c = batch.to_pydict()
            pairs = [content(t) for t in c["text"]]
            metas = [metadata(*x).tolist() for x in zip(c["text"], c["source"], c["lang"], c["n_chars"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(c["y"], pa.int32()), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                                              pa.array([p[1] for p in pairs], pa.list_(pa.float32())), pa.array(metas, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "at", "value", "meta"])

    sample = short.join(F.broadcast(chosen), "doc_id").mapInArrow(featurise, "doc_id long, y int, at array<int>, value array<float>, meta array<double>")
    got = sample.toArrow().combine_chunks()
    if not len(got):
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    at, value = _lists(got, "at"), _lists(got, "value")
    contents = [(at[i], value[i]) for i in order]
    return co_train(contents, np.stack(_lists(got, "meta"))[order], got["y"].to_numpy()[order], rounds)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """The lists of a column as views of one array, which frees all its memory at once."""
    lists = [chunk for chunk in table[name].chunks]
    return [view for c in lists for view in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])]


_SCORES = "content_score double, meta_score double, score double"


def _score(model: Model | None):
    def run(batches):
        for batch in batches:
            c = batch.to_pydict()
            n = len(c["text"])
            if model is None or not n:
                scores = [np.ones(n)] * 3
            else:
                scores = model.scores([content(t) for t in c["text"]], np.stack([
                    metadata(*x) for x in zip(c["text"], c["source"], c["lang"], c["n_chars"], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores)],
                                             names=["doc_id", "content_score", "meta_score", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    lang_col: str = "lang", chars_col: str | None = "n_chars", label_col: str = "quality", cut: float = CUT,
                    fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, content_score, meta_score, score (probability of good quality) and keep."""
    small_batches(docs.sparkSession)
    columns = (id_col, text_col, source_col, lang_col, chars_col)
    model = fit(docs, labels, *columns, label_col, fit_rows, rounds)
    rows = docs.select(*_inputs(docs, *columns))
    return rows.mapInArrow(_score(model), f"doc_id long, {_SCORES}").withColumn("keep", F.col("score") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              lang_col: str = "lang", chars_col: str | None = "n_chars", label_col: str = "quality", cut: float = CUT,
              fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs with a score of `cut` or more, with all their columns."""
    small_batches(docs.sparkSession)
    columns = (id_col, text_col, source_col, lang_col, chars_col)
    model = fit(docs, labels, *columns, label_col, fit_rows, rounds)
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)

    def run(batches):
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            c = [batch.column(n).to_pylist() for n in places]
            text, source, lang = ([x or "" for x in col] for col in c[:3])
            scores = model.scores([content(t) for t in text], np.stack([metadata(*x) for x in zip(text, source, lang, c[3] if chars_col else [None] * len(text), strict=True)]))[2]
            yield batch.filter(pa.array(scores >= cut))

    places = [names[docs.columns.index(n)] for n in columns[1:] if n]
    return wide.mapInArrow(run, wide.schema).toDF(*docs.columns)
