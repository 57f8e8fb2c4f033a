"""Vectors from text, media bytes and captions, through a model the caller supplies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lumaspark.functions.keys import caption_key
from lumaspark.functions.text import prefix_text
from lumaspark.session import materialize

DIMS = 768
_WORD = re.compile(r"[a-z0-9]+")


def hashed_words(dims: int = DIMS) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Offline stand-in for a text model: counts of words hashed to ``dims`` buckets.

    It finds shared words, not meaning. Pass a real model's factory in its place.
    """
    def make():
        seen: dict[str, int] = {}

        def bucket(word: str) -> int:
            if word not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[word] = int(md5(word.encode()).hexdigest()[:8], 16) % dims
            return seen[word]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for i, t in enumerate(texts):
                hits = [bucket(w) for w in _WORD.findall((t or "").lower())]
                if hits:
                    out[i] = np.bincount(hits, minlength=dims)
            return out

        return predict

    return make


def _at_unit_length(make_predict_fn):
    def make():
        predict = make_predict_fn()

        def run(texts: np.ndarray) -> np.ndarray:
            m = np.asarray(predict(texts), dtype=np.float64)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return (m / np.where(n > 0, n, 1.0)).astype(np.float32)

        return run

    return make


def embed_text(df: DataFrame, task: str = "query", text: str = "text", make_predict_fn=None,
               batch_size: int = 256) -> DataFrame:
    """Adds the unit vector of a text, given the task prefix its model expects."""
    from pyspark.ml.functions import predict_batch_udf

    model = predict_batch_udf(_at_unit_length(make_predict_fn or hashed_words()),
                              return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn("vector", model(prefix_text(text, task)))


def embed_one(text: str, make_predict_fn=None) -> list[float]:
    """Vector of one query text, computed where the query was typed."""
    v = np.asarray((make_predict_fn or hashed_words())()(np.array([text], dtype=object)))[0].astype(float)
    n = float(np.sqrt((v * v).sum())) or 1.0
    return [float(x) for x in v / n]


Infer = Callable[[list], Iterable]


def embed_media(df: DataFrame, model_fn: Callable[[], Infer], batch_size: int = 1, content: str = "content",
                key: str = "media_id", dims: int = DIMS) -> DataFrame:
    """Vectors of media bytes: (key, vector, ok, error).

    ``model_fn`` is called once per task and returns a function from a list of inputs to
    a list of vectors. A batch that raises, and an input the model answers with None,
    give zero vectors with ok = false, which must not reach the cache, and say why in ``error``.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"{key} {fields[key]}, vector array<float>, ok boolean, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model_fn()
        for pdf in batches:
            ids, data, vecs, oks, errors = list(pdf[key]), list(pdf[content]), [], [], []
            for at in range(0, len(ids), batch_size):
                part, why = data[at:at + batch_size], "no vector for this input"
                try:
                    got = list(infer(part))
                    if len(got) != len(part):
                        raise ValueError("model returned a different number of vectors")
                except Exception as e:  # noqa: BLE001 - any model failure marks its batch
                    got, why = [None] * len(part), f"{type(e).__name__}: {e}"
                for v in got:
                    oks.append(v is not None)
                    errors.append(why if v is None else None)
                    vecs.append(np.zeros(dims, np.float32) if v is None else _unit(v))
            yield pd.DataFrame({key: ids, "vector": vecs, "ok": oks, "error": errors})

    return df.select(key, content).mapInPandas(run, schema)


def _unit(v) -> np.ndarray:
    a = np.asarray(v, dtype=np.float64)
    n = float(np.sqrt((a * a).sum()))
    return (a / (n if n > 0 else 1.0)).astype(np.float32)


def caption_lookup(files: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds the stored caption of each file, null where there is none yet."""
    keyed = files.withColumn("caption_key", caption_key())
    return keyed.join(captions.select("caption_key", "caption"), "caption_key", "left")


def caption_and_embed(files: DataFrame, captions: DataFrame, caption_fn: Callable[[], Callable[[list], Iterable[str]]],
                      make_text_fn=None, content: str = "content", batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Describes the files that have no caption and embeds every caption as a document.

    Returns (files with caption and vector, new caption rows to store).
    """
    found = caption_lookup(files, captions)
    fields = {f.name: f.dataType.simpleString() for f in found.schema}
    missing = found.where(F.col("caption").isNull()).select("caption_key", content)

    def describe(batches):
        fn = caption_fn()
        for pdf in batches:
            texts: list[str] = []
            for at in range(0, len(pdf), batch_size):
                texts += [str(t).strip() for t in fn(list(pdf[content][at:at + batch_size]))]
            yield pd.DataFrame({"caption_key": pdf["caption_key"], "caption": texts})

    distinct = missing.groupBy("caption_key").agg(F.first(content).alias(content))
    # both results read the new captions; the model must run once
    fresh = materialize(distinct.mapInPandas(describe, f"caption_key {fields['caption_key']}, caption string"))
    filled = found.drop("caption").join(
        found.select("caption_key", "caption").where(F.col("caption").isNotNull()).distinct().unionByName(fresh),
        "caption_key", "left",
    )
    return embed_text(filled, "document", "caption", make_text_fn), fresh
