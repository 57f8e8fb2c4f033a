"""Vector expressions on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col

SCORE_DECIMALS = 9  # scores closer than this are ties, broken by id


def as_doubles(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once per row: a lambda body evaluates what it names anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def norm(c) -> Column:
    return F.sqrt(F.aggregate(as_doubles(c), F.lit(0.0), lambda s, v: s + v * v))


def l2_normalize(c) -> Column:
    """Unit vector as floats; a zero (or NaN) norm divides by one. Linear in the dimension."""
    def unit(v: Column) -> Column:
        n = norm(v)
        safe = F.when((n == 0) | F.isnan(n), F.lit(1.0)).otherwise(n)
        return bound(safe, lambda d: F.transform(v, lambda x: x / d))

    return bound(as_doubles(c), unit).cast("array<float>")


def cosine(a, b) -> Column:
    """Cosine similarity; null when either side is a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def angular_distance(a, b) -> Column:
    c = cosine(a, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def pick_output(outputs) -> Column:
    """Tensor of a named model output: last_hidden_state, else pooler_output, else the first one."""
    m = _col(outputs)
    return F.coalesce(
        F.try_element_at(m, F.lit("last_hidden_state")),
        F.try_element_at(m, F.lit("pooler_output")),
        F.try_element_at(F.map_values(m), F.lit(1)),
    )


def mean_pool(df: DataFrame, item: str | list[str] = "item_id", hidden: str = "hidden") -> DataFrame:
    """Mean over the sequence of each item, then unit length.

    Summarizer keeps one running vector per item and combines map-side, so a very
    long sequence never gathers in one task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = [item] if isinstance(item, str) else list(item)
    pooled = df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(as_doubles(hidden))).alias("_m"))
    return pooled.select(*keys, l2_normalize(vector_to_array("_m")).alias("vector"))


def split_batch(flat, hidden_size: int) -> Column:
    """Rows of a flat [batch, hidden] output, each at unit length."""
    def rows(c: Column) -> Column:
        count = (F.size(c) / F.lit(hidden_size)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda b: l2_normalize(F.slice(c, b * hidden_size + 1, F.lit(hidden_size))),
        )

    return bound(as_doubles(flat), rows)


def split_sequence_batch(flat, seq_len: int, hidden_size: int) -> Column:
    """Items of a flat [batch, seq, hidden] output: mean over seq, then unit length.

    Sums grow row by row of the sequence, so every number is read once."""
    def items(c: Column) -> Column:
        count = (F.size(c) / F.lit(seq_len * hidden_size)).cast("int")

        def item(b: Column) -> Column:
            start = b * (seq_len * hidden_size)
            sums = F.aggregate(
                F.sequence(F.lit(0), F.lit(seq_len - 1)), F.array_repeat(F.lit(0.0), hidden_size),
                lambda acc, s: F.zip_with(acc, F.slice(c, start + s * hidden_size + 1, F.lit(hidden_size)), lambda x, y: x + y),
                lambda acc: F.transform(acc, lambda x: x / F.lit(float(seq_len))),
            )
            return l2_normalize(sums)

        return F.transform(F.sequence(F.lit(0), count - 1), item)

    return bound(as_doubles(flat), items)
