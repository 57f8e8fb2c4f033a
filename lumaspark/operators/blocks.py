"""Joins of two large sides whose rows all may meet, cut into bounded blocks.

Each side is split per cell into blocks of at most about ``block_rows`` rows, and one
task sees one pair of blocks as arrays. No pair of rows is ever a row of a DataFrame:
the kernel returns what it reduced the block pair to. A cell that holds a third of all
rows becomes many block pairs, not one large task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.session import materialize

BLOCK_ROWS = 4096


def _crowded(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Cells that need more than one block on a side, with the blocks per side. Fewer of
    them exist than rows / block_rows."""
    both = left.select("_cell", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("_cell", F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy("_cell").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    # a cell that one side lacks has nothing to meet
    many = counts.where(((F.col("l") > block_rows) | (F.col("r") > block_rows)) & (F.col("l") > 0) & (F.col("r") > 0))
    return many.select("_cell", F.ceil(F.col("l") / block_rows).cast("int").alias("_nl"),
                       F.ceil(F.col("r") / block_rows).cast("int").alias("_nr"))


def block_join(
    left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, left_id: Column, right_id: Column, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Applies ``kernel`` to every pair of blocks that share a ``_cell``.

    Both sides carry ``_cell``. A row that matters to several cells appears once in each.
    The ids only spread rows over blocks, evenly and the same way on every attempt.
    """
    crowded = materialize(_crowded(left, right, block_rows))
    if crowded.isEmpty():
        return pair_groups(left, right, ["_cell"], kernel, schema)

    def cut(side: DataFrame, own: str, other: str, ident: Column, own_block: str, other_block: str) -> DataFrame:
        sized = side.join(crowded, "_cell", "left").fillna(1, ["_nl", "_nr"])
        return (
            sized.withColumn(own_block, F.pmod(F.xxhash64(ident, F.lit(17)), F.col(own)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_nl", "_nr")
        )

    a = cut(left, "_nl", "_nr", left_id, "_lb", "_rb")
    b = cut(right, "_nr", "_nl", right_id, "_rb", "_lb")
    return pair_groups(a, b, ["_cell", "_lb", "_rb"], kernel, schema)


def pair_groups(left: DataFrame, right: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    """Cogroup of two sides that may stem from the same rows (fresh column names tell them apart)."""
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, schema)
