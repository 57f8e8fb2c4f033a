"""Ranks and neighbours in a global or per-group order, without a one-task window.

A window over (partition by group order by ...) sends each group to one task, and one
with no partition key sends everything there. Here rows are range-partitioned on
(group, order), so a group may span many partitions; each partition numbers its own
rows and a table with a row per (partition, group) supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def slices(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Range-partitioned rows with their slice number and position in the slice.

    The result is checkpointed: both numbers must stay the same in every later use,
    also when an executor is lost.
    """
    sort_keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    # no fixed width: the session's shuffle width, from which AQE merges small neighbours
    ranged = df.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
    tagged = ranged.withColumn("_tag", F.monotonically_increasing_id())
    return materialize(
        tagged.select(
            *df.columns,
            F.shiftright("_tag", _ROW_BITS).cast("int").alias("_slice"),
            F.col("_tag").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
        )
    )


def ordered_rank(
    df: DataFrame, group: list[str], order: list[Column | str], rank: str = "rn", count: str | None = None
) -> DataFrame:
    """Adds the 1-based rank of each row in its group and, if asked, the group size.

    ``order`` must end in a unique column, so that the result is deterministic.
    """
    cut = slices(df, *group, *order)
    per = cut.groupBy("_slice", *group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # at most one row per (slice, group): a group has no more rows here than there are slices
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if count:
        per = per.withColumn(count, F.sum("_n").over(Window.partitionBy(*group)))
    out = cut.join(per, ["_slice", *group]).withColumn(rank, F.col("_pos") - F.col("_first") + F.col("_skip") + 1)
    return out.select(*df.columns, rank, *([count] if count else []))


def ordered_neighbours(
    df: DataFrame, group: list[str], order: list[Column | str], value: Column | str,
    prev: str = "prev", next: str = "next", wrap: bool = False,
) -> DataFrame:
    """Adds the value before and after each row of its group, optionally wrapping round.

    Inside a slice a window does it; the row at a slice edge looks at the edge
    values of the neighbouring slices.
    """
    value = F.col(value) if isinstance(value, str) else value
    cut = slices(df.withColumn("_v", F.struct(value.alias("v"))), *group, *order)
    inside = Window.partitionBy("_slice", *group).orderBy("_pos")
    edges = cut.groupBy("_slice", *group).agg(
        F.min_by("_v", "_pos").alias("_head"), F.max_by("_v", "_pos").alias("_tail")
    )
    across = Window.partitionBy(*group).orderBy("_slice")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag("_tail").over(across), F.lead("_head").over(across)
    if wrap:
        before = F.coalesce(before, F.last("_tail").over(whole))
        after = F.coalesce(after, F.first("_head").over(whole))
    edges = edges.select("_slice", *group, before.alias("_before"), after.alias("_after"))
    out = (
        cut.withColumn("_p", F.lag("_v").over(inside)).withColumn("_q", F.lead("_v").over(inside))
        .join(edges, ["_slice", *group])
    )
    return out.select(
        *df.columns,
        F.coalesce("_p", "_before")["v"].alias(prev),
        F.coalesce("_q", "_after")["v"].alias(next),
    )
