"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import Steps


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs; root is the smallest node reachable.

    Each round gives a node the smallest label among its own and its neighbours', then the label
    of that label, so paths shorten by halves. Rounds go on until no label changes; each is a
    written table. Sums over neighbours are combined before the shuffle, and joins are plain, so
    adaptive execution may split a node with very many edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = steps.write(both, "edges")
    labels = steps.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                         .select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jumped"))
        after = steps.write(hooked.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("jumped", "low")).alias("root"), F.col("root").alias("was")), "labels")
        changed = after.filter("root <> was").limit(1).count()
        steps.drop(labels)
        labels = after
        if not changed:
            steps.drop(both)
            return labels.select("node", "root")
