"""Projections of vectors to the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumaspark.operators.knn import neighbour_count
from lumaspark.operators.project import forces, graph, linear, stress

METHODS = ("TSNE", "PCA", "ISOMAP", "LLE", "MDS", "SAMMON", "TriMap", "UMAP")


class ProjectionError(RuntimeError):
    """A projection failed; the message names the method."""


def project(vectors: DataFrame, method: str = "TSNE", seed: int = 0, key: str = "media_id", **options) -> DataFrame:
    """(media_id, x, y) by one of METHODS; an unknown method means UMAP.

    Neighbour-based methods use up to 15 neighbours, never more than there are.
    """
    try:
        rows = vectors.selectExpr(f"{key} AS media_id", "cast(vector AS array<double>) AS vector")
        n = rows.count()
        k = neighbour_count(n)
        if n == 0:
            return rows.sparkSession.createDataFrame([], "media_id bigint, x double, y double")
        if n == 1:
            return rows.selectExpr("media_id", "0.0D AS x", "0.0D AS y")
        if n == 2 or method == "PCA":
            return linear.pca(rows)
        if method == "MDS":
            return linear.classical_mds(rows)
        if method == "SAMMON":
            return stress.sammon(rows, seed=seed, **options)
        if method == "ISOMAP":
            return graph.isomap(rows, k, seed=seed, **options)
        if method == "LLE":
            return graph.lle(rows, k, **options)
        if method == "TSNE":
            return forces.tsne(rows, n, seed=seed, **options)
        if method == "TriMap":
            return forces.trimap(rows, n, seed=seed, **options)
        return forces.umap(rows, n, k, seed=seed, **options)
    except Exception as e:
        raise ProjectionError(f"{method} projection failed: {e}") from e
