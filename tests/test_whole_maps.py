"""The registered jobs run with the defaults of the job, not over a smaller one."""

import numpy as np
import pytest

from lumaspark.plans import maps as plans
from lumaspark.registry import maps
from lumaspark.registry.data import points


@pytest.mark.parametrize("name, job", [("viewer_map_spread", "build_viewer"), ("built_map", "build_map")])
def test_jobs_have_no_fewer_rounds_and_no_other_method(spark, monkeypatch, name, job):
    class Seen(Exception):
        pass

    def seen(*args, **options):
        raise Seen(options)

    monkeypatch.setattr(plans, job, seen)
    with pytest.raises(Seen) as got:
        maps.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == {}


@pytest.mark.parametrize("name", ["tsne", "umap", "trimap", "lle"])
def test_projections_run_to_their_end(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def seen(vectors, method, **options):
        raise Seen(options)

    monkeypatch.setattr(maps, "project", seen)
    with pytest.raises(Seen) as got:
        maps.QUERIES[f"projection_{name}"](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == {}


def test_kmeans_ends_at_a_fixed_point(spark):
    """Each point is at its nearest centroid, each centroid the mean of its points."""
    rows = maps.kmeans_converged(spark, "/root/testdata/sf0.001").join(points(spark, "/root/testdata/sf0.001"), "media_id").toPandas()
    xy, label = rows[["x", "y"]].to_numpy(), rows["cluster"].to_numpy()
    names = np.unique(label)
    means = np.stack([xy[label == j].mean(0) for j in names])
    d = ((xy[:, None] - means[None]) ** 2).sum(2)
    assert (d[np.arange(len(xy)), np.searchsorted(names, label)] <= d.min(1) + 1e-9).all()
