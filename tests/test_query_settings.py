"""Registered fits run at the study's settings."""

import inspect
from types import SimpleNamespace

import pytest

from pulsegrid.operators import classify, clusters, effects
from pulsegrid.plans import multivariate_queries as Q, source_queries


class Called(Exception):
    pass


@pytest.mark.parametrize("module, operator, plan, want", [
    (clusters, "pam", Q.pam_clusters, {"n_init": 8, "max_iter": 100}),
    (clusters, "silhouette_sweep", Q.silhouette_sweep, {"ks": range(2, 9), "n_init": 10}),
    (clusters, "subsampled_labels", Q.consensus_runs, {"runs": 100, "algorithms": ("kmeans", "gmm", "pam")}),
    (classify, "forest", Q.forest_classification, {"permutations": 60}),
    (effects, "huber_slope", source_queries.huber_slope, {"max_iter": 50, "tolerance": 1e-8})])
def test_settings(spark, monkeypatch, module, operator, plan, want):
    real, got = getattr(module, operator), {}

    def spy(*args, **named):
        bound = inspect.signature(real).bind(*args, **named)
        bound.apply_defaults()
        got.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, operator, spy)
    rows = [(i, i % 3, [float((i * (j + 3)) % 7) if j < 5 else 0.0 for j in range(64)]) for i in range(30)]
    t = SimpleNamespace(embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"),
                        supplier=spark.createDataFrame([(1, 1, 2.0)], "s_nationkey long, s_suppkey long, s_acctbal double"))
    with pytest.raises(Called):
        plan(t)
    assert {k: got[k] for k in want} == want
    if operator in ("silhouette_sweep", "subsampled_labels"):
        assert 1 < len(got["df"].first()["scores"]) <= 5


def test_subsamples_are_clustered_by_medoids_too(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 100, 1.0 * (i % 2)]) for i in range(20)], "id long, x array<double>")
    labels = [r["labels"] for r in clusters.subsampled_labels(rows, "id", 2, runs=1, algorithms=("pam",)).orderBy("id").collect()]
    assert sum(x[0] is not None for x in labels) == 16
    assert len({x[0] for x in labels[0::2] if x[0] is not None}) == 1 and len({x[0] for x in labels if x[0] is not None}) == 2
