import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import metric_tree as mt


def brute(rows, k, step):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(mt, "PAGE", 16)
    monkeypatch.setattr(mt, "GROUP", 3)
    monkeypatch.setattr(mt, "BLOCK", 7)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] + spread * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a hot vector, all ties
    rows += [(2000, None), (2010, [None] * 12), (2020, [float("nan")] + [0.0] * 11), (2030, [float("inf")] + [1.0] * 11), (None, [1.0] * 12), (2040, [0.0] * 12), (2050, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, mt.top_k(table, F.col("vec_id") % 10 == 0, 5).collect()))
    assert got == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mt.top_k(table, F.col("vec_id") == 0, 5).collect())) == [(0, 1, 1, -98304), (0, 2, 2, -98304)]
    assert mt.top_k(table.limit(0), F.col("vec_id") == 0, 5).count() == 0
    assert mt.top_k(table, F.col("vec_id") == 9, 5).count() == 0


def test_bounds_save_scores():
    """On clustered vectors most pages are never opened."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(32, 16)) * 400
    x = np.floor(centers[:, None, :] + rng.normal(size=(32, 50, 16)) * 5)
    longest = float((x * x).sum(axis=2).max())
    pivots = mt._lifted(x[:, 0, :], longest)
    pages = []
    for c in range(32):
        lifted = mt._lifted(x[c], longest)
        own = mt._distances(lifted[:1], lifted)[0]
        pages.append({"pivot": c, "parent": 0.0, "radius": float(own.max()), "center": lifted[0].tobytes(), "ids": np.arange(c * 50, c * 50 + 50).tobytes(),
                      "vectors": x[c].astype(np.int32).tobytes(), "own": own.tobytes()})
    queries = x[:, 1, :]
    best, computed = mt.search_group(pages, np.arange(32) * 50 + 1, queries, pivots, longest, 5)
    flat = x.reshape(-1, 16)
    want = np.sort(np.where(np.arange(1600)[None, :] == (np.arange(32) * 50 + 1)[:, None], -np.inf, queries @ flat.T), axis=1)[:, ::-1][:, :5]
    assert np.array_equal(best.scores, want) and computed < 0.5 * 32 * 1600
