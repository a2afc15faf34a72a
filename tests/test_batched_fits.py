"""Labellings drawn by blocks, forests grown together, clusterings of many runs, Ward's hierarchy: against brute force."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import batched as BM, classify as L, clusters as K, forest as FO, labellings as LB, ward as WD


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1, 2], [40, 30, 22])
    x = rng.normal(size=(len(y), 3)) + np.array([[0, 0, 0], [5, 0, 0], [0, 5, 1]])[y]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label int, x array<double>")
    return df, x, y


def cells_of(lab):
    """{p: {id: cell}} of all labellings."""
    def work(blocks):
        import pandas as pd
        for b in blocks:
            for p in range(b.first, b.stop):
                yield pd.DataFrame({"p": p, "id": b.ids, "cell": b.cells(p), "code": b.codes})
    out = {}
    for r in lab.run(work, "p int, id long, cell int, code int").collect():
        out.setdefault(r["p"], {})[r["id"]] = (r["cell"], r["code"])
    return out


@pytest.mark.parametrize("block_cells", [1 << 20, 60])
def test_labellings_keep_cell_sizes(clouds, monkeypatch, block_cells):
    monkeypatch.setattr(LB, "BLOCK_CELLS", block_cells)
    df, _, y = clouds
    lab = LB.labellings(df.repartition(5).withColumn("b", F.lit(1)), "id", "label", "x", 12, 5, seed=4)
    assert lab.n_blocks == (1 if block_cells > 1000 else 5)
    found = cells_of(lab)
    assert sorted(found) == list(range(13))
    want = [n // 5 + (f < n % 5) for n in (40, 30, 22) for f in range(5)]
    for p, cells in found.items():
        assert len(cells) == len(y) and np.bincount([c for c, _ in cells.values()], minlength=15).tolist() == want
    assert all(cell // 5 == y[i] == code for i, (cell, code) in found[0].items())
    moved = [sum(cell // 5 != code for cell, code in found[p].values()) for p in range(1, 13)]
    assert min(moved) > 30 and len({tuple(sorted((i, c) for i, (c, _) in cells.items())) for cells in found.values()}) == 13
    again = cells_of(LB.labellings(df.repartition(2), "id", "label", "x", 12, 5, seed=4))
    if block_cells > 1000:
        assert again == found


def test_permuted_classes_are_uniform(clouds):
    df, _, y = clouds
    found = cells_of(LB.labellings(df, "id", "label", "x", 400, 1, seed=9))
    share = np.mean([[found[p][i][0] == 0 for i in range(len(y))] for p in range(1, 401)], axis=0)
    assert abs(share - 40 / 92).max() < 5 * (0.25 / 400) ** 0.5


def test_quota_above_numpys_limit():
    rng = np.random.default_rng(0)
    left = np.array([3 * 10 ** 9, 10 ** 9, 5])
    draws = np.array([LB.quota(rng, left, 1000) for _ in range(50)])
    assert (draws.sum(axis=1) == 1000).all() and abs(draws[:, 0].mean() - 750) < 15 and draws[:, 2].max() <= 5


def test_rows_without_label_or_vector_take_no_part(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, None, [2.0]), (3, 1, None), (4, 1, [3.0])], "id long, label int, x array<double>")
    assert set(cells_of(LB.labellings(df, "id", "label"))[0]) == {1, 4}
    assert LB.labellings(df.where("id > 9"), "id", "label") is None


@pytest.mark.parametrize("model", ["lda", "pls"])
def test_linear_models_equal_fits_fold_by_fold(clouds, model):
    df, x, y = clouds
    lab = L.fold_labellings(df, "id", "label", "x", 3, 5, 1, 2)
    cells = cells_of(lab)
    got = {(r["p"], r["fold"], r["code"]): (r["hits"], r["seen"]) for r in L.linear_counts(lab, model).groupBy("p", "fold", "code").agg(
        F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect()}
    want = {}
    for p, own in cells.items():
        cell = np.array([own[i][0] for i in range(len(y))])
        code, fold = cell // 5, cell % 5
        for k in range(5):
            train = fold != k
            n = np.bincount(code[train], minlength=3).astype(float)
            sums = np.array([x[train & (code == c)].sum(0) for c in range(3)])
            w = (L.lda if model == "lda" else L.pls)(n, sums, x[train].T @ x[train])
            guess = (np.hstack([x, np.ones((len(x), 1))]) @ w.T).argmax(1)
            for c in range(3):
                mine = (fold == k) & (code == c)
                want[p, k, c] = (float((guess[mine] == c).sum()), float(mine.sum()))
    assert got == want


def test_best_split_is_the_largest_fall_of_impurity():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (6, 3, 5, 3)).astype(float)
    counts[:, 1:] = counts[:, :1, :, :][:, :, rng.permutation(5)]  # every feature sees the same rows
    counts[5] = 0
    counts[5, :, 2, 1] = 7  # pure: no split
    drawn = np.array([[4, 8, 9]] * 6)
    feature, cut, children = FO._best_splits(counts, drawn)
    assert feature[5] == -1

    def impurity(v):
        return v.sum() - (v ** 2).sum() / v.sum() if v.sum() else 0.0
    for node in range(5):
        best = min(impurity(counts[node, j, :b + 1].sum(0)) + impurity(counts[node, j, b + 1:].sum(0)) for j in range(3) for b in range(4))
        assert impurity(children[node, 0]) + impurity(children[node, 1]) == pytest.approx(best)
        j = list(drawn[node]).index(feature[node])
        assert np.array_equal(children[node, 0], counts[node, j, :cut[node] + 1].sum(0))


def test_forest_judges_clouds(clouds, monkeypatch):
    df, _, _ = clouds
    one = L.forest(df, "id", "label", trees=15, permutations=12, seed=2).first()
    assert one["acc"] > 0.9 and one["p_value"] == pytest.approx(1 / 13) and 0.2 < one["null_mean"] < 0.5 and (one["n"], one["classes"]) == (92, 3)
    few = L.forest(df, "id", "label", trees=5, permutations=2, seed=2).first()
    monkeypatch.setattr(FO, "TREE_BYTES", 1)  # a labelling at a time
    assert L.forest(df, "id", "label", trees=5, permutations=2, seed=2).first() == few
    monkeypatch.setattr(LB, "BLOCK_CELLS", 60)
    assert L.forest(df, "id", "label", trees=15, seed=2).first()["acc"] > 0.9
    assert L.forest(df.where("label = 0 OR id = 45"), "id", "label") is None


def test_task_list(clouds):
    df, _, _ = clouds
    tasks = {"all": ({0: "a", 1: "b", 2: "c"}, "lda"), "two": ({0: "a", 1: "b"}, "pls"), "pooled": ({0: "a", 1: "x", 2: "x"}, "lda"), "few": ({0: "a", 7: "z"}, "lda")}
    got = {r["task"]: r for r in L.task_list(df, "id", "label", tasks, permutations=24).collect()}
    assert [got[t]["n"] for t in tasks] == [92, 70, 92, None] and [got[t]["classes"] for t in tasks] == [3, 2, 2, None]
    assert all(got[t]["verdict"] == "SIGNIFICANT" and got[t]["acc"] > 0.8 for t in ("all", "two", "pooled")) and got["few"]["verdict"] == "too few per class"


# ---- clusterings of many runs

@pytest.mark.parametrize("block_cells", [1 << 20, 60])
def test_runs_are_clustered_to_a_fixed_point(clouds, monkeypatch, block_cells):
    monkeypatch.setattr(LB, "BLOCK_CELLS", block_cells)
    df, x, _ = clouds
    lab = BM.subsamples(df, "id", "x", 4, 0.8, seed=1)
    inside = {r: np.array(sorted(i for i, (c, _) in own.items() if c == 0)) for r, own in cells_of(lab).items()}
    assert sorted(inside) == [1, 2, 3, 4] and all(len(v) == int(0.8 * 92) for v in inside.values())
    centres = BM.lloyd(lab, (2, 3), starts=5)
    for k, r in itertools.product((2, 3), inside):
        part, c = x[inside[r]], centres[k][r - 1]
        own = ((part[:, None] - c) ** 2).sum(2).argmin(1)
        assert np.allclose([part[own == j].mean(0) for j in range(k)], c)
    three = centres[3]
    assert all(sorted(np.round(m / 5).astype(int)[:, :2].tolist()) == [[0, 0], [0, 1], [1, 0]] for m in three)

    found, cost = BM.medoids(lab, (2, 3))
    for k, r in itertools.product((2, 3), inside):
        part, m = x[inside[r]], found[k][r - 1]
        far = np.sqrt(((part[:, None] - part) ** 2).sum(2))
        to = np.sqrt(((part[:, None] - m) ** 2).sum(2))
        own = to.argmin(1)
        assert cost[k][r - 1] == pytest.approx(to.min(1).sum())
        for j in range(k):  # no row of a cluster has a smaller total
            mine = np.flatnonzero(own == j)
            assert far[np.ix_(mine, mine)].sum(1).min() == pytest.approx(to[mine, j].sum())

    weights, means, white, det = BM.mixtures(lab, centres)[3]
    for r in inside:
        logs = BM.log_densities(x[inside[r]], [m[r - 1] for m in (weights, means, white, det)])
        assert np.exp(weights[r - 1]).sum() == pytest.approx(1.0)
        fit = np.log(np.exp(logs).sum(1)).mean()
        assert fit > -5.5 and np.bincount(logs.argmax(1), minlength=3).min() > 10


def test_runs_of_one_block_are_fitted_without_jobs_between_steps(clouds, monkeypatch):
    lab = BM.subsamples(clouds[0], "id", "x", 3, 0.8, seed=2)
    assert lab.n_blocks == 1
    apart = replace(lab, n_blocks=2)  # as if there were a second block: a job a step
    centres, near = BM.lloyd(apart, (2, 3), starts=4), BM.medoids(apart, (2, 3))
    mixed = BM.mixtures(apart, centres)
    with monkeypatch.context() as m:
        m.setattr(BM, "_summed", None)  # the driver's; tasks have their own
        got, got_near, got_mixed = BM.lloyd(lab, (2, 3), starts=4), BM.medoids(lab, (2, 3)), BM.mixtures(lab, centres)
    for k in (2, 3):
        assert np.allclose(got[k], centres[k]) and np.allclose(got_near[0][k], near[0][k]) and np.allclose(got_near[1][k], near[1][k])
        for a, b in zip(got_mixed[k], mixed[k], strict=True):
            assert np.allclose(a, b, rtol=1e-5, atol=1e-8)


def brute_ward(x):
    """Merge heights and the clusters at every number of them, by trying all pairs."""
    groups, heights, at = [[i] for i in range(len(x))], [], {}
    while True:
        at[len(groups)] = sorted(map(sorted, groups))
        if len(groups) == 1:
            return heights, at
        cost, i, j = min((2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j)
                         for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        heights.append(cost ** 0.5)
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("local,tile", [(256, 2048), (8, 16)])
def test_ward_equals_greedy_merging(spark, monkeypatch, local, tile):
    monkeypatch.setattr(WD, "LOCAL", local)
    monkeypatch.setattr(WD, "TILE", tile)
    rng = np.random.default_rng(8)
    xs = {r: rng.normal(size=(n, 2)) * (1 + 3 * (rng.random((n, 1)) > 0.8)) for r, n in ((1, 60), (2, 35), (3, 3))}
    points = spark.createDataFrame([(r, i, v.tolist()) for r, x in xs.items() for i, v in enumerate(x)], "r int, id long, x array<double>")
    labels, heights = WD.ward(points, (2, 3, 5))
    got_heights = {r: sorted(row["height"] for row in rows) for r, rows in itertools.groupby(sorted(heights.collect()), key=lambda t: t["r"])}
    groups = {}
    for t in labels.collect():
        groups.setdefault((t["r"], t["k"]), {}).setdefault(t["label"], []).append(t["id"])
    for r, x in xs.items():
        want, at = brute_ward(x)
        assert got_heights[r] == pytest.approx(sorted(want))
        for k in (2, 3, 5):
            if k <= len(x):
                assert sorted(map(sorted, groups[r, k].values())) == at[k]


@pytest.mark.parametrize("local,tile", [(256, 2048), (20, 16)])
def test_ward_in_rounds_of_one_task_equals_greedy_merging(spark, monkeypatch, local, tile):
    monkeypatch.setattr(WD, "LOCAL", local)
    monkeypatch.setattr(WD, "TILE", tile)
    monkeypatch.setattr(WD, "FEW", 8)
    monkeypatch.setattr(WD, "STRIP_CELLS", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(70, 3)) * (1 + 3 * (rng.random((70, 1)) > 0.8))
    x = np.vstack([x, x[:20], x[:5]])
    points = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "r int, id long, x array<double>")
    labels, heights = WD.ward(points, (2, 3, 5))
    want, at = brute_ward(x)
    assert sorted(t["height"] for t in heights.collect()) == pytest.approx(sorted(want), abs=1e-6)
    groups = {}
    for t in labels.collect():
        groups.setdefault(t["k"], {}).setdefault(t["label"], []).append(t["id"])
    for k in (2, 3, 5):
        assert sorted(map(sorted, groups[k].values())) == at[k]


def test_ward_cuts_copies_of_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(WD, "FEW", 40)
    points = spark.createDataFrame([(1, i, [float(i % 2)]) for i in range(400)], "r int, id long, x array<double>")
    labels, heights = WD.ward(points, (2, 6))
    found = {k: {t["label"]: set() for t in labels.where(f"k = {k}").collect()} for k in (2, 6)}
    for t in labels.collect():
        found[t["k"]][t["label"]].add(t["id"] % 2)
    assert sorted(map(sorted, found[2].values())) == [[0], [1]] and len(found[6]) == 6 and all(len(v) == 1 for v in found[6].values())
    assert heights.count() == 399


def test_estimated_sizes_do_not_grow_over_passes(spark):
    from pulsegrid.session import cut_lineage
    rows = spark.range(50).withColumnRenamed("id", "a")
    bits = []
    for _ in range(5):
        rows = cut_lineage(rows.join(rows.select("a", (rows["a"] + 0).alias("b")), "a").join(rows.select("a"), "a").select("a"))
        bits.append(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
    assert max(bits) <= 64 and rows.count() == 50


def test_consensus_finds_the_clouds(clouds):
    df, x, y = clouds
    got = {r["k"]: r for r in K.consensus_choice(df, "id", (2, 3), runs=6).collect()}
    assert got[3]["chosen"] and not got[2]["chosen"] and got[3]["pac"] < 0.1 < got[2]["pac"] and got[3]["pairs"] == 92 * 91 // 2
    labels = K.consensus_labels(df, "id", (3,), runs=6).collect()
    assert len(labels) == 92 and all(len(r["labels"]) == 24 for r in labels)
    for j in range(24):
        seen = {(r["labels"][j], y[r["id"]]) for r in labels if r["labels"][j] is not None}
        assert sum(r["labels"][j] is not None for r in labels) == int(0.8 * 92) and len({a for a, _ in seen}) == 3
