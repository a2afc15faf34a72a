"""DataFrame operators against brute force on small, awkward inputs (ties, hot groups, NULLs)."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as X, constants as C, tails
from pulsegrid.operators import (beats as B, classify as L, clusters as K, effects as E, inference as S, matrix as M, morphology as Mo, ordered as O,
                                 pairwise as PW, permutation as P, relational as R, resampling as Rs, template as T, windows as V)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, many ties, some NULLs."""
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i < 400 else f"g{rng.integers(0, 8)}", int(rng.integers(0, 4)), None if rng.random() < 0.05 else float(rng.integers(0, 60)) / 4)
            for i in range(1200)]
    return spark.createDataFrame(rows, "id long, g string, level int, value double").cache(), rows


def groups(rows, at=1):
    out = {}
    for r in rows:
        if r[3] is not None:
            out.setdefault(r[at], []).append(r)
    return out


def test_exact_quantiles(hot):
    df, rows = hot
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "value", {"a": 0.05, "b": 0.5, "c": 0.9}).collect()}
    for g, rs in groups(rows).items():
        assert [got[g][k] for k in "abc"] == pytest.approx(np.percentile([r[3] for r in rs], [5, 50, 90]))


def test_positions_and_neighbours(hot):
    df, rows = hot
    got = {r["id"]: r["p"] for r in O.positions(df.where("value IS NOT NULL"), ["g"], "value", ["id"], "p").collect()}
    for rs in groups(rows).values():
        for k, r in enumerate(sorted(rs, key=lambda r: (r[3], r[0]))):
            assert got[r[0]] == k + 1
    for offset in (-1, 1):
        near = {r["id"]: r["o"] for r in O.neighbour(df, ["g"], "id", [], {"o": "level"}, 50, offset).collect()}
        by = {}
        for r in rows:
            by.setdefault(r[1], []).append(r)
        for rs in by.values():
            for k, r in enumerate(rs):
                j = k + offset
                assert near[r[0]] == (rs[j][2] if 0 <= j < len(rs) else None)


def test_block_width_and_forward_search(hot, spark):
    """Any block width gives the same forward matches as looking at every later event."""
    df, rows = hot
    assert O.block_width(df, ["g"], "id", 50) == 50 and O.block_width(df.limit(0), ["g"], "id") == 1
    probes, events = df.where("level = 0").select("g", "id"), df.where("level = 3").select("g", F.col("id").alias("e"))
    for block in (None, 1, 7, 5000):
        got = {r["id"]: r["hit"] for r in O.first_at_or_after(probes, events, ["g"], "id", "e", 20, name="hit", block=block).collect()}
        for r in rows:
            if r[2] == 0:
                want = [x[0] for x in rows if x[1] == r[1] and x[2] == 3 and r[0] <= x[0] <= r[0] + 20]
                assert (got[r[0]]["t"] if got[r[0]] else None) == (min(want) if want else None)
        near = {r["id"]: r["m"] for r in O.any_within(probes, events, ["g"], "id", "e", 9, "m").collect()}
        assert all(near[r[0]] == any(x[1] == r[1] and x[2] == 3 and abs(x[0] - r[0]) <= 9 for x in rows) for r in rows if r[2] == 0)


def test_kruskal_jt_spearman(hot):
    df, rows = hot
    long = df.withColumn("study", F.lit(1))
    vals = [(r[2], r[3]) for r in rows if r[3] is not None]
    v = np.array([x[1] for x in vals])
    rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    lev = np.array([x[0] for x in vals])
    n = len(v)
    ties = np.unique(v, return_counts=True)[1].astype(float)
    h = (12 / (n * (n + 1)) * sum(rank[lev == g].sum() ** 2 / (lev == g).sum() for g in range(4)) - 3 * (n + 1)) / (1 - (ties ** 3 - ties).sum() / (n ** 3 - n))
    assert S.kruskal(long, ["study"], "level").first()["h_stat"] == pytest.approx(h)
    u = sum((b > a) + 0.5 * (b == a) for i, j in itertools.combinations(range(4), 2) for a in v[lev == i] for b in v[lev == j])
    assert S.jonckheere(long, ["study"], "level", 4).first()["u_stat"] == pytest.approx(u)
    rl = np.array([(lev < x).sum() + ((lev == x).sum() + 1) / 2 for x in lev])
    assert S.spearman(long, ["study"], "level").first()["rho"] == pytest.approx(np.corrcoef(rank, rl)[0, 1])
    assert S.jonckheere(long.where("level <> 2"), ["study"], "level", 4).first()["z_stat"] is None


def test_leave_one_out(spark):
    rng = np.random.default_rng(1)
    rows = [(1, int(rng.integers(0, 3)), float(rng.integers(0, 9))) for _ in range(40)]
    df = spark.createDataFrame(rows, "k int, level int, value double")

    def z(rs):
        g = [[r[2] for r in rs if r[1] == i] for i in range(3)]
        u = sum((b > a) + 0.5 * (b == a) for i, j in itertools.combinations(range(3), 2) for a in g[i] for b in g[j])
        n, s = len(rs), [len(x) for x in g]
        return (u - (n * n - sum(x * x for x in s)) / 4) / np.sqrt((n * n * (2 * n + 3) - sum(x * x * (2 * x + 3) for x in s)) / 72)
    want = [z(rows[:i] + rows[i + 1:]) for i in range(len(rows))]
    got = S.jonckheere_leave_one_out(df, ["k"], "level", 3).first()
    assert (got["z_all"], got["z_min"], got["z_max"]) == pytest.approx((z(rows), min(want), max(want)))


@pytest.mark.parametrize("probes", [15, 255])
def test_pairwise_slopes(spark, probes):
    """The narrowed brackets end at the median of all pairs."""
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(0, 3)), float(np.round(rng.normal() * 10 + k, 1))) for k in (0, 1) for _ in range(45 + k)]
    df = spark.createDataFrame(rows, "k int, level int, value double")
    got = {r["k"]: r["median"] for r in E.median_pairwise_slope(df, ["k"], "level", 3, probes).collect()}
    for k in (0, 1):
        rs = [r for r in rows if r[0] == k]
        want = np.median([(b[2] - a[2]) / (b[1] - a[1]) for a in rs for b in rs if b[1] > a[1]])
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_tails_and_tests(spark):
    one = spark.range(1)
    p = one.select(tails.f_tail(F.lit(4.0), F.lit(2), F.lit(27)).alias("f"), tails.t_two_sided(F.lit(2.0), F.lit(10)).alias("t"),
                   tails.chi2_tail(F.lit(5.0), F.lit(3)).alias("c"), tails.normal_two_sided(F.lit(1.96)).alias("n"),
                   tails.t_two_sided(F.lit(None).cast("double"), F.lit(10)).alias("null")).first()
    assert p["f"] == pytest.approx((1 + 8 / 27) ** -13.5) and p["t"] == pytest.approx(0.073388, abs=1e-5)
    assert p["c"] == pytest.approx(0.171797, abs=1e-5) and p["n"] == pytest.approx(0.0499958, abs=1e-6) and p["null"] is None


def test_shapiro_published(spark):
    """Weights of eleven men: W = 0.79, p = 0.0067."""
    v = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, id int, value double")
    r = S.shapiro(df, ["k"], "value", ["id"]).first()
    assert r["w_stat"] == pytest.approx(0.79, abs=0.003) and r["p_value"] == pytest.approx(0.0067, abs=0.0005) and not r["normal"]


def test_two_way_anova(spark):
    """Type II sums of squares against least squares on the raw rows."""
    rng = np.random.default_rng(3)
    rows = [(1, "abc"[rng.integers(0, 3)], "mf"[rng.integers(0, 2)], float(rng.normal())) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, a string, b string, value double")
    got = {r["effect"]: r for r in S.two_way_anova(df, ["k"], "a", "b").collect()}
    y = np.array([r[3] for r in rows])
    da = np.array([[r[1] == c for c in "bc"] for r in rows], float)
    db = np.array([[r[2] == "m"] for r in rows], float)
    rss = lambda *m: (lambda x: float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()))(np.hstack([np.ones((60, 1)), *m]))
    full = rss(da, db, da * db)
    assert got["a"]["ss"] == pytest.approx(rss(db) - rss(da, db)) and got["b"]["ss"] == pytest.approx(rss(da) - rss(da, db))
    assert got["a:b"]["f_stat"] == pytest.approx((rss(da, db) - full) / 2 / (full / 54)) and got["a"]["df_error"] == 54


def test_triage_golden(spark):
    rows = [("OK", 500.0, 0.151, "KEEP"), ("OK", 544.0, 0.234, "KEEP"), ("OK", 573.0, 0.264, "REVIEW"), ("OK", 452.0, 0.587, "REVIEW"),
            ("OK", 400.0, 0.650, "DROP"), ("NEEDS_REVIEW", 213.0, 0.647, "DROP"), ("OK", 500.0, None, "DROP"), ("OK", 701.0, 0.1, "DROP")]
    df = spark.createDataFrame(rows, "status string, hr double, cv double, want string")
    assert all(r["t"] == r["want"] for r in df.withColumn("t", X.triage_tier(F.col("status"), F.col("hr"), F.col("cv"))).collect())


def test_clean_predicate_boundary(spark):
    rows = [("OK", 0.15, True), ("OK", 0.1500001, False), ("OK", None, False), ("NEEDS_REVIEW", 0.1, False)]
    df = spark.createDataFrame(rows, "s string, cv double, want boolean")
    assert all(r["c"] == r["want"] for r in df.withColumn("c", X.is_clean_rhythm(F.col("s"), F.col("cv"))).collect())


def test_unknown_group_is_an_error(spark):
    df = spark.createDataFrame([("Other",)], "g string")
    with pytest.raises(Exception, match="unknown group"):
        df.select(X.dose_of_group(F.col("g"))).collect()


def test_golden_gallery_qtc(spark):
    rows = [(492, 44.5, 40.3), (531, 44.0, 41.4), (544, 43.2, 41.2), (551, 43.3, 41.5), (512, 44.7, 41.3), (529, 43.9, 41.2), (510, 45.8, 42.2),
            (517, 45.9, 42.6), (533, 43.3, 40.9), (596, 43.5, 43.3)]
    df = spark.createDataFrame([(float(a), b, c) for a, b, c in rows], "hr double, qt double, want double")
    got = df.withColumn("qtc", X.qtc_mitchell(F.col("qt"), 60000.0 / F.col("hr"))).collect()
    assert all(abs(r["qtc"] - r["want"]) < 0.2 for r in got)
    assert np.mean([r["qtc"] for r in got]) == pytest.approx(41.6, abs=0.1)


def test_per_beat_measures_against_loops(spark):
    rng = np.random.default_rng(4)
    t = np.arange(250) - 100
    beats = [(i, [float(v) for v in np.exp(-0.5 * (t / 3.0) ** 2) * 0.5 - 0.1 * np.exp(-0.5 * ((t - 45) / 8.0) ** 2) + 0.02 * rng.normal(size=250)]) for i in range(12)]
    df = spark.createDataFrame(beats, "i int, beat array<double>")
    b = Mo.Beat("beat")
    got = {r["i"]: r for r in df.select("i", *[c.alias(k) for k, c in Mo.measures(b).items()], b.qt(F.lit(140.0)).alias("qt")).collect()}
    for i, x in beats:
        x = np.array(x)
        r, half = int(x.argmax()), x.max() / 2
        lo = r
        while lo > 0 and x[lo] > half:
            lo -= 1
        hi = r
        while hi < 249 and x[hi] > half:
            hi += 1
        base = np.median(x[t < -70])
        assert got[i]["qrs_duration_ms"] == hi - lo
        w = (t >= 40) & (t <= 80)
        assert got[i]["t_wave_excursion_mv"] == pytest.approx(np.abs(x[w] - base).max()) and got[i]["rt_interval_ms"] == t[w][x[w].argmax()]
        p = x[(t >= -70) & (t <= -35)] - base
        assert (got[i]["p_wave_amplitude_mv"] is not None) == (p.max() > max(0.008, 2 * x[t < -70].std()))
        level = x[50:80].mean()
        exc = np.abs(x[130:170] - level)
        k = exc.argmax()
        below = np.flatnonzero(exc[k:] <= 0.3 * exc[k])
        want = None if not len(below) or not 15 <= 30 + k + below[0] <= 90 else 30 + k + below[0]
        assert got[i]["qt"] == want


def test_template_drops_the_remainder(spark):
    rows = [(1, i, [float(i), 1.0]) for i in range(10)] + [(2, i, [float(i), 2.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "r int, beat_no int, beat array<double>")
    got = {r["r"]: r for r in B.template(df, ["r"]).collect()}
    assert got[1]["template"] == [3.5, 1.0] and got[1]["n_averaged"] == 8 and got[2]["template"] == [1.0, 2.0]


def test_sweep_starts(spark):
    df = spark.createDataFrame([(30000,), (10000,), (5000,), (10001,)], "n int")
    got = [r["s"] for r in df.select(V.sweep_starts(F.col("n"), 10000, 2000).alias("s")).collect()]
    assert got == [list(range(0, max(1, n - 10000), 2000)) for n in (30000, 10000, 5000, 10001)]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 4)) + 4 * c for c in range(3)])
    rows = [(i, int(i // 30), [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id int, label int, x array<double>").cache(), x, np.repeat(range(3), 30)


def test_silhouette_over_many_tiles(cloud):
    df, x, lab = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r["id"]: r["silhouette"] for r in PW.silhouette_rows(df, "id", "x", "label", tile_rows=20).collect()}
    for i in range(90):
        a = d[i, lab == lab[i]].sum() / 29
        b = min(d[i, lab == c].mean() for c in range(3) if c != lab[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_clusterers_find_the_clouds(cloud):
    df, x, lab = cloud
    for c in (K.kmeans(df, 3, n_init=2), K.pam(df, "id", 3, n_init=2)):
        assert K.adjusted_rand(c, "label", "cluster").first()["ari"] == pytest.approx(1.0)


def test_pca_and_covariance(cloud):
    df, x, _ = cloud
    cov = {(r["i"], r["j"]): r["cov"] for r in M.covariance(df).collect()}
    want = np.cov(x.T)
    assert all(v == pytest.approx(want[k]) for k, v in cov.items()) and len(cov) == 10
    p = M.Components(df, 4)
    val, vec = np.linalg.eigh(want)
    assert p.explained == pytest.approx(list(val[::-1] / val.sum()))
    s = np.array([r["scores"] for r in p.scores(df).orderBy("id").collect()])
    v = vec[:, ::-1] * np.sign(vec[np.abs(vec).argmax(0), range(4)])[::-1]
    assert np.allclose(s, (x - x.mean(0)) @ v, atol=1e-8) and p.components_for(0.8) == 1


def test_permutation_plan_keeps_class_sizes(cloud):
    df = cloud[0]
    plan = P.permutation_plan(df, "id", "label", 7, folds=5).collect()
    codes, folds = np.array([r["codes"] for r in plan]), np.array([r["folds"] for r in plan])
    assert codes.shape == (90, 8) and all((np.bincount(codes[:, p]) == 30).all() for p in range(8))
    assert all(np.bincount(folds[codes[:, p] == c, p]).tolist() == [6] * 5 for p in range(8) for c in range(3))
    assert (codes[:, 0] == np.array([r["id"] for r in plan]) // 30).all() and (codes[:, 1] != codes[:, 0]).any()


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_permanova_against_distances(cloud, monkeypatch, cells):
    df, x, lab = cloud
    monkeypatch.setattr(P, "BLOCK_CELLS", cells)  # one block, then four
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    sums = P.permuted_sums(df, "id", "label", permutations=200).persist()
    ssw = sum(d2[np.ix_(lab == g, lab == g)].sum() / 60 for g in range(3))
    f = {r["p"]: r["f_stat"] for r in P.pseudo_f(sums).collect()}
    assert f[0] == pytest.approx(((d2.sum() / 180 - ssw) / 2) / (ssw / 87)) and len(f) == 201
    rows = sums.collect()
    assert len(rows) == 603 and all(r["n"] == 30 for r in rows)  # class sizes are kept exactly
    total = np.zeros((201, 4))
    for r in rows:
        total[r["p"]] += r["total"]
    assert np.allclose(total, x.sum(0))
    # a class mean over uniform permutations has the mean and variance of a sample without replacement
    means = np.array([np.array(r["total"]) / 30 for r in rows if r["p"] > 0 and r["code"] == 0])
    sd = x.std(0, ddof=1) * np.sqrt((1 - 30 / 90) / 30)
    assert (np.abs(means.mean(0) - x.mean(0)) < 4 * sd / np.sqrt(200)).all() and (np.abs(means.std(0) / sd - 1) < 0.25).all()
    assert P.permanova(df, "id", "label", permutations=99).first()["p_value"] == pytest.approx(0.01)
    assert P.permuted_sums(df.where("id < 0"), "id", "label", permutations=3).count() == 0


def test_positions_split_a_tied_value(spark):
    rng = np.random.default_rng(8)
    v = np.where(rng.random(4000) < 0.7, 5, rng.integers(0, 10, 4000))
    df = spark.createDataFrame([(int(i), float(a)) for i, a in zip(rng.permutation(4000), v)], "id long, v double")
    got = [(r["v"], r["id"]) for r in O.positions(df, [], "v", ["id"]).orderBy("pos").collect()]
    assert got == sorted(got)
    blocks = {(r["v"], r[O.BLOCK]) for r in O.with_value_blocks(df, "v", ties="id").select("v", O.BLOCK).distinct().collect()}
    assert len([b for a, b in blocks if a == 5.0]) > 3


def test_normal_quantile_column(spark):
    from statistics import NormalDist
    ps = [1e-9, 1e-4, 0.025, 0.3, 0.5, 0.9, 0.975, 1 - 1e-6]
    got = [r["q"] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select(tails.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[:len(ps)] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7) and got[len(ps):] == [None] * 3


def test_ranked_puts_unscored_last(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(-(i // 2))) for i in range(200)], "animal_id long, rmse_warp double")
    got = [r["animal_id"] for r in T.ranked(df).orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (i % 3 == 0, 0 if i % 3 == 0 else -(i // 2), i))


def test_classifiers(cloud, spark):
    df, x, lab = cloud
    # PLS-DA regresses on indicators, so the middle of three clouds on a line is partly masked
    for model, least in (("lda", 0.9), ("pls", 0.6)):
        r = L.cross_validated(df, "id", "label", model=model, permutations=19).first()
        assert r["acc"] > least and r["p_value"] == pytest.approx(0.05) and r["null_mean"] < 0.5
    tiny = df.where("label = 0 OR id = 31")
    assert L.cross_validated(tiny, "id", "label") is None
    assert L.forest(df, "id", "label", trees=10, max_folds=2).first()["acc"] > 0.9


def test_lda_matches_gaussian_rule():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    x[y == 1] += 1
    w = L.lda(np.bincount(y).astype(float), np.array([x[y == c].sum(0) for c in range(3)]), x.T @ x)
    means = np.array([x[y == c].mean(0) for c in range(3)])
    cov = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / 57
    logp = np.array([-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m) + np.log((y == c).mean()) for c, m in enumerate(means)]).T
    assert (np.hstack([x, np.ones((60, 1))]) @ w.T).argmax(1).tolist() == logp.argmax(1).tolist()


def test_pls_matches_least_squares_when_complete():
    """With as many components as features, PLS is ordinary least squares."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(50, 2)), rng.integers(0, 3, 50)
    w = L.pls(np.bincount(y).astype(float), np.array([x[y == c].sum(0) for c in range(3)]), x.T @ x, 2)
    wide = np.hstack([x, np.ones((50, 1))])
    assert np.allclose(wide @ w.T, wide @ np.linalg.lstsq(wide, np.eye(3)[y], rcond=None)[0], atol=1e-8)


def test_bootstrap_interval_and_partition_independence(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 1, "ab"[i % 2], float(rng.normal() + (i % 2))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, arm string, value double")
    one = Rs.bootstrap_interval(df.repartition(1), ["k"], "arm", "a", "b", ["id"], 800).first()
    many = Rs.bootstrap_interval(df.repartition(7), ["k"], "arm", "a", "b", ["id"], 800).first()
    assert one["diff_low"] == pytest.approx(many["diff_low"]) and one["replicates"] == 800 and one["undefined"] == 0
    small = Rs.bootstrap_interval(df.where("arm = 'a' OR id < 4"), ["k"], "arm", "a", "b", ["id"], 800).first()
    assert small["replicates"] == 800 and 0 < small["undefined"] < 800
    a, b = (np.array([r[3] for r in rows if r[2] == s]) for s in "ab")
    se = np.sqrt(a.var() / 100 + b.var() / 100)
    assert one["diff_low"] == pytest.approx(a.mean() - b.mean() - 1.96 * se, abs=0.35 * se)
    assert one["diff_high"] == pytest.approx(a.mean() - b.mean() + 1.96 * se, abs=0.35 * se)


def test_gibbs(spark):
    rng = np.random.default_rng(9)
    rows = [(1, g, int(r), float(rng.normal() * 0.3 + m)) for r, (g, m) in enumerate((("a", 1.0), ("b", 2.0), ("c", 3.0))) for _ in range(80)]
    df = spark.createDataFrame(rows, "k int, arm string, rank int, value double")
    draws = Rs.hierarchical_means(S.arm_moments(df, ["k"], "arm"), ["k"], "arm", 3000, 500)
    s = {r["param"]: r for r in Rs.posterior_summary(draws, ["k"]).collect()}
    assert s["a"]["mean"] == pytest.approx(1.0, abs=0.1) and s["sigma"]["mean"] == pytest.approx(0.3, abs=0.05) and s["b"]["draws"] == 2500
    c = Rs.posterior_summary(Rs.posterior_contrast(draws, ["k"], "a", "c"), ["k"]).first()
    assert c["p_negative"] == 1.0 and c["low"] < -2 < c["high"]
    b = {r["param"]: r for r in Rs.posterior_summary(Rs.slope_posterior(df, ["k"], "rank", 3000, 500), ["k"]).collect()}["slope"]
    assert b["mean"] == pytest.approx(1.0, abs=0.05) and b["low"] < b["mean"] < b["high"]


def test_systematic_sample(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(7)], "g int, i long")
    got = sorted((r["g"], r["i"]) for r in R.systematic_sample(df, ["g"], "i", [], 13).collect())
    want = [(1, int(v)) for v in np.unique(np.linspace(0, 99, 13).astype(int))] + [(2, i) for i in range(7)]
    assert got == want


def test_feature_columns_are_fixed():
    assert len(C.FEATURE_COLUMNS) == 27 and len(set(C.FEATURE_COLUMNS)) == 27
