"""Filters carried over blocks, windows around marks, ragged means, slope medians' order of doubles: against plain loops."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import beats as BT, clusters as K, effects as E, long_signals as LS


def traces(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    xs = {k: np.cumsum(rng.normal(size=n)) * 0.05 + np.sin(np.arange(n) / 9) for k, n in enumerate(lengths)}
    pdf = pd.concat([pd.DataFrame({"recording_id": k, "sample_idx": np.arange(len(x)), "mv": x}) for k, x in xs.items()])
    return spark.createDataFrame(pdf).repartition(6), xs


def by_recording(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["recording"], r["first"])):
        assert r["first"] == len(out.setdefault(r["recording"], []))
        out[r["recording"]] += r["x"]
    return out


@pytest.mark.parametrize("coefficients", [dsp.butter_band(2, 1.0, 100.0, 1000.0), dsp.notch(50.0, 30.0, 1000.0)])
def test_filter_over_blocks_equals_one_pass(spark, coefficients):
    b, a = coefficients
    samples, xs = traces(spark, [10, 16, 300, 511, 512, 513, 4000])
    got = by_recording(LS.zero_phase(samples, b, a, size=256).collect())
    pad = 3 * max(len(a), len(b))
    assert sorted(got) == [k for k, x in xs.items() if len(x) > pad]
    for k, y in got.items():
        assert np.allclose(y, dsp.zero_phase(b, a, xs[k]), atol=1e-6)  # up to the rounding of the state


def test_seventeen_minutes_are_filtered_in_many_tasks(spark):
    b, a = dsp.butter_band(2, 1.0, 100.0, 1000.0)
    samples, xs = traces(spark, [1_009_300])
    found = LS.zero_phase(samples, b, a)
    rows = found.collect()
    assert len(rows) == 1_009_300 // LS.BLOCK
    assert np.allclose(by_recording(rows)[0], dsp.zero_phase(b, a, xs[0]), atol=1e-6)


def test_windows_and_widths(spark):
    samples, xs = traces(spark, [700, 90], seed=3)
    marks = [(k, r) for k, x in xs.items() for r in (0, 3, 22, 45, 63, 64, 65, 300, len(x) - 2, len(x) - 1) if r < len(x)]
    marked = spark.createDataFrame(marks, "recording long, r long")
    blocks = LS.blocks_of(samples, size=64)
    got = {(r["recording"], r["r"]): (r["start"], r["x"]) for r in LS.windows_at(blocks, marked, 50, 140, size=64).collect()}
    for k, r in marks:
        low = max(0, r - 50)
        assert got[k, r] == (low, xs[k][low:r + 140].tolist())

    widths, intervals = {}, {}
    for k, r in marks:
        x = xs[k]
        left = [i for i in range(max(0, r - 25), r) if x[i] < x[r] / 2]
        right = [i for i in range(r, min(len(x), r + 25)) if x[i] < x[r] / 2]
        if left and right:
            widths[k, r] = float(right[0] - left[-1])
        after, base = x[r + 30:r + 100], x[max(0, r - 50):max(0, r - 20)]
        if len(after) and len(base):
            t = r + 30 + int(np.argmax(after))
            back = [i for i in range(t, min(len(x), t + 40)) if x[i] <= base.mean() + 0.01]
            if back and 30 <= back[0] - r <= 100:
                intervals[k, r] = float(back[0] - r)
    windows = LS.windows_at(blocks, marked, 50, 140, size=64)
    assert {(r["recording"], r["r"]): r["qrs_ms"] for r in LS.half_height_width(windows).collect()} == widths and widths
    assert {(r["recording"], r["r"]): r["qt_ms"] for r in LS.return_to_baseline(windows).collect()} == intervals and intervals


def test_ragged_means(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [3.0]), (1, [5.0, None]), (2, [7.0]), (3, []), (4, None)]
    got = {r["k"]: r for r in BT.elementwise_ragged(spark.createDataFrame(rows, "k int, x array<double>"), ["k"], "x").collect()}
    assert sorted(got) == [1, 2] and got[1]["mean"] == [3.0, 2.0, 3.0] and got[1]["counts"] == [3, 1, 1] and got[1]["n"] == 3
    assert got[1]["sd"] == [2.0, None, None] and got[2]["sd"] == [None]


def test_doubles_in_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e9])
    n = E._as_ordered(x)
    assert (np.diff(n[[i for i in range(len(x)) if i != 4]]) > 0).all() and n[8] - n[7] == 1
    assert np.array_equal(E._as_doubles(n), x)
    assert E._between(1.0, float(np.nextafter(1.0, 2)), 15) == [] and len(E._between(-3.0, 3.0, 15)) == 15


def test_enrichment_equals_contingency_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), "ab"[int(rng.random() < 0.3 + 0.3 * c)], int(rng.integers(0, 3)) if i else 9) for i, c in enumerate(rng.integers(0, 2, 200))] + [(None, "a", 1), (1, None, 2)]
    df = spark.createDataFrame(rows, "cluster int, two string, many int")
    got = {r["labelling"]: r for r in K.enrichment(df, "cluster", ["two", "many"]).collect()}
    for name, at in (("two", 1), ("many", 2)):
        own = [r for r in rows if r[0] is not None and r[at] is not None]
        values = sorted({r[at] for r in own})
        o = np.array([[sum(r[0] == c and r[at] == v for r in own) for v in values] for c in (0, 1)], float)
        e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
        gap = np.abs(o - e)
        if len(values) == 2:
            gap -= np.minimum(0.5, gap)
        assert got[name]["chi2"] == pytest.approx((gap ** 2 / e).sum()) and (got[name]["n"], got[name]["dof"]) == (len(own), len(values) - 1)
    profile = {r["cluster"]: (r["n"], r["many"]) for r in K.profile(df, "cluster", ["many"]).collect()}
    assert profile[0] == (sum(r[0] == 0 for r in rows), pytest.approx(np.mean([r[2] for r in rows if r[0] == 0])))


def test_relabelled_clusters(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0), (3, 9.0), (4, 6.0), (None, 3.0)], "c int, v double")
    got = {(r["c"], r["phenotype"]) for r in K.relabel_by_mean(df, "c", "v").collect()}
    assert got == {(3, "A"), (4, "B"), (1, "C"), (2, "D"), (None, None)}
    two = {r["c"]: r["phenotype"] for r in K.relabel_by_mean(df.where("c < 3"), "c", "v").collect()}
    assert two == {1: "A", 2: "B"}
