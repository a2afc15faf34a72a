"""The side studies and the report over a small synthetic cohort."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pulse_train, write_recording
from pulsegrid.functions import constants as C, dsp
from pulsegrid.operators import clusters as K, effects as E, signals as S
from pulsegrid.plans import recordings as P, studies as St, study_report
from pulsegrid.sources.tables import Store, long_results, read_animals


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cohort")
    raw = base / "raw"
    raw.mkdir()
    mark = {500: "* ecg baseline", 14500: "* ecg baseline end"}
    meta = ["Code,dox treatment,Etn Treatment,Sex,date of surgery "]
    for i in range(8):
        x, _ = pulse_train(16, 112 + 3 * i, 20 + i, amp=0.4 + 0.02 * i, sign=-1.0 if i == 5 else 1.0, jitter=1.0)
        write_recording(raw, f"2024_0{1 + 4 * (i > 3)}_{10 + i}_{300 + i}", x, mark)
        meta.append(f"{300 + i},{0 if i % 2 else 20},{0 if i % 4 == 0 else 16},{'Male' if i % 3 else 'Female'},2024-01-0{i + 1}")
    (base / "animals.csv").write_text("\n".join(meta) + "\n")
    out = P.run(spark, str(raw), read_animals(spark, str(base / "animals.csv")), str(base / "out"))
    store = Store(spark, str(base / "out"))
    gated = store.read("gated").where("failed IS NULL")
    packed = store.stage("packed", S.pack(store.read("samples"), gated.select("recording_id", "base_start", "base_end"), "base_start", "base_end"))
    return out, store, packed


def test_all_ok(cohort):
    out = cohort[0]
    assert out["audit"].where("status = 'OK'").count() == 8
    assert {r["group"] for r in out["master"].collect()} == {"Control", "Dox", "Dox+Etn16"}


def test_detectors_and_diagnosis(cohort):
    out, _, _ = cohort
    for r in St.detector_robustness(out["segments"]).collect():
        assert r["match"] > 90 and r["hr_mad"] == pytest.approx(r["hr_alt"], rel=0.03)
    d = {r["recording_id"]: r for r in St.detection_diagnosis(out["segments"]).collect()}
    seg = {r["recording_id"]: r for r in out["segments"].collect()}
    for k, r in d.items():
        rr = np.diff(seg[k]["peaks"])
        assert (r["rr_p5_ms"], r["rr_median_ms"]) == pytest.approx((np.percentile(rr, 5), np.median(rr))) and not r["diverges"]
        f, p = dsp.welch(np.array(seg[k]["filtered"]), 1000, min(4000, len(seg[k]["filtered"]) // 4))
        band = (f >= 0.5) & (f <= 150)
        assert r["psd_dom_hz"] == pytest.approx(f[band][p[band].argmax()])


def test_rich_features(cohort):
    out, store, _ = cohort
    rich = St.rich_features(out["segments"], store.read("templates"), out["master"], 3).collect()
    seg = {r["recording_id"]: r for r in out["segments"].collect()}
    for r in rich:
        rr = np.diff(seg[r["recording_id"]]["peaks"]).astype(float)
        d = np.diff(rr)
        assert (r["sdnn"], r["rmssd"], r["sd1"]) == pytest.approx((rr.std(ddof=1), np.sqrt((d ** 2).mean()), np.sqrt(0.5) * d.std(ddof=1)))
    assert len(rich) == 8 and sum(r["fpca1"] for r in rich) == pytest.approx(0, abs=1e-9)


def test_mains_and_denoising(cohort):
    _, _, packed = cohort
    for r in St.mains_comparison(packed).collect():
        assert r["rejected_ls_sequential_pct"] > 80 and abs(r["loss_ls_sequential_pct"]) < abs(r["loss_notch60_pct"]) + 5
    d = St.denoising_comparison(packed, ("raw", "notch30", "ls_joint"))
    assert d.count() == 24 and d.where("method = 'raw' AND snr_delta <> 0").count() == 0


def test_overlay_qt_and_templates(cohort, spark):
    out, store, _ = cohort
    beats = store.read("beats")
    o = {r["recording_id"]: r for r in St.beat_overlay(beats).collect()}
    assert len(o) == 8 and all(r["r_pos_sd"] < 1.0 and r["n_beats"] > 90 for r in o.values())
    cons, yields = St.per_beat_report(beats)
    assert cons.count() == 40 and yields.count() == 8
    manual = spark.createDataFrame([(next(iter(o)), 44.0)], "recording_id string, qt_manual_ms double")
    assert St.qt_audit(beats, manual).where("qt_manual_ms IS NOT NULL").count() == 1
    rec = out["features"].select("recording_id", "animal_id", "status", "n_beats", "median_rr_ms", (F.col("rr_std_ms") / F.col("rr_mean_ms")).alias("rr_cv"))
    dist = {r["animal_id"]: r for r in St.distance_to_healthy(rec, store.read("templates"), [300, 301], [307]).collect()}
    assert dist[300]["corr_warp"] > 0.9 and dist[300]["in_template"] and dist[307]["note"] == "HARD_EXCLUDE"
    assert sorted(r["rank"] for r in dist.values()) == list(range(1, 9))


def test_triage_and_figures(cohort):
    out, store, packed = cohort
    tri = St.problem_triage(packed, out["segments"], out["features"]).collect()
    assert len(tri) == 8 and all(r["tier"] == "KEEP" and 0 < r["corr_full"] <= 1 for r in tri)
    assert St.template_lines(store.read("templates")).count() == 8 * 250
    assert St.beat_bundle(store.read("beats"), 20).groupBy("recording_id").count().agg(F.max("count")).first()[0] == 20
    assert St.rr_histogram(out["segments"]).agg(F.sum("n")).first()[0] == St.tachogram(out["segments"]).count()
    assert St.spectrum_lines(out["segments"]).count() > 0 and St.trace_slice(out["segments"], 1.0, 0.5).count() == 8 * 500
    assert St.rate_bars(out["features"]).count() == 8


def test_clusters_and_sweep(cohort):
    out, _, _ = cohort
    c = St.cluster_study(out["master"], ks=(2,))
    assert c.count() == 8 and set(c.columns) >= {"cluster_k2", "cluster_gmm_k2"} and len(c.first()["x"]) == 18
    m = out["master"].withColumn("study", F.lit("acute"))
    r = St.classification_sweep(m, {"std": ["heart_rate_bpm", "r_amplitude_mv"]}, ["acute"], ["any_dox_vs_control"], ["lda"], 9)
    assert r.first()["n"] == 8 and 0 <= r.first()["acc"] <= 1
    assert St.classification_sweep(m, {"std": ["heart_rate_bpm"]}, ["acute"], ["control_vs_dox"], ["lda"], 9) is None


def test_report(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        g = C.GROUPS[i % 5]
        rows.append((i, "chronic" if i % 2 else "acute", "OK", 0.05 if i % 17 else 0.3, g, "male" if i % 3 else "female", float(500 + 5 * (i % 5) + rng.normal()), float(rng.normal())))
    m = spark.createDataFrame(rows, "animal_id long, study string, status string, rr_cv double, `group` string, sex string, heart_rate_bpm double, qt_ms double")
    for c in C.TESTED_PARAMETERS:
        if c not in m.columns:
            m = m.withColumn(c, F.col("heart_rate_bpm") * 0.5 + F.col("qt_ms"))
    t = study_report.run(m, Store(spark, str(tmp_path)))
    assert t["summary"].count() == 22 and t["oneway"].count() == 22 and t["tukey"].count() == 88
    hr = t["all_tests"].where("study = 'chronic' AND parameter = 'heart_rate_bpm'").first()
    assert hr["anova_p"] < 1e-6 and hr["jt_p"] < 1e-6 and hr["spearman_rho"] > 0.7 and "+/-" in hr["dox"]
    assert t["twoway"].where("effect = 'a' AND parameter = 'heart_rate_bpm'").first()["p_value"] < 1e-6
    assert long_results(t["oneway"].select("study", "parameter", "anova_f"), ["study", "parameter"], "oneway").count() == 22


def test_huber(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 80).astype(float)
    y = 2 + 0.5 * x + rng.normal(size=80)
    y[:6] += 15
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "s int, x double, value double")
    a, b = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    for _ in range(200):
        r = np.abs(y - a - b * x)
        s = np.median(r) / 0.6744897501960817
        w = np.sqrt(np.where(r <= 1.345 * s, 1.0, 1.345 * s / r))
        a, b = np.linalg.lstsq(np.column_stack([w, w * x]), w * y, rcond=None)[0]
    got = E.huber_slope(df, ["s"], "x", max_iter=12, tolerance=1e-5).first()
    assert got["slope"] == pytest.approx(b, abs=1e-3)


def test_choose_phenotypes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2) + 20 * (i // 20)]) for i in range(40)], "id int, x array<double>")
    got = {r["id"]: (r["phenotype"], r["k"]) for r in St.choose_phenotypes(df, "id", ks=(2,), runs=2, algorithms=("kmeans",)).collect()}
    assert len(got) == 40 and all(len({got[i] for i in range(20 * c, 20 * c + 20)}) == 1 for c in range(2)) and set(got.values()) == {(1, 2), (2, 2)}
