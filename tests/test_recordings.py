"""Raw chart exports to features, on recordings whose beats are known."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pulse_train, write_recording
from pulsegrid.functions import dsp
from pulsegrid.operators import windows as V
from pulsegrid.plans import recordings as P, recovery
from pulsegrid.sources import labchart
from pulsegrid.sources.tables import Store, read_animals


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("study")
    raw = base / "raw"
    raw.mkdir()
    mark = {1000: "* ecg baseline", 21000: "* ecg baseline end"}
    truth = {}
    x, truth["2024_01_05_201"] = pulse_train(30, 120, 1)
    write_recording(raw, "2024_01_05_201", x, mark, extra_rows=(500, 501), bad_rows=(1500, 1501, 1502))
    x, truth["2024_01_09_146"] = pulse_train(30, 110, 2, sign=-1.0)
    write_recording(raw, "2024_01_09_146", x, mark)
    x, _ = pulse_train(30, 120, 3)
    write_recording(raw, "22024_06_01_115", np.linspace(300, 500, len(x)), mark)
    x, _ = pulse_train(40, 130, 4, jitter=45)
    write_recording(raw, "2024_06_03_125", x, {2000: "1 start", 30000: "2 done"})
    x, _ = pulse_train(5, 120, 5)
    write_recording(raw, "2024_06_03_130", x)
    write_recording(raw, "nonumbers", x, mark)
    rng = np.random.default_rng(7)
    slow, _ = pulse_train(15, 700, 6, noise=0.003)
    fast, _ = pulse_train(60, 125, 9, jitter=1.5)
    write_recording(raw, "2024_06_03_140", np.concatenate([slow, fast]), {5: "* baseline", 12000: "* end"})
    assert rng is not None
    meta = base / "animals.csv"
    meta.write_text("Code,dox treatment,Etn Treatment,Sex,date of surgery \n201,0,,Male,2024-01-01\n146,20,0,female,2024-01-02\n"
                    "125,20,16,Female,bad\n140,20,5,,2024-01-02\n")
    out = P.run(spark, str(raw), read_animals(spark, str(meta)), str(base / "out"))
    return out, truth, base


def rows(df, key="recording_id"):
    return {r[key]: r for r in df.collect()}


def test_reader(study, spark):
    out, _, base = study
    r = rows(out["recordings"])
    assert r["2024_01_05_201"]["n_header"] == 6 and r["2024_01_05_201"]["ecg_col"] == 2
    assert r["2024_01_05_201"]["n_samples"] == 30000 and r["2024_01_05_201"]["fs"] == 1000
    assert str(r["22024_06_01_115"]["recording_date"]) == "2024-06-01" and r["22024_06_01_115"]["animal_id"] == 115
    assert r["nonumbers"]["animal_id"] is None
    s = Store(spark, str(base / "out")).read("samples").where("recording_id = '2024_01_05_201'")
    got = [x["mv"] for x in s.orderBy("sample_idx").collect()]
    x, _ = pulse_train(30, 120, 1)
    x = np.round(x, 6)
    x[1500:1503] = np.interp([1500, 1501, 1502], [1499, 1503], [x[1499], x[1503]])
    assert np.allclose(got, x, atol=1e-9)
    nulls = labchart.parse(labchart.read_lines(spark, str(base / "raw"), "2024_01_05_201.txt"),
                           labchart.layout(labchart.read_lines(spark, str(base / "raw"), "2024_01_05_201.txt")), "null")
    assert nulls.count() == 30002
    assert labchart.find_recording(out["recordings"], 125).first()["recording_id"] == "2024_06_03_125"


def test_reader_splits_files(study, spark):
    """The same samples when every file is read as many byte blocks."""
    _, _, base = study
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        lines = labchart.read_lines(spark, str(base / "raw"))
        assert lines.select("recording_id", "block").distinct().count() > 40
        split = labchart.parse(lines, labchart.layout(lines))
        whole = Store(spark, str(base / "out")).read("parsed")
        assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_statuses(study):
    a = rows(study[0]["audit"], "file")
    assert a["2024_01_05_201.txt"]["status"] == "OK" and not a["2024_01_05_201.txt"]["inverted"]
    assert a["2024_01_05_201.txt"]["rule_used"] == "A_same_*" and a["2024_01_05_201.txt"]["start_annotation"].startswith("#* ecg baseline")
    assert a["2024_01_09_146.txt"]["status"] == "OK"
    assert a["22024_06_01_115.txt"]["status"] == "FAILED_COLUMN" and "looks like BPM" in a["22024_06_01_115.txt"]["rule_used"]
    assert a["2024_06_03_130.txt"]["status"] == "FAILED_ANNOTATION" and a["2024_06_03_130.txt"]["rule_used"] == "no_markers"
    assert a["nonumbers.txt"]["status"] == "FAILED_FILE"
    assert a["2024_06_03_125.txt"]["rule_used"] == "B_cross"


def test_features(study):
    out, truth, _ = study
    f = rows(out["features"])["2024_01_05_201"]
    inside = [b for b in truth["2024_01_05_201"] if 1000 <= b < 21000]
    assert abs(f["n_beats"] - len(inside)) <= 2
    assert f["heart_rate_bpm"] == pytest.approx(500, abs=1) and f["rr_mean_ms"] == pytest.approx(120, abs=0.3)
    assert 0.35 < f["r_amplitude_mv"] < 0.75 and f["qrs_duration_ms"] < 15
    assert f["qtc_ms"] is None or f["qtc_ms"] == pytest.approx(f["qt_ms"] / np.sqrt(f["rr_mean_ms"] / 100))
    assert f["study_guess"] == "acute" and rows(out["features"])["2024_06_03_125"]["study_guess"] == "chronic"


def test_quality_guard_relocates(study):
    w = rows(study[0]["window_audit"])["2024_06_03_140"]
    assert w["quality_flag"] == "solid" and w["window_moved"] and w["new_start"] == 15005
    assert w["n_tried"] == 12 and w["old_HR_bpm"] < 300 <= w["new_HR_bpm"]


def test_master(study):
    m = rows(study[0]["master"], "animal_id")
    assert m[201]["group"] == "Control" and m[146]["group"] == "Dox" and m[125]["group"] == "Dox+Etn16" and m[140]["group"] is None
    assert m[201]["sex"] == "male" and m[140]["sex"] is None and m[125]["surg"] is None and str(m[201]["surg"]) == "2024-01-01"
    assert m[125]["rhythm_regular"] == 0 and m[125]["qt_ms"] is None and m[201]["rhythm_regular"] == 1


def test_recovery(study, spark, tmp_path):
    out = study[0]
    flagged = out["master"].where("rr_cv > 0.15").select("recording_id", "animal_id", "group", "study", "rr_cv")
    assert flagged.count() >= 1
    r = recovery.run(out["segments"], flagged, Store(spark, str(tmp_path)))
    assert r["recovery"].count() == flagged.count()
    seg = rows(out["segments"])["2024_06_03_125"]
    trace = np.array(seg["filtered"]) * (-1 if seg["inverted"] else 1)
    best = np.inf
    for s0 in range(0, max(1, len(trace) - 10000), 2000):
        p, _, _ = dsp.oriented_peaks(trace[s0:s0 + 10000])
        rr = np.diff(p).astype(float)
        rr = rr[(rr >= 60000 / 700) & (rr <= 200)]
        if len(p) >= 5 and len(rr) >= 5:
            best = min(best, rr.std() / rr.mean())
    got = rows(r["recovery"])["2024_06_03_125"]
    assert got["best_window_cv"] == pytest.approx(best, abs=0.0051) and got["recoverable"] == (best <= 0.15)
    r["shortwin"].collect(), r["recovered"].collect()


def test_baseline_tiers_against_nested_loops(spark):
    """The window search against the plain nested-loop reading of its rules."""
    rng = np.random.default_rng(3)
    texts = ["baseline", "basline end", "ecg", "start x", "done", "stop", "oc 1 start", "note", "baseline end", "injection"]
    marks, n = [], {}
    for rec in range(60):
        n[rec] = int(rng.integers(20000, 1500000))
        for idx in sorted(rng.choice(n[rec], int(rng.integers(0, 7)), replace=False)):
            marks.append((str(rec), int(idx), str(rng.choice(list("*123"))), str(rng.choice(texts))))
    df = spark.createDataFrame(marks, "recording_id string, idx bigint, prefix string, text string")
    recs = spark.createDataFrame([(str(k), v) for k, v in n.items()], "recording_id string, n_samples bigint")
    got = rows(V.baseline_windows(V.annotate_markers(df), recs))

    def brute(rec):
        ms = [m for m in marks if m[0] == str(rec) and not any(k in m[3] for k in ("oc 1", "injection"))]
        end = lambda m: any(k in m[3] for k in ("end", "done", "stop"))
        base = lambda m: "baseline" in m[3].replace("basline", "baseline")
        def first(s, e, lo, hi):
            return next(((a, b) for a in s for b in e if lo <= b[1] - a[1] <= hi), None)
        st, en = [m for m in ms if not end(m)], [m for m in ms if end(m)]
        for p in "*123":
            hit = first([m for m in st if m[2] == p], [m for m in en if m[2] == p], 10000, 120000)
            if hit:
                return hit[0][1], min(hit[1][1], n[rec]), f"A_same_{p}"
        hit = first(st, en, 10000, 120000)
        if hit:
            return hit[0][1], min(hit[1][1], n[rec]), "B_cross"
        hit = first([m for m in st if base(m)], [m for m in en if base(m)], 10000, 900000)
        if hit:
            return hit[0][1], min(hit[0][1] + 60000, hit[1][1], n[rec]), "C_long_baseline"
        c = next((m for m in st if any(k in m[3] for k in ("baseline", "ecg", "start"))), None) or (st or ms or [None])[0]
        return (c[1], min(c[1] + 30000, n[rec]), "D_single_30s") if c else (None, None, "no_markers")
    for rec in range(60):
        g = got[str(rec)]
        assert (g["base_start"], g["base_end"], g["rule_used"]) == brute(rec), rec


def test_gap_fill_against_interp(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=500)
    hole = rng.random(500) < 0.6
    hole[:7] = hole[-9:] = True
    df = spark.createDataFrame([(1, i, None if h else float(x)) for i, (x, h) in enumerate(zip(v, hole))], "r int, i bigint, v double")
    got = [x["v"] for x in V.fill_gaps(df, ["r"], "i", "v", block=16).orderBy("i").collect()]
    ok = np.flatnonzero(~hole)
    assert np.allclose(got, np.interp(np.arange(500), ok, v[ok]))
    assert F is not None
