"""The side studies: every function takes stage tables of ``recordings.run`` and returns a result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import arrays as A, columns as X, constants as C
from pulsegrid.operators import beats as B, classify as L, clusters as K, matrix as M, morphology as Mo, pairwise as PW, signals as S
from pulsegrid.operators import template as T

PRE, POST, N = C.PRE_R_MS, C.POST_R_MS, C.PRE_R_MS + C.POST_R_MS


def _rr(fs: int = C.FS_HZ):
    return F.transform(A.diff(F.col("peaks")), lambda v: v * (1000.0 / fs))


def detector_robustness(segments: DataFrame, tolerance: int = 10, at_least: int = 5, fs: int = C.FS_HZ) -> DataFrame:
    """Both detectors on the same filtered segment; peaks of a segment are few, so they are matched in place."""
    s = segments.where("error IS NULL").select("recording_id", "hr", "peaks", S.second_peaks(F.col("filtered"), fs).alias("alt"))
    s = s.where((F.size("peaks") >= at_least) & (F.size("alt") >= at_least))
    hit = F.filter("peaks", lambda p: F.exists("alt", lambda q: F.abs(q - p) <= tolerance))
    return s.select("recording_id", F.col("hr").alias("hr_mad"), (60000.0 / (A.median(A.diff(F.col("alt"))) * 1000.0 / fs)).alias("hr_alt"),
                    F.size("peaks").alias("n_mad"), F.size("alt").alias("n_alt"), (100.0 * F.size(hit) / F.size("peaks")).alias("match"))


def hrv_rows(segments: DataFrame) -> DataFrame:
    s = segments.where("error IS NULL").select("recording_id", _rr().alias("rr"))
    s = s.withColumns({"d": A.diff(F.col("rr")), "sdnn": A.sd(F.col("rr"))})
    s = s.withColumn("sdd", A.sd(F.col("d")))
    ok, sdnn, sdd = F.size("rr") >= 5, F.col("sdnn"), F.col("sdd")
    values = {"sdnn": sdnn, "rmssd": F.sqrt(A.dot(F.col("d"), F.col("d")) / F.size("d")), "cv": sdnn / A.mean(F.col("rr")),
              "sd1": F.sqrt(F.lit(0.5)) * sdd, "sd2": F.sqrt(F.greatest(2 * sdnn * sdnn - 0.5 * sdd * sdd, F.lit(0.0)))}
    return s.select("recording_id", *[F.when(ok, v).alias(k) for k, v in values.items()])


def rich_features(segments: DataFrame, templates: DataFrame, master: DataFrame, components: int = 5) -> DataFrame:
    """HRV plus functional principal components of baseline-subtracted templates, for clean animals."""
    clean = master.where(X.is_clean_rhythm(F.col("status"), F.col("rr_cv"))).select("recording_id", "animal_id", "group", "study")
    shape = templates.join(clean, "recording_id").select("recording_id", A.let(
        lambda b, base: F.transform(b, lambda v: v - base), F.col("template"), Mo.Beat("template").level(-70)).alias("x"))
    p = M.Components(shape, components)
    scores = p.scores(shape).select("recording_id", *[F.col("scores")[i].alias(f"fpca{i + 1}") for i in range(components)])
    return clean.join(hrv_rows(segments), "recording_id").join(scores, "recording_id")


def detection_diagnosis(segments: DataFrame, fs: int = C.FS_HZ) -> DataFrame:
    """RR percentiles, heart rate three ways and the spectrum's dominant line per segment."""
    s = segments.where("error IS NULL AND size(peaks) >= 2").select(
        "recording_id", "inverted", F.col("hr").alias("pipeline_hr"), F.size("peaks").alias("n_peaks"), (F.size("filtered") / fs).alias("dur_s"), _rr(fs).alias("rr"),
        S.spectrum(F.col("filtered"), float(fs), quarter=True).alias("psd"))
    rr = F.col("rr")
    out = s.withColumns({"rr_min_ms": F.array_min("rr"), "rr_p5_ms": A.quantile(rr, .05), "rr_median_ms": A.median(rr), "rr_p95_ms": A.quantile(rr, .95), "rr_mean_ms": A.mean(rr),
                         "pct_near_floor": 100.0 * A.mean(F.transform(rr, lambda v: (v <= C.REFRACTORY_MS + 10).cast("double"))),
                         "hr_count": F.col("n_peaks") / F.col("dur_s") * 60.0, **S.spectrum_diagnosis(F.col("psd"))})
    return out.withColumns({"hr_mean_rr": 60000.0 / F.col("rr_mean_ms"), "hr_median_rr": 60000.0 / F.col("rr_median_ms"),
                            "polarity": F.when(F.col("inverted"), "inverted").otherwise("upright")}).withColumn(
        "diverges", F.abs(F.col("hr_count") - F.col("hr_median_rr")) > 50).drop("rr", "psd")


def beat_overlay(beats: DataFrame) -> DataFrame:
    return Mo.overlay(beats, B.elementwise(beats, ["recording_id"]), ["recording_id"], PRE, N)


def per_beat_report(beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per wave consistency, QT yield) of every recording's beats."""
    qt = Mo.Beat("beat").qt(F.col("median_rr_ms"))
    yields = beats.groupBy("recording_id").agg(F.count("*").alias("n_beats"), (100.0 * F.count(qt) / F.count("*")).alias("qt_yield_pct"), F.avg(qt).alias("qt_ms"))
    return Mo.landmark_consistency(beats, ["recording_id"], PRE, N), yields


def qt_audit(beats: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Old and new QT per recording, their difference and, where given, the percent error against manual values."""
    b = Mo.Beat("beat")
    per = beats.select("recording_id", b.qt(F.col("median_rr_ms")).alias("new"), b.qt_absolute().alias("old"))
    out = per.groupBy("recording_id").agg(F.avg("old").alias("qt_old_ms"), F.avg("new").alias("qt_new_ms"), F.count("*").alias("n_beats"))
    out = out.withColumn("qt_delta_ms", F.col("qt_new_ms") - F.col("qt_old_ms"))
    if manual is None:
        return out
    err = lambda c: 100.0 * (F.col(c) - F.col("qt_manual_ms")) / F.col("qt_manual_ms")
    return out.join(manual, "recording_id", "left").withColumns({"old_error_pct": err("qt_old_ms"), "new_error_pct": err("qt_new_ms")})


def mains_comparison(packed: DataFrame, fs: int = C.FS_HZ) -> DataFrame:
    """R-amplitude loss and 50 Hz rejection of notch and least-squares mains removal, per recording.

    ``packed`` (recording_id, raw): the raw segments.
    """
    def swing(name):
        d = S.detected(F.col("raw"), fs, name)
        cut = packed.select("recording_id", d.alias("d")).select("recording_id", "d.filtered", "d.peaks")
        n = F.size(B.cut_beats(F.col("filtered"), F.col("peaks"), PRE, POST))
        beats = B.explode_beats(cut, ["recording_id"]).join(cut.select("recording_id", n.alias("_n")), "recording_id")
        return B.template(beats, ["recording_id"], count="_n").select("recording_id", Mo.Beat("template").swing(-15, 35).alias(f"r_{name}"))

    def power(trace, name):
        return S.band_power(S.spectrum(trace, float(fs), 4096), 49, 51).alias(name)
    rate = packed.select("recording_id", power(F.col("raw"), "p_raw"), *[power(S.filtered(F.col("raw"), fs, m), f"p_{m}") for m in ("notch60", "ls_sequential")])
    out = swing("none").join(swing("notch60"), "recording_id").join(swing("ls_sequential"), "recording_id").join(rate, "recording_id")
    for m in ("notch60", "ls_sequential"):
        out = out.withColumn(f"loss_{m}_pct", 100.0 * (F.col("r_none") - F.col(f"r_{m}")) / F.col("r_none"))
        out = out.withColumn(f"rejected_{m}_pct", F.when(F.col("p_raw") > 0, 100.0 * (1.0 - F.col(f"p_{m}") / F.col("p_raw"))))
    return out


def denoising_comparison(packed: DataFrame, methods=("raw", "notch30", "notch60", "ls_joint", "ls_sequential"), baseline: str = "raw", fs: int = C.FS_HZ) -> DataFrame:
    """Rhythm, SNR and wave amplitudes per recording and method, with difference and percent change to the baseline."""
    from pyspark.sql import Window as W
    waves = (("R", -5, 5, 1), ("P", -55, -15, 1), ("S", 1, 12, -1), ("J", 12, 35, 1), ("T", 40, 90, 1))
    out = None
    for m in methods:
        cut = packed.select("recording_id", S.filtered(F.col("raw"), fs, m).alias("y")).select(
            "recording_id", F.col("y").alias("trace"), S.detected(F.col("y"), fs, mains=None).alias("d")).select("recording_id", "trace", "d.filtered", "d.peaks")
        n = F.size(B.cut_beats(F.col("filtered"), F.col("peaks"), PRE, POST))
        rhythm = cut.select("recording_id", n.alias("_n"), F.size("peaks").alias("n_beats"), A.mean(_rr(fs)).alias("rr_mean_ms"), A.sd(_rr(fs)).alias("rr_std_ms"),
                            S.cardiac_share(S.spectrum(F.col("trace"), float(fs), 4096)).alias("snr"))
        beats = B.explode_beats(cut, ["recording_id"]).join(rhythm.select("recording_id", "_n"), "recording_id")
        b = Mo.Beat("mean")
        tpl = B.elementwise(beats, ["recording_id"]).select("recording_id", *[b.amplitude(lo, hi, s).alias(f"{w}_amp_mv") for w, lo, hi, s in waves],
                                                            b.return_time(40, b.level(-70), 0.05 * F.array_max("mean")).alias("qt_ms"))
        one = rhythm.drop("_n").join(tpl, "recording_id", "left").withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    mine = W.partitionBy("recording_id")
    for c in ("snr", *[f"{w[0]}_amp_mv" for w in waves]):
        base = F.max(F.when(F.col("method") == baseline, F.col(c))).over(mine)
        out = out.withColumns({f"{c}_delta": F.col(c) - base, f"{c}_pct": F.when(base != 0, 100.0 * (F.col(c) - base) / F.abs(base))})
    return out.withColumns({"hr_bpm": 60000.0 / F.col("rr_mean_ms"), "qtc_ms": X.qtc_mitchell(F.col("qt_ms"), F.col("rr_mean_ms"))})


def problem_triage(packed: DataFrame, segments: DataFrame, flagged: DataFrame, fs: int = C.FS_HZ) -> DataFrame:
    """Raw against filtered over the whole window and its first second, with population rr_cv and tier."""
    x = packed.join(segments.select("recording_id", "filtered", "inverted", "peaks", "hr"), "recording_id").join(flagged.select("recording_id", "status"), "recording_id")
    sign = F.when(F.col("inverted"), -1.0).otherwise(1.0)
    filt = A.let(lambda f, s: F.transform(f, lambda v: v * s), F.col("filtered"), sign)
    head = lambda c: F.slice(c, F.lit(1), F.lit(fs))
    x = x.withColumn("_f", filt)
    full, first = Mo.raw_filtered_metrics(F.col("raw"), F.col("_f")), Mo.raw_filtered_metrics(head(F.col("raw")), head(F.col("_f")))
    out = x.select("recording_id", "status", "inverted", F.col("hr"), F.size("peaks").alias("beats"), (F.size("raw") / fs).alias("window_s"),
                   (A.sd(_rr(fs), 0) / A.mean(_rr(fs))).alias("rr_cv_pop"), full["corr"].alias("corr_full"), full["pct_removed"].alias("pct_full"),
                   first["corr"].alias("corr_1s"), first["pct_removed"].alias("pct_1s"))
    return out.withColumns({"d_corr": F.col("corr_1s") - F.col("corr_full"), "d_pct": F.col("pct_1s") - F.col("pct_full"),
                            "tier": X.triage_tier(F.col("status"), F.col("hr"), F.col("rr_cv_pop"))})


def distance_to_healthy(recordings: DataFrame, templates: DataFrame, seeds: list[int], excluded: list[int] = ()) -> DataFrame:
    """Every recording (recording_id, animal_id, status, n_beats, median_rr_ms, rr_cv) against the seed template."""
    full = recordings.join(templates, "recording_id", "left")
    p = T.prepare(full, "template", "median_rr_ms", PRE, N)
    scored = T.score(p, T.reference_template(p.where(F.col("animal_id").isin(*seeds))))
    c = F.col
    return T.ranked(scored.withColumns({
        "in_template": c("animal_id").isin(*seeds), "rr_cv_flag": T.rhythm_flag(c("rr_cv"), c("corr_warp")),
        "null_reason": T.null_reason(c("template"), c("n_beats"), c("fms"), c("corr_warp"), c("warp")),
        "note": T.score_note(c("animal_id").isin(*excluded) if excluded else F.lit(False), c("template"), c("fms"), c("median_rr_ms"))}).drop("template", "fms", "warp"))


def cluster_study(master: DataFrame, ks=(2, 5), seed: int = 42) -> DataFrame:
    """Feature matrix with flags and every clustering of it as a column."""
    x = M.feature_matrix(master, ["recording_id"], C.CLUSTER_FEATURES, C.CAUSE_FLAGS)
    out = x
    for k in ks:
        for name, fit in (("cluster", K.kmeans), ("cluster_gmm", K.mixture)):
            out = out.join(fit(x, k, seed=seed).select("recording_id", F.col("cluster").alias(f"{name}_k{k}")), "recording_id")
    return out


def choose_phenotypes(points: DataFrame, id_: str, x: str = "x", ks=(2, 3, 4, 5), runs: int = 100,
                      algorithms=("kmeans", "ward", "gmm", "pam")) -> DataFrame:
    """Consensus clustering: the k whose subsampled runs are least ambiguous, then k-means at that k over all rows."""
    best = K.consensus_choice(points, id_, ks, x, runs, algorithms=algorithms).where("chosen").first()["k"]
    return K.kmeans(points, best, x).select(id_, (F.col("cluster") + 1).alias("phenotype"), F.lit(best).alias("k"))


def supervised_tasks(master: DataFrame, columns: list[str], studies=("acute", "chronic"), permutations: int = 200) -> DataFrame:
    """The task list per study: all arms (two models), control against dox, dox against the pooled treated arms."""
    control, dox, *treated = C.GROUPS
    every, pooled = {a: a for a in C.GROUPS}, {dox: dox} | {a: f"{dox}+" for a in treated}
    tasks = {"5-group [LDA]": (every, "lda"), "5-group [PLS-DA]": (every, "pls"), "Control-vs-Dox [LDA]": ({control: control, dox: dox}, "lda"),
             "Dox-vs-pooled [LDA]": (pooled, "lda")}
    out = None
    for study in studies:
        matrix = M.feature_matrix(master.where(F.col("study") == study), ["recording_id", "group"], columns)
        one = L.task_list(matrix, "recording_id", "group", tasks, permutations=permutations).select(F.lit(study).alias("study"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def classification_sweep(master: DataFrame, feature_sets: dict[str, list[str]], studies=("acute", "chronic"),
                         groupings=("five_groups", "control_vs_dox", "any_dox_vs_control", "dox_vs_any_etn", "high_etn_vs_rest"),
                         models=("lda", "forest"), permutations: int = 60, min_class: int = 3) -> DataFrame | None:
    """Study × labelling × feature set × model; a combination with a class under ``min_class`` is left out."""
    out = None
    for study in studies:
        rows = master.where(F.col("study") == study)
        for grouping in groupings:
            labelled = rows.withColumn("_y", X.labelling(F.col("group"), grouping)).where("_y IS NOT NULL")
            for fs_name, columns in feature_sets.items():
                matrix = M.feature_matrix(labelled, ["recording_id", "_y"], columns)
                for model in models:
                    r = L.cross_validated(matrix, "recording_id", "_y", model=model, permutations=permutations, min_class=min_class)
                    if r is not None:
                        r = r.select(*[F.lit(v).alias(n) for n, v in (("study", study), ("grouping", grouping), ("features", fs_name), ("model", model))], "*")
                        r = r.withColumn("verdict", F.when(F.col("p_value") < 0.05, "SIGNIFICANT").otherwise("chance"))
                        out = r if out is None else out.unionByName(r)
    return out


# ---- figure data --------------------------------------------------------------------------------------------
def template_lines(templates: DataFrame) -> DataFrame:
    return templates.select("recording_id", F.posexplode("template").alias("i", "mv")).select("recording_id", (F.col("i") - PRE).alias("t_ms"), "mv")


def rate_bars(features: DataFrame, band=(400, 500)) -> DataFrame:
    return features.select("animal_id", "heart_rate_bpm", F.col("heart_rate_bpm").between(*band).alias("in_band"))


def tachogram(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", F.posexplode(_rr()).alias("beat_no", "rr_ms"))


def rr_histogram(segments: DataFrame, low: float = 0, high: float = 300, bins: int = 60) -> DataFrame:
    index = F.least(F.floor((F.col("rr_ms") - low) / ((high - low) / bins)), F.lit(bins - 1))
    return tachogram(segments).where(F.col("rr_ms").between(low, high)).groupBy("recording_id", index.alias("bin")).agg(F.count("*").alias("n"))


def spectrum_lines(segments: DataFrame, fs: int = C.FS_HZ, nperseg: int = 4096) -> DataFrame:
    return segments.select("recording_id", F.inline(S.spectrum(F.col("filtered"), float(fs), nperseg)))


def trace_slice(segments: DataFrame, first_s: float, seconds: float, fs: int = C.FS_HZ) -> DataFrame:
    part = F.slice("filtered", F.lit(int(first_s * fs) + 1), F.lit(int(seconds * fs)))
    return segments.select("recording_id", F.posexplode(part).alias("i", "mv")).withColumn("t_s", first_s + F.col("i") / fs)


def beat_bundle(beats: DataFrame, at_most: int = 150) -> DataFrame:
    """At most ``at_most`` evenly spaced beats per recording for an overlay plot."""
    from pulsegrid.operators.relational import systematic_sample
    return systematic_sample(beats.select("recording_id", "beat_no", "beat"), ["recording_id"], "beat_no", [], at_most, block=F.floor(F.col("beat_no") / 4096))


def pca_scatter(points: DataFrame, id_: str, x: str = "x") -> DataFrame:
    p = M.Components(points, 2, x)
    s = p.scores(points)
    a, b = F.col("scores")[0], F.col("scores")[1]
    return s.select(id_, a.alias("pc1"), b.alias("pc2"), ((a > 5) | (F.abs(b) > 3)).alias("outlier"))


def dose_panel(long: DataFrame, keys: list[str], dose: str) -> DataFrame:
    from pulsegrid.operators.effects import ols_slope
    from pulsegrid.operators.relational import dose_means
    means = dose_means(long, keys, dose)
    ranked = long.join(means.select(*keys, dose, "dose_rank"), [*keys, dose])
    return means.join(ols_slope(ranked, keys, "dose_rank"), keys).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("dose_rank"))
