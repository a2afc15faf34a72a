"""Raw recordings to the feature table and the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions import arrays as A, columns as X, constants as C
from pulsegrid.operators import beats as B, morphology as M, ordered as O, signals as S, windows as V
from pulsegrid.plans.features import assign_study
from pulsegrid.sources import labchart
from pulsegrid.sources.tables import Store


def load(spark: SparkSession, path: str, store: Store, short_rows: str = "drop", layout: str = "header"):
    """Read every export under ``path`` once; later stages read the written tables."""
    lines = labchart.read_lines(spark, path)
    layouts = labchart.layout(lines) if layout == "header" else labchart.fixed_layout(lines)
    layouts = store.stage("layouts", layouts)
    parsed = store.stage("parsed", labchart.parse(lines, layouts, short_rows))
    recordings = store.stage("recordings", labchart.recordings_of(layouts, parsed))
    samples = V.fill_gaps(parsed.select("recording_id", "sample_idx", "mv"), ["recording_id"], "sample_idx", "mv")
    return recordings, store.stage("samples", samples), labchart.markers_of(parsed)


def gate(recordings: DataFrame, samples: DataFrame, markers: DataFrame) -> DataFrame:
    """Window and status of every recording before any signal is touched."""
    column = V.median_exceeds(samples, ["recording_id"], "mv", C.MAX_MEDIAN_ABS)
    suspects = samples.join(column.where("wrong_column").select("recording_id"), "recording_id", "left_semi")
    column = column.join(V.column_gate(suspects, ["recording_id"], "mv").drop("wrong_column"), "recording_id", "left")
    w = V.baseline_windows(V.annotate_markers(markers), recordings).join(column, "recording_id", "left")
    length = F.col("base_end") - F.col("base_start")
    bad_name, empty = F.col("animal_id").isNull(), F.col("n_samples") == 0
    short = F.coalesce(length < C.MIN_SEGMENT_S * C.FS_HZ, F.lit(True))
    failed = (F.when(bad_name | empty, "FAILED_FILE").when(F.col("wrong_column"), "FAILED_COLUMN")
               .when(F.col("base_start").isNull() | short, "FAILED_ANNOTATION"))
    note = (F.when(bad_name, "filename parse").when(empty, "no voltage rows")
             .when(F.col("wrong_column"), F.format_string("voltage median |.| = %.1f (looks like BPM)", F.col("median_abs")))
             .when(F.col("base_start").isNotNull() & short, F.format_string("%s (window too short: %d samples)", F.col("rule_used"), length))
             .otherwise(F.col("rule_used")))
    return w.withColumn("failed", failed).withColumn("rule_used", note)


def detect(samples: DataFrame, gated: DataFrame, store: Store, mains: str = "ls_joint") -> tuple[DataFrame, DataFrame]:
    """Filtered segment and peaks per recording, relocated by the quality guard where the rate is implausible.

    Returns (segments, window audit). Only recordings that trigger the guard are read a second time.
    """
    S.limit_batches(samples.sparkSession)
    wanted = gated.where("failed IS NULL").select("recording_id", "base_start", "base_end", "n_samples")
    packed = S.pack(samples, wanted.select("recording_id", "base_start", "base_end"), "base_start", "base_end")
    first = packed.select("recording_id", S.detected(F.col("raw"), mains=mains).alias("d")).select("recording_id", "d.*")
    first = store.stage("detected", first.join(wanted, "recording_id"))
    plausible = F.coalesce(F.col("hr").between(*C.HR_ACCEPT), F.lit(False))
    trigger = first.where(~plausible & F.col("error").isNull()).select(
        "recording_id", F.col("hr").alias("old_hr"), F.col("base_start").alias("old_start"), "n_samples")

    width, step, reach = (v * C.FS_HZ for v in (C.QUALITY_WIDTH_S, C.QUALITY_STEP_S, C.QUALITY_REACH_S))
    spans = trigger.select("recording_id", "old_start", F.least(F.col("n_samples"), F.col("old_start") + reach).alias("old_end"))
    search = S.sub_windows(S.pack(samples, spans, "old_start", "old_end"), F.col("raw"), width, step, partial=False)
    tried = search.select("recording_id", F.col("start").alias("offset"), S.detected(F.col("x"), mains=mains).alias("d"))
    rr = F.transform(A.diff(F.col("d.peaks")), lambda v: v * (1000.0 / C.FS_HZ))
    tried = store.stage("quality_windows", tried.join(trigger.select("recording_id", "old_start"), "recording_id").select(
        "recording_id", (F.col("old_start") + F.col("offset")).alias("start"), F.col("d.hr").alias("hr"), A.sd(rr).alias("rr_std"),
        F.size("d.peaks").alias("n_beats"), F.col("d.filtered").alias("filtered"), F.col("d.peaks").alias("peaks"), F.col("d.inverted").alias("inverted")))
    passes = (F.col("hr").between(*C.QUALITY_HR) & (F.col("rr_std") <= C.QUALITY_RR_STD_MAX) & (F.col("n_beats") >= C.QUALITY_MIN_BEATS))
    counts = tried.groupBy("recording_id").agg(F.count("*").alias("_tried"))
    choice = V.quality_choice(tried.join(counts, "recording_id").drop("filtered", "peaks"), ["recording_id"], passes, F.col("_tried"))
    audit = trigger.join(choice, "recording_id", "left").withColumns({
        "quality_flag": F.coalesce("quality_flag", F.lit("no_clean_window_found")),
        "n_passing": F.coalesce("n_passing", F.lit(0)), "n_tried": F.coalesce("n_tried", F.lit(0))})
    solid = audit.where("quality_flag = 'solid'").select("recording_id", F.col("best_start").alias("start"))
    moved = tried.join(solid, ["recording_id", "start"]).select(
        "recording_id", "filtered", "peaks", "inverted", "hr", F.lit(None).cast("string").alias("error"),
        F.col("start").alias("base_start"), (F.col("start") + width).alias("base_end"))
    kept = first.join(solid, "recording_id", "left_anti").select(*moved.columns)
    segments = store.stage("segments", kept.unionByName(moved))
    is_solid = F.col("quality_flag") == "solid"
    new = moved.select("recording_id", F.col("hr").alias("_new_hr"))
    audit = audit.join(new, "recording_id", "left").select(
        "recording_id", "old_start", F.round(F.col("old_start") / C.FS_HZ, 2).alias("old_start_s"),
        F.when(is_solid, F.col("best_start")).otherwise(F.col("old_start")).alias("new_start"),
        F.round(F.when(is_solid, F.col("best_start")).otherwise(F.col("old_start")) / C.FS_HZ, 2).alias("new_start_s"),
        (is_solid & (F.col("best_start") != F.col("old_start"))).alias("window_moved"), F.round("old_hr", 2).alias("old_HR_bpm"),
        F.round(F.coalesce("_new_hr", "old_hr"), 2).alias("new_HR_bpm"), F.round("best_rr_std", 2).alias("rr_std_chosen"),
        "n_passing", "n_tried", "quality_flag")
    return segments, store.stage("window_audit", audit)


def rhythm_of(segments: DataFrame, fs: int = C.FS_HZ) -> DataFrame:
    """Rhythm columns straight from the peak array of each segment."""
    s = segments.withColumn("rr", F.transform(A.diff(F.col("peaks")), lambda v: v * (1000.0 / fs)))
    rr = F.col("rr")
    return s.select("recording_id", F.size("peaks").alias("n_beats"), F.col("hr").alias("heart_rate_bpm"), A.mean(rr).alias("rr_mean_ms"),
                    F.when(F.size(rr) == 1, F.lit(0.0)).otherwise(A.sd(rr)).alias("rr_std_ms"), A.median(rr).alias("median_rr_ms"),
                    (100.0 * A.mean(F.transform(rr, lambda v: (v <= C.NEAR_FLOOR_MS).cast("double")))).alias("pct_near_floor"))


def features(recordings: DataFrame, gated: DataFrame, segments: DataFrame, store: Store) -> DataFrame:
    """One row per analysed recording with the fixed feature columns."""
    rhythm = rhythm_of(segments)
    beats = B.explode_beats(segments.where("error IS NULL"), ["recording_id"])
    sizes = segments.select("recording_id", F.size(B.cut_beats(F.col("filtered"), F.col("peaks"), C.PRE_R_MS, C.POST_R_MS)).alias("_n"))
    beats = beats.join(sizes.join(rhythm.select("recording_id", "median_rr_ms", "n_beats"), "recording_id"), "recording_id").where(
        F.col("n_beats") >= C.MIN_PEAKS)
    beats = store.stage("beats", beats)
    templates = store.stage("templates", B.template(beats, ["recording_id"], count="_n"))
    shape = M.assemble(templates, beats, ["recording_id"], C.PRE_R_MS, C.PRE_R_MS + C.POST_R_MS, rr_ms="median_rr_ms")
    base = recordings.join(gated.select("recording_id", "failed"), "recording_id").join(rhythm, "recording_id").join(
        segments.select("recording_id", "error"), "recording_id").join(shape, "recording_id", "left")
    few = F.col("n_beats") < C.MIN_PEAKS
    for c in ("rr_mean_ms", "rr_std_ms", "median_rr_ms", "pct_near_floor"):
        base = base.withColumn(c, F.when(~few, F.col(c)))
    base = base.where("error IS NULL").withColumns({
        "status": V.recording_status(F.lit(False), F.lit(False), F.lit(False), F.col("n_beats"), F.col("heart_rate_bpm")),
        "source_file": F.col("file"), "qtc_ms": X.qtc_mitchell(F.col("qt_ms"), F.col("rr_mean_ms")),
        "qtc_formula": F.when(~few, F.lit("Mitchell"))})
    return assign_study(base, "recording_date", name="study_guess").select("recording_id", *C.FEATURE_COLUMNS)


def null_and_flag(feats: DataFrame) -> DataFrame:
    """rr_cv, the two nulling rules and the four cause flags."""
    f = feats.withColumn("rr_cv", F.col("rr_std_ms") / F.col("rr_mean_ms"))
    f = f.drop(*[c for c in f.columns if c.endswith("_obs")])
    f = X.null_where(f, F.col("rr_cv") > C.RR_CV_CLEAN, ["rr_mean_ms", "qt_ms", "qtc_ms"])
    f = X.null_where(f, F.col("t_wave_excursion_mv") < C.T_EXCURSION_MIN_MV, ["t_wave_amplitude_mv", "rt_interval_ms", "qt_ms", "qtc_ms"])
    return f.withColumns({
        "beats_detected": X.flag(F.col("status") != "FAILED_PEAKS"), "rhythm_regular": X.flag(F.col("rr_cv") <= C.RR_CV_CLEAN),
        "twave_isolated": X.flag(F.col("t_wave_excursion_mv") >= C.T_EXCURSION_MIN_MV),
        "enough_beats_for_sd": X.flag(F.col("qt_std_ms").isNotNull())})


def master(feats: DataFrame, animals: DataFrame) -> DataFrame:
    """Features left-joined to the animal metadata, with group, study, sex, dox and surgery date."""
    m = feats.join(animals, F.col("animal_id") == F.col("Code"), "left")
    dox = F.col("`dox treatment`")
    return m.withColumns({
        "group": X.treatment_group(dox, F.col("`Etn Treatment`")), "study": F.col("study_guess"), "sex": F.lower("Sex"),
        "dox": dox,
        "surg": F.to_date(F.coalesce(F.col("`date of surgery `").try_cast("date")))})


def run(spark: SparkSession, path: str, animals: DataFrame, folder: str, mains: str = "ls_joint") -> dict[str, DataFrame]:
    """The whole job; every table is also left under ``folder``."""
    store = Store(spark, folder)
    recordings, samples, markers = load(spark, path, store)
    gated = store.stage("gated", gate(recordings, samples, markers))
    segments, window_audit = detect(samples, gated, store, mains)
    feats = store.stage("features", features(recordings, gated, segments, store))
    table = store.stage("master", master(null_and_flag(feats), animals))
    found = segments.select("recording_id", F.size("peaks").alias("beats"), F.col("hr").alias("HR_bpm"), "inverted", "error",
                            F.col("base_start").alias("_s"), F.col("base_end").alias("_e"))
    a = gated.join(found, "recording_id", "left").withColumns({"base_start": F.coalesce("_s", "base_start"), "base_end": F.coalesce("_e", "base_end")})
    audit = a.select(
        F.col("file"), "animal_id", "beats", "HR_bpm", "base_start", "base_end",
        ((F.col("base_end") - F.col("base_start")) / C.FS_HZ).alias("duration_s"), F.coalesce("error", "rule_used").alias("rule_used"),
        F.col("ecg_col").alias("ecg_column"), F.coalesce("inverted", F.lit(False)).alias("inverted"),
        F.coalesce("failed", V.recording_status(F.col("error").isNotNull(), F.lit(False), F.lit(False), F.col("beats"), F.col("HR_bpm"))).alias("status"),
        "start_annotation", "end_annotation").orderBy("file")
    return {"recordings": recordings, "segments": segments, "features": feats, "master": table, "window_audit": window_audit,
            "audit": store.stage("per_file_audit", audit)}
