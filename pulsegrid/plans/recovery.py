"""Flagged recordings to recovered windows and features: one window table, every report a projection of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import arrays as A, columns as X, constants as C
from pulsegrid.operators import beats as B, morphology as M, signals as S, windows as V

WIDTHS_S = {10: (2, 1), 5: (1,), 3: (1,)}


def sweep(segments: DataFrame, width_s: int, step_s: int, fs: int = C.FS_HZ, upright: bool = True) -> DataFrame:
    """Every sub-window of each filtered segment with its peaks and interval statistics.

    Segments hold at most two minutes, so a row turns into at most 120 windows of ``width_s`` seconds.
    """
    width, step = width_s * fs, step_s * fs
    trace = F.col("filtered") if upright else F.when(F.col("inverted"), F.transform("filtered", lambda v: -v)).otherwise(F.col("filtered"))
    cut = S.sub_windows(segments.where("error IS NULL"), trace, width, step, partial=True)
    seen = cut.select("recording_id", "start", F.col("x").alias("trace"), S.detected(F.col("x"), fs, mains=None, keep_trace=False).alias("d"))
    rr = F.transform(A.diff(F.col("d.peaks")), lambda v: v * (1000.0 / fs))
    low, high = C.RR_KEEP_MS
    out = seen.select("recording_id", F.lit(width_s).alias("width_s"), "start", "trace", F.col("d.peaks").alias("peaks"),
                      F.filter(rr, lambda v: (v >= low) & (v <= high)).alias("rr"))
    enough = (F.size("peaks") >= C.RECOVERY_MIN_COUNT) & (F.size("rr") >= C.RECOVERY_MIN_COUNT)
    return out.where(enough).select(
        "recording_id", "width_s", "start", "trace", "peaks", F.size("rr").cast("bigint").alias("n_rr"), A.mean(F.col("rr")).alias("rr_mean"),
        (A.sd(F.col("rr"), 0) / A.mean(F.col("rr"))).alias("cv_pop"))


def recoverable(flagged: DataFrame, windows: DataFrame) -> DataFrame:
    """Lowest cv over 10-second windows against the limit."""
    best = V.lowest_cv(windows, ["recording_id"])
    return flagged.join(best, "recording_id", "left").select(
        "recording_id", "group", F.bround("rr_cv", 2).alias("orig_rr_cv"), F.bround("best_cv", 2).alias("best_window_cv"),
        F.coalesce("recoverable", F.lit(False)).alias("recoverable"))


def short_windows(remaining: DataFrame, windows: DataFrame) -> DataFrame:
    """Lowest cv per width and the verdict."""
    best = windows.groupBy("recording_id").agg(*[
        F.bround(F.min(F.when(F.col("width_s") == w, F.col("cv_pop"))), 3).alias(f"cv_{w}s") for w in WIDTHS_S])
    return remaining.join(best, "recording_id", "left").withColumn("verdict", V.recovery_verdict(F.col("cv_5s"), F.col("cv_3s")))


def first_windows(windows: DataFrame, plan: DataFrame) -> DataFrame:
    """Leftmost clean window of each recording at its planned width."""
    planned = windows.join(plan, ["recording_id", "width_s"])
    return V.first_clean(planned, ["recording_id", "width_s"], take=("cv_pop", "n_rr", "rr_mean", "trace", "peaks"))


def recovered(first: DataFrame, animals: DataFrame, fs: int = C.FS_HZ) -> DataFrame:
    """Features of the recovered windows, rounded and flagged for plausibility."""
    beats = B.explode_beats(first, ["recording_id"], "trace", "peaks")
    sizes = first.select("recording_id", F.size(B.cut_beats(F.col("trace"), F.col("peaks"), C.PRE_R_MS, C.POST_R_MS)).alias("_n"))
    tpl = B.template(beats.join(sizes, "recording_id"), ["recording_id"], count="_n")
    x = first.drop("trace", "peaks").join(tpl, "recording_id").join(animals, "recording_id", "left")
    shape = M.recovered_features(M.Beat("template"), F.col("rr_mean"))
    wide = x.withColumns({"R_swing_mV": F.array_max("template") - F.array_min("template"), "HeartRate_bpm": 60000.0 / F.col("rr_mean"),
                          "RR_ms": F.col("rr_mean"), "RR_CV": F.col("cv_pop"), "Beats": F.col("n_rr"), **shape})
    wide = wide.withColumn("Plausible", X.plausible(F.col("R_amp_mV"), F.col("HeartRate_bpm"))).withColumns({
        "start_time_s": F.col("start") / fs, "end_time_s": F.col("start") / fs + F.col("width_s")})
    digits = ["HeartRate_bpm", "RR_ms", "RR_CV", "R_amp_mV", "P_amp_mV", "T_amp_mV", "QT_ms", "QTc_ms", "R_swing_mV"]
    return wide.withColumns({c: F.bround(c, 3) for c in digits}).drop("template", "n_averaged", "n_rr", "rr_mean", "cv_pop", "start")


def run(segments: DataFrame, flagged: DataFrame, store) -> dict[str, DataFrame]:
    """``flagged`` (recording_id, animal_id, group, study, rr_cv): the recordings outside the clean set."""
    S.limit_batches(segments.sparkSession)
    mine = segments.join(flagged.select("recording_id"), "recording_id", "left_semi")
    coarse = store.stage("recovery_windows_coarse", sweep(mine, 10, 2, upright=False))
    found = store.stage("flagged_recovery", recoverable(flagged, coarse))
    left = flagged.join(found.where("NOT recoverable").select("recording_id"), "recording_id", "left_semi")
    fine = None
    for w in WIDTHS_S:
        part = sweep(mine, w, 1)
        fine = part if fine is None else fine.unionByName(part)
    fine = store.stage("recovery_windows", fine)
    short = store.stage("flagged_shortwin_recovery", short_windows(left, fine))
    plan = found.where("recoverable").select("recording_id", F.lit(10).alias("width_s")).unionByName(
        short.where("cv_5s <= 0.15").select("recording_id", F.lit(5).alias("width_s")))
    first = first_windows(fine, plan)
    table = store.stage("recovered_features", recovered(first, flagged.select("recording_id", "animal_id", "group", "study")))
    return {"recovery": found, "shortwin": short, "recovered": table}
