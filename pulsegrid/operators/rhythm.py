"""Rhythm of beat sequences: RR series, variability, diagnosis, detector agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import constants as C
from pulsegrid.operators import ordered as O


def rr_series(beats: DataFrame, keys: Sequence[str], tick: str, ties: Sequence[str], block_width: int,
              ticks_per_ms: float) -> DataFrame:
    """Add ``prev`` (tick of the previous beat) and ``rr_ms``; the first beat of a recording has NULLs."""
    out = O.neighbour(beats, keys, tick, ties, {"prev": tick}, block_width)
    return out.withColumn("rr_ms", (F.col(tick) - F.col("prev")) / F.lit(float(ticks_per_ms)))


def rhythm_summary(rr: DataFrame, keys: Sequence[str], floor_ms: float = C.NEAR_FLOOR_MS) -> DataFrame:
    """Beats, mean, SD (0 for a single interval), median, heart rate, share near the refractory floor, rr_cv."""
    x = F.col("rr_ms")
    base = rr.groupBy(*keys).agg(
        F.count("*").alias("n_beats"), F.avg(x).alias("rr_mean_ms"),
        F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x)).alias("rr_std_ms"),
        (100.0 * F.avg((x <= floor_ms).cast("int"))).alias("pct_near_floor"))
    median = O.exact_quantiles(rr, keys, "rr_ms", {"median_rr_ms": 0.5})
    return (base.join(median, list(keys), "left")
            .withColumn("heart_rate_bpm", 60000.0 / F.col("rr_mean_ms"))
            .withColumn("rr_cv", F.col("rr_std_ms") / F.col("rr_mean_ms")))


def variability(rr: DataFrame, keys: Sequence[str], tick: str, ties: Sequence[str], block_width: int) -> DataFrame:
    """SDNN, RMSSD, CV and the Poincaré axes; NULL below five intervals."""
    known = rr.where("rr_ms IS NOT NULL")
    steps = O.neighbour(known, keys, tick, ties, {"_prev_rr": "rr_ms"}, block_width)
    d = F.col("rr_ms") - F.col("_prev_rr")
    agg = steps.groupBy(*keys).agg(
        F.count("rr_ms").alias("n_rr"), F.stddev_samp("rr_ms").alias("sdnn"), F.avg("rr_ms").alias("_mean"),
        F.sqrt(F.avg(d * d)).alias("rmssd"), F.var_samp(d).alias("_vd"))
    sdnn = F.col("sdnn")
    values = {
        "cv": sdnn / F.col("_mean"),
        "sd1": F.sqrt(0.5 * F.col("_vd")),
        "sd2": F.sqrt(F.greatest(2 * sdnn * sdnn - 0.5 * F.col("_vd"), F.lit(0.0))),
        "rmssd": F.col("rmssd"), "sdnn": sdnn}
    return agg.select(*keys, "n_rr", *[F.when(F.col("n_rr") >= 5, v).alias(n) for n, v in values.items()])


def interval_diagnosis(rr: DataFrame, keys: Sequence[str], duration_s: str, floor_band_ms: float = 10.0,
                       refractory_ms: float = C.REFRACTORY_MS) -> DataFrame:
    """Percentiles of RR, share near the refractory floor and heart rate by count, mean and median."""
    x = F.col("rr_ms")
    base = rr.groupBy(*keys).agg(
        F.count("*").alias("n_peaks"), F.min(x).alias("rr_min_ms"), F.avg(x).alias("_mean"),
        (100.0 * F.avg((x <= refractory_ms + floor_band_ms).cast("int"))).alias("pct_near_floor"),
        F.max(duration_s).alias("_dur"))
    q = O.exact_quantiles(rr, keys, "rr_ms", {"rr_p5_ms": .05, "rr_median_ms": .5, "rr_p95_ms": .95})
    out = base.join(q, list(keys)).withColumns({
        "hr_count": F.col("n_peaks") / F.col("_dur") * 60.0,
        "hr_mean_rr": 60000.0 / F.col("_mean"),
        "hr_median_rr": 60000.0 / F.col("rr_median_ms")})
    return out.withColumn("diverges", F.abs(F.col("hr_count") - F.col("hr_median_rr")) > 50).drop("_mean", "_dur")


def detector_agreement(first: DataFrame, second: DataFrame, keys: Sequence[str], tick: str, tolerance: int,
                       at_least: int = 5) -> DataFrame:
    """Share of ``first`` peaks with a ``second`` peak within ``tolerance`` ticks; both need ``at_least`` peaks."""
    marked = O.any_within(first, second, keys, tick, tick, tolerance)
    a = marked.groupBy(*keys).agg(F.count("*").alias("n_mad"), F.count_if("matched").alias("n_matched"))
    b = second.groupBy(*keys).agg(F.count("*").alias("n_alt"))
    return (a.join(b, list(keys)).where((F.col("n_mad") >= at_least) & (F.col("n_alt") >= at_least))
            .withColumn("match", 100.0 * F.col("n_matched") / F.col("n_mad")))
