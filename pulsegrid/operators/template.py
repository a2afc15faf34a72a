"""Distance of each recording's mean beat to a healthy template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators.beats import elementwise
from pulsegrid.operators.morphology import Beat
from pulsegrid.operators.ordered import attach_one_row, positions


def normalised(beat: Beat, quiet: int = -70, r_half: int = 5) -> Column:
    """Quiet level 0 and R height 1; NULL when the R height is not positive."""
    def scaled(b, base, height):
        return F.when(height > 0, F.transform(b, lambda x: (x - base) / height))
    return A.let(lambda b, base, top: A.let(scaled, b, base, top - base), beat.a,
                 A.mean(beat.window(-beat.pre, quiet - 1)), beat.top(-r_half, r_half))


def warped(norm: Column, rr_ms: Column, pre: int, points: int = 200, first: float = -0.15, last: float = 0.60) -> Column:
    """The beat on a grid of RR fractions, linearly interpolated and clamped at its ends."""
    step = (last - first) / (points - 1)

    def body(b, rr, edge):
        def value(x):
            return A.let(lambda i: F.get(b, i) + (F.get(b, i + 1) - F.get(b, i)) * (x - i),
                         F.least(F.floor(x).cast("int"), edge - 1))
        where = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.greatest(
            F.lit(0.0), F.least((F.lit(first) + k * F.lit(step)) * rr + pre, edge.cast("double"))))
        return F.transform(where, value)
    return F.when(norm.isNotNull() & rr_ms.isNotNull(), A.let(body, norm, rr_ms, F.size(norm) - 1))


def prepare(recordings: DataFrame, mean_beat: str, rr_ms: str, pre: int, n: int, quiet: int = -70, r_half: int = 5,
            points: int = 200, first: float = -0.15, last: float = 0.60) -> DataFrame:
    b = Beat(F.col(mean_beat).cast("array<double>"), pre, n)
    out = recordings.withColumn("fms", normalised(b, quiet, r_half))
    return out.withColumn("warp", warped(F.col("fms"), F.col(rr_ms), pre, points, first, last))


def reference_template(prepared: DataFrame) -> DataFrame:
    """One row: mean, SD and size of the fixed-time and warped beats of the given recordings."""
    both = [elementwise(prepared.where(f"{c} IS NOT NULL"), [], c).select(
        F.col("mean").alias(f"{c}_ref"), F.col("sd").alias(f"{c}_sd"), F.col("n").alias(f"{c}_n"))
        for c in ("fms", "warp")]
    return attach_one_row(both[0], both[1])


def score(prepared: DataFrame, reference: DataFrame) -> DataFrame:
    """Correlation and RMSE to the template on both axes. The reference is a single row of two short arrays."""
    scored = attach_one_row(prepared, reference)
    return scored.withColumns({
        "corr_fms": A.pearson(F.col("fms_ref"), F.col("fms")), "rmse_fms": A.rmse(F.col("fms_ref"), F.col("fms")),
        "corr_warp": A.pearson(F.col("warp_ref"), F.col("warp")), "rmse_warp": A.rmse(F.col("warp_ref"), F.col("warp")),
    }).drop("fms_ref", "fms_sd", "fms_n", "warp_ref", "warp_sd", "warp_n")


def score_note(excluded: Column, mean_beat: Column, norm: Column, rr_ms: Column) -> Column:
    return (F.when(excluded, "HARD_EXCLUDE").when(mean_beat.isNull(), "no_mean_beat").when(norm.isNull(), "normalise_failed")
             .when(rr_ms.isNull(), "no_median_rr").otherwise("scored"))


def null_reason(mean_beat: Column, n_beats: Column, norm: Column, corr_warp: Column, warp: Column) -> Column:
    return (F.when(mean_beat.isNull(), "no_mean_beat").when(n_beats < 2, "too_few_beats")
             .when(norm.isNull(), "normalise_failed").when(warp.isNotNull() & corr_warp.isNull(), "warp_pearsonr_failed")
             .otherwise(""))


def rhythm_flag(rr_cv: Column, corr_warp: Column, limit: float = 0.15) -> Column:
    return F.coalesce((rr_cv > limit) & corr_warp.isNotNull(), F.lit(False))


def ranked(scores: DataFrame, by: str = "rmse_warp", ties: str = "animal_id") -> DataFrame:
    """Final report order: one row per animal, nearest first, unscored last."""
    unscored = F.col(by).isNull()
    placed = positions(scores.withColumns({"_unscored": unscored, "_by": F.coalesce(F.col(by), F.lit(0.0))}), ["_unscored"], "_by", [ties], "rank")
    placed = attach_one_row(placed, scores.agg(F.count(by).alias("_scored")))
    rank = F.col("rank") + F.when(F.col("_unscored"), F.col("_scored")).otherwise(0)
    return placed.withColumn("rank", rank.cast("int")).drop("_unscored", "_by", "_scored")
