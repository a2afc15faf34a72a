"""Annotation windows, gates and sliding-window searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import constants as C
from pulsegrid.functions.columns import contains_any
from pulsegrid.operators import ordered as O


# ---- annotation text ----------------------------------------------------------------------------------------
def is_end(text: Column) -> Column:
    return contains_any(text, C.END_WORDS)


def is_excluded(text: Column) -> Column:
    return contains_any(text, C.EXCLUDED_WORDS)


def is_baseline(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(C.BASELINE_TYPO), F.lit(C.BASELINE_WORD)).contains(C.BASELINE_WORD)


def annotate_markers(markers: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return (markers.where(~is_excluded(t)).withColumns({
        "is_end": is_end(t), "is_baseline": is_baseline(t), "is_start_hint": contains_any(t, C.START_WORDS)}))


# ---- baseline window ----------------------------------------------------------------------------------------
def _pairs(starts: DataFrame, ends: DataFrame, keys: Sequence[str], low: int, high: int, tier: Column,
           rule: Column, block: int | None = None) -> DataFrame:
    """Per start the first end with a gap in [low, high]; the caller keeps the earliest start."""
    probes = starts.withColumn("_from", F.col("idx") + low)
    found = O.first_at_or_after(probes, ends, keys, "_from", "idx", high - low, take=["text"], name="_end", block=block)
    return found.where(F.col("_end").isNotNull()).select(
        "recording_id", tier.alias("tier"), rule.alias("rule"), F.col("idx").alias("start"),
        F.col("_end.t").alias("end"), F.col("text").alias("start_text"), F.col("_end.text").alias("end_text"))


def baseline_windows(markers: DataFrame, recordings: DataFrame, scale: int = C.FS_HZ,
                     gap: tuple[int, int] = (C.GAP_MIN_S, C.GAP_MAX_S), long_gap: int = C.GAP_MAX_LONG_S,
                     long_use: int = C.LONG_USE_S, single_use: int = C.SINGLE_USE_S, block: int | None = None) -> DataFrame:
    """One analysis window per recording from its annotations.

    ``markers`` (recording_id, idx, prefix, text + the flags of ``annotate_markers``), ``recordings``
    (recording_id, n_samples). Preference: a start and an end of the same prefix, of any prefix, a long pair
    of baseline annotations, a single marker. Within a rule the earliest start wins, then its earliest end.
    """
    lo, hi = gap[0] * scale, gap[1] * scale
    marks = markers.select("recording_id", "idx", "prefix", "text", "is_end", "is_baseline", "is_start_hint")
    starts, ends = marks.where(~F.col("is_end")), marks.where("is_end")
    prefix_rank = F.array_position(F.array(*[F.lit(p) for p in C.MARKER_PREFIXES]), F.col("prefix"))
    known = F.col("prefix").isin(*C.MARKER_PREFIXES)
    same = _pairs(starts.where(known), ends.where(known), ["recording_id", "prefix"], lo, hi,
                  prefix_rank.cast("int"), F.concat(F.lit("A_same_"), F.col("prefix")), block)
    cross = _pairs(starts, ends, ["recording_id"], lo, hi, F.lit(10), F.lit("B_cross"), block)
    long = _pairs(starts.where("is_baseline"), ends.where("is_baseline"), ["recording_id"], lo, long_gap * scale,
                  F.lit(20), F.lit("C_long_baseline"), block)
    single = marks.select(
        "recording_id",
        F.when(~F.col("is_end") & F.col("is_start_hint"), 30).when(~F.col("is_end"), 31).otherwise(32).alias("tier"),
        F.lit(f"D_single_{single_use}s").alias("rule"), F.col("idx").alias("start"),
        F.lit(None).cast("bigint").alias("end"), F.col("text").alias("start_text"),
        F.lit(None).cast("string").alias("end_text"))
    options = same.unionByName(cross).unionByName(long).unionByName(single)
    row = F.struct("tier", "start", "end", "rule", "start_text", "end_text")
    best = options.groupBy("recording_id").agg(F.min(row).alias("w"))
    out = recordings.join(best, "recording_id", "left")
    start, tier = F.col("w.start"), F.col("w.tier")
    limit = (F.when(tier < 20, F.col("w.end"))
              .when(tier == 20, F.least(start + long_use * scale, F.col("w.end")))
              .otherwise(start + single_use * scale))
    end = F.when(start.isNotNull(), F.least(limit, F.col("n_samples")))
    return out.select(*recordings.columns, start.alias("base_start"), end.alias("base_end"),
                      F.coalesce(F.col("w.rule"), F.lit("no_markers")).alias("rule_used"),
                      F.col("w.start_text").alias("start_annotation"), F.col("w.end_text").alias("end_annotation"))


def simple_baseline(markers: DataFrame, scale: int = C.FS_HZ, low: int = C.GAP_MIN_S, high: int = C.GAP_MAX_LONG_S,
                    block: int | None = None) -> DataFrame:
    """First baseline start with a baseline end ``low``..``high`` seconds later."""
    starts = markers.where("is_baseline AND NOT is_end")
    ends = markers.where("is_baseline AND is_end")
    pairs = _pairs(starts, ends, ["recording_id"], low * scale, high * scale, F.lit(0), F.lit("baseline"), block)
    return pairs.groupBy("recording_id").agg(F.min(F.struct("start", "end")).alias("w")).select(
        "recording_id", F.col("w.start").alias("base_start"), F.col("w.end").alias("base_end"))


# ---- sliding windows ----------------------------------------------------------------------------------------
def window_starts(first: Column, last_exclusive: Column, step: int) -> Column:
    """Starts first, first+step, … below ``last_exclusive``."""
    return F.when(last_exclusive > first, F.sequence(first, last_exclusive - 1, F.lit(step))
                  ).otherwise(F.array().cast("array<bigint>"))


def sweep_starts(length: Column, width: int, step: int) -> Column:
    """Window starts over a segment: the start equal to length-width is left out, a short segment gives one."""
    return window_starts(F.lit(0).cast("bigint"), F.greatest(F.lit(1), length - width).cast("bigint"), step)


def windows_of_interval(prev: Column, tick: Column, origin: Column, width: int, step: int, last_start: Column) -> Column:
    """Starts of the windows [start, start+width) that hold both ends of an interval."""
    low = F.greatest(F.lit(0), F.ceil((tick - width + 1 - origin) / F.lit(step)))
    high = F.least(F.floor((prev - origin) / F.lit(step)), F.floor((last_start - origin) / F.lit(step)))
    return F.when((high >= low) & (prev >= origin),
                  F.transform(F.sequence(low.cast("bigint"), high.cast("bigint")), lambda k: origin + k * step))


def windows_of_widths(prev: Column, tick: Column, origin: Column, widths: Sequence[int], step: int,
                      last_start: Column) -> Column:
    """Array of (width, start) over several window widths, for ``inline``."""
    def tagged(width):
        starts = windows_of_interval(prev, tick, origin, width, step, last_start)
        return F.transform(F.coalesce(starts, F.array().cast("array<bigint>")),
                           lambda s: F.struct(F.lit(width).cast("bigint").alias("width"), s.alias("start")))
    return F.concat(*[tagged(w) for w in widths])


def window_statistics(rr: DataFrame, keys: Sequence[str], tick: str, origin: str, width: int, step: int,
                      last_start: Column, keep: tuple[float, float] | None = None, intervals: int = 1) -> DataFrame:
    """Interval count, mean, SD and cv per sliding window.

    An interval is copied to the few windows that hold it and summed there, so the work per window is partial
    sums whatever the recording's length. ``keep`` drops intervals outside a physiological band.
    """
    x = F.col("rr_ms")
    inside = rr.where(x.isNotNull())
    if keep:
        inside = inside.where(x.between(*keep))
    starts = windows_of_interval(F.col("prev"), F.col(tick), F.col(origin), width, step, last_start)
    return (inside.select(*keys, "rr_ms", F.explode(starts).alias("start"))
            .groupBy(*keys, "start").agg(
                F.count(x).alias("n_rr"), F.avg(x).alias("rr_mean"), F.stddev_samp(x).alias("rr_std"),
                F.stddev_pop(x).alias("rr_std_pop"))
            .where(F.col("n_rr") >= intervals)
            .withColumn("hr", 60000.0 / F.col("rr_mean"))
            .withColumn("cv_pop", F.col("rr_std_pop") / F.col("rr_mean")))


def quality_choice(windows: DataFrame, keys: Sequence[str], passes: Column, tried: Column,
                   pass_rate: float = C.QUALITY_PASS_RATE) -> DataFrame:
    """Nearest passing window and its verdict; ``tried`` is the number of windows tried per recording.

    A recording has at most (reach - width) / step + 1 windows, so the percentile per recording is bounded.
    """
    ok = windows.withColumn("_ok", F.coalesce(passes, F.lit(False)))
    std = F.when(F.col("_ok"), F.col("rr_std"))
    agg = ok.groupBy(*keys).agg(
        F.count_if("_ok").alias("n_passing"), F.max(tried).alias("n_tried"),
        F.min(F.when(F.col("_ok"), F.struct("start", "hr", "rr_std"))).alias("_best"),
        F.percentile(std, C.QUALITY_PERCENTILE).alias("_p75"))
    weak = (F.col("n_passing") / F.col("n_tried") < pass_rate) | (F.col("_best.rr_std") > F.col("_p75"))
    marginal = F.concat(F.lit("marginal_"), F.col("n_passing"), F.lit("/"), F.col("n_tried"))
    return agg.select(
        *keys, F.col("_best.start").alias("best_start"), F.col("_best.hr").alias("best_hr"),
        F.col("_best.rr_std").alias("best_rr_std"), "n_passing", "n_tried",
        F.when(F.col("n_passing") == 0, "no_clean_window_found").when(weak, marginal).otherwise("solid")
         .alias("quality_flag"))


def lowest_cv(windows: DataFrame, keys: Sequence[str], limit: float = C.RR_CV_CLEAN) -> DataFrame:
    return windows.groupBy(*keys).agg(F.min("cv_pop").alias("best_cv")).withColumn(
        "recoverable", F.coalesce(F.col("best_cv") <= limit, F.lit(False)))


def first_clean(windows: DataFrame, keys: Sequence[str], limit: float = C.RR_CV_CLEAN, take=("cv_pop", "n_rr")):
    """Leftmost window with cv within the limit."""
    best = windows.where(F.col("cv_pop") <= limit).groupBy(*keys).agg(F.min(F.struct("start", *take)).alias("w"))
    return best.select(*keys, "w.*")


def recovery_verdict(cv_5s: Column, cv_3s: Column, limit: float = C.RR_CV_CLEAN) -> Column:
    return (F.when(cv_5s <= limit, "recoverable @5s").when(cv_3s <= limit, "recoverable @3s only")
             .otherwise("still not recoverable"))


# ---- samples ------------------------------------------------------------------------------------------------
def column_gate(samples: DataFrame, keys: Sequence[str], value: str, limit: float = C.MAX_MEDIAN_ABS) -> DataFrame:
    """Exact median of abs(value) per recording and whether it looks like the wrong column."""
    med = O.exact_quantiles(samples.select(*keys, F.abs(value).alias("_abs")), keys, "_abs", {"median_abs": 0.5})
    return med.withColumn("wrong_column", F.col("median_abs") > limit)


def median_exceeds(samples: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    """Whether the exact median of abs(value) exceeds ``limit``, from counts alone.

    With an even count and half the values above, the two middle values are the largest at or below and the
    smallest above the limit. One pass of partial sums; nothing is sorted.
    """
    v = F.abs(value)
    g = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(v > limit).alias("_above"),
        F.max(F.when(v <= limit, v)).alias("_low"), F.min(F.when(v > limit, v)).alias("_high"))
    twice = 2 * F.col("_above")
    return g.select(*keys, F.when(twice == F.col("_n"), (F.col("_low") + F.col("_high")) / 2.0 > limit)
                    .otherwise(twice > F.col("_n")).alias("wrong_column"))


def fill_gaps(samples: DataFrame, keys: Sequence[str], index: str, value: str, block: int = 65536) -> DataFrame:
    """Linear interpolation of NULL values over ``index``; the ends take the nearest valid value.

    Nearest valid neighbours come from within blocks of ``block`` ticks; gaps across blocks use the last and
    first valid sample of each block.
    """
    from pyspark.sql import Window as W
    keys, B = list(keys), O.BLOCK
    v = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    marked = samples.withColumn(B, F.floor(F.col(index) / F.lit(block))).withColumn("_v", v)
    inside = W.partitionBy(*keys, B).orderBy(index)
    # both directions run from the start of their order: a frame to UNBOUNDED FOLLOWING is quadratic
    back = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*keys, B).orderBy(F.desc(index)).rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = marked.groupBy(*keys, B).agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    before = W.partitionBy(*keys).orderBy(B).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc(B)).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, B, F.last("_hi", ignorenulls=True).over(before).alias("_pc"),
        F.last("_lo", ignorenulls=True).over(after).alias("_nc"))
    near = marked.withColumns({"_p": F.last("_v", ignorenulls=True).over(back),
                               "_n": F.last("_v", ignorenulls=True).over(ahead)})
    near = near.join(blocks, [*keys, B]).withColumns(
        {"_p": F.coalesce("_p", "_pc"), "_n": F.coalesce("_n", "_nc")})
    slope = (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.i") - F.col("_p.i"))
    line = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(
        F.col("_p.v") + slope * (F.col(index) - F.col("_p.i")))
    return near.withColumn(value, F.coalesce(F.col(value), line)).drop(B, "_v", "_p", "_n", "_pc", "_nc")


def fill_with_segment_mean(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    means = samples.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return samples.join(means, list(keys)).withColumn(value, F.coalesce(value, "_m")).drop("_m")


def part_of_recording(index: Column, base_start: Column, base_end: Column) -> Column:
    return F.when(index < base_start, "pre").when(index < base_end, "baseline").otherwise("post")


def recording_status(file_error: Column, wrong_column: Column, no_window: Column, n_peaks: Column, hr: Column) -> Column:
    """First failing gate decides; enough peaks with a rate in the accepted band is OK."""
    return (F.when(F.coalesce(file_error, F.lit(False)), "FAILED_FILE")
             .when(F.coalesce(wrong_column, F.lit(False)), "FAILED_COLUMN")
             .when(F.coalesce(no_window, F.lit(False)), "FAILED_ANNOTATION")
             .when(F.coalesce(n_peaks, F.lit(0)) < C.MIN_PEAKS, "FAILED_PEAKS")
             .when(hr.between(*C.HR_ACCEPT), "OK").otherwise("NEEDS_REVIEW"))


def template_status(n_peaks: Column, hr: Column, low: float = C.TEMPLATE_HR[0], high: float = C.TEMPLATE_HR[1]) -> Column:
    """The template study's status: peaks fail below two only, and no quality guard beside the heart rate."""
    return F.when(n_peaks < 2, "FAILED_PEAKS").when(hr.between(low, high), "OK").otherwise("NEEDS_REVIEW")


def template_rhythm(rr: DataFrame, keys: Sequence[str], value: str = "rr_ms") -> DataFrame:
    """(keys, n_beats, rr_cv, status) of RR intervals: cv with ddof 1 from two intervals on; the rate from their mean."""
    g = rr.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    beats = F.when(F.col("_n") > 0, F.col("_n") + 1).otherwise(0)
    cv = F.when((F.col("_n") > 1) & (F.col("_m") > 0), F.col("_s") / F.col("_m"))
    return g.select(*keys, beats.alias("n_beats"), cv.alias("rr_cv"), template_status(beats, 60000.0 / F.nullif(F.col("_m"), F.lit(0.0))).alias("status"))
