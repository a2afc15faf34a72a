"""Wave measurements on one beat held as an array column.

A beat covers t = -pre … n-pre-1 in steps of one sample. Slices with ``array_max``/``array_min`` carry the work,
lambdas appear only where an element has to be compared with a value of its own beat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A, constants as C


class Beat:
    """A beat column with its time axis."""

    def __init__(self, column: Column | str, pre: int = C.PRE_R_MS, n: int = C.PRE_R_MS + C.POST_R_MS):
        self.a = F.col(column) if isinstance(column, str) else column
        self.pre, self.n = pre, n

    def window(self, first: int, last: int) -> Column:
        """Samples with first <= t <= last, cut at the ends of the beat."""
        lo, hi = max(first, -self.pre), min(last, self.n - self.pre - 1)
        return F.slice(self.a, lo + self.pre + 1, max(hi - lo + 1, 0))

    def top(self, first, last) -> Column:
        return F.array_max(self.window(first, last))

    def bottom(self, first, last) -> Column:
        return F.array_min(self.window(first, last))

    def top_time(self, first, last) -> Column:
        return A.argmax(self.window(first, last)) + max(first, -self.pre)

    def bottom_time(self, first, last) -> Column:
        return A.argmin(self.window(first, last)) + max(first, -self.pre)

    def amplitude(self, first, last, sign: int = 1) -> Column:
        return self.top(first, last) if sign >= 0 else self.bottom(first, last)

    def landmark(self, first, last, sign: int = 1) -> Column:
        return self.top_time(first, last) if sign >= 0 else self.bottom_time(first, last)

    def swing(self, first, last) -> Column:
        return self.top(first, last) - self.bottom(first, last)

    def level(self, before: int) -> Column:
        """Median of the samples with t < before."""
        return A.median(self.window(-self.pre, before - 1))

    def noise(self, before: int) -> Column:
        return A.sd(self.window(-self.pre, before - 1), ddof=0)

    def half_width(self) -> Column:
        """Width at half the highest sample of the beat; a side that never falls to half ends at the edge."""
        def side(part, half):
            return A.first_true(F.transform(part, lambda x: x <= half))

        def body(b, half, at):
            left = F.coalesce(side(F.reverse(F.slice(b, F.lit(1), at)), half), at - 1)
            right = F.coalesce(side(F.slice(b, at, F.size(b) - at + 1), half), F.size(b) - at)
            return (left + right).cast("double")
        peak = F.array_max(self.a)
        return A.let(body, self.a, peak / 2.0, F.array_position(self.a, peak))

    def return_time(self, first: int, level: Column, tolerance: Column) -> Column:
        """First t >= first with the sample within ``tolerance`` of ``level``."""
        def body(part, lev, tol):
            return A.first_true(F.transform(part, lambda x: F.abs(x - lev) <= tol))
        return (A.let(body, self.window(first, self.n), level, tolerance) + first).cast("double")

    def qt(self, rr_ms: Column | None, base=(-50, -21), start: int = 30, fallback: int = 100, rr_share: float = 0.5,
           fraction: float = 0.30, accept=(15, 90)) -> Column:
        """QT of one beat: largest excursion from the pre-R level between ``start`` and half the RR interval,
        ended where the excursion has decayed to ``fraction`` of its peak; works for either polarity."""
        room = F.lit(self.n - self.pre)
        cap = F.lit(fallback) if rr_ms is None else F.when(rr_ms > 0, F.floor(rr_ms * rr_share)).otherwise(fallback)
        length = F.greatest(F.least(room, cap.cast("int")) - start, F.lit(0))

        def end_of_t(excursion, at, limit):
            tail = F.slice(excursion, at, F.size(excursion) - at + 1)
            return F.when(limit > 0, at - 1 + A.first_true(F.transform(tail, lambda x: x <= limit)) + start)

        def with_peak(excursion):
            peak = F.array_max(excursion)
            return A.let(end_of_t, excursion, F.array_position(excursion, peak), fraction * peak)

        def body(part, level):
            return A.let(with_peak, F.transform(part, lambda x: F.abs(x - level)))
        qt = A.let(body, F.slice(self.a, F.lit(self.pre + start + 1), length), A.mean(self.window(*base))).cast("double")
        return F.when((length > 0) & qt.between(*accept), qt)

    def qt_absolute(self, base=(-50, -21), start: int = 30, stop: int = 100, reach: int = 40, level_mv: float = 0.01,
                    accept=(30, 100)) -> Column:
        """The superseded QT: signed maximum after R, ended at the first sample near the pre-R level."""
        def body(b, at, level):
            tail = F.slice(b, at + self.pre + start + 1, F.lit(reach))
            return (at + A.first_true(F.transform(tail, lambda x: x <= level + level_mv)) + start).cast("double")
        qt = A.let(body, self.a, A.argmax(self.window(start, stop - 1)), A.mean(self.window(*base)))
        return F.when(qt.between(*accept), qt)


def measures(beat: Beat, waves=C.PIPELINE_WAVES, r_window=(-15, 35), quiet: int = -70, return_from: int = 40,
             p_floor: float = 0.008) -> dict[str, Column]:
    """The wave measurements of a beat or template. J and T are read as they are, P, Q and S from the quiet level."""
    w = {name: (first, last) for name, first, last, _ in waves}
    level, noise = beat.level(quiet), beat.noise(quiet)
    p = beat.top(*w["P"]) - level
    has_p = p > F.greatest(F.lit(p_floor), 2.0 * noise)
    return {
        "r_amplitude_mv": beat.swing(*r_window),
        "qrs_duration_ms": beat.half_width(),
        "j_wave_amplitude_mv": beat.top(*w["J"]),
        "t_wave_amplitude_mv": beat.top(*w["T"]),
        "t_wave_excursion_mv": F.greatest(F.abs(beat.top(*w["T"]) - level), F.abs(beat.bottom(*w["T"]) - level)),
        "rt_interval_ms": beat.top_time(*w["T"]).cast("double"),
        "qt_template_ms": beat.return_time(return_from, level, 0.05 * F.array_max(beat.a)),
        "p_wave_amplitude_mv": F.when(has_p, p),
        "pr_interval_ms": F.when(has_p, (-beat.top_time(*w["P"])).cast("double")),
        "q_wave_amplitude_mv": beat.bottom(*w["Q"]) - level,
        "s_wave_amplitude_mv": beat.bottom(*w["S"]) - level,
    }


def assemble(templates: DataFrame, beats: DataFrame, keys: list[str], pre: int, n: int, rr_ms: str | None = None,
             qt_args: dict | None = None, **kw) -> DataFrame:
    """Feature block per key: template measurements, with per-beat means and SDs where there is more than one beat."""
    t = templates.select(*keys, *[c.alias(k) for k, c in measures(Beat("template", pre, n), **kw).items()])
    per = measures(Beat("beat", pre, n), **kw)
    b = beats.select(*keys, per["r_amplitude_mv"].alias("_r"), per["qrs_duration_ms"].alias("_q"),
                     Beat("beat", pre, n).qt(F.col(rr_ms) if rr_ms else None, **(qt_args or {})).alias("_qt"))
    s = b.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg("_r").alias("_r_mean"), F.avg("_qt").alias("_qt_mean"),
        F.stddev_samp("_qt").alias("qt_std_ms"), F.stddev_samp("_q").alias("qrs_std_ms"),
        F.stddev_samp("_r").alias("r_amplitude_std_mv"))
    many = F.col("_n") > 1
    return (t.join(s, keys, "left")
            .withColumn("qt_ms", F.when(many, F.coalesce("_qt_mean", "qt_template_ms")).otherwise(F.col("qt_template_ms")))
            .withColumn("r_amplitude_mv", F.when(many, F.col("_r_mean")).otherwise(F.col("r_amplitude_mv")))
            .drop("_n", "_r_mean", "_qt_mean", "qt_template_ms"))


def overlay(beats: DataFrame, spread: DataFrame, keys: list[str], pre: int, n: int, half: int = 15) -> DataFrame:
    """Amplitude and timing jitter of R over beats, and where in the beat the variation lives."""
    b = Beat("beat", pre, n)
    at_r = F.get(F.col("beat"), F.lit(pre)).cast("double")
    agg = beats.groupBy(*keys).agg(
        F.count("*").alias("n_beats"), F.avg(at_r).alias("r_amp_mean"), F.stddev_samp(at_r).alias("r_amp_sd"),
        F.stddev_samp(b.top_time(-half, half)).alias("r_pos_sd"))
    env = spread.select(*keys, A.mean(F.col("sd")).alias("sd_env_mean"), F.array_max("sd").alias("sd_env_peak"),
                        (A.argmax(F.col("sd")) - pre).alias("sd_peak_t"))
    return agg.join(env, keys).withColumn("r_amp_cv", F.when(F.col("r_amp_mean") != 0, F.col("r_amp_sd") / F.abs("r_amp_mean")))


def landmark_consistency(beats: DataFrame, keys: list[str], pre: int, n: int, waves=C.GALLERY_WAVES,
                         quiet: int = -75) -> DataFrame:
    """Per wave: position mean and SD over beats against a uniform draw, amplitude over noise, verdict."""
    b = Beat("beat", pre, n)
    level = b.level(quiet)
    rows = F.array(*[F.struct(
        F.lit(name).alias("wave"), F.lit((last - first) / 12 ** 0.5).alias("rand_sd"),
        b.landmark(first, last, sign).cast("double").alias("t"),
        F.abs(b.amplitude(first, last, sign) - level).alias("amp")) for name, first, last, sign in waves])
    per = beats.select(*keys, b.noise(quiet).alias("_noise"), F.inline(rows))
    agg = per.groupBy(*keys, "wave").agg(
        F.avg("t").alias("pos"), F.stddev_pop("t").alias("sd"), F.max("rand_sd").alias("rand_sd"),
        (F.avg("amp") / F.avg("_noise")).alias("snr"))
    ratio = F.col("sd") / F.col("rand_sd")
    return agg.withColumn("ratio", ratio).withColumn(
        "verdict", F.when(ratio < 0.45, "ok").when(ratio < 0.75, "~").otherwise("NOISE"))


def qtc_comparison(intervals: DataFrame, keys: list[str], qt: str, rr: str, hr: str, target: float = 41.0,
                   max_r: float = 0.20) -> DataFrame:
    """Mean, SD and dependence on RR of each QT correction, and which one a study should prefer."""
    from pulsegrid.functions.columns import qtc_family
    family = qtc_family(F.col(qt), F.col(rr), F.col(hr))
    rows = F.array(*[F.struct(F.lit(k).alias("formula"), c.alias("qtc")) for k, c in family.items()])
    agg = intervals.select(*keys, F.col(rr).alias("_rr"), F.inline(rows)).groupBy(*keys, "formula").agg(
        F.avg("qtc").alias("mean"), F.stddev_pop("qtc").alias("sd"), F.abs(F.corr("qtc", "_rr")).alias("abs_r"))
    out = agg.withColumn("distance", F.abs(F.col("mean") - target))
    from pyspark.sql import Window as W
    good = (F.col("abs_r") < max_r) & (F.col("formula") != "Raw")
    nearest = F.min(F.when(good, F.struct("distance", "formula"))).over(W.partitionBy(*keys))["formula"]
    return out.withColumn("best", F.coalesce(F.col("formula") == nearest, F.lit(False)))


def raw_filtered_metrics(raw: Column, filtered: Column) -> dict[str, Column]:
    """Correlation of raw and filtered trace and percent of the de-meaned raw power that was removed."""
    def removed(r, f, shift, mr):
        left = F.aggregate(F.zip_with(r, f, lambda x, y: x - y - shift), F.lit(0.0), lambda s, e: s + e * e)
        power = F.aggregate(r, F.lit(0.0), lambda s, x: s + (x - mr) * (x - mr))
        return 100.0 * F.sqrt(left / power)
    pct = A.let(lambda r, f: A.let(removed, r, f, A.mean(r) - A.mean(f), A.mean(r)), raw, filtered)
    return {"corr": A.pearson(raw, filtered), "pct_removed": pct}


def recovered_features(beat: Beat, rr_mean: Column, r=(-20, 20), p=(-55, -10), t=(15, 90), quiet=(-95, -70),
                       qt_from: int = 10, qt_cap: int = 90, rr_share: float = 0.9, qt_add: int = 15) -> dict[str, Column]:
    """Template measurements used for recovered recordings."""
    base = A.median(beat.window(*quiet))
    stop = F.least(F.floor(rr_mean * rr_share), F.lit(qt_cap)).cast("int")
    tail = F.slice(beat.a, F.lit(beat.pre + qt_from + 1), F.greatest(stop - qt_from + 1, F.lit(0)))
    qt = F.when(F.size(tail) > 0, (A.argmin(tail) + qt_from + qt_add).cast("double"))
    return {
        "R_amp_mV": beat.swing(*r), "P_amp_mV": beat.swing(*p), "T_amp_mV": base - beat.bottom(*t),
        "QT_ms": qt, "QTc_ms": qt / F.sqrt(rr_mean / 100.0)}
