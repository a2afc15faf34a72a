"""Segments of samples as array columns, filtered and searched for beats inside tasks.

A segment is one annotation window or one sliding window: at most two minutes of samples by construction, so
it fits a row. Which segments exist, how they are grouped and everything after the peaks are Spark operators.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions import arrays as A, constants as C, dsp
from pulsegrid.operators.windows import sweep_starts, window_starts

DETECTED = "struct<filtered array<double>, peaks array<int>, inverted boolean, hr double, error string>"


def limit_batches(spark: SparkSession, rows: int = 64) -> None:
    """Keep Arrow batches of segment rows small: a row can hold a megabyte."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pack(samples: DataFrame, windows: DataFrame, start: str, end: str, index: str = "sample_idx", value: str = "mv",
         name: str = "raw") -> DataFrame:
    """The samples of each window as one ordered array; ``windows`` has one row per recording."""
    inside = samples.join(windows, "recording_id").where((F.col(index) >= F.col(start)) & (F.col(index) < F.col(end)))
    ordered = F.array_sort(F.collect_list(F.struct(index, value)))
    packed = inside.groupBy("recording_id").agg(ordered.alias("_s"))
    return packed.select("recording_id", F.transform("_s", lambda s: s[value]).alias(name))


def sub_windows(segments: DataFrame, trace: Column, width: int, step: int, partial: bool) -> DataFrame:
    """One row (recording_id, start, x) per sliding window of a segment.

    ``partial`` leaves out the start equal to length - width and gives a short segment one cut window; without
    it only complete windows are produced.
    """
    def cut(t):
        starts = (sweep_starts(F.size(t), width, step) if partial
                  else window_starts(F.lit(0).cast("bigint"), (F.size(t) - width + 1).cast("bigint"), step))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(t, (s + 1).cast("int"), F.lit(width)).alias("x")))
    return segments.select("recording_id", F.inline(A.let(cut, trace)))


def _safe(work, raw):
    try:
        return work(np.asarray(raw, float))
    except Exception as problem:  # a bad recording becomes a status, not a failed job
        return dict(filtered=None, peaks=None, inverted=None, hr=None, error=f"{type(problem).__name__}: {problem}")


def detected(raw: Column, fs: int = C.FS_HZ, mains: str | None = "ls_joint", nearest: bool = True, flip_again: bool = False,
             upright: bool = True, keep_trace: bool = True) -> Column:
    """Filter (``mains=None``: already filtered) and detect. The trace is turned upright when found inverted."""
    def one(x):
        y = x if mains is None else dsp.clean(x, fs, mains)
        peaks, inverted, hr = dsp.oriented_peaks(y, fs, nearest, flip_again)
        y = -y if inverted and upright else y
        return dict(filtered=y if keep_trace else None, peaks=peaks.astype("int32"), inverted=bool(inverted),
                    hr=None if np.isnan(hr) else float(hr), error=None)

    @F.pandas_udf(DETECTED)
    def run(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(one, x) for x in series], columns=["filtered", "peaks", "inverted", "hr", "error"])
    return run(raw)


def filtered(raw: Column, fs: int = C.FS_HZ, method: str = "ls_joint") -> Column:
    """A trace cleaned by a named method: the mains variants or ``raw``."""
    def one(x):
        if method == "raw":
            return x
        return dsp.clean(x, fs, method)

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(x, float)) for x in series])
    return run(raw)


def mains_removed(raw: Column, fs: float, freqs: Sequence[float] = (50.0, 100.0), joint: bool = True) -> Column:
    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([dsp.subtract_mains(np.asarray(x, float), fs, tuple(freqs), joint) for x in series])
    return run(raw)


def second_peaks(trace: Column, fs: int = C.FS_HZ) -> Column:
    @F.pandas_udf("array<int>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([dsp.prominence_peaks(np.asarray(x, float), fs).astype("int32") for x in series])
    return run(trace)


def picked(trace: Column, distance: int, height: float | None = None, prominence: float | None = None) -> Column:
    @F.pandas_udf("array<int>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([dsp.pick_peaks(np.asarray(x, float), distance, height, prominence).astype("int32") for x in series])
    return run(trace)


def spectrum(trace: Column, fs: float, nperseg: int | None = None, quarter: bool = False) -> Column:
    """Welch density as an array of (f, p). ``quarter`` takes segments of min(4·fs, n/4) samples."""
    @F.pandas_udf("array<struct<f: double, p: double>>")
    def run(series: pd.Series) -> pd.Series:
        out = []
        for x in series:
            n = min(int(4 * fs), len(x) // 4) if quarter else min(nperseg or len(x), len(x))
            f, p = dsp.welch(x, fs, n)
            out.append([{"f": float(a), "p": float(b)} for a, b in zip(f, p)])
        return pd.Series(out)
    return run(trace)


# ---- figures of a spectrum (a bounded array) --------------------------------------------------------------
def band_power(psd: Column, low: float | None = None, high: float | None = None) -> Column:
    """Trapezoid area over the bins with low <= f <= high."""
    part = psd if low is None else F.filter(psd, lambda s: (s["f"] >= low) & (s["f"] <= high))
    n = F.size(part)
    pairs = F.zip_with(F.slice(part, F.lit(1), n - 1), F.slice(part, F.lit(2), n - 1),
                       lambda a, b: (b["f"] - a["f"]) * (a["p"] + b["p"]) / 2.0)
    return F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def cardiac_share(psd: Column, low: float = 4.0, high: float = 45.0) -> Column:
    whole = band_power(psd)
    return F.when(whole > 0, band_power(psd, low, high) / whole)


def strongest(psd: Column, low: float, high: float, skip: Sequence[float] = (), half: float = 2.0) -> Column:
    """Frequency of the highest bin in [low, high], leaving out ± ``half`` around the ``skip`` frequencies."""
    def wanted(s):
        ok = (s["f"] >= low) & (s["f"] <= high)
        for f in skip:
            ok = ok & (F.abs(s["f"] - f) > half)
        return ok
    ranked = F.transform(F.filter(psd, wanted), lambda s: F.struct(s["p"].alias("p"), (-s["f"]).alias("f")))
    return -F.array_max(ranked)["f"]


def peak_power(psd: Column, low: float, high: float) -> Column:
    return F.array_max(F.transform(F.filter(psd, lambda s: (s["f"] >= low) & (s["f"] <= high)), lambda s: s["p"]))


def spectrum_diagnosis(psd: Column, mains: tuple[float, float] = (48, 52), cardiac: tuple[float, float] = (4, 12),
                       band: tuple[float, float] = (0.5, 150.0), skip: Sequence[float] = (50, 100, 150)) -> dict[str, Column]:
    ratio = peak_power(psd, *mains) / F.nullif(peak_power(psd, *cardiac), F.lit(0.0))
    f = strongest(psd, *band)
    return {"psd_dom_hz": f, "psd_dom_period_ms": F.when(f > 0, 1000.0 / f), "psd_dom_safe_hz": strongest(psd, *band, skip=skip),
            "mains_ratio": ratio, "mains_leak": F.coalesce(ratio > 5, F.lit(False))}
