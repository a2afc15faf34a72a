"""Beats cut from a trace and their averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import constants as C
from pulsegrid.operators import ordered as O


def cut_beats(trace: Column, peaks: Column, pre: int, post: int) -> Column:
    """Array of beats ``trace[r-pre : r+post]`` for the 0-based peaks whose window lies inside the trace."""
    whole = F.filter(peaks, lambda r: (r >= pre) & (r + post <= F.size(trace)))
    return F.transform(whole, lambda r: F.slice(trace, r - pre + 1, F.lit(pre + post)))


def explode_beats(segments: DataFrame, keys: Sequence[str], trace: str = "filtered", peaks: str = "peaks",
                  pre: int = C.PRE_R_MS, post: int = C.POST_R_MS) -> DataFrame:
    """One row per complete beat: (keys, beat_no, beat). Cut before exploding, so the trace is not repeated."""
    cut = segments.select(*keys, cut_beats(F.col(trace), F.col(peaks), pre, post).alias("_beats"))
    return cut.select(*keys, F.posexplode("_beats").alias("beat_no", "beat"))


def elementwise(beats: DataFrame, keys: Sequence[str], beat: str = "beat") -> DataFrame:
    """Mean and SD (ddof 1) per position and the number of beats, one row per key.

    Vector summaries are combined before the shuffle, so a key with many beats costs one short row per task.
    """
    v = array_to_vector(F.col(beat).cast("array<double>"))
    s = Summarizer.metrics("mean", "variance", "count").summary(v)
    grouped = beats.groupBy(*keys) if keys else beats.groupBy()
    out = grouped.agg(s.alias("_s"))
    n = F.col("_s.count")
    sd = F.transform(vector_to_array("_s.variance"), lambda x: F.sqrt(x))
    return out.select(*keys, vector_to_array("_s.mean").alias("mean"), F.when(n > 1, sd).alias("sd"), n.alias("n"))


def elementwise_ragged(rows: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Mean, SD (ddof 1, null for one value) and count at each position, over arrays of any lengths; nulls inside are left out.

    Positions are summed before the shuffle, so what travels is one short row for each key, position and task.
    """
    keys = list(keys)
    at = rows.select(*keys, F.posexplode(F.col(array).cast("array<double>")).alias("_i", "_v")).groupBy(*keys, "_i").agg(
        F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"), F.count("_v").alias("_n"))
    s = F.array_sort(F.collect_list(F.struct("_i", "_m", "_s", "_n")))
    grouped = (at.groupBy(*keys) if keys else at.groupBy()).agg(s.alias("_e"), F.max("_n").alias("n"))
    return grouped.select(*keys, F.transform("_e", lambda e: e["_m"]).alias("mean"), F.transform("_e", lambda e: e["_s"]).alias("sd"),
                          F.transform("_e", lambda e: e["_n"]).alias("counts"), "n")


def gallery_summary(features: DataFrame, id_: str, shown: Sequence, measures: Sequence[str]) -> DataFrame:
    """(measure, n, mean, sd): the chosen recordings' measures, SD with ddof 1."""
    few = features.where(F.col(id_).isin(*shown))
    long = few.select(*[F.col(m).cast("double").alias(m) for m in measures]).unpivot([], list(measures), "measure", "v")
    return long.groupBy("measure").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def template(beats: DataFrame, keys: Sequence[str], order: str = "beat_no", count: str | None = None,
             group_size: int = C.BEATS_PER_AVERAGE) -> DataFrame:
    """Mean beat over whole groups of ``group_size`` beats; with fewer beats than one group, over all of them.

    ``order`` counts beats from 0, ``count`` holds the beats of the key (computed here if not given).
    """
    if count is None:
        sizes = beats.groupBy(*keys).agg(F.count("*").alias("_n"))
        beats, count = beats.join(sizes, list(keys)), "_n"
    n = F.col(count)
    full = F.floor(n / group_size) * group_size
    used = beats.where(F.col(order) < F.when(full > 0, full).otherwise(n))
    return elementwise(used, keys).select(*keys, F.col("mean").alias("template"), F.col("n").alias("n_averaged"))


def numbered(beats: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``beat_no`` from 0 and ``_n`` for beats that come from a table rather than from one segment."""
    placed = O.positions(beats, keys, order, [], "_p", total="_n")
    return placed.withColumn("beat_no", F.col("_p") - 1).drop("_p")
