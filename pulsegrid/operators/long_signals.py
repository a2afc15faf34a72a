"""Signals of any length as blocks of samples: filters carried over blocks, and windows around marks.

A recursive filter is linear, so what a block passes on is its own end state from rest plus the incoming state times
a power of the state matrix: pairs that compose associatively. One pass computes the end states from rest, a table with a
row a block carries them along each recording, and a second pass filters every block from its true start. Many tasks
filter one recording, and the result is that of a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import arrays as A, dsp
from pulsegrid.operators.signals import limit_batches
from pulsegrid.session import cut_lineage

BLOCK = 4096


def blocks_of(samples: DataFrame, recording: str = "recording_id", index: str = "sample_idx", value: str = "mv", size: int = BLOCK) -> DataFrame:
    """(recording, b, first, x): consecutive samples of each recording, ``size`` a block; indexes run from 0 without gaps."""
    rows = samples.select(F.col(recording).alias("recording"), F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    packed = rows.groupBy("recording", F.floor(F.col("i") / size).alias("b")).agg(ordered.alias("s"))
    return packed.select("recording", "b", F.col("s")[0]["i"].alias("first"), F.transform("s", lambda e: e["v"]).alias("x"))


def _end_state(b: np.ndarray, a: np.ndarray, x: np.ndarray, step: int = 256) -> np.ndarray:
    """The filter's state after ``x``, from rest; zeros before the first sample change nothing."""
    _, _, load, jump = dsp._block_operators(tuple(b), tuple(a), step)
    rows = np.zeros(-(-len(x) // step) * step)
    rows[len(rows) - len(x):] = x
    state = np.zeros(len(jump))
    for pushed in rows.reshape(-1, step) @ load.T:
        state = jump @ state + pushed
    return state


def _one_way(blocks: DataFrame, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """(recording, at, x) filtered in the order of ``at``; the first block starts in the steady state of its first sample."""
    trans, drive = dsp._state_space(b, a)
    steady = np.linalg.solve(np.eye(len(drive)) - trans, drive)
    kind = dict(blocks.dtypes)["recording"]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"recording": pdf["recording"], "at": pdf["at"], "n": pdf["x"].map(len), "head": pdf["x"].map(lambda x: x[0]),
                                "push": [_end_state(b, a, np.asarray(x, float)) for x in pdf["x"]]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        state, out, powers = steady * pdf["head"].iloc[0], [], {}
        for n, push in zip(pdf["n"], pdf["push"], strict=True):
            out.append(state)
            if n not in powers:
                powers[n] = np.linalg.matrix_power(trans, int(n))
            state = powers[n] @ state + push
        return pd.DataFrame({"recording": pdf["recording"], "at": pdf["at"], "state": out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"recording": pdf["recording"], "at": pdf["at"],
                                "x": [dsp.run_iir(b, a, np.asarray(x, float), np.asarray(s, float)) for x, s in zip(pdf["x"], pdf["state"], strict=True)]})
    own = blocks.mapInPandas(ends, f"recording {kind}, at long, n int, head double, push array<double>")
    states = own.groupBy("recording").applyInPandas(carry, f"recording {kind}, at long, state array<double>")
    return cut_lineage(blocks.join(states, ["recording", "at"]).mapInPandas(run, f"recording {kind}, at long, x array<double>"))


def zero_phase(samples: DataFrame, b, a, recording: str = "recording_id", index: str = "sample_idx", value: str = "mv", size: int = BLOCK) -> DataFrame:
    """(recording, b, first, x): forward and backward filtering with odd extension, as one pass over the whole recording does.

    Recordings of no more samples than the extension takes have no rows.
    """
    b, a = np.asarray(b, float), np.asarray(a, float)
    pad = 3 * max(len(a), len(b))
    limit_batches(samples.sparkSession)
    lengths = samples.groupBy(F.col(recording).alias("recording")).agg((F.max(F.col(index)) + 1).cast("long").alias("n")).where(F.col("n") > pad)
    plain = blocks_of(samples, recording, index, value, max(size, pad + 1)).join(lengths, "recording")
    # a short last block joins the one before, so that the extension comes from one block
    whole = F.greatest(F.floor(F.col("n") / max(size, pad + 1)) - 1, F.lit(0))
    parts = plain.groupBy("recording", F.least("b", whole).alias("at"), F.col("n").alias("total")).agg(F.array_sort(F.collect_list(F.struct("first", "x"))).alias("p"))
    joined = parts.select("recording", "at", "total", F.col("p")[0]["first"].alias("first"), F.flatten(F.transform("p", lambda e: e["x"])).alias("x"))
    last = F.col("first") + F.size("x") == F.col("total")

    def before(x: Column) -> Column:
        return F.transform(F.reverse(F.slice(x, 2, pad)), lambda v: 2 * x[0] - v)

    def after(x: Column) -> Column:
        n = F.size(x)
        return F.transform(F.reverse(F.slice(x, n - pad, F.lit(pad))), lambda v: 2 * F.element_at(x, -1) - v)
    none = F.array().cast("array<double>")
    wide = joined.withColumn("x", A.let(lambda x: F.concat(F.when(F.col("at") == 0, before(x)).otherwise(none), x, F.when(last, after(x)).otherwise(none)), F.col("x")))
    wide = cut_lineage(wide)
    place = wide.select("recording", "at", "first", "total")
    there = _one_way(wide.select("recording", "at", "x"), b, a)
    back = _one_way(there.select("recording", (-F.col("at")).alias("at"), F.reverse("x").alias("x")), b, a)
    found = back.select("recording", (-F.col("at")).alias("at"), F.reverse("x").alias("y")).join(place, ["recording", "at"])
    skip = F.when(F.col("at") == 0, pad).otherwise(0)
    rest = F.when(F.col("at") == F.greatest(F.floor(F.col("total") / max(size, pad + 1)) - 1, F.lit(0)), pad).otherwise(0)
    return found.select("recording", F.col("at").alias("b"), "first", F.slice("y", skip + 1, F.size("y") - skip - rest).alias("x"))


def windows_at(blocks: DataFrame, marks: DataFrame, before: int, after: int, recording: str = "recording", mark: str = "r", size: int = BLOCK) -> DataFrame:
    """(recording, r, start, x): the samples in [r - before, r + after) that exist, for each mark.

    A mark meets the one or two blocks (or more, if windows are longer than blocks) that its window touches; only the part inside leaves them.
    """
    near = marks.select(F.col(recording).alias("recording"), F.col(mark).cast("long").alias("r"))
    touched = F.sequence(F.floor(F.greatest(F.col("r") - before, F.lit(0)) / size), F.floor((F.col("r") + after - 1) / size))
    met = near.withColumn("b", F.explode(touched)).join(blocks.select("recording", "b", "first", "x"), ["recording", "b"])
    lo = F.greatest(F.col("r") - before - F.col("first"), F.lit(0)).cast("int")
    hi = F.least(F.col("r") + after - F.col("first"), F.size("x").cast("long")).cast("int")
    part = met.where(hi > lo).select("recording", "r", (F.col("first") + lo).alias("start"), F.slice("x", lo + 1, hi - lo).alias("x"))
    pieces = part.groupBy("recording", "r").agg(F.array_sort(F.collect_list(F.struct("start", "x"))).alias("p"))
    return pieces.select("recording", "r", F.col("p")[0]["start"].alias("start"), F.flatten(F.transform("p", lambda e: e["x"])).alias("x"))


def _places(x: Column, test) -> Column:
    """Indexes of the elements that pass, nulls elsewhere (``array_min`` and ``array_max`` skip these)."""
    return F.transform(x, lambda v, i: F.when(test(v), i))


def half_height_width(windows: DataFrame, fs: float = 1000.0, reach: int = 25) -> DataFrame:
    """(recording, r, qrs_ms): from the last sample under half the mark's height in ``reach`` samples before it to the first after it.

    A mark without such a sample on one side has no row. Windows must reach ``reach`` samples to both sides.
    """
    def width(x: Column, at: Column) -> Column:
        half = F.get(x, at) / 2
        left = F.slice(x, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)))
        right = F.slice(x, at + 1, F.lit(reach))
        onset = F.greatest(at - reach, F.lit(0)) + F.array_max(_places(left, lambda v: v < half))
        return (at + F.array_min(_places(right, lambda v: v < half)) - onset) / fs * 1000
    at = (F.col("r") - F.col("start")).cast("int")
    return windows.select("recording", "r", A.let(width, F.col("x"), at).alias("qrs_ms")).where("qrs_ms IS NOT NULL")


def return_to_baseline(windows: DataFrame, fs: float = 1000.0, search=(30, 100), tail: int = 40, base=(50, 20), above: float = 0.01,
                       plausible=(30.0, 100.0)) -> DataFrame:
    """(recording, r, qt_ms): from the mark to where the signal, after its largest value in ``search``, is back near the baseline before the mark.

    Values outside ``plausible`` have no row; neither have marks with no samples for the baseline or the search.
    """
    def interval(x: Column, at: Column) -> Column:
        low = F.greatest(at - base[0], F.lit(0))
        level = A.mean(F.slice(x, low + 1, F.greatest(at - base[1] - low, F.lit(0)))) + above
        after = F.slice(x, at + search[0] + 1, F.greatest(F.least(F.lit(search[1] - search[0]), F.size(x) - at - search[0]), F.lit(0)))
        peak = at + search[0] + A.argmax(after)
        end = A.let(lambda p, lv: p + F.array_min(_places(F.slice(x, p + 1, F.lit(tail)), lambda v: v <= lv)), peak, level)
        return F.when(F.size(after) > 0, (end - at) / fs * 1000)
    at = (F.col("r") - F.col("start")).cast("int")
    return windows.select("recording", "r", A.let(interval, F.col("x"), at).alias("qt_ms")).where(F.col("qt_ms").between(*plausible))
