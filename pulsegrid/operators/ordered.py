"""Ranks, quantiles, positions and neighbours in groups of any size.

A window partitioned by the group alone puts a hot group into one task. Everything here splits each group
into *blocks* that are consecutive in the ordering column, works inside the blocks, and adds a carry from a
small table with one row per (group, block). Blocks of a value column come from approximate quantiles (only
their balance depends on the approximation, the results are exact); blocks of a time column are fixed-width.
Equal values are counted before anything is shuffled for sorting.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BLOCK = "_block"


def with_value_blocks(df: DataFrame, column: str, cut_from: DataFrame | None = None, ties: str | None = None) -> DataFrame:
    """Add a block id that is monotone in ``column`` (non-null), about as many as shuffle partitions.

    ``cut_from`` names a cheaper frame with the same column to place the cuts by: the rows before they were
    grouped, so that the quantile pass is a plain scan. A value that fills several blocks is cut further by ``ties``
    where that is a numeric column, so that blocks are monotone in (column, ties).
    """
    n = min(4096, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    source = df if cut_from is None else cut_from
    cuts = source.select(F.col(column).cast("double").alias(column)).approxQuantile(
        column, [i / n for i in range(1, n)], 0.25 / n)
    heavy = sorted({c for c in cuts if cuts.count(c) > 1 and math.isfinite(c)}) if ties and isinstance(df.schema[ties].dataType, T.NumericType) else []
    # a heavy value gets a bucket of its own
    blocked = _bucketed(df, F.col(column), {*cuts, *[math.nextafter(c, math.inf) for c in heavy]})
    if not heavy:
        return blocked
    tie, own = F.coalesce(F.col(ties).cast("double"), F.lit(float("-inf"))), F.col(column).cast("double").isin(heavy)
    more = df.where(own).select(tie.alias("_tie")).approxQuantile("_tie", [i / n for i in range(1, n)], 0.25 / n)
    finer = _bucketed(blocked.withColumnRenamed(BLOCK, "_coarse"), tie, set(more))
    return finer.withColumn(BLOCK, F.col("_coarse") * (n + 3) + F.when(own, F.col(BLOCK)).otherwise(0.0)).drop("_coarse")


def _bucketed(df: DataFrame, value: Column, cuts: set[float]) -> DataFrame:
    inner = sorted({c for c in cuts if math.isfinite(c)} or {0.0})
    return (Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_as_double", outputCol=BLOCK, handleInvalid="keep")
            .transform(df.withColumn("_as_double", value.cast("double"))).drop("_as_double"))


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(keys), how)


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                 totals: bool = False, cut_from: DataFrame | None = None) -> DataFrame:
    """For rows unique by (keys, order): ``<c>_before`` = sum of ``c`` over strictly smaller ``order``.

    With ``totals`` also ``<c>_total`` over the whole group.
    """
    keys = list(keys)
    blocked = with_value_blocks(df, order, cut_from)
    inside = W.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    carry = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    columns = [F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in sums]
    if totals:
        columns += [F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in sums]
    carry = carry.select(*keys, BLOCK, *columns)
    out = blocked.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = _join_on(out, carry, [*keys, BLOCK])
    return (out.withColumns({f"{c}_before": F.col(f"_i_{c}") + F.col(f"_c_{c}") for c in sums})
               .drop(BLOCK, *[f"_i_{c}" for c in sums], *[f"_c_{c}" for c in sums]))


def value_counts_with_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``n`` ties, ``n_before`` smaller rows, ``n_total`` rows, ``avg_rank``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, keys, value, ["n"], totals=True, cut_from=df)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per entry of ``probs``; groups may be of any size."""
    ranked = value_counts_with_rank(df, keys, value)
    picks, finals = [], []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_{name}_w"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finals.append((lo + (hi - lo) * F.col(f"_{name}_w")).alias(name))
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    return grouped.agg(*picks).select(*keys, *finals)


def cross_group_ranks(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Pooled average ranks: one row per (keys, group, value) with ``n`` rows, ``ties``, ``avg_rank``, ``n_total``.

    The number of groups is the number of study arms, so the per-value list of group counts is short.
    """
    per_group = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
                   .groupBy(*keys, value, group).agg(F.count("*").alias("_k")))
    pooled = per_group.groupBy(*keys, value).agg(
        F.sum("_k").alias("ties"), F.collect_list(F.struct(group, "_k")).alias("_arms"))
    ranked = running_sums(pooled, keys, value, ["ties"], totals=True, cut_from=df)
    return ranked.select(*keys, value, "ties", F.col("ties_total").alias("n_total"),
                         (F.col("ties_before") + (F.col("ties") + 1) / 2.0).alias("avg_rank"),
                         F.inline("_arms")).withColumnRenamed("_k", "n")


def ordered_level_counts(df: DataFrame, keys: Sequence[str], level: str, value: str, n_levels: int) -> DataFrame:
    """One row per (keys, value): ``c0..`` rows per ordered level and ``c<i>_before`` counts of smaller values."""
    names = [f"c{i}" for i in range(n_levels)]
    counts = df.where(F.col(value).isNotNull() & F.col(level).isNotNull()).groupBy(*keys, value).agg(
        *[F.count_if(F.col(level) == i).alias(c) for i, c in enumerate(names)])
    return running_sums(counts, keys, value, names, totals=True, cut_from=df)


def positions(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (),
              name: str = "pos", total: str | None = None, block: Column | None = None) -> DataFrame:
    """Row number from 1 within ``keys`` by (order, ties); pass ``block`` when a monotone block id is known."""
    keys = list(keys)
    blocked = df.withColumn(BLOCK, block) if block is not None else with_value_blocks(df, order, ties=ties[0] if ties else None)
    inside = W.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carry = blocked.groupBy(*keys, BLOCK).agg(F.count("*").alias("_k"))
    columns = [F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_carry")]
    if total:
        columns.append(F.sum("_k").over(W.partitionBy(*keys)).alias(total))
    carry = carry.select(*keys, BLOCK, *columns)
    out = _join_on(blocked.withColumn("_inblock", F.row_number().over(inside)), carry, [*keys, BLOCK])
    return out.withColumn(name, F.col("_inblock") + F.col("_carry")).drop("_inblock", "_carry", BLOCK)


def neighbour(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], take: dict[str, str],
              block_width: int, offset: int = -1) -> DataFrame:
    """``lag`` (offset -1) or ``lead`` (offset 1) of columns within ``keys``, split into blocks of the order axis.

    ``take`` maps new column names to source columns. ``order`` is an integer axis such as a sample index or
    microseconds, so a block holds at most ``block_width`` ticks of one recording.
    """
    keys, back = list(keys), offset < 0
    source = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_width)))
    inside = W.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    step = F.lag if back else F.lead
    out = source.withColumn("_edge", F.row_number().over(
        inside if back else W.partitionBy(*keys, BLOCK).orderBy(F.desc(order), *[F.desc(t) for t in ties])) == 1)
    out = out.withColumns({n: step(c).over(inside) for n, c in take.items()})
    pick = F.max_by if back else F.min_by
    ends = source.groupBy(*keys, BLOCK).agg(
        pick(F.struct(*take.values()), F.struct(order, *ties)).alias("_end"))
    across = W.partitionBy(*keys).orderBy(BLOCK)
    ends = ends.withColumn("_end", step("_end").over(across))
    out = _join_on(out, ends, [*keys, BLOCK])
    return out.withColumns({n: F.when(F.col("_edge"), F.col(f"_end.{c}")).otherwise(F.col(n))
                            for n, c in take.items()}).drop("_edge", "_end", BLOCK)


def block_width(df: DataFrame, keys: Sequence[str], order: str, rows_per_block: int = 1_000_000) -> int:
    """Ticks per block so that the largest group has about ``rows_per_block`` rows in each.

    One counting pass; the answer is a single row. Sampled signals have a fixed rate and need no such pass.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    top = per_key.agg(F.max(F.struct("n", "lo", "hi")).alias("t")).first()["t"]
    if top is None or top["lo"] is None:
        return 1
    return max(1, -(-(top["hi"] - top["lo"] + 1) * rows_per_block // top["n"]))


def first_at_or_after(probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_t: str, event_t: str,
                      within: int, take: Sequence[str] = (), name: str = "found", block: int | None = None) -> DataFrame:
    """For each probe the earliest event with ``probe_t <= event_t <= probe_t + within`` in the same keys.

    The axis is cut into blocks of ``block`` ticks (default: ``within``): the answer is in the probe's own block
    or is the first event of the next block that has one. Neither pairs nor whole groups are formed. The
    result struct ``name`` holds ``t`` and the ``take`` columns; it is NULL where nothing was found.
    """
    keys, width = list(keys), block or within
    body = F.struct(F.col(event_t).alias("t"), *take)
    marks = events.select(*keys, F.floor(F.col(event_t) / width).alias(BLOCK), F.col(event_t).alias("_t"),
                          body.alias("_event"))
    asks = probes.withColumn(BLOCK, F.floor(F.col(probe_t) / width)).withColumn("_t", F.col(probe_t))
    both = asks.withColumn("_probe", F.lit(True)).unionByName(
        marks.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    # looking ahead = looking back in descending order; a frame that ends at UNBOUNDED FOLLOWING is quadratic
    ahead = (W.partitionBy(*keys, BLOCK).orderBy(F.desc("_t"), F.desc("_event"))
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    own = both.withColumn("_own", F.last("_event", ignorenulls=True).over(ahead)).where("_probe")
    later = W.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    heads = both.groupBy(*keys, BLOCK).agg(F.min("_event").alias("_head"))
    heads = heads.select(*keys, BLOCK, F.last("_head", ignorenulls=True).over(later).alias("_next"))
    out = _join_on(own.drop("_event", "_probe"), heads, [*keys, BLOCK], "left")
    found = F.coalesce("_own", "_next")
    return (out.withColumn(name, F.when(found["t"] <= F.col(probe_t) + within, found))
               .drop("_own", "_next", "_t", BLOCK))


def any_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
               tolerance: int, name: str = "matched") -> DataFrame:
    """Flag left rows with a right row no more than ``tolerance`` ticks away in the same keys.

    Right rows are reduced to the first and last tick per block of ``tolerance + 1`` ticks: any right row in
    the same block matches, in the previous block only the last can be near, in the next only the first.
    """
    keys, width = list(keys), tolerance + 1
    block = F.floor(F.col(right_t) / width)
    cells = right.groupBy(*keys, block.alias(BLOCK)).agg(
        F.min(right_t).alias("_first"), F.max(right_t).alias("_last"))
    around = cells.select(*keys, F.explode(F.sequence(F.col(BLOCK) - 1, F.col(BLOCK) + 1)).alias("_at"),
                          BLOCK, "_first", "_last")
    around = around.groupBy(*keys, F.col("_at").alias(BLOCK)).agg(
        F.bool_or(F.col(BLOCK) == F.col("_at")).alias("_same"),
        F.max(F.when(F.col(BLOCK) < F.col("_at"), F.col("_last"))).alias("_before"),
        F.min(F.when(F.col(BLOCK) > F.col("_at"), F.col("_first"))).alias("_after"))
    out = _join_on(left.withColumn(BLOCK, F.floor(F.col(left_t) / width)), around, [*keys, BLOCK], "left")
    t = F.col(left_t)
    hit = reduce(lambda a, b: a | b, [
        F.coalesce(F.col("_same"), F.lit(False)),
        F.coalesce(t - F.col("_before") <= tolerance, F.lit(False)),
        F.coalesce(F.col("_after") - t <= tolerance, F.lit(False))])
    return out.withColumn(name, hit).drop("_same", "_before", "_after", BLOCK)


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as scalars (a scalar subquery, no join); no row gives NULLs."""
    value = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", value).select(*df.columns, *[F.col("_one")[c].alias(c) for c in one.columns])


def largest_gap_split(df: DataFrame, day: str) -> DataFrame:
    """One row ``(split_day, gap_days, n_days)``: the last day before the widest gap (the first on ties).

    Distinct calendar days are few whatever the number of recordings, so one ordered pass over them is small.
    """
    days = df.where(F.col(day).isNotNull()).select(F.col(day).alias("split_day")).distinct()
    gap = F.datediff(F.lead("split_day").over(W.orderBy("split_day")), "split_day")
    gaps = days.withColumn("gap_days", gap)
    best = F.max_by(F.struct("split_day", "gap_days"),
                    F.when(F.col("gap_days").isNotNull(), F.struct("gap_days", -F.unix_date("split_day"))))
    return gaps.agg(best.alias("b"), F.count("*").alias("n_days")).select("b.*", "n_days")
