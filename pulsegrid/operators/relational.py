"""Reusable relational steps of a study: long form, arm summaries, cross-tabs, imputation, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid.operators.ordered import exact_quantiles, positions


def measurements(df: DataFrame, ids: Sequence[str], parameters: Sequence[str]) -> DataFrame:
    """Long form ``(ids, parameter, value)``; every test is then one grouped aggregation."""
    return df.select(*ids, *[F.col(p).cast("double").alias(p) for p in parameters]).unpivot(
        list(ids), list(parameters), "parameter", "value")


def arm_summary(long: DataFrame, keys: Sequence[str], arm: str, arms: dict[str, str], digits: int = 4) -> DataFrame:
    """Mean, SD (ddof 1) and n per arm, one row per ``keys``; ``arms`` maps arm values to column prefixes.

    Conditional aggregates instead of ``pivot``: one shuffle of partial sums and a fixed schema.
    """
    columns = []
    for value, prefix in arms.items():
        v = F.when(F.col(arm) == value, F.col("value"))
        columns += [F.round(F.avg(v), digits).alias(f"{prefix}_mean"),
                    F.round(F.stddev_samp(v), digits).alias(f"{prefix}_sd"),
                    F.count(v).alias(f"{prefix}_n")]
    return long.groupBy(*keys).agg(*columns)


def cross_tab(df: DataFrame, row: str, column: str, levels: dict[str, str]) -> DataFrame:
    """Counts of row × column over the known column levels, 0 where a pair never occurs."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(n) for v, n in levels.items()])


def counts_over_domain(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Value counts reindexed to a fixed domain; a level that never occurs has a NULL count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return domain.join(counts, column, "left")


def impute_median(long: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """Fill NULL values with the exact median of their parameter; ``imputed`` marks filled rows."""
    medians = exact_quantiles(long, [parameter], value, {"_median": 0.5})
    return (long.join(medians, parameter, "left")
                .withColumn("imputed", F.col(value).isNull())
                .withColumn(value, F.coalesce(value, "_median")).drop("_median"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that have NULLs and how many."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "n_null").where("n_null > 0")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal bin of [low, high]; the last bin is closed on the right, values outside are left out."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - F.lit(float(low))) / F.lit(float(width))), F.lit(bins - 1))
    return (df.where(F.col(value).between(low, high)).groupBy(index.cast("int").alias("bin"))
              .agg(F.count("*").alias("n")))


def cumulative_share(shares: DataFrame, order: str, share: str) -> DataFrame:
    """Running share of a short ordered table (explained variance, arm sizes)."""
    run = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return shares.withColumn("cumulative", F.sum(share).over(run) / F.sum(share).over(W.partitionBy()))


def percent_change(df: DataFrame, name: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Difference and percent difference of each row to the row called ``baseline`` (one row per method)."""
    everything = W.partitionBy()
    out = df
    for m in metrics:
        base = F.max(F.when(F.col(name) == baseline, F.col(m))).over(everything)
        out = out.withColumn(f"{m}_delta", F.col(m) - base).withColumn(
            f"{m}_pct", F.when(base != 0, 100.0 * (F.col(m) - base) / F.abs(base)))
    return out


def systematic_sample(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], at_most: int,
                      block: Column | None = None) -> DataFrame:
    """Evenly spaced rows of each group in ``order``, both ends included: floor(linspace(0, n-1, at_most))."""
    placed = positions(df, keys, order, ties, "_pos", total="_n", block=block)
    i, n, m = F.col("_pos") - 1, F.col("_n"), F.lit(at_most)
    # i is picked when i = floor(j*(n-1)/(m-1)) for an integer j in 0..m-1: the smallest j reaching i lands on it
    j = F.floor((i * (m - 1) + (n - 2)) / (n - 1))
    picked = (n <= m) | (F.floor(j * (n - 1) / (m - 1)) == i)
    return placed.where(picked).drop("_pos", "_n")


def tag_and_union(parts: dict[str, DataFrame], tag: str = "src") -> DataFrame:
    out = None
    for name, part in parts.items():
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def dose_means(long: DataFrame, keys: Sequence[str], dose: str) -> DataFrame:
    """Mean and SEM per dose with its dense rank; aggregated first, ranked over the few doses after."""
    means = long.where(F.col(dose).isNotNull()).groupBy(*keys, dose).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))
    return means.withColumn("dose_rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(dose)))


def patch_columns(table: DataFrame, patch: DataFrame, key: str, after: str, columns: Sequence[str]) -> DataFrame:
    """Left-join recomputed columns and place them right after a named column."""
    names = [c for c in table.columns if c not in columns]
    at = names.index(after) + 1
    joined = table.drop(*columns).join(patch.select(key, *columns), key, "left")
    return joined.select(*names[:at], *columns, *names[at:])
