"""Feature table steps that need the whole cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.ordered import attach_one_row, largest_gap_split


def assign_study(df: DataFrame, day: str, split_on: str | None = None, name: str = "study") -> DataFrame:
    """``acute`` up to the day before the widest gap between recording days, ``chronic`` after, else ``unknown``.

    The split is a one-row aggregate attached as a scalar.
    """
    split = largest_gap_split(df, split_on or day).select(F.col("split_day"))
    return (attach_one_row(df, split).withColumn(name, F.when(F.col("split_day").isNull(), "unknown")
                              .when(F.col(day) <= F.col("split_day"), "acute").otherwise("chronic"))
            .drop("split_day"))
