"""Recording names: ``[prefix]year_month_day_animal`` or ``year_month_animal``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions.arrays import let


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def id_run(runs: Column) -> Column:
    """Animal id as text: the 4th run of four or more, the 3rd of exactly three, else NULL."""
    return F.when(F.size(runs) >= 4, F.get(runs, F.lit(3))).when(F.size(runs) == 3, F.get(runs, F.lit(2)))


def parse_name(stem: Column) -> Column:
    """Struct (animal_id, recording_date); both NULL when there are too few runs or the date does not exist."""
    def parts(runs):
        four = F.size(runs) >= 4
        year = F.right(F.get(runs, F.lit(0)), F.lit(4)).try_cast("int")
        month = F.get(runs, F.lit(1)).try_cast("int")
        day = F.when(four, F.get(runs, F.lit(2)).try_cast("int")).otherwise(F.lit(1))
        date = F.when(F.size(runs) >= 3, F.try_make_timestamp(
            year, month, day, F.lit(0), F.lit(0), F.lit(0.0).cast("decimal(8,6)")).cast("date"))
        return F.struct(id_run(runs).try_cast("bigint").alias("id"), date.alias("day"))

    def checked(p):
        return F.struct(F.when(p["day"].isNotNull(), p["id"]).alias("animal_id"), p["day"].alias("recording_date"))
    return let(checked, let(parts, digit_runs(stem)))
