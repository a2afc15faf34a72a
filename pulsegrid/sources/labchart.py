"""Tab-separated chart exports as DataFrames: recordings, samples and markers.

The files are read with Spark's own text source, so a long recording is split over many tasks. A line's place
in its file comes from its byte block and its order inside the block; nothing depends on a file fitting in one
task. Parsing is column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.functions import constants as C
from pulsegrid.functions.columns import nan_to_null
from pulsegrid.sources.filenames import parse_name

DATA_LINE = r"^\s*([0-9+\-.].*)?$"
FS_LINE = r"(?i)([0-9.]+(?:e[+-]?[0-9]+)?)\s*s"


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(recording_id, block, line_id, value): ``line_id`` orders lines inside a byte block of one file."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return lines.select(stem.alias("recording_id"), "file", "block", F.monotonically_increasing_id().alias("line_id"), "value")


def _values(line: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(line, r"^[^=]*=", ""), r"^\t+|\t+$", "")
    return F.filter(F.transform(F.split(rest, "\t"), F.trim), lambda v: v != "")


def layout(lines: DataFrame, channel: str = "channel 3") -> DataFrame:
    """One row per file: header length, channel titles, lead columns, ECG column, sampling rate."""
    head = lines.where(F.col("block") == 0)
    is_data = F.col("value").rlike(DATA_LINE)
    first = head.where(is_data).groupBy("recording_id").agg(F.min_by("value", "line_id").alias("first_row"), F.min("line_id").alias("_cut"))
    files = lines.groupBy("recording_id").agg(F.min("file").alias("file"))
    header = head.join(first.select("recording_id", "_cut"), "recording_id", "left").where(
        F.col("_cut").isNull() | (F.col("line_id") < F.col("_cut")))
    key = F.trim(F.regexp_extract("value", r"^([^=]*)=", 1))
    info = header.groupBy("recording_id").agg(
        F.count("*").alias("n_header"),
        F.max_by(F.when(key == "ChannelTitle", _values(F.col("value"))), F.when(key == "ChannelTitle", F.col("line_id"))).alias("titles"),
        F.min_by(F.regexp_extract("value", FS_LINE, 1), F.when(F.lower("value").startswith("interval"), F.col("line_id"))).alias("_interval"))
    out = files.join(first.drop("_cut"), "recording_id", "left").join(info, "recording_id", "left")
    titles = F.coalesce("titles", F.array().cast("array<string>"))
    n_channels = F.greatest(F.size(titles), F.lit(1))
    columns = F.coalesce(F.size(F.split("first_row", "\t")), n_channels + 1)
    lead = F.greatest(F.lit(1), columns - n_channels)
    at = F.array_position(F.transform(titles, F.lower), channel)
    interval = F.col("_interval").try_cast("double")
    return out.select(
        "recording_id", "file", F.coalesce("n_header", F.lit(0)).alias("n_header"), titles.alias("titles"), lead.alias("lead_cols"),
        (lead + F.when(at > 0, at - 1).otherwise(0)).cast("int").alias("ecg_col"),
        F.when(interval > 0, F.round(1.0 / interval).cast("int")).otherwise(C.FS_HZ).alias("fs"))


def fixed_layout(lines: DataFrame, n_header: int = 6, ecg_col: int = 2) -> DataFrame:
    """Layout of a format known beforehand."""
    return lines.groupBy("recording_id").agg(F.min("file").alias("file")).select(
        "recording_id", "file", F.lit(n_header).cast("bigint").alias("n_header"), F.array().cast("array<string>").alias("titles"),
        F.lit(ecg_col).alias("lead_cols"), F.lit(ecg_col).alias("ecg_col"), F.lit(C.FS_HZ).alias("fs"))


def parse(lines: DataFrame, layouts: DataFrame, short_rows: str = "drop") -> DataFrame:
    """(recording_id, sample_idx, mv, prefix, text) for every sample row.

    A row with too few fields is dropped and does not advance the index; ``short_rows="null"`` keeps it as a
    missing sample. Unreadable numbers are NULL. The index adds the row's place in its block to the rows of
    earlier blocks.
    """
    spec = layouts.select("recording_id", "n_header", "ecg_col")
    inside = W.partitionBy("recording_id", "block").orderBy("line_id")
    numbered = lines.drop("file").withColumn("_line", F.row_number().over(inside)).join(spec, "recording_id")
    body = numbered.where((F.col("block") > 0) | (F.col("_line") > F.col("n_header")))
    fields = F.split("value", "\t")
    if short_rows == "drop":
        body = body.where(F.size(fields) > F.col("ecg_col"))
    mark = F.regexp_extract("value", C.MARKER_PATTERN, 1)
    rows = body.select(
        "recording_id", "block", "line_id", nan_to_null(F.get(fields, F.col("ecg_col")).try_cast("double")).alias("mv"),
        F.when(mark != "", mark).alias("prefix"),
        F.when(mark != "", F.trim(F.regexp_extract("value", "(" + C.MARKER_PATTERN.replace("(", "").replace(")", "") + ".*)$", 1))).alias("text"))
    counts = rows.groupBy("recording_id", "block").agg(F.count("*").alias("_k"))
    before = W.partitionBy("recording_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = counts.select("recording_id", "block", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_carry"))
    out = rows.withColumn("_i", F.row_number().over(inside)).join(carry, ["recording_id", "block"])
    return out.select("recording_id", (F.col("_i") - 1 + F.col("_carry")).alias("sample_idx"), "mv", "prefix", "text")


def markers_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("prefix IS NOT NULL").select("recording_id", F.col("sample_idx").alias("idx"), "prefix", "text")


def recordings_of(layouts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Layout with the name's animal and date and the number of samples."""
    name = parse_name(F.col("recording_id"))
    sizes = parsed.groupBy("recording_id").agg(F.count("*").alias("n_samples"))
    return (layouts.join(sizes, "recording_id", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
            .withColumns({"animal_id": name["animal_id"], "recording_date": name["recording_date"]}))


def find_recording(recordings: DataFrame, animal_id: int) -> DataFrame:
    """The first file by name whose last digit run is the animal."""
    last = F.try_element_at(F.regexp_extract_all("recording_id", F.lit("([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")
    return recordings.where(last == animal_id).orderBy("file").limit(1)
