"""Helpers shared by the text operators: staging, word rules, native prefix sums, files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import arrays
from pulsegrid.session import shared_checkpoint_dir

# The white space that separates words, as characters and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return arrays.let(body, value)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    return f"{shared_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it survives lost executors and has a known size."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of integers; linear in time for arrays of any length.

    Appending to an array copies it, so sums are built inside blocks and shifted by the totals of earlier blocks.
    """
    empty = F.array().cast("array<bigint>")

    def inside(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("t"), empty.alias("a"))
        return F.aggregate(part, start, lambda s, x: F.struct(
            (s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"] + x)).alias("a")))["a"]

    def by_block(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
                             lambda b: inside(F.slice(v, b * block + 1, block)))
        return let(blocks, lambda bs: let(
            F.concat(F.array(F.lit(0).cast("bigint")), inside(F.transform(bs, lambda b: F.element_at(b, -1)))),
            lambda before: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: x + before[i])))))

    return let(values, lambda v: F.when(F.size(v) > 0, by_block(v)).otherwise(empty))


def file_system(uri: str):
    """Arrow's file system and path for a folder of the shared store, whatever its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


#: What a table that is sent to every task may hold: rows, and bytes of its strings.
SMALL_ROWS = 100_000
SMALL_BYTES = 8 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df`` with the hint to send it to every task where its measured size allows; otherwise as it is."""
    strings = [F.sum(F.octet_length(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, *sizes = df.agg(F.count("*"), *strings).first()
    return F.broadcast(df) if n <= SMALL_ROWS and sum(x or 0 for x in sizes) <= SMALL_BYTES else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, staged, with the rows' numbers from 0 in ``order`` as column ``name``; rows that tie get numbers of their own.

    Rows are range-partitioned (ties by where they were read, so that a value with many rows splits too) and numbered
    inside partitions; a table with one row a partition has the numbers that these start from.
    """
    salt, at = fresh(df, "_salt"), fresh(df, "_at")
    keys = [*order, F.col(salt)]
    rows = (df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
            .drop(salt).withColumn(at, F.monotonically_increasing_id()))
    rows = stage(rows, name)
    part = F.shiftright(at, 33)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.shiftleft("_part", 33)).alias("_start"))
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, F.col(at) + F.col("_start")).drop(at, "_part", "_start")
