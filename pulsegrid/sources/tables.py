"""Study tables: the metadata dimension, stage tables and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ANIMAL_SCHEMA = "`Code` INT, `dox treatment` DOUBLE, `Etn Treatment` DOUBLE, `Sex` STRING, `date of surgery ` STRING"


def read_animals(spark: SparkSession, path: str) -> DataFrame:
    """Metadata exported from the animal sheet as CSV (Spark reads no Excel)."""
    return spark.read.schema(ANIMAL_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


class Store:
    """Stage and result tables under one folder that all executors reach.

    A stage is written once and read back, so later stages neither recompute it nor depend on executors that
    may be gone.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def report(self, name: str, df: DataFrame) -> None:
        """A result table for people: CSV with a header."""
        df.write.mode("overwrite").option("header", True).csv(self.path(name))


def long_results(df: DataFrame, keys: list[str], test: str) -> DataFrame:
    """Any result table as (keys…, test, key, value) for one common results table."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(
        keys, values, "key", "value").withColumn("test", F.lit(test)).select(*keys, "test", "key", "value")
