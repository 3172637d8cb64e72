"""Parquet tables of one folder, `{folder}/{name}.parquet`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """The same table as a stream of its files; options are those of the file source, such as maxFilesPerTrigger."""
    path = f"{folder}/{name}.parquet"
    # As a pattern, since the file source takes no single file by its plain name.
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{path[:-1]}[t]")
