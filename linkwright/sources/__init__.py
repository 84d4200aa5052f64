"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table of any format that Spark reads; CSV and JSON should be given their schema."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_links(links: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    """Write matches in any format that Spark writes."""
    links.write.format(kind).mode(mode).options(**options).save(path)
