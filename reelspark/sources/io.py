"""Readers and writers.

CSV readers declare their schema (no inference pass over the data) and use
``"`` as the escape character so doubled quotes inside a quoted title parse
as one quote.  Malformed values become null (Spark's PERMISSIVE mode), as in
the reference; pass ``mode="FAILFAST"`` to fail instead.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from reelspark.sources.schemas import LINKS_SCHEMA, MOVIES_SCHEMA, RATINGS_SCHEMA, TAGS_SCHEMA


def _csv(spark: SparkSession, path: str, schema, mode: str = "PERMISSIVE") -> DataFrame:
    """Typed columns; a header that does not name them in this order fails."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("mode", mode)
        .csv(path)
    )


def _csv_by_header(spark: SparkSession, path: str, schema, mode: str) -> DataFrame:
    """All columns string, taken by the names in the header, in any order."""
    raw = spark.read.option("header", True).option("escape", '"').option("mode", mode).csv(path)
    return raw.select(*schema.fieldNames())


def read_ratings_csv(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """userId int, movieId int, rating float, timestamp long (epoch s)."""
    return _csv(spark, path, RATINGS_SCHEMA, mode)


def read_movies_csv(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """movieId int, title string, genres string."""
    return _csv(spark, path, MOVIES_SCHEMA, mode)


def read_tags_csv(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """S3: all columns string."""
    return _csv_by_header(spark, path, TAGS_SCHEMA, mode)


def read_links_csv(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """All columns string."""
    return _csv_by_header(spark, path, LINKS_SCHEMA, mode)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (catalog, prepared ratings, recommendations)."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a table as Parquet, replacing it by default."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def persist(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs read (memory, spill to disk).
    Call before the first action; ``unpersist`` when done."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
