"""Declared schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

RATINGS_SCHEMA = StructType(
    [
        StructField("userId", IntegerType(), True),
        StructField("movieId", IntegerType(), True),
        StructField("rating", FloatType(), True),
        StructField("timestamp", LongType(), True),  # epoch seconds
    ]
)

MOVIES_SCHEMA = StructType(
    [
        StructField("movieId", IntegerType(), True),
        StructField("title", StringType(), True),
        StructField("genres", StringType(), True),  # pipe-delimited
    ]
)

# The raw tags/links files are read as strings (header names come from the
# file); the column names below follow the public dataset documentation.
TAGS_SCHEMA = StructType(
    [
        StructField("userId", StringType(), True),
        StructField("movieId", StringType(), True),
        StructField("tag", StringType(), True),
        StructField("timestamp", StringType(), True),
    ]
)

LINKS_SCHEMA = StructType(
    [
        StructField("movieId", StringType(), True),
        StructField("imdbId", StringType(), True),
        StructField("tmdbId", StringType(), True),
    ]
)

# Search results of an external movie database, one row per (query, rank).
METADATA_SCHEMA = StructType(
    [
        StructField("query_title", StringType(), True),
        StructField("result_rank", IntegerType(), True),
        StructField("tmdb_id", LongType(), True),
        StructField("overview", StringType(), True),
        StructField("release_date", StringType(), True),
        StructField("vote_average", DoubleType(), True),
        StructField("vote_count", LongType(), True),
        StructField("popularity", DoubleType(), True),
        StructField("poster_path", StringType(), True),
    ]
)

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def checked_int_id(c: Column, name: str) -> Column:
    """Cast an id column to int, failing the job when a value is out of range.

    ALS keys must be ints.  Silent wrap-around would merge distinct ids, so an
    out-of-range value raises inside the task instead (``raise_error``).
    """
    return (
        F.when(c.isNull(), F.lit(None).cast("int"))
        .when(
            (c >= F.lit(INT_MIN)) & (c <= F.lit(INT_MAX)),
            c.cast("int"),
        )
        .otherwise(
            F.raise_error(F.concat(F.lit(f"{name} out of int range: "), c.cast("string")))
            .cast("int")
        )
    )


def with_int_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Project ``cols`` through :func:`checked_int_id`, keeping column order."""
    return df.select(
        *[checked_int_id(F.col(c), c).alias(c) if c in cols else F.col(c) for c in df.columns]
    )
