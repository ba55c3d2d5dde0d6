"""Rating statistics kept up to date as ratings are appended.

Counts, sums and a histogram by rating value are kept by key in a state table; a new
batch is reduced to partials of the same shape and both are added up, so a batch costs
the batch and the state, never the history.  Ratings are kept as counts of each distinct
value, so averages are those of all rows, whatever the batches were.

A state is written as a new version beside the last one and named by a marker file, so
readers never meet half a state and a killed write leaves the last one valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.versions import latest, publish

STATE = "key int, rating double, n long"


def partials(ratings: DataFrame, key: str) -> DataFrame:
    """(key, rating) rows -> one row for each key and rating value: key, rating, n."""
    rows = ratings.select(F.col(key).cast("int").alias("key"), F.col("rating").cast("double").alias("rating")).filter("key IS NOT NULL")
    return rows.groupBy("key", "rating").agg(F.count("*").alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """States or partials added up; the order in which they come does not matter."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("key", "rating").agg(F.sum("n").alias("n"))


def statistics(state: DataFrame, key: str) -> DataFrame:
    """Key, num_ratings, avg_rating of a state."""
    rated = F.coalesce(F.sum(F.when(F.col("rating").isNotNull(), F.col("n"))), F.lit(0))
    average = F.sum(F.col("rating") * F.col("n")) / F.nullif(rated, F.lit(0))
    return state.groupBy(F.col("key").alias(key)).agg(rated.alias("num_ratings"), average.alias("avg_rating"))


def histogram(state: DataFrame) -> DataFrame:
    """Rating, count."""
    return state.groupBy("rating").agg(F.sum("n").alias("count"))


def crossed(before: DataFrame, after: DataFrame, least: int = 20) -> DataFrame:
    """The keys that reach ``least`` ratings with this state and had not: key, num_ratings."""
    old = before.groupBy("key").agg(F.sum("n").alias("_old"))
    new = after.groupBy("key").agg(F.sum("n").alias("num_ratings")).filter(F.col("num_ratings") >= least)
    return new.join(old, "key", "left").filter(F.coalesce("_old", F.lit(0)) < least).select("key", "num_ratings")


def append(ratings: DataFrame, key: str, path: str, keep: int = 2) -> DataFrame:
    """Add a batch of ratings to the state under ``path`` (made if there is none); the new state."""
    spark = ratings.sparkSession
    last = latest(spark, path)
    new = partials(ratings, key)
    state = new if last is None else merged(spark.read.schema(STATE).parquet(last), new)
    return spark.read.schema(STATE).parquet(publish(spark, path, lambda folder: state.write.parquet(folder), keep))
