"""Cleaning, calendar features, per-key statistics, density filter, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENRICHED_COLUMNS = ["movieId", "userId", "rating", "timestamp", "datetime", "year", "month", "dayofweek"]


def drop_incomplete(ratings: DataFrame) -> DataFrame:
    """Drop rows whose rating, userId or movieId is null (NaN stays,
    timestamp may be null)."""
    return ratings.filter(
        F.col("rating").isNotNull() & F.col("userId").isNotNull() & F.col("movieId").isNotNull()
    )


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def add_time_features(ratings: DataFrame, time_zone: str | None = None) -> DataFrame:
    """R2: epoch seconds -> datetime string, year, month, day of week
    (1 = Sunday).

    ``time_zone=None`` renders in the session time zone, as the reference
    does; a zone name (e.g. "UTC") renders in that zone whatever the
    session says, using zone-free timestamp arithmetic."""
    if time_zone is None:
        ts = F.timestamp_seconds(F.col("timestamp"))
        datetime = F.from_unixtime(F.col("timestamp"))
    else:
        ts = F.timestamp_add("SECOND", F.col("timestamp"), _epoch_ntz())  # UTC wall clock
        if time_zone.upper() not in ("UTC", "Z", "GMT"):
            ts = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), ts)
        datetime = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return ratings.select(
        "*",
        datetime.alias("datetime"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofweek(ts).alias("dayofweek"),
    )


def key_stats(ratings: DataFrame, key: str) -> DataFrame:
    """(key, num_ratings, avg_rating); partial aggregation map-side,
    so a hot key costs one row per map task in the shuffle."""
    return ratings.groupBy(key).agg(
        F.count("rating").alias("num_ratings"), F.avg(F.col("rating").cast("double")).alias("avg_rating")
    )


def user_stats(ratings: DataFrame) -> DataFrame:
    return key_stats(ratings, "userId")


def movie_stats(ratings: DataFrame) -> DataFrame:
    return key_stats(ratings, "movieId")


def active_keys(ratings: DataFrame, key: str, min_ratings: int) -> DataFrame:
    """Keys with at least ``min_ratings`` ratings."""
    return key_stats(ratings, key).filter(F.col("num_ratings") >= min_ratings).select(key)


def active_users(ratings: DataFrame, min_ratings: int = 20) -> DataFrame:
    return active_keys(ratings, "userId", min_ratings)


def popular_movies(ratings: DataFrame, min_ratings: int = 20) -> DataFrame:
    return active_keys(ratings, "movieId", min_ratings)


def density_filter(ratings_clean: DataFrame, min_user_ratings: int = 20, min_movie_ratings: int = 20) -> DataFrame:
    """Keep ratings of active users and popular movies — one pass, both
    counts taken on the input (a kept user may end with fewer rows).

    Two semi joins against the key sets; Spark picks broadcast or shuffle by
    the measured size of the key sets (AQE), and splits a hot user or movie
    partition (AQE skew join).
    """
    users = active_users(ratings_clean, min_user_ratings)
    movies = popular_movies(ratings_clean, min_movie_ratings)
    out = ratings_clean.join(users, "userId", "left_semi").join(movies, "movieId", "left_semi")
    front = ["movieId", "userId"]
    return out.select(*front, *[c for c in ratings_clean.columns if c not in front])


def density_flags(ratings_clean: DataFrame, min_user_ratings: int = 20, min_movie_ratings: int = 20) -> DataFrame:
    """Every input row with a boolean ``keep`` (the density filter's verdict)."""
    u = key_stats(ratings_clean, "userId").select("userId", F.col("num_ratings").alias("_nu"))
    m = key_stats(ratings_clean, "movieId").select("movieId", F.col("num_ratings").alias("_nm"))
    joined = ratings_clean.join(u, "userId", "left").join(m, "movieId", "left")
    keep = F.coalesce((F.col("_nu") >= min_user_ratings) & (F.col("_nm") >= min_movie_ratings), F.lit(False))
    return joined.withColumn("keep", keep).drop("_nu", "_nm")


# --- R8: reproducible split ---------------------------------------------------

SPLIT_KEY_COLUMNS = ("userId", "movieId", "timestamp")
_HASH_SPACE = 2**32


def split_bucket(seed: int, cols=SPLIT_KEY_COLUMNS) -> Column:
    """A 32-bit value from the md5 of ``seed:col1:col2:...`` (nulls skipped).

    Depends only on the row's own values, so the split is the same for any
    partitioning, any number of executors and after a task is retried.
    """
    text = F.concat_ws(":", F.lit(str(int(seed))), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _bounds(weights) -> list[int]:
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and sum to a positive value")
    bounds, acc = [0], 0.0
    for w in weights:
        acc += w
        bounds.append(int(round(acc / total * _HASH_SPACE)))
    return bounds


def hash_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42, cols=SPLIT_KEY_COLUMNS) -> list[DataFrame]:
    """Split ``df`` by weights with a per-row hash (default), returning
    one DataFrame per weight.  Unlike ``randomSplit`` the result does not
    depend on how the parent is partitioned or whether it is cached."""
    bounds = _bounds(weights)
    b = split_bucket(seed, cols)
    return [df.filter((b >= lo) & (b < hi)) for lo, hi in zip(bounds[:-1], bounds[1:])]


def label_split(
    df: DataFrame, weights=(0.8, 0.2), seed: int = 42, names=("train", "test"), cols=SPLIT_KEY_COLUMNS,
    label: str = "split",
) -> DataFrame:
    """R8 in one pass: the same split as :func:`hash_split`, as a ``label``
    column naming each row's part, so all parts are produced by one job
    (e.g. written once, partitioned by the label)."""
    if len(names) != len(weights):
        raise ValueError("one name per weight")
    bounds = _bounds(weights)
    b = split_bucket(seed, cols)
    expr = None
    for name, lo, hi in zip(names, bounds[:-1], bounds[1:]):
        cond = (b >= lo) & (b < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(label, expr)


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """R8 as in the reference (``randomSplit``; depends on partitioning)."""
    return df.randomSplit(list(weights), seed=seed)
