"""Cleaning, features, density filter and split on literal ratings."""

import math

import pytest
from pyspark.sql import functions as F

from reelspark.operators import prepare, profile


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [
        (1, 10, 4.0, 0),  # 1970-01-01 00:00:00, a Thursday
        (1, 11, None, 86400 * 3),  # Sunday
        (None, 10, 3.0, 5),
        (2, None, 3.0, 5),
        (2, 10, float("nan"), None),
        (3, 12, 5.0, 1700000000),
    ]
    return spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")


def test_drop_incomplete_keeps_nan_and_null_timestamp(ratings):
    rows = prepare.drop_incomplete(ratings).collect()
    assert len(rows) == 3
    assert any(r.rating is not None and math.isnan(r.rating) for r in rows)
    assert any(r.timestamp is None for r in rows)


def test_time_features(ratings):
    rows = {r.timestamp: r for r in prepare.add_time_features(ratings).collect()}
    r0 = rows[0]
    assert (r0.datetime, r0.year, r0.month, r0.dayofweek) == ("1970-01-01 00:00:00", 1970, 1, 5)
    assert rows[86400 * 3].dayofweek == 1  # Sunday is 1
    assert rows[1700000000].datetime == "2023-11-14 22:13:20"
    assert rows[None].datetime is None and rows[None].year is None


def test_density_filter_is_one_pass(spark):
    # user 1 rates m1..m3; user 2 rates m1; movie m3 only by user 1.
    rows = [(1, 1, 1.0, 0), (1, 2, 1.0, 0), (1, 3, 1.0, 0), (2, 1, 1.0, 0), (2, 2, 1.0, 0), (3, 1, 1.0, 0)]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")
    out = prepare.density_filter(df, min_user_ratings=2, min_movie_ratings=2)
    assert out.columns[:2] == ["movieId", "userId"]
    got = sorted((r.userId, r.movieId) for r in out.collect())
    # movie 3 has one rating -> dropped; user 1 keeps 2 rows (counts are not re-taken)
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]
    red = profile.data_reduction(df, 2, 2).first()
    assert (red.original_rows, red.filtered_rows) == (6, 4)
    assert red.reduction_pct == pytest.approx((6 - 4) / 6 * 100)


def test_stats_and_thresholds(spark):
    rows = [(1, 1, 1.0, 0), (1, 2, 2.0, 0), (2, 1, 4.0, 0)]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")
    u = {r.userId: (r.num_ratings, r.avg_rating) for r in prepare.user_stats(df).collect()}
    assert u == {1: (2, 1.5), 2: (1, 4.0)}
    assert [r.movieId for r in prepare.popular_movies(df, 2).collect()] == [1]


def test_hash_split_is_partition_independent(spark, smoke_dir):
    from reelspark.sources import fixtures as fx

    r = fx.ratings(spark, smoke_dir)
    parts = []
    for n in (1, 3, 11):
        train, test = prepare.hash_split(r.repartition(n), (0.8, 0.2), seed=42)
        parts.append((set(map(tuple, train.collect())), set(map(tuple, test.collect()))))
    assert parts[0] == parts[1] == parts[2]
    train, test = parts[0]
    total = r.count()
    assert not (train & test) and len(train) + len(test) == total
    assert 0.75 < len(train) / total < 0.85
    other_seed = set(map(tuple, prepare.hash_split(r, (0.8, 0.2), seed=7)[0].collect()))
    assert other_seed != train


def test_hash_split_weights(spark):
    df = spark.range(20000).select(F.col("id").cast("int").alias("userId"), F.lit(1).alias("movieId"),
                                   F.lit(0).cast("long").alias("timestamp"))
    a, b, c = prepare.hash_split(df, (1, 1, 2), seed=1)
    na, nb, nc = a.count(), b.count(), c.count()
    assert na + nb + nc == 20000
    assert abs(na - 5000) < 400 and abs(nc - 10000) < 400
    with pytest.raises(ValueError):
        prepare.hash_split(df, (0, 0))


def test_profile_summary_and_missing(ratings):
    s = {r.column_name: r for r in profile.numeric_summary(ratings).collect()}
    assert s["userId"].n == 5 and s["userId"].min_value == 1.0 and s["userId"].max_value == 3.0
    m = profile.missing_counts(ratings).first()
    assert (m.userId, m.movieId, m.rating, m.timestamp) == (1, 1, 2, 1)
    h = {r.rating: r["count"] for r in profile.rating_histogram(ratings).collect() if r.rating == r.rating}
    assert h[3.0] == 2


def test_label_split_equals_hash_split(spark, smoke_dir):
    from reelspark.sources import fixtures as fx

    r = fx.ratings(spark, smoke_dir)
    train, test = prepare.hash_split(r, (0.8, 0.2), seed=42)
    lab = prepare.label_split(r, (0.8, 0.2), seed=42, names=("train", "test"))
    got_train = set(map(tuple, lab.filter("split = 'train'").drop("split").collect()))
    got_test = set(map(tuple, lab.filter("split = 'test'").drop("split").collect()))
    assert got_train == set(map(tuple, train.collect()))
    assert got_test == set(map(tuple, test.collect()))
    assert lab.filter("split IS NULL").count() == 0


def test_time_features_explicit_zone_ignores_session(spark, ratings):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        utc = {r.timestamp: r for r in prepare.add_time_features(ratings, time_zone="UTC").collect()}
        assert utc[0].datetime == "1970-01-01 00:00:00" and utc[0].dayofweek == 5
        ist = {r.timestamp: r for r in prepare.add_time_features(ratings, time_zone="Asia/Kolkata").collect()}
        assert ist[0].datetime == "1970-01-01 05:30:00"
        session = {r.timestamp: r for r in prepare.add_time_features(ratings).collect()}
        assert session[0].datetime == "1970-01-01 05:30:00"  # reference behaviour: session zone
        assert utc[None].datetime is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_data_reduction_on_empty_input(spark):
    empty = spark.createDataFrame([], "userId int, movieId int, rating float, timestamp long")
    r = profile.data_reduction(empty).first()
    assert (r.original_rows, r.filtered_rows, r.reduction_pct) == (0, 0, None)
