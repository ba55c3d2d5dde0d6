"""Quarantined CSV, dense ids, appended states, published versions, changed buckets, pruned top-N."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import dense_ids, prepare, pruned, rating_state, recommend, versions
from reelspark.plans.training import refresh_recommendations
from reelspark.sources import quarantine
from reelspark.sources.schemas import MOVIES_SCHEMA, RATINGS_SCHEMA

RATINGS = "userId int, movieId int, rating float, timestamp long"


def _csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_bad_records_are_kept_apart_with_file_and_reason(spark, tmp_dir):
    _csv(f"{tmp_dir}/in", "a.csv", "userId,movieId,rating,timestamp\n1,2,3.5,9\nx,2,3.5,9\n,2,1.0,9\n1,2\n1,2,,9\n")
    _csv(f"{tmp_dir}/in", "b.csv", "userId,movieId,rating,timestamp\n5,99999999999,3.5,9\n5,6,4.0,9,extra\n7,8,4.5,\n7,,4.5,1\n")
    got = quarantine.read_csv(spark, f"{tmp_dir}/in", RATINGS_SCHEMA, f"{tmp_dir}/out", ("userId", "movieId"))
    assert sorted(map(tuple, got.good.collect()), key=str) == [(1, 2, 3.5, 9), (1, 2, None, 9), (7, 8, 4.5, None)]
    rejects = {(os.path.basename(r.file), r.line, r.reason) for r in got.rejects.collect()}
    assert rejects == {
        ("a.csv", "x,2,3.5,9", "unparsable"), ("a.csv", None, "no userId"), ("a.csv", "1,2", "unparsable"),
        ("b.csv", "5,99999999999,3.5,9", "unparsable"), ("b.csv", "5,6,4.0,9,extra", "unparsable"), ("b.csv", None, "no movieId"),
    }
    assert tuple(got.counts().first()) == (3, 6) and {tuple(r) for r in got.reasons().collect()} == {("unparsable", 4), ("no userId", 1), ("no movieId", 1)}


def test_quoted_titles_and_empty_files(spark, tmp_dir):
    _csv(f"{tmp_dir}/in", "m.csv", 'movieId,title,genres\n1,"A ""b"", c (1999)",Drama|War\n')
    got = quarantine.read_csv(spark, f"{tmp_dir}/in", MOVIES_SCHEMA, f"{tmp_dir}/out", ("movieId",))
    assert [tuple(r) for r in got.good.collect()] == [(1, 'A "b", c (1999)', "Drama|War")] and got.rejects.count() == 0
    _csv(f"{tmp_dir}/none", "m.csv", "movieId,title,genres\n")
    none = quarantine.read_csv(spark, f"{tmp_dir}/none", MOVIES_SCHEMA, f"{tmp_dir}/out")
    assert tuple(none.counts().first()) == (0, 0)


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_ids_keep_the_order(spark, partitions):
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.integers(-(2**60), 2**60, 300)] + [0, 2**62, -(2**62)]
    df = spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "who long")
    got = {r.who: r.dense for r in dense_ids.dense_ids(df, "who", partitions=partitions).collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)))}
    words = spark.createDataFrame([(w,) for w in ["b", "a", "ä", "", "b", "Z"]], "who string")
    assert {r.who: r.dense for r in dense_ids.dense_ids(words, "who", first=5).collect()} == {"": 5, "Z": 6, "a": 7, "b": 8, "ä": 9}
    assert dense_ids.dense_ids(df.limit(0), "who").count() == 0


def test_dense_ids_there_and_back_through_fit_and_recommend(spark):
    from reelspark.operators import model as M

    rng = np.random.default_rng(2)
    rows = [(f"user-{u}", int(m) * 5_000_000_000, float(rng.integers(1, 11)) / 2) for u in range(12) for m in rng.choice(15, 8, replace=False)]
    ratings = spark.createDataFrame(rows, "userId string, movieId long, rating float")
    users, movies = dense_ids.dense_ids(ratings, "userId"), dense_ids.dense_ids(ratings, "movieId")
    dense = dense_ids.with_dense(dense_ids.with_dense(ratings, "userId", users), "movieId", movies)
    assert dense.schema["userId"].dataType.simpleString() == "int" and dense.count() == len(rows)
    back = dense_ids.with_original(dense_ids.with_original(dense, "userId", users), "movieId", movies)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    model = M.fit_als(dense, rank=3, max_iter=2)
    recs = recommend.unnest(recommend.recommend_for_all_users(model, 4, exclude_seen=dense))
    named = dense_ids.with_original(dense_ids.with_original(recs, "userId", users), "movieId", movies).collect()
    seen = {(u, m) for u, m, _ in rows}
    assert len(named) == 12 * 4 and not any((r.userId, r.movieId) in seen for r in named)


def test_appended_batches_equal_one_pass(spark, tmp_dir):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(m), None if rng.random() < 0.1 else float(rng.integers(1, 11)) / 2, 0) for u, m in zip(np.minimum(rng.integers(0, 60, 900), 30), rng.integers(0, 40, 900), strict=True)]
    rows += [(None, 1, 3.0, 0)]
    every = spark.createDataFrame(rows, RATINGS).withColumn("batch", F.pmod(F.xxhash64("userId", "movieId"), F.lit(4)))
    states = [rating_state.append(every.filter(F.col("batch") == b), "userId", f"{tmp_dir}/s", keep=5) for b in range(4)]
    want = {tuple(r) for r in prepare.user_stats(every.filter("userId IS NOT NULL")).collect()}
    assert {tuple(r) for r in rating_state.statistics(states[-1], "userId").collect()} == want
    hist = {tuple(r) for r in every.filter("userId IS NOT NULL").groupBy("rating").count().collect()}
    assert {tuple(r) for r in rating_state.histogram(states[-1]).collect()} == hist
    assert len(versions.versions(spark, f"{tmp_dir}/s")) == 4
    new = {r.key for r in rating_state.crossed(states[2], states[3]).collect()}
    n = [{r.key: r.n for r in s.groupBy("key").agg(F.sum("n").alias("n")).collect()} for s in states[2:]]
    assert new == {k for k, v in n[1].items() if v >= 20 and n[0].get(k, 0) < 20}
    again = rating_state.append(every.limit(0), "userId", f"{tmp_dir}/s", keep=2)
    assert {tuple(r) for r in rating_state.statistics(again, "userId").collect()} == want
    assert len(versions.versions(spark, f"{tmp_dir}/s")) == 2


def test_readers_see_the_last_published_version(spark, tmp_dir):
    path = f"{tmp_dir}/v"
    assert versions.latest(spark, path) is None
    one = versions.publish(spark, path, lambda f: spark.range(1).write.parquet(f))

    def write(folder):
        spark.range(2).write.parquet(folder)
        assert versions.latest(spark, path) == one  # between the two steps the old one is seen

    two = versions.publish(spark, path, write)

    def dies(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        versions.publish(spark, path, dies)
    assert versions.latest(spark, path) == two and spark.read.parquet(two).count() == 2
    three = versions.publish(spark, path, lambda f: spark.range(3).write.parquet(f))
    assert [f"{path}/{v}" for v in versions.versions(spark, path)] == [two, three] and not os.path.exists(one)
    assert spark.read.parquet(two).count() == 2  # a reader that resolved it before goes on


def test_published_models(spark, tmp_dir):
    from reelspark.operators import model as M

    rows = [(u, m, float(1 + (u * m) % 5)) for u in range(8) for m in range(8) if (u + m) % 3]
    model = M.fit_als(spark.createDataFrame(rows, "userId int, movieId int, rating float"), rank=2, max_iter=1)
    with pytest.raises(FileNotFoundError):
        versions.load_latest_model(spark, f"{tmp_dir}/m")
    versions.publish_model(model, f"{tmp_dir}/m")
    versions.publish_model(model, f"{tmp_dir}/m", keep=1)
    assert versions.load_latest_model(spark, f"{tmp_dir}/m").rank == 2 and len(versions.versions(spark, f"{tmp_dir}/m")) == 1


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_changed_buckets_are_rewritten(spark, tmp_dir):
    rows = [(u, m, f"t{m}", "g", float(u * m % 7)) for u in range(20) for m in range(3)]
    frame = lambda x: spark.createDataFrame(x, "userId int, movieId int, title string, genres string, score float")
    path = f"{tmp_dir}/recs"
    assert refresh_recommendations(frame(rows), path, 5) == [0, 1, 2, 3, 4]
    before = _files(path)
    assert refresh_recommendations(frame(rows[::-1]), path, 5) == [] and _files(path) == before
    moved = [(u, m, t, g, s + 1) if u == 7 and m == 1 else (u, m, t, g, s) for u, m, t, g, s in rows]
    assert refresh_recommendations(frame(moved), path, 5) == [2]
    after = _files(path)
    assert {f for f in before if "user_bucket=2" not in f} == {f for f in after if "user_bucket=2" not in f}
    stored = spark.read.parquet(path).drop("user_bucket")
    assert sorted(map(tuple, stored.collect())) == sorted(moved)
    fewer = [r for r in moved if r[0] % 5 != 3] + [(100, 1, "t", "g", 1.0)]
    assert refresh_recommendations(frame(fewer), path, 5) == [0, 3]
    assert sorted(map(tuple, spark.read.parquet(path).drop("user_bucket").collect())) == sorted(fewer)


def test_pruned_top_n_equals_all_pairs_and_skips_most(spark):
    rng = np.random.default_rng(5)
    k, o = rng.random((300, 4)), rng.random((2000, 4)) * (1 / np.arange(1, 2001))[:, None] ** 0.5
    o[50:80] = o[50]  # ties, also across blocks
    k[7], o[9] = 0.0, 0.0
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<float>")
    users, items = frame(k).persist(), frame(o).persist()
    got, work = pruned.pruned_top_n(users, items, 8, bucket_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, recommend.top_n(users, items, 8).collect()))
    pairs = work.agg(F.sum("pairs"), F.sum("all_pairs")).first()
    assert pairs[1] == 300 * 2000 and pairs[0] < 0.35 * pairs[1]
    for n, some in ((0, items), (3, items.limit(0)), (5000, items.limit(10))):
        got, _ = pruned.pruned_top_n(users, some, n, bucket_rows=4)
        assert sorted(map(str, got.collect())) == sorted(map(str, recommend.top_n(users, some, n).collect()))
