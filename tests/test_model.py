"""ALS fit / predict / recommend properties on a planted low-rank table."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import model as M
from reelspark.operators import prepare, recommend

N_USERS, N_ITEMS = 120, 80


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings = clipped dot product of two rank-2 non-negative factor sets,
    observed on about half of the (user, item) pairs."""
    pairs = spark.range(N_USERS * N_ITEMS).select(
        (F.col("id") / N_ITEMS).cast("int").alias("userId"), (F.col("id") % N_ITEMS).cast("int").alias("movieId")
    )
    fu = lambda k: (F.abs(F.hash(F.col("userId"), F.lit(k))) % 100) / 100.0
    fi = lambda k: (F.abs(F.hash(F.col("movieId"), F.lit(k + 10))) % 100) / 100.0
    score = 1 + 2 * (fu(1) * fi(1) + fu(2) * fi(2))
    keep = F.abs(F.hash(F.col("userId"), F.col("movieId"))) % 2 == 0
    return pairs.filter(keep).select(
        "userId", "movieId", score.cast("float").alias("rating"), F.lit(0).cast("long").alias("timestamp")
    ).cache()


@pytest.fixture(scope="module")
def fitted(planted):
    train, test = prepare.hash_split(planted, (0.8, 0.2), seed=42)
    m = M.fit_als(train, rank=4, max_iter=10, reg_param=0.01, seed=3)
    return m, train, test


def test_factors_non_negative(fitted):
    m, _, _ = fitted
    for f in (m.userFactors, m.itemFactors):
        assert all(min(r.features) >= 0 for r in f.collect())


def test_quality_beats_global_mean(fitted):
    m, train, test = fitted
    metrics = M.error_metrics(M.predict(m, test)).first()
    mean = train.agg(F.avg("rating")).first()[0]
    base = M.error_metrics(test.withColumn("prediction", F.lit(mean))).first()
    assert math.isfinite(metrics.rmse) and metrics.rmse < 0.5 * base.rmse
    assert metrics.mae <= metrics.rmse


def test_cold_start_and_nan_filter(spark, fitted):
    m, _, _ = fitted
    unknown = spark.createDataFrame([(10_000, 1, 3.0)], "userId int, movieId int, rating float")
    assert M.predict(m, unknown).count() == 0
    p = spark.createDataFrame([(1.0, 1.0), (2.0, float("nan")), (3.0, None)], "rating double, prediction float")
    r = M.error_metrics(p).first()
    assert r.n == 1 and r.rmse == 0.0


def test_recommendations_are_exact_top_n(fitted):
    m, train, _ = fitted
    n = 5
    recs = recommend.unnest(recommend.recommend_for_all_users(m, n)).collect()
    uf = {r.id: np.array(r.features) for r in m.userFactors.collect()}
    items = {r.id: np.array(r.features) for r in m.itemFactors.collect()}
    train_items = {r.movieId for r in train.select("movieId").distinct().collect()}
    by_user = {}
    for r in recs:
        by_user.setdefault(r.userId, []).append((r.movieId, r.predicted_rating))
    assert set(by_user) == set(uf)
    ids = np.array(sorted(items))
    mat = np.stack([items[i] for i in ids])
    for uid, lst in by_user.items():
        assert len(lst) == n
        scores = [s for _, s in lst]
        assert scores == sorted(scores, reverse=True)
        assert {mid for mid, _ in lst} <= train_items
        brute = mat @ uf[uid]
        assert np.allclose(sorted(brute, reverse=True)[:n], scores, rtol=1e-4, atol=1e-4)
    items_side = recommend.unnest(recommend.recommend_for_all_items(m, 3), key="movieId", item="userId")
    assert items_side.groupBy("movieId").count().agg(F.max("count")).first()[0] == 3


def test_user_subset_and_catalog_join(spark, fitted):
    m, _, _ = fitted
    movies = spark.createDataFrame([(i, f"T{i}", "G") for i in range(N_ITEMS) if i != 0],
                                   "movieId int, title string, genres string")
    users = spark.createDataFrame([(1,), (1,), (99_999,)], "userId int")
    out = recommend.user_recommendations(m, movies, users, 4)
    rows = sorted(out.collect(), key=lambda r: (r.userId, r["rank"]))
    assert out.columns == ["userId", "rank", "movieId", "title", "genres", "predicted_rating"]
    assert {r.userId for r in rows} == {1}
    assert len(rows) <= 4 and 0 not in {r.movieId for r in rows}
    assert [r.predicted_rating for r in rows] == sorted((r.predicted_rating for r in rows), reverse=True)
    one = recommend.recommendations_for_user(m, movies, 1, 4)
    assert one.columns == ["movieId", "title", "genres", "predicted_rating"]
    assert [r.movieId for r in one.collect()] == [r.movieId for r in rows]
    assert recommend.recommendations_for_user(m, movies, 99_999, 4).count() == 0
    assert recommend.user_recommendations(m, movies, users.limit(0), 4).count() == 0
    batch = recommend.batch_recommendations(m, movies, 3)
    assert batch.columns == ["userId", "movieId", "title", "genres", "score"]
    with pytest.raises(ValueError):
        recommend.recommend_for_all_users(m, -1)


def test_save_load_round_trip(fitted, tmp_dir):
    m, _, test = fitted
    path = os.path.join(tmp_dir, "model")
    M.save_model(m, path)
    m2 = M.load_model(path)
    a = sorted(map(tuple, M.predict(m, test).select("userId", "movieId", "prediction").collect()))
    b = sorted(map(tuple, M.predict(m2, test).select("userId", "movieId", "prediction").collect()))
    assert a == b


def test_training_pipeline_end_to_end(spark, smoke_dir, tmp_dir):
    from reelspark.plans.training import run_training
    from reelspark.sources import fixtures as fx

    res = run_training(spark, fx.ratings(spark, smoke_dir), fx.movies(spark, smoke_dir), tmp_dir,
                       top_n=5, min_user_ratings=2, min_movie_ratings=2, max_iter=3)
    m = res.metrics.first()
    assert m.n > 0 and math.isfinite(m.rmse)
    recs = res.recommendations
    assert recs.columns == ["userId", "movieId", "title", "genres", "score"]
    assert recs.groupBy("userId").count().agg(F.max("count")).first()[0] <= 5
    for sub in ("model", "preprocessed_data/ratings_data/split=train", "preprocessed_data/ratings_data/split=test",
                "preprocessed_data/movies_data", "user_recommendations"):
        assert os.path.isdir(os.path.join(tmp_dir, sub))
    assert res.train.count() + res.test.count() > 0


def _nested(rows, key, other):
    return {r[key]: [(x[other], x.rating) for x in r.recommendations] for r in rows}


def test_block_counts_never_change_top_n(spark, smoke_dir):
    """Planted ties: the factors take few values, so most scores repeat."""
    from reelspark.sources import fixtures as fx

    users, items = fx.user_factors(spark, smoke_dir).persist(), fx.item_factors(spark, smoke_dir).persist()
    want = None
    for blocks in (1, 3, 50):
        got = _nested(recommend.top_n(users, items, 7, key_blocks=blocks, other_blocks=blocks).collect(), "userId", "movieId")
        want = got if want is None else want
        assert got == want
    assert all(len(v) == 7 and v == sorted(v, key=lambda x: (-x[1], x[0])) for v in want.values())
    assert any(len({s for _, s in v}) < 7 for v in want.values())


def test_model_scores_do_not_depend_on_blocks(fitted):
    m, _, _ = fitted
    a = _nested(recommend.top_n(m.userFactors, m.itemFactors, 5, key_blocks=1, other_blocks=1).collect(), "userId", "movieId")
    b = _nested(recommend.top_n(m.userFactors, m.itemFactors, 5, key_blocks=7, other_blocks=11).collect(), "userId", "movieId")
    assert a == b and len(a) == m.userFactors.count()


def test_zero_and_more_than_all(spark, fitted):
    m, _, _ = fitted
    none = recommend.recommend_for_all_users(m, 0)
    assert none.count() == m.userFactors.count() and none.filter("size(recommendations) > 0").count() == 0
    nothing = recommend.top_n(m.userFactors, m.itemFactors.limit(0), 3)
    assert nothing.schema == none.schema and nothing.filter("size(recommendations) > 0").count() == 0
    big = recommend.recommend_for_all_users(m, 10_000).first().recommendations
    assert len(big) == m.itemFactors.count()
    assert [x.rating for x in big] == sorted((x.rating for x in big), reverse=True)


def test_top_n_plan_has_no_pair_product_and_cuts_before_the_shuffle(spark, smoke_dir):
    from reelspark.sources import fixtures as fx

    df = recommend.top_n(fx.user_factors(spark, smoke_dir), fx.item_factors(spark, smoke_dir), 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_default_fit_does_not_depend_on_the_cluster(smoke_dir):
    """The same data in sessions of two and of four cores, no block argument."""
    import json
    import subprocess
    import sys

    code = """
import json, sys
from reelspark.session import local_session
from reelspark.operators import model as M, prepare
from reelspark.sources import fixtures as fx
spark = local_session(cores=int(sys.argv[1]), driver_memory="2g")
data = prepare.drop_incomplete(fx.ratings(spark, sys.argv[2]))
m = M.fit_als(data, max_iter=3)
rows = M.predict(m, data).select("userId", "movieId", "prediction").orderBy("userId", "movieId", "prediction").limit(500).collect()
print("ROWS" + json.dumps([list(r) for r in rows]))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = []
    for cores in ("2", "4"):
        proc = subprocess.run([sys.executable, "-c", code, cores, smoke_dir], capture_output=True, text=True, timeout=600,
                              cwd=root, env=dict(os.environ, PYTHONPATH=root))
        assert proc.returncode == 0, proc.stderr[-2000:]
        got.append(json.loads(proc.stdout.split("ROWS")[1]))
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]] and len(got[0]) > 100
    assert np.allclose([r[2] for r in got[0]], [r[2] for r in got[1]], atol=1e-4)


def test_fit_is_reproducible(planted):
    train, test = prepare.hash_split(planted, (0.8, 0.2), seed=42)
    a = M.fit_als(train, rank=4, max_iter=5, reg_param=0.05, seed=11, num_blocks=3)
    b = M.fit_als(train.repartition(5), rank=4, max_iter=5, reg_param=0.05, seed=11, num_blocks=3)
    pa_ = sorted(map(tuple, M.predict(a, test).select("userId", "movieId", "prediction").collect()))
    pb_ = sorted(map(tuple, M.predict(b, test).select("userId", "movieId", "prediction").collect()))
    assert [r[:2] for r in pa_] == [r[:2] for r in pb_]
    assert np.allclose([r[2] for r in pa_], [r[2] for r in pb_], atol=1e-4)


def test_training_command_line(spark, smoke_dir, tmp_dir):
    import json
    import subprocess
    import sys

    from reelspark.sources import fixtures as fx

    r_csv, m_csv = os.path.join(tmp_dir, "ratings_csv"), os.path.join(tmp_dir, "movies_csv")
    fx.ratings(spark, smoke_dir).write.option("header", True).csv(r_csv)
    fx.movies(spark, smoke_dir).write.option("header", True).option("escape", '"').csv(m_csv)
    out = os.path.join(tmp_dir, "job")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=root)
    proc = subprocess.run(
        [sys.executable, "-m", "reelspark.plans.training", "--ratings", r_csv, "--movies", m_csv, "--out", out,
         "--min-user-ratings", "2", "--min-movie-ratings", "2", "--max-iter", "2", "--top-n", "3"],
        capture_output=True, text=True, env=env, timeout=600, cwd=root,
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    res = json.loads(proc.stdout.strip().splitlines()[-1])
    assert res["n_test"] > 0 and math.isfinite(res["rmse"])
    recs = spark.read.parquet(os.path.join(out, "user_recommendations"))
    assert recs.columns == ["userId", "movieId", "title", "genres", "score"] and recs.count() > 0


def test_bucketed_recommendations_layout(spark, smoke_dir, tmp_dir):
    from reelspark.plans.training import read_user_recommendations, run_training
    from reelspark.sources import fixtures as fx

    res = run_training(spark, fx.ratings(spark, smoke_dir), fx.movies(spark, smoke_dir), tmp_dir,
                       top_n=4, min_user_ratings=2, min_movie_ratings=2, max_iter=2, recs_user_buckets=8)
    path = os.path.join(tmp_dir, "user_recommendations")
    assert os.path.isdir(os.path.join(path, "user_bucket=0"))
    uid = res.recommendations.select("userId").first().userId
    flat = os.path.join(tmp_dir, "flat_recs")
    res.recommendations.write.parquet(flat)
    assert [r.movieId for r in read_user_recommendations(spark, flat, uid).collect()] == [
        r.movieId for r in read_user_recommendations(spark, path, uid, 8).collect()]
    assert read_user_recommendations(spark, path, uid).columns == ["userId", "movieId", "title", "genres", "score"]
    one = read_user_recommendations(spark, path, uid, 8)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_bucket" in plan and f"(user_bucket#" in plan
    rows = one.collect()
    assert 0 < len(rows) <= 4 and {r.userId for r in rows} == {uid}
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_best_of_block_breaks_ties_by_smaller_id():
    """Items tied at the cut-off: the smaller ids are kept; seen ones never come up."""
    ids = np.array([9, 3, 7, 1, 5, 0, 8, 2, 6, 4, 10], dtype=np.int32)
    others = np.array([[1.0]] * 10 + [[2.0]])
    for n in (1, 3, 5, 11, 20):
        row, col, score = recommend.best_of_block(np.ones((1, 1)), others, ids, n)
        assert [int(i) for i in ids[col]] == ([10] + list(range(10)))[: min(n, 11)] and not row.any()
        row, col, score = recommend.best_of_block(np.ones((1, 1)), others, ids, n, (np.array([0, 0]), np.array([10, 5])))
        assert [int(i) for i in ids[col]] == list(range(1, 10))[:n] and set(score) == {1.0}


def _scoring_tasks(spark, users, items, monkeypatch):
    """Rows of found pairs by the task that scored them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(recommend, "nested", lambda found, *_: found)
    found = recommend.top_n(users, items, 3)
    return [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]


@pytest.mark.parametrize(("n_users", "n_items"), [(4000, 200), (300, 20_000)])
def test_scoring_is_spread_over_the_tasks(spark, monkeypatch, n_users, n_items):
    """Small and large other sides: at least as many tasks as shuffle partitions, none with most of the work."""
    from pyspark.sql import functions as F

    def factors(n, a):
        x = (F.col("id") * a % 1000 / 1000).cast("float")
        return spark.range(n).select(F.col("id").cast("int"), F.array(x, 1 - x).alias("features"))

    rows = _scoring_tasks(spark, factors(n_users, 7), factors(n_items, 13), monkeypatch)
    assert len(rows) >= min(8, -(-n_users // recommend.LEAST_KEY_ROWS) * -(-n_items // recommend.OTHER_BLOCK_ROWS)) - 3
    assert max(rows) <= sum(rows) / 2


def test_seen_items_are_left_out_and_n_others_remain(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    k, o = rng.integers(-4, 5, (40, 3)) / 4, rng.integers(-4, 5, (60, 3)) / 4
    frame = lambda x: spark.createDataFrame([(i - 5, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<float>")
    seen = {(u - 5, m - 5) for u in range(40) for m in range(60) if rng.random() < 0.3}
    seen |= {(0, m - 5) for m in range(60)} | {(1, m - 5) for m in range(58)} | {(999, 1), (1, 999)}
    seen -= {(1, 53), (1, 54)}  # one has seen all, one all but two
    rows = [*seen, *list(seen)[:50], (None, 3), (3, None)]
    seen_df = spark.createDataFrame(rows, "userId int, movieId int").select("movieId", "userId", F.lit(1).alias("pair"))
    want = {}
    for u in range(40):
        left = [(-float((k[u] * o[m]).sum()), m - 5) for m in range(60) if (u - 5, m - 5) not in seen]
        want[u - 5] = [(m, -s) for s, m in sorted(left)[:7]]
    for blocks in (1, 4):
        got = _nested(recommend.top_n(frame(k), frame(o), 7, key_blocks=blocks, other_blocks=blocks, seen=seen_df).collect(), "userId", "movieId")
        assert got == want and got[0] == [] and len(got[1]) == 2
    assert recommend.top_n(frame(k), frame(o), 0, seen=seen_df).filter("size(recommendations) > 0").count() == 0
