"""Containment of any text, one-movie forms, page enrichment, header checks and the pipeline's files."""

import glob
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelspark.functions.titles import WHITE_SPACE, lookup_key
from reelspark.operators import catalog, display, model, prepare
from reelspark.plans import queries as Q
from reelspark.plans.training import run_training
from reelspark.sources import fixtures as fx
from reelspark.sources import io

MOVIES = "movieId int, title string, genres string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df):
    return _plan(df).count("FileScan")


# --- genre containment ---------------------------------------------------------


def test_containment_counts_code_points(spark):
    movies = spark.createDataFrame([(1, "a", "😀A"), (2, "b", "?A"), (3, "c", "x"), (4, "d", "x😀AB|?"), (5, "e", None), (6, "f", "")], MOVIES)
    got = {r.genre: r.num_movies for r in catalog.genre_statistics(movies).collect()}
    texts = ["😀A", "?A", "x", "x😀AB|?", ""]
    assert got == {g: sum(g in t for t in texts) for g in ("😀A", "?A", "x", "x😀AB", "?")}


def test_containment_of_long_strings_is_linear(spark):
    rows = [(i, f"T{i}", "".join("abcdefghij"[(i * k * k + k) % 10] for k in range(200 + 13 * i))) for i in range(300)]
    movies = spark.createDataFrame(rows, MOVIES)
    start = time.time()
    plain = {r.genre: r.num_movies for r in catalog.genre_statistics(movies).collect()}
    kept = io.persist(movies)
    again = {r.genre: r.num_movies for r in catalog.genre_statistics(kept).collect()}
    kept.unpersist()
    assert time.time() - start < 60
    assert plain == again and len(plain) == 300
    for g in [r[2] for r in rows[::60]]:
        assert plain[g] == sum(g in r[2] for r in rows)


def test_grams_are_the_substrings(spark):
    for text, n in (("abcdef" * 40, 3), ("😀a😀b" * 30, 2), ("xyz", 3), ("ab" * 64 + "c", 16)):
        df = spark.createDataFrame([(text, n)], "t string, n int").select(catalog._grams(F.col("t"), F.col("n")).alias("g"))
        assert set(df.first().g) == {text[i : i + n] for i in range(len(text) - n + 1)}


# --- one movie, pages ------------------------------------------------------------


@pytest.mark.parametrize("match", catalog.MATCH_MODES)
def test_similar_to_one_is_the_batch_form(spark, match):
    movies = spark.createDataFrame(
        [(1, "a", "X|Y"), (2, "b", "XX"), (3, "c", "(no genres listed)"), (4, "d", None), (5, "e", "Y|X"), (6, "f", "(no genres listed)|X"), (7, "g", "")],
        MOVIES,
    )
    batch = {}
    for r in catalog.similar_by_genre(movies, movies.select("movieId"), 3, match).collect():
        batch.setdefault(r.target_id, set()).add(tuple(r))
    for i in range(1, 9):
        assert {tuple(r) for r in catalog.similar_to(movies, i, 3, match).collect()} == batch.get(i, set()), i


def test_similar_to_one_scans_twice_and_joins_nothing(spark, smoke_dir):
    from tools.plan_report import census

    df = Q.q_similar_one(spark, smoke_dir)
    df.collect()
    assert census(_plan(df))["scan"] <= 2  # of the plan that ran; the first plan prints the subquery twice
    assert "Join" not in _plan(df) and "TakeOrderedAndProject" in _plan(df)


def test_page_enrichment_is_the_full_one_on_its_rows(spark, smoke_dir):
    movies, metadata = fx.movies(spark, smoke_dir), fx.metadata(spark, smoke_dir)
    page = catalog.catalog_head(movies, 30)
    page = page.unionByName(page.limit(2)).unionByName(spark.createDataFrame([(9, None, None)], MOVIES))  # repeated rows, a null title
    a = sorted(map(str, display.enrich(page, metadata).collect()))
    assert a == sorted(map(str, display.enrich_page(page, metadata).collect())) and len(a) == 33


def test_a_page_aggregates_only_its_own_metadata(spark):
    movies = spark.createDataFrame([(i, f"T{i} (1990)", "G") for i in range(50)], MOVIES)
    metadata = spark.range(20_000).selectExpr(
        "concat('T', id % 2000) AS query_title", "cast(id % 10 AS int) AS result_rank", "id AS tmdb_id", "'o' AS overview", "'d' AS release_date",
        "1.0D AS vote_average", "id AS vote_count", "2.0D AS popularity", "'/p' AS poster_path",
    )
    df = display.enrich_page(catalog.catalog_head(movies, 5), metadata)
    assert df.count() == 5
    rows = df.collect()
    assert all(r.tmdb_id == r.movieId for r in rows)
    df = display.enrich_page(catalog.catalog_head(movies, 5), metadata)
    df.collect()
    plan = _plan(df)
    # the metadata meet the page in a join below the only aggregate
    assert plan.index("Aggregate") < plan.index("Join")


def test_result_count_reads_once(spark, smoke_dir):
    assert _scans(Q.q_search_title_count(spark, smoke_dir)) == 1


def test_movie_by_id_filters_in_the_scan(spark, smoke_dir):
    assert f"EqualTo(p_partkey,{Q.MOVIE_ID})" in _plan(Q.q_movie_by_id(spark, smoke_dir))


def test_all_white_space_is_trimmed(spark):
    titles = [f"{w}Toy{w}Story{w} (1995)" for w in WHITE_SPACE]
    got = [r.k for r in spark.createDataFrame([(t,) for t in titles], "t string").select(lookup_key(F.col("t")).alias("k")).collect()]
    assert got == [t.split("(")[0].strip() for t in titles]


def test_mean_predictor_in_one_pass_is_the_join_form(spark, smoke_dir):
    dense = prepare.drop_incomplete(fx.ratings_with_nulls(spark, smoke_dir)).unionByName(fx.ratings(spark, smoke_dir).limit(200))  # repeated ratings
    labelled = prepare.label_split(dense).persist()
    train, test = (labelled.filter(F.col("split") == s) for s in ("train", "test"))
    means = prepare.movie_stats(train.select("movieId", "rating")).select("movieId", F.col("avg_rating").cast("float").alias("prediction"))
    want = model.error_metrics(test.join(means.filter("prediction is not null"), "movieId")).first()
    got = model.mean_predictor_metrics(labelled.filter(F.col("rating").isNotNull())).first()
    assert got.n == want.n and abs(got.rmse - want.rmse) < 1e-9 and abs(got.mae - want.mae) < 1e-9


# --- readers -----------------------------------------------------------------------


def _csv(tmp_dir, name, text):
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_tags_and_links_follow_the_header(spark, tmp_dir):
    tags = _csv(tmp_dir, "tags.csv", "tag,timestamp,movieId,userId\nfun,9,2,1\n")
    assert io.read_tags_csv(spark, tags).first().asDict() == {"userId": "1", "movieId": "2", "tag": "fun", "timestamp": "9"}
    links = _csv(tmp_dir, "links.csv", "tmdbId,movieId,imdbId\n862,1,0114709\n")
    assert io.read_links_csv(spark, links).first().asDict() == {"movieId": "1", "imdbId": "0114709", "tmdbId": "862"}


def test_a_wrong_header_fails_instead_of_mislabelling(spark, tmp_dir):
    path = _csv(tmp_dir, "ratings.csv", "movieId,userId,rating,timestamp\n1,2,3.5,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_ratings_csv(spark, path).collect()


# --- the pipeline's files -----------------------------------------------------------


def test_training_reads_the_text_once_and_lays_out_its_files(spark, smoke_dir, tmp_dir):
    raw = os.path.join(tmp_dir, "ratings.csv")
    fx.ratings(spark, smoke_dir).repartition(2).write.option("header", True).csv(raw)
    ratings = io.read_ratings_csv(spark, raw)
    out = os.path.join(tmp_dir, "out")
    run_training(spark, ratings, fx.movies(spark, smoke_dir), out, top_n=3, min_user_ratings=2, min_movie_ratings=2, max_iter=2, recs_user_buckets=4)
    data = os.path.join(out, "preprocessed_data")
    dense = prepare.density_filter(io.read_parquet(spark, os.path.join(data, "clean_ratings")), 2, 2)
    assert "FileScan csv" not in _plan(dense)  # what follows the cleaned table reads no text
    assert io.read_parquet(spark, os.path.join(data, "clean_ratings")).count() == ratings.count()
    for b in range(4):
        assert len(glob.glob(os.path.join(out, "user_recommendations", f"user_bucket={b}", "*.parquet"))) <= 1
    movies = io.read_parquet(spark, os.path.join(data, "movies_data"))
    assert "EqualTo(movieId,42)" in _plan(catalog.movie_by_id(movies, 42))
    for f in glob.glob(os.path.join(data, "movies_data", "*.parquet")):
        ids = pq.read_table(f).column("movieId").to_pylist()
        assert ids == sorted(ids)


def test_ids_beyond_32_bits_fail_the_job(spark, tmp_dir):
    ratings = spark.createDataFrame([(2**40, 1, 3.0, 5)], "userId long, movieId int, rating float, timestamp long")
    with pytest.raises(Exception, match="out of int range"):
        run_training(spark, ratings, spark.createDataFrame([(1, "t", "g")], MOVIES), os.path.join(tmp_dir, "o"))
