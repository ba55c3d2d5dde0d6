"""Readers, writers, schemas and fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from reelspark.sources import fixtures as fx
from reelspark.sources import io
from reelspark.sources.schemas import MOVIES_SCHEMA, RATINGS_SCHEMA, with_int_ids


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_movies_csv_doubled_quotes(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "movies.csv"),
               'movieId,title,genres\n1,"""Great Performances"" Cats (1998)",Musical\n'
               '2,"American President, The (1995)",Comedy|Drama|Romance\nx,Broken,\n')
    rows = io.read_movies_csv(spark, p).orderBy(F.col("movieId").asc_nulls_last()).collect()
    assert rows[0].title == '"Great Performances" Cats (1998)'
    assert rows[1].title == "American President, The (1995)"
    assert rows[2].movieId is None and rows[2].title == "Broken"  # permissive: bad id -> null
    assert io.read_movies_csv(spark, p).schema == MOVIES_SCHEMA


def test_ratings_tags_links_csv(spark, tmp_dir):
    r = _write(os.path.join(tmp_dir, "ratings.csv"), "userId,movieId,rating,timestamp\n1,2,3.5,964982703\n")
    t = _write(os.path.join(tmp_dir, "tags.csv"), "userId,movieId,tag,timestamp\n1,2,funny,1\n")
    lk = _write(os.path.join(tmp_dir, "links.csv"), "movieId,imdbId,tmdbId\n1,0114709,862\n")
    assert io.read_ratings_csv(spark, r).schema == RATINGS_SCHEMA
    assert tuple(io.read_ratings_csv(spark, r).first()) == (1, 2, 3.5, 964982703)
    assert io.read_tags_csv(spark, t).first().tag == "funny"
    assert io.read_links_csv(spark, lk).first().imdbId == "0114709"  # kept as text


def test_parquet_round_trip(spark, smoke_dir, tmp_dir):
    m = fx.movies(spark, smoke_dir)
    out = os.path.join(tmp_dir, "movies_pq")
    io.write_parquet(m, out)
    io.write_parquet(m, out)  # overwrite
    back = io.read_parquet(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))
    part = os.path.join(tmp_dir, "by_bucket")
    io.write_parquet(m.withColumn("bucket", F.col("movieId") % 4), part, partition_by=["bucket"])
    assert io.read_parquet(spark, part).filter("bucket = 1").count() == m.filter(F.col("movieId") % 4 == 1).count()


def test_id_range_check(spark):
    ok = spark.createDataFrame([(1, 2)], "userId long, movieId long")
    assert with_int_ids(ok, "userId", "movieId").schema["userId"].dataType.simpleString() == "int"
    bad = spark.createDataFrame([(2**40, 2)], "userId long, movieId long")
    with pytest.raises(Exception, match="out of int range"):
        with_int_ids(bad, "userId", "movieId").collect()


def test_fixture_sizes(spark, smoke_dir):
    m = fx.movies(spark, smoke_dir)
    r = fx.ratings(spark, smoke_dir)
    assert m.count() == m.select("movieId").distinct().count()
    assert r.count() == r.select("userId", "movieId").distinct().count()
    assert r.filter(F.col("rating").isNull()).count() == 0
    assert fx.ratings_with_nulls(spark, smoke_dir).filter(F.col("rating").isNull()).count() > 0
    md = fx.metadata(spark, smoke_dir)
    assert set(r.result_rank for r in md.select("result_rank").distinct().collect()) == {1, 2}
