"""Title search through the trigram index against the scan of all titles."""

import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalog, title_index, versions
from reelspark.sources import fixtures as fx

MOVIES = "movieId int, title string, genres string"
LONG = "".join(chr(97 + i * i % 26) for i in range(4000)) + "tail end"
ROWS = [
    (1, "Alpha (1999)", "Drama"), (2, "alphabet soup", "War"), (3, None, "War"), (4, "", None), (5, "a", "x"), (6, "ab", None),
    (7, "aaaaaaa", "x"), (8, "aaaa", "x"), (9, LONG, "x"), (10, "naïve \U0001f3ac\U0001f3ac film", "x"), (11, "'; DROP % _ \\ \" title", "x"),
    (12, "abc", "x"), (12, "bcd", "x"), (12, "abc", "x"), (12, "abc", None), (None, "abcd with no id", "x"), (None, "other", "x"), (13, "abcabcabd", "x"),
]
STRINGS = ["a", "ab", "abc", "abcd", "aaaaa", "aaaaaa", "abcabd", "Alpha", "alpha (", "\U0001f3ac", "\U0001f3ac\U0001f3ac f", "tail end", LONG[60:700], "% _", "\\ \" t", "absent", ""]


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path, movies = str(tmp_path_factory.mktemp("index")), spark.createDataFrame(ROWS, MOVIES)
    title_index.build(movies, path)
    return path, movies


@pytest.mark.parametrize("query", STRINGS)
def test_the_index_finds_what_a_scan_finds(spark, index, query):
    path, movies = index
    for limit in (2, title_index.NAMED_IDS + 1):
        assert _rows(title_index.search(spark, path, query, limit)) == _rows(catalog.search_titles(movies, query, limit))


def test_every_character_starts_a_gram(spark):
    got = title_index.postings(spark.createDataFrame([(1, LONG, "x"), (1, LONG, "y"), (2, "ab", None)], MOVIES))
    rows = {(r.movieId, r.pos): r.gram for r in got.collect()}
    assert got.count() == len(rows) == len(LONG) + 2
    assert all(g == (LONG if m == 1 else "ab")[p : p + 3] for (m, p), g in rows.items())


def test_pieces_cover_the_query():
    for n in range(3, 20):
        q = LONG[:n]
        covered = {i + j for g, i in title_index.pieces(q) for j in range(3)}
        assert covered == set(range(n)) and all(q[i : i + 3] == g for g, i in title_index.pieces(q))


def test_scans_are_pushed_down(spark, index):
    path, _ = index
    folder = versions.latest(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    long, short, page = (plan(x) for x in (title_index.hits(spark, folder, "abcabd"), title_index.hits(spark, folder, "ab"), title_index.search(spark, path, "abc", 2)))
    assert "gram" in long and "/titles" not in long and ("EqualTo(gram" in long or "In(gram" in long)
    assert "StringStartsWith(gram,ab)" in short and "/titles" not in short
    assert "/postings" not in page and ("In(movieId" in page or "EqualTo(movieId" in page or "IsNull(movieId" in page)


def test_missing_empty_and_replaced_indexes(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        title_index.search(spark, tmp_dir, "abc")
    movies = spark.createDataFrame(ROWS, MOVIES)
    title_index.build(movies.limit(0), tmp_dir)
    for q in ("a", "abc", ""):
        assert _rows(title_index.search(spark, tmp_dir, q)) == []
    title_index.build(movies.withColumn("gram", F.lit(1)).withColumn("doc", F.lit("d")), tmp_dir)
    got = title_index.search(spark, tmp_dir, "abc", 5)
    assert got.columns == ["movieId", "title", "genres", "gram", "doc"] and len(_rows(got)) == 5
    with pytest.raises(ValueError):
        title_index.search(spark, tmp_dir, "abc", -1)


def test_on_the_fixture_with_a_hot_gram(spark, smoke_dir, tmp_dir):
    movies = fx.movies(spark, smoke_dir).withColumn("title", F.concat(F.col("title"), F.when(F.col("movieId") % 3 == 0, F.lit(" hothothot")).otherwise(F.lit(""))))
    title_index.build(movies, tmp_dir)
    for q in ("hot", "hothoth", " (a.k.a. Brand#1", "195", "e"):
        assert _rows(title_index.search(spark, tmp_dir, q, 30)) == _rows(catalog.search_titles(movies, q, 30))
