"""Display rules on literal titles (FIXTURES section 3) and genre helpers."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import (
    clean_title,
    first_valid_genre,
    genre_tags,
    lookup_key,
    placeholder_poster,
    poster_url,
    title_year,
    year_or_null,
    year_sort_key,
)

LONG = "A" * 45 + " (2001)"

CASES = [
    # title, year, clean title, year sort key
    ("Toy Story (1995)", "1995", "Toy Story", "1995"),
    ("American President, The (1995)", "1995", "American President, The", "1995"),
    ('"Great Performances" Cats (1998)', "1998", '"Great Performances" Cats', "1998"),
    ("(500) Days of Summer (2009)", "2009", "Untitled Movie", "2009"),
    ("Seven (a.k.a. Se7en) (1995)", "1995", "Seven", "1995"),
    ("Babylon 5", "N/A", "Babylon 5", "Babylon 5"),
    ("Something (TV Series)", "N/A", "Something (TV Series)", "Something (TV Series)"),
    ("1984 (1956) extra", "1956", "1984", "1956"),
    ("Short (12)", "12", "Short", "Short (12)"),
    (LONG, "2001", "A" * 37 + "...", "2001"),
    ("", "N/A", "Untitled Movie", ""),
]


def _python_rule(title):
    """The display rule written out in plain Python, for comparison."""
    if "(" in title and ")" in title:
        y = title.split("(")[-1].split(")")[0]
        if y.isdigit():
            year, ct = y, title.split("(")[0].strip()
        else:
            year, ct = "N/A", title
    else:
        year, ct = "N/A", title
    if len(ct) > 40:
        ct = ct[:37] + "..."
    if not ct:
        ct = "Untitled Movie"
    return year, ct


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "movieId int, title string")


def test_year_clean_title_sort_key(titles):
    t = F.col("title")
    rows = titles.select("movieId", title_year(t), clean_title(t), year_sort_key(t)).orderBy("movieId").collect()
    for row, (title, year, ct, key) in zip(rows, CASES):
        assert (row[1], row[2], row[3]) == (year, ct, key), title
        assert (row[1], row[2]) == _python_rule(title)


def test_null_title(spark):
    df = spark.createDataFrame([(1, None)], "movieId int, title string")
    r = df.select(title_year(F.col("title")), clean_title(F.col("title")), year_or_null(title_year(F.col("title")))).first()
    assert tuple(r) == ("N/A", "Untitled Movie", None)


def test_lookup_key_always_cuts(spark):
    df = spark.createDataFrame([("Seven (a.k.a. Se7en) (1995)",), ("Babylon 5",), ("(500) Days",)], "title string")
    assert [r[0] for r in df.select(lookup_key(F.col("title"))).collect()] == ["Seven", "Babylon 5", ""]


def test_placeholder_poster(spark):
    df = spark.createDataFrame([(0, "Toy Story (1995)"), (9, "A (B) C"), (-1, "x")], "movieId int, title string")
    got = [r[0] for r in df.select(placeholder_poster(F.col("title"), F.col("movieId"))).collect()]
    assert got[0] == "https://via.placeholder.com/300x450/FF6B6B/FFFFFF?text=Toy+Story+1995"
    assert got[1] == "https://via.placeholder.com/300x450/4ECDC4/FFFFFF?text=A+B+C"
    assert got[2].startswith("https://via.placeholder.com/300x450/85C1E9/")  # pmod, as Python's %


def test_poster_url_prefers_non_empty_path(spark):
    df = spark.createDataFrame([(1, "T", "/p.jpg"), (1, "T", ""), (1, "T", None)], "movieId int, title string, p string")
    got = [r[0] for r in df.select(poster_url(F.col("p"), F.col("title"), F.col("movieId"))).collect()]
    assert got[0] == "https://image.tmdb.org/t/p/w500/p.jpg"
    assert got[1].startswith("https://via.placeholder.com/") and got[2] == got[1]


def test_genre_helpers(spark):
    rows = [("",), (None,), ("A|",), ("A|A",), ("(no genres listed)",), ("(no genres listed)|B",)]
    df = spark.createDataFrame(rows, "genres string")
    got = df.select(first_valid_genre(F.col("genres")), genre_tags(F.col("genres"))).collect()
    assert [tuple(r) for r in got] == [
        ("", ""),
        (None, None),
        ("A", "A|"),
        ("A", "A|A"),
        (None, ""),
        ("B", "B"),
    ]


def test_best_metadata_prefers_known_low_rank(spark):
    from reelspark.operators.display import best_metadata
    from reelspark.sources.schemas import METADATA_SCHEMA

    rows = [
        ("Toy Story", None, 99, "null rank", None, None, None, None, "/n.jpg"),
        ("Toy Story", 2, 7, "second", None, None, None, None, "/b.jpg"),
        ("Toy Story", 1, 8, "first, larger id", None, None, None, None, "/c.jpg"),
        ("Toy Story", 1, 5, "first", None, None, None, None, "/a.jpg"),
        ("Other", None, None, "only unknown", None, None, None, None, None),
    ]
    md = spark.createDataFrame(rows, METADATA_SCHEMA)
    got = {r.query_title: r.overview for r in best_metadata(md).collect()}
    assert got == {"Toy Story": "first", "Other": "only unknown"}
