"""Catalog operators on literal catalogs, checked against plain Python."""

import pytest

from reelspark.operators import catalog

SENT = "(no genres listed)"
ROWS = [
    (1, "Alpha (2001)", "Brand#1|X"),
    (2, "Beta (1999)", "Brand#13|Y"),
    (3, "Gamma", "Y|Brand#1"),
    (4, "Delta (TV Series)", SENT),
    (5, "Epsilon (2010)", None),
    (6, "Zeta (2005)", "X"),
    (7, "Eta (1980)", "X|Y"),
    (8, "Theta (1970)", f"{SENT}|Brand#13"),
    (9, "Iota", "Y"),
    (10, "Kappa (1995)", "Brand#13|Brand#1"),
]


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame(ROWS, "movieId int, title string, genres string")


def _listed():
    out = set()
    for _, _, g in ROWS:
        if g is not None:
            out.update(x for x in g.split("|") if x not in (SENT, ""))
    return sorted(out)


def _first_valid(g):
    for x in g.split("|"):
        if x != SENT:
            return x
    return None


def test_genre_statistics_substring_and_exact(movies):
    sub = {r.genre: r.num_movies for r in catalog.genre_statistics(movies).collect()}
    exact = {r.genre: r.num_movies for r in catalog.genre_statistics(movies, match="exact").collect()}
    for g in _listed():
        assert sub[g] == sum(1 for _, _, s in ROWS if s is not None and g in s)
        assert exact[g] == sum(1 for _, _, s in ROWS if s is not None and g in s.split("|"))
    assert sub["Brand#1"] == 5 and exact["Brand#1"] == 3
    assert set(sub) == set(_listed())


def test_genre_statistics_order(movies):
    rows = catalog.genre_statistics(movies).collect()
    keys = [(-r.num_movies, r.genre) for r in rows]
    assert keys == sorted(keys)


def test_genre_count(movies):
    assert catalog.genre_count(movies, "Brand#1").first().num_movies == 5
    assert catalog.genre_count(movies, "Brand#1", match="exact").first().num_movies == 3
    # a substring of a genre that is not itself a genre counts 0
    assert catalog.genre_count(movies, "Brand#").first().num_movies == 0
    assert catalog.genre_count(movies, SENT).first().num_movies == 0


def test_genre_share(movies):
    rows = catalog.genre_share(catalog.genre_statistics(movies)).collect()
    top = max(r.num_movies for r in rows)
    for r in rows:
        assert r.share_pct == pytest.approx(r.num_movies / top * 100)


@pytest.mark.parametrize("match", ["substring", "exact"])
@pytest.mark.parametrize("limit", [0, 1, 3, 20])
def test_similar_by_genre_matches_brute_force(spark, movies, match, limit):
    targets = spark.createDataFrame([(i,) for i in range(0, 12)], "movieId int")
    got = {}
    for r in catalog.similar_by_genre(movies, targets, limit, match).collect():
        got.setdefault(r.target_id, []).append((r.similar_rank, r.movieId))
    expect = {}
    for tid, _, tg in ROWS:
        if tg is None:
            continue
        fg = _first_valid(tg)
        cands = []
        for mid, _, g in sorted(ROWS):
            if mid == tid:
                continue
            if fg is None:
                ok = True
            elif g is None:
                ok = False
            elif match == "exact":
                ok = fg in g.split("|")
            else:
                ok = fg in g
            if ok:
                cands.append(mid)
        if cands[:limit]:
            expect[tid] = [(i + 1, m) for i, m in enumerate(cands[:limit])]
    assert {k: sorted(v) for k, v in got.items()} == expect


def test_movies_by_genre_sorts(movies):
    by_title = [r.movieId for r in catalog.movies_by_genre(movies, "Y", 10, "title").collect()]
    assert by_title == [2, 7, 3, 9]
    by_year = [r.movieId for r in catalog.movies_by_genre(movies, "Y", 10, "year").collect()]
    # undated titles first (letters sort above digits in descending order)
    assert by_year == [9, 3, 2, 7]
    assert [r.movieId for r in catalog.movies_by_genre(movies, "Y", 2, "title").collect()] == [2, 7]


def test_errors_raise(movies):
    with pytest.raises(ValueError):
        catalog.movies_by_genre(movies, "Y", 10, "rating")
    with pytest.raises(ValueError):
        catalog.search_titles(movies, "a", -1)
    with pytest.raises(ValueError):
        catalog.genre_statistics(movies, match="fuzzy")


def test_search_and_lookup(movies):
    assert catalog.search_titles(movies, "").count() == 0
    assert [r.movieId for r in catalog.search_titles(movies, "ta", 3).collect()] == [2, 4, 6]
    assert catalog.search_titles(movies, "TA").count() == 0  # case-sensitive
    assert catalog.movie_by_id(movies, 3).first().title == "Gamma"
    assert catalog.movie_by_id(movies, 99).count() == 0
    assert [r.movieId for r in catalog.catalog_head(movies, 3).collect()] == [1, 2, 3]


def test_result_count(movies):
    rows = catalog.with_result_count(catalog.search_titles(movies, "a", 4)).collect()
    assert len(rows) == 4 and {r["count"] for r in rows} == {4}


def test_genre_lists(movies):
    assert catalog.genres_sorted(movies).collect()[0].genre == "Brand#1"
    assert [r.genre for r in catalog.top_genres(movies, 2).collect()] == ["Brand#1", "Brand#13"]
    assert SENT in {r.genre for r in catalog.distinct_genres(movies).collect()}


def test_fallback_genres_is_explicit(spark):
    got = [r.genre for r in catalog.fallback_genres(spark).collect()]
    assert len(got) == 18 and got == sorted(got)


def test_long_genre_strings_are_matched_whole(spark):
    """A 20,000-character genre piece: substring matching sees all of it."""
    long_piece = "x" * 10_000 + "Noir" + "y" * 10_000
    rows = [(1, "A", long_piece), (2, "B", "Noir"), (3, "C", "Film-Noir|Drama"), (4, "D", "Drama")]
    df = spark.createDataFrame(rows, "movieId int, title string, genres string")
    stats = {r.genre: r.num_movies for r in catalog.genre_statistics(df).collect()}
    assert stats["Noir"] == 3 and stats["Drama"] == 2 and stats["Film-Noir"] == 1
    assert stats[long_piece] == 1
    sim = {(r.target_id, r.movieId) for r in catalog.similar_by_genre(df, df.select("movieId"), 5).collect()}
    assert (2, 1) in sim and (2, 3) in sim and (4, 3) in sim


def test_containment_unicode_and_empty_genre(spark):
    rows = [(1, "A", "Ciência|Ação"), (2, "B", "Ficção Ciência"), (3, "C", "|Drama"), (4, "D", "Ação\\nnova"),
            (5, "E", "😀Ação"), (6, "F", None)]
    df = spark.createDataFrame(rows, "movieId int, title string, genres string")
    stats = {r.genre: r.num_movies for r in catalog.genre_statistics(df).collect()}
    for g, n in stats.items():
        assert n == sum(1 for _, _, s in rows if s is not None and g in s), g
    assert stats["Ação"] == 3
    # movie 3's first valid genre is the empty string: every other movie with genres matches
    sim = sorted(r.movieId for r in catalog.similar_by_genre(df, df.filter("movieId = 3").select("movieId"), 10).collect())
    assert sim == [1, 2, 4, 5]
