"""Catalog questions over a ``movies`` table (movieId, title, genres).

Genre matching comes in two flavours:

* ``"substring"`` (default, the reference behaviour): a movie is in genre g
  when its genre *string* contains g, so ``Brand#1`` also matches
  ``Brand#13``.
* ``"exact"``: g must be one of the movie's pipe-separated genres.

Substring matching is never evaluated as movies x genres.  The catalog is
first collapsed to its distinct genre strings (partial aggregation, so a hot
genre string costs one row per map task), the strings are split into pieces,
and "g occurs in s" becomes an equi-join between the distinct short grams of
each distinct piece and the wanted genres' leading grams, checked with
``contains``.  The work grows with the number of distinct genre strings, not
with the number of movies times genres.

Every limited result has a total order (ties end on movieId) so it is
deterministic; an unknown sort key or a negative limit raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.genres import (
    NO_GENRES,
    first_valid_genre,
    genre_array,
    genre_text,
)
from reelspark.functions.titles import year_sort_key

# fixed values: the genre list used when the caller asks for a fallback
FALLBACK_GENRES = [
    "Action", "Adventure", "Animation", "Children", "Comedy",
    "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir",
    "Horror", "Musical", "Mystery", "Romance", "Sci-Fi",
    "Thriller", "War", "Western",
]

SORT_KEYS = ("title", "year")
MATCH_MODES = ("substring", "exact")
# marks that no genre holds
ANY_MOVIE, ANY_GENRES = "\x01", "\x02"


def _check_limit(limit: int) -> int:
    if limit is None or int(limit) < 0:
        raise ValueError(f"limit must be a non-negative integer, got {limit!r}")
    return int(limit)


def _check_match(match: str) -> str:
    if match not in MATCH_MODES:
        raise ValueError(f"match must be one of {MATCH_MODES}, got {match!r}")
    return match


# --- C1 / C2 / C3 / C4 ------------------------------------------------------


def with_genre_list(movies: DataFrame) -> DataFrame:
    """Add ``genre_list`` (array of the pipe-separated genres)."""
    return movies.withColumn("genre_list", genre_array(F.col("genres")))


def with_genre_text(movies: DataFrame) -> DataFrame:
    """Add ``genres_clean`` (pipes replaced by spaces)."""
    return movies.withColumn("genres_clean", genre_text(F.col("genres")))


def genre_combinations(movies: DataFrame) -> DataFrame:
    """Distinct genre strings with their row count: (genres, n_rows)."""
    return movies.groupBy("genres").agg(F.count(F.lit(1)).alias("n_rows"))


def _pieces(combos: DataFrame) -> DataFrame:
    """(genres, n_rows, piece) — one row per distinct piece of each string."""
    return combos.select(
        "genres", "n_rows", F.explode(F.array_distinct(genre_array(F.col("genres")))).alias("piece")
    )


def distinct_genres(movies: DataFrame) -> DataFrame:
    """Every distinct genre, the sentinel included."""
    return _pieces(genre_combinations(movies)).select(F.col("piece").alias("genre")).distinct()


def listed_genres(movies: DataFrame) -> DataFrame:
    """Distinct genres without the sentinel and without the empty genre
    (which would match every movie under substring matching)."""
    return distinct_genres(movies).filter((F.col("genre") != NO_GENRES) & (F.col("genre") != ""))


def genres_sorted(movies: DataFrame) -> DataFrame:
    """C4: the genre list, sorted ascending."""
    return listed_genres(movies).orderBy("genre")


def fallback_genres(spark) -> DataFrame:
    """The fixed genre list, for callers that want a list even when the
    catalog cannot be read.  Never substituted silently."""
    return spark.createDataFrame([(g,) for g in FALLBACK_GENRES], "genre string")


def top_genres(movies: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` genres in alphabetical order."""
    return genres_sorted(movies).limit(_check_limit(n))


# --- containment relation -------------------------------------------------


#: Longest gram that the containment join uses, and characters of a piece cut at a time.
MAX_GRAM = 16
GRAM_CHUNK = 64


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of ``size`` characters (code points) of a text.

    Cutting chunk by chunk keeps each cut short, so the work follows the length
    of the text, and so does the output: a gram for each character at most.
    """
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - size) / GRAM_CHUNK).cast("int")),
        lambda k: F.substring(text, k * GRAM_CHUNK + 1, size + (GRAM_CHUNK - 1)),
    )
    cut = F.transform(
        chunks, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size))
    )
    return F.array_distinct(F.flatten(cut))


def _containment(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """(piece, genre) for every distinct piece and wanted genre inside it.

    ``wanted`` has one column ``genre``, none empty.  Grams are as long as the
    shortest wanted genre (``MAX_GRAM`` at most), so every wanted genre starts
    with one; a piece's grams are joined to those leading grams, which names
    each (piece, genre) once, and ``contains`` decides.  Gram rows carry a hash of
    their piece, not the piece.
    """
    wanted = wanted.distinct()
    size = wanted.agg(F.least(F.min(F.length("genre")), F.lit(MAX_GRAM))).scalar()
    vocab = pieces.select("piece").distinct().select("piece", F.sha2("piece", 256).alias("_pk"))
    sized = vocab.select("_pk", "piece", size.alias("_size")).filter(F.length("piece") >= F.col("_size"))
    grams = sized.select("_pk", F.explode(_grams(F.col("piece"), F.col("_size"))).alias("_gram"))
    leading = wanted.select("genre", size.alias("_size")).select("genre", F.substring(F.col("genre"), F.lit(1), F.col("_size")).alias("_gram"))
    named = grams.join(leading, "_gram").select("_pk", "genre")
    return vocab.join(named, "_pk").filter(F.col("piece").contains(F.col("genre"))).select("piece", "genre")


def genre_members(movies: DataFrame, wanted: DataFrame, match: str = "substring") -> DataFrame:
    """(genres, n_rows, genre): distinct genre strings that fall in each wanted genre."""
    _check_match(match)
    pieces = _pieces(genre_combinations(movies))
    if match == "exact":
        hits = pieces.join(wanted.distinct().withColumnRenamed("genre", "piece"), "piece")
        return hits.select("genres", "n_rows", F.col("piece").alias("genre"))
    rel = _containment(pieces, wanted)
    return pieces.join(rel, "piece").select("genres", "n_rows", "genre").distinct()


# --- C12 / C13 / C18 / D7 ---------------------------------------------------


def genre_statistics(movies: DataFrame, match: str = "substring") -> DataFrame:
    """Movies per genre (genre, num_movies), count descending then
    genre ascending.  Genres are the C4 list, so none has a zero count."""
    wanted = listed_genres(movies)
    return (
        genre_members(movies, wanted, match)
        .groupBy("genre")
        .agg(F.sum("n_rows").alias("num_movies"))
        .orderBy(F.desc("num_movies"), "genre")
    )


def genre_count(movies: DataFrame, genre: str, match: str = "substring") -> DataFrame:
    """One row (genre, num_movies); 0 when ``genre`` is not in the list.

    A single aggregate pass: the count of matching rows and whether the
    genre occurs as a genre at all.
    """
    _check_match(match)
    g = F.lit(genre)
    pieces = genre_array(F.col("genres"))
    if match == "exact":
        hit = F.array_contains(pieces, g)
    else:
        hit = F.col("genres").contains(g)
    listed = genre not in (NO_GENRES, "")
    known = F.coalesce(F.bool_or(F.array_contains(pieces, g)), F.lit(False)) & F.lit(listed)
    return movies.agg(
        F.lit(genre).alias("genre"),
        F.when(known, F.count_if(F.coalesce(hit, F.lit(False)))).otherwise(F.lit(0)).cast("bigint").alias("num_movies"),
    )


def genre_share(stats: DataFrame) -> DataFrame:
    """Each genre's count as a percentage of the largest count
    and as shown, to one decimal (halves to even).  The maximum is a scalar
    subquery, not a single-partition window."""
    top = stats.agg(F.max("num_movies")).scalar()
    share = stats.select("genre", "num_movies", (F.col("num_movies") / top * F.lit(100.0)).alias("share_pct"))
    return share.withColumn("share_pct_shown", F.bround("share_pct", 1))


# --- C6 / C7-C11 / C14 / C15 ------------------------------------------------


def search_titles(movies: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Case-sensitive literal substring search on the title, first
    ``limit`` by movieId.  An empty query returns no rows."""
    limit = _check_limit(limit)
    if not query:
        return movies.limit(0)
    return (
        movies.filter(F.col("title").contains(F.lit(query)))
        .orderBy("movieId", "title", "genres")
        .limit(limit)
    )


def _genre_predicate(genre: str, match: str) -> Column:
    _check_match(match)
    if match == "exact":
        return F.array_contains(genre_array(F.col("genres")), F.lit(genre))
    return F.col("genres").contains(F.lit(genre))


def movies_by_genre(
    movies: DataFrame, genre: str, limit: int = 20, sort_by: str = "title", match: str = "substring"
) -> DataFrame:
    """Movies of a genre, sorted by title (ascending) or by the year
    key (descending, a string order: undated titles come first), top
    ``limit``."""
    limit = _check_limit(limit)
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {SORT_KEYS}, got {sort_by!r}")
    hits = movies.filter(_genre_predicate(genre, match))
    if sort_by == "title":
        order = [F.col("title").asc_nulls_first(), F.col("movieId"), F.col("genres")]
    else:
        order = [year_sort_key(F.col("title")).desc_nulls_last(), F.col("movieId"), F.col("genres")]
    return hits.orderBy(*order).limit(limit)


def movie_by_id(movies: DataFrame, movie_id: int) -> DataFrame:
    """C14: the movie with this id (first of duplicates by title, genres)."""
    return (
        movies.filter(F.col("movieId") == F.lit(int(movie_id)))
        .orderBy(F.col("title").asc_nulls_first(), F.col("genres").asc_nulls_first())
        .limit(1)
    )


def catalog_head(movies: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` catalog rows by movieId (no ranking)."""
    return movies.orderBy("movieId", "title", "genres").limit(_check_limit(limit))


def with_result_count(df: DataFrame, name: str = "count") -> DataFrame:
    """Attach the row count of a limited result to its rows.

    One window over the result, which its limit bounds; the query below runs once.
    """
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy()))


# --- C16: similar movies ------------------------------------------------------


def similar_to(movies: DataFrame, movie_id: int, limit: int = 10, match: str = "substring") -> DataFrame:
    """C16/C17 for one movie: up to ``limit`` other movies whose genres contain
    its first valid genre, by movieId, in the form of :func:`similar_by_genre`.

    A point lookup gives the genre (a scalar subquery); the catalog is then
    filtered and cut to a top-k.  An unknown movie or one with null genres has
    none; one without a valid genre has any other movies.
    """
    limit = _check_limit(limit)
    _check_match(match)
    # what to look for, once, so that the subquery is planned once: the genre, or a
    # mark that every movie bears (no valid genre) or every movie with genres (the empty one)
    genre = first_valid_genre(F.col("genres"))
    wanted = F.when(genre.isNull(), F.lit(ANY_MOVIE)).when((genre == "") & F.lit(match == "substring"), F.lit(ANY_GENRES)).otherwise(genre)
    found = movie_by_id(movies, movie_id).agg(F.max(F.when(F.col("genres").isNotNull(), wanted))).scalar()
    if match == "exact":
        fits = F.array_contains(F.concat(F.array(F.lit(ANY_MOVIE)), F.coalesce(genre_array(F.col("genres")), F.array())), found)
    else:
        fits = F.concat(F.lit(ANY_MOVIE), F.coalesce(F.concat(F.lit(ANY_GENRES), F.col("genres")), F.lit(""))).contains(found)
    others = movies.filter((F.col("movieId") != int(movie_id)) & fits).select("movieId", "title", "genres")
    order = [F.col("movieId"), F.col("title").asc_nulls_first(), F.col("genres").asc_nulls_first()]
    top = others.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy().orderBy(*order))  # over ``limit`` rows
    return top.select(F.lit(int(movie_id)).alias("target_id"), "movieId", "title", "genres", rank.alias("similar_rank"))


def similar_by_genre(
    movies: DataFrame, targets: DataFrame, limit: int = 10, match: str = "substring"
) -> DataFrame:
    """For each target movieId, up to ``limit`` other movies whose
    genres contain the target's first valid genre, by movieId.

    A target with no valid genre gets any other movies; an unknown target or
    one with null genres gets none.  Output: (target_id, movieId, title,
    genres, similar_rank).

    Candidates depend only on the first genre, so the plan is
      targets -> first genre  (distinct first genres F, a handful)
      F x catalog via the containment relation -> first limit+1 movies per
      genre (dense_rank <= k+1 lets Spark cut each map task to k+1 ranks per
      genre before the shuffle, so a hot genre stays cheap)
      join back to targets on the genre, drop self, keep the first ``limit``.
    Cost: catalog pieces + targets x (limit + 1); never targets x catalog.
    """
    limit = _check_limit(limit)
    _check_match(match)
    k1 = limit + 1
    t = (
        targets.select(F.col("movieId").alias("target_id"))
        .join(movies.select(F.col("movieId").alias("target_id"), "genres"), "target_id")
        .filter(F.col("genres").isNotNull())
        .select("target_id", first_valid_genre(F.col("genres")).alias("first_genre"))
        .distinct()
    )
    wanted = t.filter(F.col("first_genre").isNotNull()).select(F.col("first_genre").alias("genre"))

    rows = movies.filter(F.col("movieId").isNotNull()).select("movieId", "title", "genres")
    exploded = rows.select("*", F.explode(F.array_distinct(genre_array(F.col("genres")))).alias("piece"))
    if match == "exact":
        keyed = exploded.join(wanted.distinct().withColumnRenamed("genre", "piece"), "piece").withColumn(
            "genre", F.col("piece")
        )
    else:
        rel = _containment(exploded.select("piece"), wanted)
        keyed = exploded.join(rel, "piece")
    # dense_rank: a movie whose pieces match g twice keeps one rank, and the
    # rank filter is applied per map task before the shuffle.
    order = [F.col("movieId"), F.col("title").asc_nulls_first(), F.col("genres").asc_nulls_first()]
    w = Window.partitionBy("genre").orderBy(*order)
    per_genre = (
        keyed.select("movieId", "title", "genres", "genre", F.dense_rank().over(w).alias("rk"))
        .filter(F.col("rk") <= k1)
        .select("movieId", "title", "genres", "genre")
        .distinct()
    )
    # targets without a valid genre: no genre filter at all (top-k, bounded)
    anyone = rows.orderBy(*order).limit(k1).withColumn("genre", F.lit(None).cast("string"))
    cands = per_genre.unionByName(anyone)
    paired = t.join(cands, t.first_genre.eqNullSafe(cands.genre)).filter(
        F.col("movieId") != F.col("target_id")
    )
    w_t = Window.partitionBy("target_id").orderBy(*order)
    return (
        paired.withColumn("similar_rank", F.row_number().over(w_t))
        .filter(F.col("similar_rank") <= limit)
        .select("target_id", "movieId", "title", "genres", "similar_rank")
    )
