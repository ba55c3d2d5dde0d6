"""Display projection and metadata enrichment as column expressions / joins.

The reference computed these per row in Python after collecting, and looked
metadata up with one HTTP call per movie.  Here they are projections over
any DataFrame with (movieId, title[, genres]) and a left join with a
``metadata`` table of search results (query_title, result_rank, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.genres import genre_tags
from reelspark.functions.posters import placeholder_poster, poster_url
from reelspark.functions.titles import clean_title, lookup_key, title_year, year_or_null

METADATA_FIELDS = ["tmdb_id", "overview", "release_date", "vote_average", "vote_count", "popularity"]


def with_display_columns(df: DataFrame) -> DataFrame:
    """Add year, clean_title and a placeholder poster_url."""
    t, mid = F.col("title"), F.col("movieId")
    return df.select(
        "*",
        title_year(t).alias("year"),
        clean_title(t).alias("clean_title"),
        placeholder_poster(t, mid).alias("poster_url"),
    )


def with_genre_tags(df: DataFrame) -> DataFrame:
    """Genres as display tags, the sentinel dropped."""
    return df.withColumn("genre_tags", genre_tags(F.col("genres")))


def with_shown_year(df: DataFrame) -> DataFrame:
    """The year to show, null when unknown."""
    return df.withColumn("shown_year", year_or_null(F.col("year")))


def with_shown_rating(df: DataFrame, score: str = "predicted_rating", name: str = "shown_rating") -> DataFrame:
    """A predicted rating as shown to users, one decimal (half up)."""
    return df.withColumn(name, F.round(F.col(score).cast("double"), 1))


def with_lookup_key(df: DataFrame) -> DataFrame:
    """The metadata search key of each title."""
    return df.withColumn("lookup_key", lookup_key(F.col("title")))


def best_metadata(metadata: DataFrame) -> DataFrame:
    """The first search result per query title (lowest rank, then lowest
    id).  An aggregate with ``min_by`` so a popular title is combined
    map-side instead of sorted in one task."""
    fields = ["result_rank", *METADATA_FIELDS, "poster_path"]
    # lowest rank then lowest id, unknown (null) values last
    order = F.struct(
        F.col("result_rank").isNull(), F.col("result_rank"), F.col("tmdb_id").isNull(), F.col("tmdb_id")
    )
    best = F.min_by(F.struct(*fields), order)
    return (
        metadata.filter(F.col("query_title").isNotNull())
        .groupBy("query_title")
        .agg(best.alias("m"))
        .select("query_title", *[F.col(f"m.{f}").alias(f) for f in fields])
    )


def enrich(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Display record with metadata attached where the lookup title
    has a search result; rows without one are kept, fields null.

    Output: the input columns, year, clean_title, poster_url and the six
    metadata fields.  For whole tables; a page uses :func:`enrich_page`.
    """
    best = best_metadata(metadata)
    keyed = df.select("*", lookup_key(F.col("title")).alias("_lookup"))
    return _display_record(keyed.join(best, keyed["_lookup"] == best["query_title"], "left"), df.columns)


def enrich_page(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """E3-E5 for a limited result: the same record, but the search results are
    joined to the page's rows first, so that only theirs are aggregated.
    The page is computed once; the metadata table is filtered, not grouped."""
    keyed = df.select("*", lookup_key(F.col("title")).alias("_lookup"), F.monotonically_increasing_id().alias("_row"))
    joined = keyed.join(metadata, keyed["_lookup"] == metadata["query_title"], "left")
    order = F.struct(
        F.col("result_rank").isNull(), F.col("result_rank"), F.col("tmdb_id").isNull(), F.col("tmdb_id")
    )
    fields = [*METADATA_FIELDS, "poster_path"]
    one = joined.groupBy("_row").agg(
        F.first(F.struct(*[F.col(c) for c in df.columns])).alias("_page"), F.min_by(F.struct(*fields), order).alias("_m")
    )
    return _display_record(one.select("_page.*", *[F.col(f"_m.{f}").alias(f) for f in fields]), df.columns)


def _display_record(joined: DataFrame, columns: list[str]) -> DataFrame:
    t, mid = F.col("title"), F.col("movieId")
    return joined.select(
        *[F.col(c) for c in columns],
        title_year(t).alias("year"),
        clean_title(t).alias("clean_title"),
        poster_url(F.col("poster_path"), t, mid).alias("poster_url"),
        *[F.col(c) for c in METADATA_FIELDS],
    )
