"""Genre column expressions.  Genres are one pipe-delimited string per movie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
NO_GENRES = "(no genres listed)"
GENRE_SEPARATOR_REGEX = r"\|"


def genre_array(genres: Column) -> Column:
    """Split on the pipe; trailing empty pieces are kept, null stays null."""
    return F.split(genres, GENRE_SEPARATOR_REGEX)


def valid_genres(genres: Column) -> Column:
    return F.filter(genre_array(genres), lambda g: g != F.lit(NO_GENRES))


def first_valid_genre(genres: Column) -> Column:
    """First genre that is not the sentinel; null when there is none."""
    return F.get(valid_genres(genres), 0)


def genre_text(genres: Column) -> Column:
    """Pipes replaced by spaces."""
    return F.regexp_replace(genres, GENRE_SEPARATOR_REGEX, " ")


def genre_tags(genres: Column) -> Column:
    """Genres shown as tags: the sentinel dropped, the rest joined by ``|``."""
    return F.array_join(valid_genres(genres), "|")
