"""Column expressions (built-in Spark functions only, codegen friendly)."""

from reelspark.functions.genres import (
    NO_GENRES,
    first_valid_genre,
    genre_array,
    genre_tags,
    genre_text,
    valid_genres,
)
from reelspark.functions.posters import placeholder_poster, poster_url
from reelspark.functions.titles import (
    clean_title,
    display_title,
    lookup_key,
    title_year,
    year_or_null,
    year_sort_key,
)

__all__ = [
    "NO_GENRES",
    "clean_title",
    "display_title",
    "first_valid_genre",
    "genre_array",
    "genre_tags",
    "genre_text",
    "lookup_key",
    "placeholder_poster",
    "poster_url",
    "title_year",
    "valid_genres",
    "year_or_null",
    "year_sort_key",
]
