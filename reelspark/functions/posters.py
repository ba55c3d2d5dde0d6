"""Poster URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (placeholder poster and image host)
PLACEHOLDER_COLORS = ["FF6B6B", "4ECDC4", "45B7D1", "FFA07A", "98D8C8", "F7DC6F", "BB8FCE", "85C1E9"]
PLACEHOLDER_PREFIX = "https://via.placeholder.com/300x450/"
PLACEHOLDER_TEXT = "/FFFFFF?text="
PLACEHOLDER_TEXT_CHARS = 20
IMAGE_BASE = "https://image.tmdb.org/t/p/w500"


def placeholder_poster(title: Column, movie_id: Column) -> Column:
    """Colour chosen by ``movieId mod 8`` (non-negative), text = title with
    spaces as ``+`` and parentheses removed, first 20 characters."""
    palette = F.array(*[F.lit(c) for c in PLACEHOLDER_COLORS])
    color = F.get(palette, F.pmod(movie_id, F.lit(len(PLACEHOLDER_COLORS))))
    text = F.substring(F.translate(title, " ()", "+"), 1, PLACEHOLDER_TEXT_CHARS)
    return F.concat(F.lit(PLACEHOLDER_PREFIX), color, F.lit(PLACEHOLDER_TEXT), text)


def poster_url(poster_path: Column, title: Column, movie_id: Column) -> Column:
    """Image URL when a non-empty poster path is known, else the placeholder."""
    return F.when(
        poster_path.isNotNull() & (poster_path != ""), F.concat(F.lit(IMAGE_BASE), poster_path)
    ).otherwise(placeholder_poster(title, movie_id))
