"""Title parsing: year, display title, year sort key, metadata lookup key.

Rules (kept distinct on purpose, they disagree on odd titles):

* year        — the text between the *last* ``(`` and the next ``)``, kept
                only when it is all ASCII digits (any count), else ``N/A``;
                requires both parentheses somewhere in the title.
* clean title — the text before the *first* ``(``, trimmed, but only when a
                year was found; otherwise the whole title.  Longer than 40
                characters → first 37 and ``...``; empty → ``Untitled Movie``.
* sort key    — the *last* parenthesised group of exactly four digits
                anywhere in the title; when there is none, the whole title.
* lookup key  — the text before the first ``(``, trimmed, always.

A null title yields year ``N/A`` and ``Untitled Movie``.  Trimming removes
all white space; digits are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values (display rules)
NO_YEAR = "N/A"
UNTITLED = "Untitled Movie"
MAX_TITLE_CHARS = 40
KEEP_TITLE_CHARS = 37
ELLIPSIS = "..."
YEAR_SORT_PATTERN = r".*\((\d{4})\).*"
# white space as Unicode counts it, with the four ASCII separators
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _has_parens(title: Column) -> Column:
    return title.contains("(") & title.contains(")")


def _year_candidate(title: Column) -> Column:
    return F.substring_index(F.substring_index(title, "(", -1), ")", 1)


def _found_year(title: Column) -> Column:
    return F.coalesce(_has_parens(title) & _year_candidate(title).rlike(r"^[0-9]+\z"), F.lit(False))


def title_year(title: Column) -> Column:
    return F.when(_found_year(title), _year_candidate(title)).otherwise(F.lit(NO_YEAR))


def lookup_key(title: Column) -> Column:
    return F.trim(F.substring_index(title, "(", 1), F.lit(WHITE_SPACE))


def display_title(title: Column) -> Column:
    """Clean title before truncation and the empty check."""
    return F.when(_found_year(title), lookup_key(title)).otherwise(F.coalesce(title, F.lit("")))


def clean_title(title: Column) -> Column:
    t = display_title(title)
    cut = F.when(
        F.length(t) > MAX_TITLE_CHARS, F.concat(F.substring(t, 1, KEEP_TITLE_CHARS), F.lit(ELLIPSIS))
    ).otherwise(t)
    return F.when(cut == "", F.lit(UNTITLED)).otherwise(cut)


def year_sort_key(title: Column) -> Column:
    return F.regexp_replace(title, YEAR_SORT_PATTERN, "$1")


def year_or_null(year: Column) -> Column:
    """Hide the ``N/A`` marker (templates print the year only when known)."""
    return F.nullif(year, F.lit(NO_YEAR))
