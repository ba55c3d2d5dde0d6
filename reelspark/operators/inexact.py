"""Titles that nearly match: a similarity join on character trigrams (E1/E2 for inexact titles).

Two titles are compared by the sets of trigrams of their folded text (A-Z lower-cased,
two blanks before and after): similarity is intersection over union.  ``closest`` gives
each query title its best titles of at least ``percent``, exactly, without comparing
all pairs:

* length filter: sets whose sizes differ by more than the threshold cannot match;
* prefix filter: with all trigrams in one order, sets that reach the threshold share one
  of their first ``size - ceil(size * threshold) + 1``.  The order is rarest first, so
  that what everyone holds comes last; only prefixes are joined.

Each distinct title takes part once and travels as a 128-bit hash of its text.  Null and
empty titles match nothing; equal scores are ordered by the title (UTF-8 bytes).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.catalog import _check_limit, _grams
from reelspark.operators.display import best_metadata
from reelspark.operators.staging import staged

GRAM, PAD = 3, "  "


def folded(title: Column) -> Column:
    """The text whose trigrams count: A-Z lower-cased, blanks around it."""
    return F.concat(F.lit(PAD), F.translate(title, string.ascii_uppercase, string.ascii_lowercase), F.lit(PAD))


def _key(title: Column) -> Column:
    return F.unhex(F.md5(title))


def gram_sets(titles: DataFrame, percent: int) -> DataFrame:
    """(side, title) -> side, key, size, grams (rarest first), prefix: how many of them may decide.

    The order counts every distinct title of both sides.  A list is as long as its title.
    """
    known = titles.filter(F.length("title") > 0).distinct()
    grams = known.select("side", _key(F.col("title")).alias("key"), F.explode(_grams(folded(F.col("title")), F.lit(GRAM))).alias("gram"))
    grams = staged(grams, "title-grams")
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    lists = counted.groupBy("side", "key").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("l"))
    size = F.size("grams")
    sets = lists.select("side", "key", F.transform("l", lambda x: x["gram"]).alias("grams"))
    return sets.select("side", "key", size.alias("size"), "grams", (size - F.ceil(size * percent / 100) + 1).cast("int").alias("prefix"))


def closest(queries: DataFrame, titles: DataFrame, percent: int = 70, n: int = 1) -> DataFrame:
    """(title) and (title) -> query, rank, title, score: the ``n`` titles most like each query title.

    ``percent`` (1 to 100) is the least similarity.  Queries without such a title give no row.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, got {percent!r}")
    asked, known = (x.select(F.col(x.columns[0]).alias("title")).distinct() for x in (queries, titles))
    both = asked.select(F.lit(0).alias("side"), "title").unionByName(known.select(F.lit(1).alias("side"), "title"))
    sets = staged(gram_sets(both, percent), "title-sets")
    first = sets.select("side", "key", "size", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    q, t = (first.filter(F.col("side") == s).select("gram", F.col("key").alias(k), F.col("size").alias(z)) for s, k, z in ((0, "q", "qs"), (1, "t", "ts")))
    met = q.join(t, "gram").filter(100 * F.least("qs", "ts") >= percent * F.greatest("qs", "ts")).select("q", "t").distinct()
    for side, k in ((0, "q"), (1, "t")):
        met = met.join(sets.filter(F.col("side") == side).select(F.col("key").alias(k), F.col("grams").alias(f"{k}g")), k)
    shared = F.size(F.array_intersect("qg", "tg"))
    pairs = met.select("q", "t", shared.alias("shared"), (F.size("qg") + F.size("tg") - shared).alias("either"))
    pairs = pairs.filter(100 * F.col("shared") >= percent * F.col("either")).select("q", "t", (F.col("shared") / F.col("either")).alias("score"))
    pairs = pairs.join(known.select(_key(F.col("title")).alias("t"), "title"), "t")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "title"))
    best = pairs.withColumn("rank", rank).filter(F.col("rank") <= _check_limit(n))
    return best.join(asked.select(_key(F.col("title")).alias("q"), F.col("title").alias("query")), "q").select("query", "rank", "title", "score")


def with_closest_metadata(df: DataFrame, metadata: DataFrame, key: str, percent: int = 70) -> DataFrame:
    """``df`` with the search result of the query title most like the column ``key``.

    Adds query_title, score and tmdb_id, null where nothing is near enough; every row stays.
    """
    best = best_metadata(metadata).select("query_title", "tmdb_id")
    near = closest(df.select(key), best.select("query_title"), percent)
    near = near.select(F.col("query").alias("_query"), F.col("title").alias("query_title"), "score").join(best, "query_title")
    joined = df.join(near, df[key] == near["_query"], "left")
    return joined.select(*[df[c] for c in df.columns], near["query_title"], near["score"], near["tmdb_id"])
