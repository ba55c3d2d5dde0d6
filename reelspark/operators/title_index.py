"""Title search through a stored index of character trigrams (C6 without a scan of all titles).

``build`` publishes three tables as one version (see ``versions``):

* ``postings`` (gram, pos, doc, movieId): a row for every character of every distinct
  (movieId, title), ``gram`` being the three characters (code points) that start there,
  fewer at a title's end.  Range-partitioned and sorted by gram, then id, so a gram of a
  third of all titles is spread over files and a filter on few grams reads few row groups;
* ``grams`` (gram, n): the length of each posting list, sorted;
* ``titles``: the catalog as it came, sorted by movieId.

``search`` cuts a query string into trigrams side by side (the last may overlap) and asks
``grams`` for their lengths; a trigram no title has ends it.  The shortest list names
(title, start) candidates; the other lists are semi-joined to these and counted, so only
candidates are grouped, and AQE broadcasts the shortest list if it measures small.  Places
must fit together, so a hit needs no look at the title.  The first ``limit`` ids are then
read from the sorted ``titles`` and ``contains`` has the last word.  A string of one or
two characters starts some gram wherever it occurs: a prefix, which is one range of grams.

The result is that of ``catalog.search_titles``, order and limit included.  Null and
empty titles are never found, null ids are kept (first in order), repeated rows come
back as often as they are there, and an empty string finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import catalog, versions

GRAM = 3
#: Characters of a title cut at a time (keeps the work of long titles in proportion).
CHUNK = 64
#: Ids that are named in the scan of ``titles``; a larger limit joins them instead.
NAMED_IDS = 1000


def _occurrences(title: Column) -> Column:
    """Array of (gram, pos): the gram that starts at each character of a title that has any."""
    last = F.floor((F.length(title) - 1) / CHUNK).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            (k * CHUNK).alias("at"),
            F.substring(title, k * CHUNK + 1, F.lit(CHUNK + GRAM - 1)).alias("text"),
            F.least(F.lit(CHUNK), F.length(title) - k * CHUNK).alias("starts"),
        ),
    )
    return F.flatten(
        F.transform(
            chunks,
            lambda c: F.transform(
                F.sequence(F.lit(1), c["starts"]),
                lambda i: F.struct(F.substring(c["text"], i, F.lit(GRAM)).alias("gram"), (c["at"] + i - 1).alias("pos")),
            ),
        )
    )


def postings(movies: DataFrame) -> DataFrame:
    """(movieId, title) -> gram, pos, doc, movieId; ``doc`` tells (movieId, title) pairs apart."""
    known = movies.filter(F.length("title") > 0).select("movieId", "title").distinct()
    rows = known.select("movieId", F.xxhash64("movieId", "title").alias("doc"), F.explode(_occurrences(F.col("title"))).alias("o"))
    return rows.select("o.gram", "o.pos", "doc", "movieId")


def build(movies: DataFrame, path: str, keep: int = 2) -> str:
    """Write the index of ``movies`` (movieId, title, genres, ...) under ``path`` and publish it; its folder."""
    spark = movies.sparkSession

    def write(folder: str) -> None:
        movies.repartitionByRange("movieId").sortWithinPartitions("movieId").write.parquet(f"{folder}/titles")
        stored = spark.read.schema(movies.schema).parquet(f"{folder}/titles")
        postings(stored).repartitionByRange("gram", "movieId").sortWithinPartitions("gram", "movieId").write.parquet(f"{folder}/postings")
        sizes = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")

    return versions.publish(spark, path, write, keep)


def pieces(query: str) -> list[tuple[str, int]]:
    """(gram, offset) of trigrams that cover a query string of three characters or more."""
    offsets = sorted({*range(0, len(query) - GRAM + 1, GRAM), len(query) - GRAM})
    return [(query[i : i + GRAM], i) for i in offsets]


def _starts(posts: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """(doc, start, movieId) for every posting of the pieces: where the query string would start."""
    offsets: dict[str, list[int]] = {}
    for gram, offset in wanted:
        offsets.setdefault(gram, []).append(offset)
    at = F.create_map(*[x for g, o in offsets.items() for x in (F.lit(g), F.array(*map(F.lit, o)))])
    rows = posts.filter(F.col("gram").isin(list(offsets)))
    rows = rows.select("doc", "movieId", "pos", F.explode(at[F.col("gram")]).alias("offset")).filter("pos >= offset")
    return rows.select("doc", (F.col("pos") - F.col("offset")).alias("start"), "movieId")


def hits(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(movieId) of the index in ``folder`` with a title that holds the query string, once each."""
    posts = spark.read.parquet(f"{folder}/postings")
    if len(query) < GRAM:
        found = posts.filter(F.col("gram").startswith(query)) if query else posts.limit(0)
        return found.select("movieId").distinct()
    wanted = pieces(query)
    sizes = spark.read.parquet(f"{folder}/grams").filter(F.col("gram").isin(sorted({g for g, _ in wanted})))
    n = {r.gram: r.n for r in sizes.collect()}  # a row for each piece of the query string at most
    if any(g not in n for g, _ in wanted):
        return posts.limit(0).select("movieId")
    first, *others = sorted(wanted, key=lambda p: (n[p[0]], p))
    found = _starts(posts, [first])
    if others:
        rest = _starts(posts, others).join(found.select("doc", "start").distinct(), ["doc", "start"], "left_semi")
        found = rest.groupBy("doc", "start", "movieId").agg(F.count("*").alias("n")).filter(F.col("n") >= len(others))
    return found.select("movieId").distinct()


def search(spark: SparkSession, path: str, query: str, limit: int = 20) -> DataFrame:
    """C6 over the newest index under ``path``: the rows of ``catalog.search_titles(movies, query, limit)``."""
    folder = versions.latest(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no title index is published under {path}")
    titles = spark.read.parquet(f"{folder}/titles")
    limit = catalog._check_limit(limit)
    # the first rows by movieId are among those of the first ``limit`` ids
    ids = hits(spark, folder, query).orderBy("movieId").limit(limit)
    if limit <= NAMED_IDS:
        named = [r.movieId for r in ids.collect()]
        some = F.col("movieId").isin([i for i in named if i is not None])
        titles = titles.filter(some | F.col("movieId").isNull() if None in named else some)
    else:
        titles = titles.alias("t").join(ids.alias("i"), F.col("t.movieId").eqNullSafe(F.col("i.movieId")), "left_semi")
    return catalog.search_titles(titles, query, limit)
