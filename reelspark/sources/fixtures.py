"""Movie-style tables derived from the driver's TPC-H-like tables.

The driver data has no ratings or movie catalog, so they are derived with
plain column expressions from ``part``, ``orders`` and ``lineitem``:

* ``movies``   — one row per part; the title and genre branches cover every
  parsing rule of the display projection (no year, leading parenthesis,
  two parenthesised groups, a non-year group, very long titles, the
  "no genres" sentinel, substring-ambiguous brand genres).
* ``ratings``  — one row per (customer, part) pair that was ordered; the
  rating is a half-star value from the smallest quantity and the timestamp
  is the first order date in epoch seconds.
* ``metadata`` — search results of an external movie database, keyed by the
  lookup title of each movie, with two ranked results per hit.

The same derivations are written as SQL in ``reelspark.plans.oracle`` so a
second engine can check every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import sf_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, table))


def _s(c):
    return c.cast("string")


def _titled_parts(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """One projection over ``part``: the movie columns plus the part columns
    the metadata fixture reuses (so it needs no second scan or join)."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    p = p if only is None else p.filter(only)
    key, name, brand, ptype, size = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    yr = _s(F.lit(1950) + key % 70)
    branch = key % 10
    title = (
        F.when(branch == 0, name)
        .when(branch == 1, F.concat(F.lit("("), _s(size), F.lit(") "), name, F.lit(" ("), yr, F.lit(")")))
        .when(branch == 2, F.concat(name, F.lit(" (a.k.a. "), brand, F.lit(") ("), yr, F.lit(")")))
        .when(branch == 3, F.concat(name, F.lit(" (TV Series)")))
        .when(
            branch == 4,
            F.concat(name, F.lit(" and the "), name, F.lit(" of the "), ptype, F.lit(" "), name,
                     F.lit(" ("), yr, F.lit(")")),
        )
        .otherwise(F.concat(name, F.lit(" ("), yr, F.lit(")")))
    )
    parity = F.when(key % 2 == 0, F.lit("Even")).otherwise(F.lit("Odd"))
    genres = (
        F.when(key % 17 == 0, F.lit("(no genres listed)"))
        .when(size % 3 == 0, ptype)
        .when(size % 3 == 1, F.concat(ptype, F.lit("|"), brand))
        .otherwise(F.concat(brand, F.lit("|"), ptype, F.lit("|"), parity))
    )
    return p.select(
        key.cast("int").alias("movieId"), title.alias("title"), genres.alias("genres"),
        "p_brand", "p_size", "p_retailprice",
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_parts(spark, sf_dir).select("movieId", "title", "genres")


def movie(spark: SparkSession, sf_dir: str, movie_id: int) -> DataFrame:
    """The rows of :func:`movies` with one id, the id filtered in the scan of ``part``."""
    return _titled_parts(spark, sf_dir, F.col("p_partkey") == int(movie_id)).select("movieId", "title", "genres")


#: Factors of the fixture: term j of a row with key k is (k * FACTORS[j] mod m) centred, in eighths.
USER_FACTORS, USER_MOD = (3, 5, 7, 11), 17
ITEM_FACTORS, ITEM_MOD = (2, 3, 5, 7), 13


def _factors(keys: DataFrame, steps: tuple[int, ...], mod: int) -> DataFrame:
    key = F.col("key").cast("bigint")
    terms = [((F.pmod(key * a, F.lit(mod)) - mod // 2) / 8).cast("float") for a in steps]
    return keys.filter(F.col("key").isNotNull()).distinct().select(F.col("key").cast("int").alias("id"), F.array(*terms).alias("features"))


def user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features) of every customer with an order: multiples of 1/8, so that
    scores are exact, and few distinct ones, so that many tie."""
    return _factors(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), USER_FACTORS, USER_MOD)


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features) of every part, like :func:`user_factors`."""
    return _factors(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), ITEM_FACTORS, ITEM_MOD)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy("o_custkey", "l_partkey")
        .agg(F.min("l_quantity").alias("q"), F.min("o_orderdate").alias("d"))
        .select(
            F.col("o_custkey").cast("int").alias("userId"),
            F.col("l_partkey").cast("int").alias("movieId"),
            (F.ceil(F.col("q") / 5) / 2).cast("float").alias("rating"),
            F.unix_timestamp(F.col("d")).cast("bigint").alias("timestamp"),
        )
    )


def ratings_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ratings`` with the rating blanked for every 50th movie (cleaning input)."""
    r = ratings(spark, sf_dir)
    return r.withColumn(
        "rating", F.when(F.col("movieId") % 50 == 0, F.lit(None).cast("float")).otherwise(F.col("rating"))
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked search results for the lookup title of two movies in three."""
    from reelspark.functions.titles import lookup_key

    hits = _titled_parts(spark, sf_dir).filter(F.col("movieId") % 3 != 0)
    ranked = hits.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("result_rank"))
    key = F.col("movieId").cast("bigint")
    rank = F.col("result_rank")
    poster = (
        F.when(key % 4 == 0, F.lit(""))
        .when(key % 4 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/"), F.regexp_replace(F.col("p_brand"), "#", ""), F.lit("_"),
                            _s(key), F.lit("_"), _s(rank), F.lit(".jpg")))
    )
    return ranked.select(
        lookup_key(F.col("title")).alias("query_title"),
        rank.cast("int").alias("result_rank"),
        (key * 10 + rank).alias("tmdb_id"),
        F.concat(F.lit("Overview of "), F.col("title")).alias("overview"),
        F.concat(_s(F.lit(1950) + key % 70), F.lit("-01-0"), _s(rank)).alias("release_date"),
        (F.col("p_size") % 10 + rank / 4).cast("double").alias("vote_average"),
        (F.col("p_size") * 7 + rank).cast("bigint").alias("vote_count"),
        (F.col("p_retailprice") / rank).cast("double").alias("popularity"),
        poster.alias("poster_path"),
    )
