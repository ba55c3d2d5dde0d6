"""Exact top-N by inner product that leaves out what cannot matter.

The others are cut into buckets of falling norm.  By Cauchy-Schwarz a key k scores at
most |k| * b in a bucket whose largest norm is b, so once the key's running n-th
score is above that, this bucket and all after it are skipped whole.  Buckets are
worked off in waves of 1, 4, 16, ... buckets (each sends the keys that remain): a key takes part in a wave only if its
bound still allows the wave's first bucket, block pairs are scored as in
:mod:`reelspark.operators.recommend`, and the running lists are merged.  A key brings
its n-th score so far, so that within the wave it skips all that cannot reach it.

The result equals :func:`recommend.top_n` row for row: a bucket is skipped only if its
bound (with room for rounding) is below the n-th score, so ties are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators import recommend
from reelspark.operators.staging import staged

#: Others in a bucket (its rows may be more where norms tie), buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1_024, 256
#: Buckets of a wave for each of the wave before.
GROWTH = 4


def _norm(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def norm_buckets(others: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[float], list[int]]:
    """(id, features) -> the rows with their bucket (0: largest norms), each bucket's largest norm and rows."""
    with_norm = staged(others.select("id", "features", _norm(F.col("features")).alias("norm")), "norms")
    n = with_norm.count()
    count = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    edges = sorted(set(with_norm.approxQuantile("norm", [i / count for i in range(1, count)], 0.001)), reverse=True) if count > 1 else []
    # edges are a bounded list; a row's bucket is the number of edges above its norm
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e > F.col("norm")))
    dealt = with_norm.select("id", "features", "norm", bucket.alias("bucket"))
    sizes = {r["bucket"]: (r["top"], r["n"]) for r in dealt.groupBy("bucket").agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect()}
    tops, rows = zip(*(sizes.get(b, (0.0, 0)) for b in range(len(edges) + 1)), strict=True)
    return dealt, list(tops), list(rows)


def _reach(norm: Column, least: Column, tops: list[float]) -> Column:
    """How many buckets, from the first, a key can still find something in."""
    room = 1 + 1e-9
    return F.size(F.filter(F.array(*map(F.lit, tops)).cast("array<double>"), lambda top: least.isNull() | (norm * top * room + 1e-12 >= least)))


def pruned_top_n(
    keys: DataFrame, others: DataFrame, n: int = 10, key: str = "userId", other: str = "movieId", bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Factor tables -> (the nested top-N of :func:`recommend.top_n`, the work of each
    wave: wave, buckets, keys, pairs that the norms allow, all_pairs).  Keys without features score 0."""
    spark = keys.sparkSession
    n = int(n)
    dealt, tops, rows = norm_buckets(others, bucket_rows)
    empty = spark.createDataFrame([], "wave int, buckets int, keys long, pairs long, all_pairs long")
    if n <= 0 or not sum(rows):
        return recommend.top_n(keys, others, n, key, other), empty
    offered = staged(dealt.select("id", "features", "bucket"), "norm-buckets")
    asked = staged(keys.select("id", "features", _norm(F.col("features")).alias("norm")), "norm-keys")
    n_asked = asked.count()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best, work, first, width, wave = None, [], 0, 1, 0
    while first < len(tops):
        last = min(len(tops), first + width)
        if best is None:
            reach = asked.withColumn("least", F.lit(None).cast("double"))
        else:
            nth = best.groupBy(F.col(key).alias("id")).agg(F.when(F.count("*") >= n, F.min("score")).alias("least"))
            reach = asked.join(nth, "id", "left")
        reach = reach.withColumn("reach", F.least(_reach(F.col("norm"), F.col("least"), tops), F.lit(last))).filter(F.col("reach") > first)
        reach = staged(reach.select("id", "features", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "reach"), "norm-reach")
        n_keys = reach.count()
        if not n_keys:  # norms only fall from here on
            break
        counts = recommend.block_counts(n_keys, sum(rows[first:last]), wide)
        wave_rows = offered.filter(F.col("bucket").between(first, last - 1)).select("id", "features")
        found = recommend.found_in_pairs(reach.drop("reach"), wave_rows, n, key, other, *counts)
        done = reach.select(F.explode(F.sequence(F.lit(first), F.col("reach") - 1)).alias("bucket")).groupBy("bucket").count()
        scored = sum(r["count"] * rows[r["bucket"]] for r in done.collect())  # a row a bucket
        work.append((wave, last - first, n_keys, scored, n_asked * sum(rows[first:last])))
        every = found if best is None else best.unionByName(found)
        if last < len(tops):  # the last wave is cut when it is nested
            order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(other).asc())
            every = staged(every.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank"), "norm-best")
        best = every
        first, width, wave = last, GROWTH * width, wave + 1
    skipped = sum(rows[first:]) * n_asked if first < len(tops) else 0
    if skipped:
        work.append((wave, len(tops) - first, 0, 0, int(skipped)))
    return recommend.nested(best, n, key, other), spark.createDataFrame(work, empty.schema)
