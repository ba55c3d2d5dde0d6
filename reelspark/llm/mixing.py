"""Mixing sources to target weights by hash-threshold histograms (native).

Every document gets a 52-bit hash of its id and text.  A source that is to give
``target`` of its ``source_size`` words gives each document floor(target /
source_size) times, and once more the documents whose hash lies under the
source's threshold.  Thresholds come from histograms: words are summed by
(source, leading hash bits), the bucket in which the running sum passes the
rest of the budget is the only one looked at again with more bits, and so on
down to one hash value.  No document is sorted and no group is gathered: each
histogram is a partial aggregate of at most 2 ** 14 buckets a source (1,024 at
first), and the refinements read the boundary bucket only.  No document is given
more than ``max_epochs`` times, wordless ones included.

Thresholds of a larger budget keep everything a smaller one takes (nested).

Edge cases: null text counts 0 words and is given like its source's other
documents; a null source is a source of its own, last in order; rows with equal
id and text share a hash and are taken alike; sources without words have the
target 0; an empty table gives no rows; texts of any length are counted whole;
further columns may have any name and are carried as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import WORD_PATTERN, staged, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hash bits read by each histogram, from the top; 52 in all.
LEVELS = (10, 14, 14, 14)
SEED = "mix"
#: Largest number of sources whose table is shipped to every executor.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """52 bits of an md5 of id and text, so that any engine can repeat it."""
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources by code point, null last, weigh ``weights``, repeating.  Shares that
    pass ``max_epochs`` times the source's size stop there and the excess goes to
    the others by weight, until none is above.  With sources in order of size
    over weight this is one running sum: a source is capped if the level that is
    left when all before it are capped passes its own cap.  One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("bigint")).withColumn("rank", F.row_number().over(by_name))
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(onward)
    cap = (max_epochs * F.col("source_size")).cast("double")
    out = ranked.withColumn("level", level).withColumn("capped", cap <= F.col("level") * F.col("weight"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(everyone)
    return out.withColumn("target", F.when(F.col("capped"), cap).otherwise(F.col("weight") * water)).select("source", "source_size", "target")


def _same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def thresholds(rows: DataFrame, targets: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(source, size, hash) rows and targets -> per source ``times`` (whole
    passes), ``edge`` (the boundary hash) and ``edge_in`` (whether it is taken).

    The boundary hash is taken if that brings the sum nearer to the budget.
    """
    total = sum(levels)
    t = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    t = t.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    edge = t.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("under"))
    done = 0
    for bits in levels:
        shift = total - done - bits
        inside = _with_source(rows, edge).filter(F.shiftright("hash", total - done) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("under").alias("under"))
        run = F.col("under") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        passed = sums.withColumn("upto", run).filter(F.col("upto") > F.col("budget"))
        edge = passed.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "budget")).alias("b")).select("source", "b.budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("under"), F.col("b.words"))
        edge = staged(edge, "mix-edge")
        done += bits
    edge = edge.withColumn("edge_in", (F.col("under") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("under")))
    out = _same_source(t.select("source", "source_size", "target", "times"), edge.select("source", F.col("prefix").alias("edge"), "edge_in"), "left")
    # no bucket passes the budget only where a source has no words: all its documents count 0 anyway
    return out.withColumn("edge", F.coalesce("edge", F.lit(1 << total))).withColumn("edge_in", F.coalesce("edge_in", F.lit(False)))


def copies(hash_: Column, max_epochs: int = MAX_EPOCHS) -> Column:
    """How often a document is given, beside its source's columns: at most ``max_epochs``
    times, also where it has no words and lies under the edge of a source at its cap."""
    more = (hash_ < F.col("edge")) | ((hash_ == F.col("edge")) & F.col("edge_in"))
    return F.least(F.col("times") + F.when(more, 1).otherwise(0), F.lit(max_epochs)).cast("bigint")


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """Documents -> (one row a document: doc_id, source, size, hash; one row a source: target and threshold)."""
    rows = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, max_epochs), "mix-targets")
    return rows, staged(thresholds(rows, targets), "mix-thresholds")


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Joined on the source; shipped to every executor only while the number of sources is small."""
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return _same_source(rows, F.broadcast(per_source) if few else per_source)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times, taken."""
    rows, per_source = plan_mix(docs, weights, max_epochs)
    out = _with_source(rows, per_source).withColumn("times", copies(F.col("hash"), max_epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, with the columns they came with; one row each time a document is given."""
    _, per_source = plan_mix(docs, weights, max_epochs)
    per_source = per_source.select("source", "times", "edge", "edge_in")
    names = {c: f"_mix_{c}" for c in ("times", "edge", "edge_in")}
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["source"].alias("source"), mix_hash(docs["doc_id"], docs["text"]).alias("_hash"))
    n = copies(F.col("_hash"), max_epochs)
    out = _with_source(kept, per_source).select("_doc", n.alias(names["times"])).filter(F.col(names["times"]) > 0)
    return out.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(names["times"])))).select("_doc.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same thresholds by a running sum over each source's hashes.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes),
leveled AS (
  SELECT *, CAST((SELECT sum(source_size) FROM ranked)
       - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
       / CAST(sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN CAST(3 * source_size AS DOUBLE) <= level * weight THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * (SELECT max(level) FROM leveled WHERE CAST(3 * source_size AS DOUBLE) > level * weight) END AS target
  FROM leveled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
runs AS (
  SELECT r.source, r.hash, sum(r.size) AS words, sum(sum(r.size)) OVER (PARTITION BY r.source ORDER BY r.hash) AS upto
  FROM rows r GROUP BY r.source, r.hash),
takes AS (
  SELECT u.source, u.hash, b.source_size, b.target, b.times,
         CASE WHEN u.upto <= b.target - b.times * b.source_size THEN 1
              WHEN u.upto - u.words <= b.target - b.times * b.source_size
               AND u.upto - (b.target - b.times * b.source_size) < (b.target - b.times * b.source_size) - (u.upto - u.words) THEN 1
              ELSE 0 END AS more
  FROM runs u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source)
SELECT r.doc_id, r.size, t.source_size, t.target, CAST(r.size * (t.times + t.more) AS BIGINT) AS taken
FROM rows r JOIN takes t ON r.source IS NOT DISTINCT FROM t.source AND r.hash = t.hash
"""
