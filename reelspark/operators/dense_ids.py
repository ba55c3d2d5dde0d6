"""Dense 32-bit ids for keys that ALS cannot take (strings, ids beyond int), and the way back.

Distinct keys are range-partitioned and sorted inside their partitions; a key's dense
id is its place in its partition plus the rows of all partitions before it.  So ids keep
the keys' order (``dense_rank() - 1``), yet no task sees more than its range: only one
count a partition meets in one place.  The numbered rows are written before they are
counted, so a task that runs again cannot deal its keys anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.staging import staged
from reelspark.sources.schemas import INT_MAX

#: Distinct keys that a partition numbers, about.
RANGE_ROWS = 1_000_000


def dense_ids(df: DataFrame, col: str, first: int = 0, partitions: int | None = None) -> DataFrame:
    """(col) -> col, dense int: the distinct non-null values of ``col`` in order, from ``first``.

    More values than ints fail the job.
    """
    keys = staged(df.select(F.col(col).alias("key")).filter(F.col("key").isNotNull()).distinct(), "dense-keys")
    n = keys.count()
    if first + n - 1 > INT_MAX:
        raise ValueError(f"{n} distinct values of {col} do not fit 32-bit ids from {first}")
    parts = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranges = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    # the upper 31 bits of this id are the partition, the lower 33 the place in it
    number = F.monotonically_increasing_id()
    dealt = ranges.select("key", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    dealt = staged(dealt, "dense-ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    # as many rows as partitions
    return dealt.join(F.broadcast(offsets), "part").select(F.col("key").alias(col), (F.col("before") + F.col("place") + first).cast("int").alias("dense"))


def with_dense(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """``df`` with ``col`` replaced by its dense id; rows whose value has none go."""
    named = ids.select(F.col(col).alias("_key"), F.col("dense").alias("_dense"))
    joined = df.join(named, F.col(col) == F.col("_key"))
    return joined.select(*[F.col("_dense").alias(c) if c == col else F.col(c) for c in df.columns])


def with_original(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The way back: ``df`` with the dense ids of ``col`` replaced by the original values."""
    named = ids.select(F.col(col).alias("_key"), F.col("dense").alias("_dense"))
    joined = df.join(named, F.col(col) == F.col("_dense"))
    return joined.select(*[F.col("_key").alias(c) if c == col else F.col(c) for c in df.columns])
