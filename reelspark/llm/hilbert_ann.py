"""Approximate nearest neighbours by shifted space-filling curves, for inner products.

Each of ``CURVES`` curves projects the vectors at random to ``DIMS`` dimensions,
squeezes them into the unit box with a shift of its own and orders them by their
Hilbert key.  Spark range-partitions and sorts (curve, key), which gives every
vector its rank on each curve; ranks are cut into blocks of ``BLOCK`` rows.  A query
is scored against its own block and its neighbours on every curve, and the best of
all curves are merged.  Every row is indexed on every curve.

Largest inner product becomes nearest neighbour by one more coordinate: with M the
largest norm, data x stand at (x, sqrt(M^2 - |x|^2)) / M and queries at (q / |q|, 0).

Neighbours on each side make up ``SHARE`` / 2 of all rows, one block at least: in
vectors without structure (such as the tables': 64 independent coordinates, the 20
nearest at a cosine of 0.35 to 0.45) no ordering brings neighbours much closer
together, and a window of a fixed number of rows would lose recall as the table
grows.  Recall against brute force is tested.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components and rows without an id take no part; rows repeating an id count once,
with their best score; ties on a curve go by row, ties in score to the smaller id;
fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import staged, table
from reelspark.llm.vectors import FOUND, best, dimension, matrix, ranked, sample_rows, usable

CURVES = 14
DIMS, BITS = 6, 6
SHARE = 0.1
BLOCK = 2048
K = 20
QUERY_STEP = 20
#: Vectors from which the spread of the projections is taken.
SAMPLE = 1_000
SEED = 11


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Position of whole-number points (n x d, each of ``bits`` bits) on the Hilbert
    curve: the axes are turned into its transposed index and interleaved."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b) & 1
    return key


class Curve:
    """One projection, squeeze and shift."""

    def __init__(self, number: int, dim: int, dims: int, bits: int, sample: np.ndarray):
        rng = np.random.default_rng([SEED, number])
        self.bits, dims = bits, min(dims, dim)
        self.axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :dims]
        self.shift = rng.random(dims) * 0.25
        y = sample @ self.axes
        self.middle, self.spread = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-12)

    def keys(self, points: np.ndarray) -> np.ndarray:
        u = 0.5 * (1 + np.tanh(0.8 * (points @ self.axes - self.middle) / self.spread))
        u = np.minimum(0.75 * u + self.shift, 1 - 1e-9)
        return hilbert_key((u * (1 << self.bits)).astype(np.int64), self.bits)


def as_data(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))])


def as_queries(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def curve_keys(vectors: DataFrame, largest: float, curves: list[Curve]) -> DataFrame:
    """(row, embedding, is_query) -> curve, key, asks, row: a row for each curve, and one more where a query enters it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, x = b.column(0).to_numpy(), matrix(b.column(1))
            asks = b.column(2).to_numpy(zero_copy_only=False)
            stands = [(row, as_data(x, largest), False)]
            if asks.any():
                stands.append((row[asks], as_queries(x[asks]), True))
            for c, curve in enumerate(curves):
                for rows, points, ask in stands:
                    yield pa.RecordBatch.from_pydict({"curve": pa.array(np.full(len(rows), c, np.int32)), "key": curve.keys(points), "asks": np.full(len(rows), ask), "row": rows})

    return vectors.select("row", "embedding", "is_query").mapInArrow(run, "curve int, key long, asks boolean, row long")


def ranks(keys: DataFrame, n: int) -> DataFrame:
    """Keys -> curve, asks, row, rank: data rows before it on its curve of n.

    Spark range-partitions and sorts the keys; the partitions' counts (one number
    each) turn places in a partition into places on the curve.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            data = ~b.column(1).to_numpy(zero_copy_only=False)
            run = before + np.cumsum(data) - data
            before += int(data.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(run)], names=["curve", "asks", "row", "part", "place"])

    order = ["curve", "key", "asks", "row"]
    sorted_ = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("curve", "asks", "row")
    placed = staged(sorted_.mapInArrow(place, "curve int, asks boolean, row long, part int, place long"), "hilbert-places")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count_if(~F.col("asks")).alias("n")).collect()}
    size = max(counts, default=0) + 1
    offsets = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(size)])])
    offset = F.element_at(F.array(*[F.lit(int(o)) for o in offsets]), F.col("part") + 1)
    return placed.select("curve", "asks", "row", (offset + F.col("place") - F.col("curve") * F.lit(n)).alias("rank"))


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k best found for every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    dim = dimension(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = staged(vectors.withColumn("is_query", is_query).withColumn("row", F.monotonically_increasing_id()), "hilbert-vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = as_data(sample_rows(rows, SAMPLE, seed=6), largest)
    made = [Curve(c, dim + 1, dims, bits, sample) for c in range(curves)]
    on_curves = ranks(curve_keys(rows, largest, made), n)
    blocks = -(-n // block)
    around = max(1, round(share * n / 2 / block))
    at = F.least(F.floor(F.col("rank") / block), F.lit(blocks - 1))
    spots = on_curves.withColumn("at", at).withColumn("first", F.col("curve") * F.lit(blocks))
    reach = F.sequence(F.greatest(F.col("at") - around, F.lit(0)), F.least(F.col("at") + around, F.lit(blocks - 1)))
    spots = spots.withColumn("to", F.when(F.col("asks"), reach).otherwise(F.array("at")))
    spots = spots.select("row", "asks", F.explode("to").alias("to"), "first").select("row", "asks", (F.col("first") + F.col("to")).cast("bigint").alias("block"))
    dealt = spots.join(rows.select("row", "vec_id", "embedding"), "row")

    def score(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        d, q = np.vstack(data["embedding"].to_list()), np.vstack(asked["q_embedding"].to_list())
        return pd.DataFrame(best(asked["q_id"].to_numpy(), q, data["vec_id"].to_numpy(), d, k))

    data = dealt.filter(~F.col("asks")).select("block", "vec_id", "embedding").groupBy("block")
    asked = dealt.filter("asks").select(F.col("block").alias("q_block"), F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding")).groupBy("q_block")
    return ranked(data.cogroup(asked).applyInPandas(score, FOUND), k)


def op5_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), skip_zero=True)
    return neighbours(vectors, F.col("vec_id") % QUERY_STEP == 0)
