"""What both searches of vectors share: usable rows, samples, local scoring, ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, skip_zero: bool) -> DataFrame:
    """(vec_id, embedding) with embeddings of doubles, without rows whose id is
    null or whose embedding is null, empty, holds null or non-finite components
    or (if asked) is zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    out = out.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad)
    return out.filter(F.exists(v, lambda x: x != 0)) if skip_zero else out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of doubles as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def dimension(vectors: DataFrame) -> int:
    """The vectors' length, 0 without vectors; different lengths cannot be compared and raise."""
    sizes = [r[0] for r in vectors.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return sizes[0] if sizes else 0


def sample_rows(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """n vectors (fewer, if there are fewer) of the smallest hashes: a bounded, repeatable sample."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n).collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


def best(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k largest inner products of each query with the block, its own id left
    out, ties to the smaller id.

    The product of the matrices only names the candidates, with a margin for its
    rounding, which depends on a row's place; they are scored again one by one.
    """
    rough = q @ d.T
    rough[d_ids[None, :] == q_ids[:, None]] = -np.inf
    kept = min(k + len(d_ids) - len(np.unique(d_ids)), rough.shape[1])  # room for rows that repeat an id
    cut = np.partition(rough, rough.shape[1] - kept, axis=1)[:, rough.shape[1] - kept]
    margin = 1e-12 * (np.linalg.norm(q, axis=1) * (np.linalg.norm(d, axis=1).max() if len(d) else 0))
    row, col = np.nonzero((rough >= (cut - margin)[:, None]) & np.isfinite(rough))
    score = (q[row] * d[col]).sum(axis=1)
    order = np.lexsort((d_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    if kept > k:
        once = np.sort(np.unique(np.column_stack([row, d_ids[col]]), axis=0, return_index=True)[1])
        row, col, score = row[once], col[once], score[once]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return {"query_id": q_ids[row[keep]], "vec_id": d_ids[col[keep]], "score": score[keep]}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score), pairs possibly repeated -> the k best of each query.

    An id counts once, with its best score.  Spark cuts each task's rows to k a
    query before they are shuffled.
    """
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
