"""Exact top-k search by a Voronoi kNN join, for the largest inner products.

Vectors x become floor(scale * x), whole numbers, so scores are exact.  Data and
queries are grouped by their nearest pivot.  Summaries of the groups (rows,
radius around the pivot, largest norm) give bounds: for a query q of a group with
centre u and radius s, and data x of a cell with pivot p and radius r,

    <u,p> - s|p| - N r  <=  <q,x>  <=  <u,p> + s|p| + N r      (N: largest |q|)

so a group's k-th score is at least the largest lower bound that cells with k + 1
rows in all reach, and cells whose upper bound is below that cannot matter.  Only
the others meet the group: cells are cut into blocks of bounded bytes, a query block
goes to each block it needs (data are shuffled once), and blocks are solved locally and
merged.  Blocks are as large as the tasks allow, so that few copies of the queries
travel; the join is a merge of both sides' blocks, since Spark does not see how many
rows the copies make and would send them all to the driver to broadcast them.

Whole numbers are packed in the narrowest exact form, and their products are exact:
in single precision up to 2 ** 24, in double precision beyond.

Pivots are a bounded sample; the bounds are computed from one row a pivot.  A cell
or a vector that holds a third of all rows only makes more blocks.

Edge cases: vectors that are null, empty or hold null or non-finite components and
rows without an id take no part; rows repeating an id count once, with their best
score; fewer candidates than k give fewer rows; an empty table gives none; numbers
whose inner products could pass 2 ** 53 raise, as doubles would round them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import staged, table
from reelspark.llm.vectors import FOUND, dimension, lists, matrix, ranked, sample_rows, usable

SCALE = 256
PIVOTS = 16
#: Bytes of a packed block at most, and the rows that blocks are not cut under for the sake of more tasks.
BLOCK_BYTES, LEAST_ROWS = 8 << 20, 8_192
#: Blocks of data wanted for each shuffle partition.
BLOCKS_PER_PARTITION = 2
#: Queries scored at once, and their scores held at once.
QUERY_ROWS, SCORE_CELLS = 256, 1 << 18
K = 5
QUERY_STEP = 50


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, embedding) -> the same with cell, away (distance to its pivot) and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            square = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None, :]
            cell = square.argmin(axis=1)
            away = np.linalg.norm(x - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(x), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.linalg.norm(x, axis=1))], names=["vec_id", "embedding", "cell", "away", "norm"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, cell int, away double, norm double")


def summaries(placed: DataFrame, pivots: int) -> dict[str, np.ndarray]:
    """Rows, radius and largest norm of every cell (0 where it is empty)."""
    out = {"n": np.zeros(pivots, np.int64), "radius": np.zeros(pivots), "norm": np.zeros(pivots)}
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect():
        for name in out:
            out[name][r["cell"]] = r[name]
    return out


def needed_cells(pivots: np.ndarray, groups: dict[str, np.ndarray], cells: dict[str, np.ndarray], k: int) -> np.ndarray:
    """needed[g, c]: whether cell c can hold one of the k best of a query of group g."""
    middle = pivots @ pivots.T
    slack = groups["radius"][:, None] * np.linalg.norm(pivots, axis=1)[None, :] + groups["norm"][:, None] * cells["radius"][None, :]
    slack = slack * (1 + 1e-9) + 1e-9 * (1 + np.abs(middle))
    low, high = middle - slack, middle + slack
    needed = np.zeros_like(middle, dtype=bool)
    for g in range(len(pivots)):
        order = np.argsort(-low[g], kind="stable")
        enough = np.cumsum(cells["n"][order]) >= k + 1  # one of them may be the query itself
        at_least = low[g][order[np.argmax(enough)]] if enough.any() else -np.inf
        needed[g] = (high[g] >= at_least) & (cells["n"] > 0) & (groups["n"][g] > 0)
    return needed


def _cut(cells: dict[str, np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the number of blocks and the first block's number."""
    parts = -(-cells["n"] // block)
    return parts, np.cumsum(parts) - parts


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _blocked(placed: DataFrame, parts: np.ndarray, first: np.ndarray, seed: int) -> DataFrame:
    at = F.col("cell") + 1
    turn = F.pmod(F.xxhash64(F.lit(seed), "vec_id", F.monotonically_increasing_id()), F.element_at(_numbers(np.maximum(parts, 1)), at))
    return placed.withColumn("block", (F.element_at(_numbers(first), at) + turn).cast("bigint"))


def block_rows(n: int, row_bytes: int, partitions: int) -> int:
    """Rows of a block of data: of bounded bytes, and blocks enough for all partitions where rows allow it."""
    return max(1, min(BLOCK_BYTES // row_bytes, max(LEAST_ROWS, -(-n // (BLOCKS_PER_PARTITION * partitions)))))


def whole_form(norm: float) -> str:
    """The narrowest form that holds whole vectors up to this norm."""
    return "<i2" if norm < 2.0**15 - 1 else "<f4" if norm < 2.0**24 - 1 else "<f8"


def packed(keyed: DataFrame, form: str, prefix: str) -> DataFrame:
    """Rows (block, vec_id, embedding) -> one row a block: block, ids and vectors packed, by id."""

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["embedding"].chunks]).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        cells = (ids[order].astype("<i8"), x[order].astype(form))
        return pa.table({"block": rows["block"][:1], **{f"{prefix}_{n}": pa.array([v.tobytes()], pa.binary()) for n, v in zip(("ids", "vectors"), cells, strict=True)}})

    return keyed.select("block", "vec_id", "embedding").groupBy("block").applyInArrow(pack, f"block bigint, {prefix}_ids binary, {prefix}_vectors binary")


def _once(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, best first, ties to the smaller id; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])])[: len(row)]
    row, ids, score = row[new], ids[new], score[new]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def best_whole(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score): the k largest products of each query with the data, its own
    id left out; ``d_ids`` ascend and may repeat, products are exact in the vectors' form.

    Later rows have larger ids, so a tie with the k-th score so far is lost.
    """
    none = np.finfo(q.dtype).min
    held, found, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
    cut, step = np.full(len(q), none, q.dtype), max(k, SCORE_CELLS // len(q))
    lo, hi = np.searchsorted(d_ids, q_ids), np.searchsorted(d_ids, q_ids, side="right")
    own = np.flatnonzero(lo < hi)
    for at in range(0, len(d), step):
        ids, score = d_ids[at : at + step], q @ d[at : at + step].T
        for r in own[(lo[own] < at + len(ids)) & (hi[own] > at)]:
            score[r, max(0, lo[r] - at) : hi[r] - at] = -np.inf
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if len(starts) < len(ids):
            ids, score = ids[starts], np.maximum.reduceat(score, starts, axis=1)
        if not at and len(ids) > k:
            nth = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            level = score == nth[:, None]
            reach = (score > nth[:, None]) | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k))
            cut = np.maximum(nth, none)
            reach &= score > none
        else:
            reach = score > cut[:, None]
        row, col = np.divmod(np.flatnonzero(reach), len(ids))
        if len(row):
            found.append((row, ids[col], score[row, col].astype("<f8")))
            waiting += len(row)
        if found and (waiting >= len(q) or at + step >= len(d)):  # until then the cuts are too low, which loses nothing
            held = _once(*(np.concatenate(x) for x in zip(held, *found, strict=True)), k)
            found, waiting = [], 0
            full = np.bincount(held[0], minlength=len(q)) == k
            last = np.searchsorted(held[0], np.flatnonzero(full), side="right") - 1
            cut[full] = held[2][last]
    return held


def score_pairs(k: int, form: str, product: str):
    """Rows of a query block beside a data block -> the best of each query in that block."""

    def vectors(b: pa.RecordBatch, j: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b[f"{prefix}_ids"][j].as_buffer(), "<i8")
        return ids, np.frombuffer(b[f"{prefix}_vectors"][j].as_buffer(), form).reshape(len(ids), -1).astype(product)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                (qi, q), (di, d) = vectors(b, j, "q"), vectors(b, j, "d")
                for at in range(0, len(q), QUERY_ROWS):
                    asked = qi[at : at + QUERY_ROWS]
                    row, ids, score = best_whole(asked, q[at : at + QUERY_ROWS], di, d, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, block: int | None = None) -> DataFrame:
    """(vec_id, embedding) of whole numbers -> query_id, rank, vec_id, score: the k
    largest inner products of every row that ``is_query`` holds for, with all other rows.
    ``block``: rows of a block at most, unless left to the row count."""
    spark = vectors.sparkSession
    length = dimension(vectors)
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = sample_rows(vectors, pivots, seed=5)
    placed = staged(assign(vectors, centres), "voronoi-cells")
    queries = placed.filter(is_query)
    cells, groups = summaries(placed, len(centres)), summaries(queries, len(centres))
    largest = cells["norm"].max() * groups["norm"].max()
    if largest >= 2.0**53:
        raise ValueError("inner products could pass 2 ** 53")
    needed = needed_cells(centres, groups, cells, k)
    form, wide = whole_form(cells["norm"].max()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = block or block_rows(int(cells["n"].sum()), length * np.dtype(form).itemsize, wide)
    parts, first = _cut(cells, block)
    q_parts, q_first = _cut(groups, block)
    tasks = int(min(2 * max(1, parts.sum()), 4 * wide))  # few blocks: room to spread
    data = packed(_blocked(placed, parts, first, 1), form, "d")
    asked = packed(_blocked(queries, q_parts, q_first, 2), form, "q")
    # one row for each group and block it needs: pivots x blocks, sent as a table
    wanted = F.array(*[F.array(*[F.lit(int(c)) for c in np.flatnonzero(needed[g])]).cast("array<int>") for g in range(len(centres))])
    group = sum((F.when(F.col("block") >= int(a), 1).otherwise(0) for a in q_first[1:]), F.lit(0)) if len(q_first) > 1 else F.lit(0)
    asked = asked.withColumn("cell", F.explode(F.element_at(wanted, (group + 1).cast("int"))))
    span = F.sequence(F.element_at(_numbers(first), F.col("cell") + 1), F.element_at(_numbers(first + np.maximum(parts, 1) - 1), F.col("cell") + 1))
    asked = asked.select("q_ids", "q_vectors", F.explode(span).alias("block")).withColumn("block", F.col("block").cast("bigint"))
    # a count of partitions that is asked for stays as it is; the rows are few and large
    met = asked.repartition(tasks, "block").join(data.repartition(tasks, "block").hint("merge"), "block")
    product = "<f4" if largest < 2.0**24 - 1 else "<f8"
    found = met.select("q_ids", "q_vectors", "d_ids", "d_vectors").mapInArrow(score_pairs(k, form, product), FOUND)
    return ranked(found, k).withColumn("score", F.col("score").cast("bigint")).select("query_id", "rank", "vec_id", "score")


def op6_voronoi_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), skip_zero=False))
    return top_products(vectors, F.col("vec_id") % QUERY_STEP == 0)


#: DuckDB: every query against every row.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
