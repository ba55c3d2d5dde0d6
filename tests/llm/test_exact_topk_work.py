"""Work of the exact search: no query copies through the driver, few copies, exact products in narrow forms."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import exact_topk

VECTORS = "vec_id long, embedding array<double>"


def _plain(q_ids, q, ids, d, k):
    out = []
    for i, own in enumerate(q_ids):
        best = {}
        for j, x in zip(ids, (d @ q[i]).tolist(), strict=True):
            if j != own:
                best[int(j)] = max(best.get(int(j), -np.inf), x)
        out.append(sorted(((-s, j) for j, s in best.items()))[:k])
    return out


@pytest.mark.parametrize("cells", [40, 1 << 18])
@pytest.mark.parametrize("repeats", [1, 7, 500])
def test_best_of_a_block_counts_ids_once_and_orders_ties(monkeypatch, cells, repeats):
    monkeypatch.setattr(exact_topk, "SCORE_CELLS", cells)
    rng = np.random.default_rng(repeats)
    for values in (1, 2, 300):
        d = rng.integers(-values, values + 1, (500, 6)).astype("<f4")
        ids = np.sort(rng.integers(0, 500 // repeats + 1, 500))
        q_ids, q = ids[::50], d[::50]
        row, got, score = exact_topk.best_whole(q_ids, q, ids, d, 5)
        mine = [[(-s, j) for s, j in zip(score[row == r].tolist(), got[row == r].tolist(), strict=True)] for r in range(len(q))]
        assert mine == _plain(q_ids, q, ids, d, 5)


def test_products_beyond_single_precision_stay_exact(spark):
    """Scores apart by one above 2 ** 24, and components too large for 16 bits."""
    for one in (5_000, 40_000, 3_000_000):
        rows = [(i, [float(one), float(one + i % 3), float(i // 3 % 2)]) for i in range(60)]
        got = {}
        for r in exact_topk.top_products(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        for q in (0, 20, 40):
            scores = [(-sum(int(a) * int(b) for a, b in zip(rows[q][1], x, strict=True)), i) for i, x in rows if i != q]
            assert got[q] == [(-s, i) for s, i in sorted(scores)[:5]]


def test_copies_of_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.integers(-90, 90, (400, 8)))], VECTORS)
    found = exact_topk.top_products(df, F.col("vec_id") % 10 == 0, block=20)
    found.collect()
    final = re.split("== (?:Initial|Physical)", found._jdf.queryExecution().toString().split("== Final Plan ==")[-1])[0]
    assert "SortMergeJoin" in final and "BroadcastExchange" not in final


def test_blocks_are_as_large_as_tasks_and_bytes_allow():
    assert exact_topk.block_rows(51_282, 128, 12) == exact_topk.LEAST_ROWS
    assert exact_topk.block_rows(15_000_000, 128, 32) == exact_topk.BLOCK_BYTES // 128
    assert exact_topk.block_rows(15_000_000, 16 << 20, 32) == 1
    assert [exact_topk.whole_form(x) for x in (300.0, 40_000.0, 2.0**25)] == ["<i2", "<f4", "<f8"]
