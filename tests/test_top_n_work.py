"""Work of the exact top-N: pairs scored, copies sent, results against plain ones."""

import numpy as np
import pytest

from reelspark.operators import recommend


def _searched(keys, others, ids, n, known=None, least=None):
    """Per key, what the leaves of one pair of blocks give (positions as ids), in the order of ``keys``."""
    k_order = recommend.leaf_order(np.arange(len(keys)), keys, recommend.KEY_LEAF)
    o_order = recommend.leaf_order(ids, others, recommend.OTHER_LEAF)
    place = np.argsort(o_order)
    block, out = recommend._Others(ids[o_order], others[o_order]), [[] for _ in keys]
    for at in range(0, len(keys), recommend.KEY_LEAF):
        here, seen = k_order[at : at + recommend.KEY_LEAF], None
        if known is not None:
            row, col = np.nonzero(known[here])
            order = np.argsort(place[col], kind="stable")
            seen = row[order], place[col][order]
        row, position, score = block.best(keys[here], n, seen, None if least is None else least[here])
        for r, p, s in zip(row, position, score, strict=True):
            out[here[r]].append((int(block.ids[p]), float(s)))
    return out


def _plain(keys, others, ids, n, known=None):
    out = []
    for i, k in enumerate(keys):
        score = recommend.exact_scores(np.broadcast_to(k, others.shape), others)
        left = np.arange(len(ids)) if known is None else np.flatnonzero(~known[i])
        best = left[np.lexsort((ids[left], -score[left]))][:n]
        out.append([(int(ids[j]), float(score[j])) for j in best])
    return out


@pytest.mark.parametrize("n", [1, 9, 700])
def test_leaves_give_the_plain_top_n(n):
    """Few values (ties everywhere), negative ones, more wanted than there are, seen ones, leaves cut short."""
    rng = np.random.default_rng(n)
    for draw in (lambda s: rng.normal(size=s), lambda s: rng.integers(-2, 3, s) / 4, np.zeros):
        keys, others, ids = draw((270, 3)), draw((1100, 3)), rng.permutation(1100) - 5
        known = rng.random((270, 1100)) < 0.4
        known[3] = True
        assert _searched(keys, others, ids, n) == _plain(keys, others, ids, n)
        assert _searched(keys, others, ids, n, known) == _plain(keys, others, ids, n, known)
        want = _plain(keys, others, ids, n)
        least = np.array([w[-1][1] for w in want])
        assert _searched(keys, others, ids, n, None, least) == want


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e-160, 1e17, 1e30, 1e120])
def test_scores_apart_by_less_than_single_precision_are_told_apart(scale):
    """Products are rough; what they cannot tell apart, underflows or overflows is scored in float64."""
    rng = np.random.default_rng(5)
    keys, one = rng.random((30, 4)) * scale, rng.random(4)
    others = one * (1 + rng.integers(-300, 300, (1500, 1)) * 1e-12) + (rng.random((1500, 4)) < 0.05) * 1e-9
    others[::50] = rng.normal(size=(30, 4)) * 1e-3
    ids = rng.permutation(1500)
    for few in (others, others * scale):
        assert _searched(keys, few, ids, 12) == _plain(keys, few, ids, 12)


def test_products_are_single_and_finds_are_merged_in_lots(monkeypatch):
    """Independent non-negative coordinates, where leaves rule out little: the work of a step."""
    rng = np.random.default_rng(4)
    keys, others, steps, merges = rng.random((256, 10)), rng.random((60_000, 10)), [], []
    plain, cut, matmul = recommend.best_of_block, recommend._cut, []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            matmul.append(np.result_type(self, other))
            return np.asarray(self) @ np.asarray(other)

    def counted(k, o, *rest):
        steps.append(len(k))
        return plain(k.view(Watched), o, *rest)

    monkeypatch.setattr(recommend, "best_of_block", counted)
    monkeypatch.setattr(recommend, "_cut", lambda *a: merges.append(1) or cut(*a))
    ids = rng.permutation(len(others))
    got = _searched(keys, others, ids, 10)
    assert set(matmul) == {np.dtype(np.float32)} and len(matmul) == len(steps)
    assert len(merges) - len(steps) < 0.7 * len(steps)  # each step cuts once itself
    assert got[:40] == _plain(keys[:40], others, ids, 10)


def test_most_pairs_are_never_scored(monkeypatch):
    rng = np.random.default_rng(2)
    keys, others = rng.normal(size=(20_000, 4)), rng.normal(size=(40_000, 4))
    cells, plain = [], recommend.best_of_block

    def counted(k, o, *rest):
        cells.append(len(k) * len(o))
        return plain(k, o, *rest)

    monkeypatch.setattr(recommend, "best_of_block", counted)
    ids = rng.permutation(len(others))
    got = _searched(keys, others, ids, 10)
    assert sum(cells) < 0.3 * len(keys) * len(others)
    some = slice(0, len(keys), 2000)
    assert got[some] == _plain(keys[some], others, ids, 10)


def test_copies_sent_follow_the_larger_side_slowly():
    """Rows sent to pairs of blocks for a million keys and others, and six times as many."""
    for times in (1, 6):
        n = 1_000_000 * times
        k, o = recommend.block_counts(n, n, 32)
        assert k * o >= 64 and n * (k + o) <= 45 * n
    assert recommend.block_counts(1, 5_000_000, 8) == (1, 16) and recommend.block_counts(1, 1, 8) == (1, 1)


def test_fit_and_predictions_prepare_the_ratings_once(spark, smoke_dir):
    """The test rows come from the stored table, the same as the split gives, and are not prepared again."""
    from reelspark.plans import queries as Q

    train, test = Q._stored_split(spark, smoke_dir)
    for got, want in zip((train, test), Q._split(spark, smoke_dir), strict=True):
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = Q.q_als_predictions(spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_equal_rows_are_dealt_to_leaves_by_id():
    """Of equal others in many leaves only the first leaf can hold the smallest ids: the rest is not scored."""
    rng = np.random.default_rng(3)
    few, ids = rng.integers(-6, 7, (13, 4)) / 8, rng.permutation(60_000)
    others = few[rng.integers(0, 13, len(ids))]
    order = recommend.leaf_order(ids, others, recommend.OTHER_LEAF)
    for one in few:
        same = np.flatnonzero((others[order] == one).all(axis=1)) // recommend.OTHER_LEAF
        of = ids[order][(others[order] == one).all(axis=1)]
        last = [of[same == leaf].max() for leaf in np.unique(same)]
        first = [of[same == leaf].min() for leaf in np.unique(same)]
        assert all(a < b for a, b in zip(last, first[1:]))


def test_ties_cost_few_scores(monkeypatch):
    rng = np.random.default_rng(6)
    keys = np.repeat(rng.integers(-6, 7, (4, 4)) / 8, 256, axis=0)
    others = (rng.integers(-6, 7, (13, 4)) / 8)[rng.integers(0, 13, 100_000)]
    cells, plain = [], recommend.best_of_block

    def counted(k, o, *rest):
        cells.append(len(k) * len(o))
        return plain(k, o, *rest)

    monkeypatch.setattr(recommend, "best_of_block", counted)
    ids = rng.permutation(len(others))
    got = _searched(keys, others, ids, 10)
    assert sum(cells) < 0.01 * len(keys) * len(others)
    assert got[::128] == _plain(keys[::128], others, ids, 10)


@pytest.mark.parametrize("scale", [1.0, 1e-160, 1e-30, 1e17, 1e30])
def test_rough_bounds_hide_nothing(scale):
    """No leaf that a key may need is missing, and no bound is below the exact one."""
    rng = np.random.default_rng(7)
    keys, others = rng.normal(size=(256, 5)) * scale, rng.normal(size=(9_000, 5)) * scale
    ids = np.arange(len(others))
    order = recommend.leaf_order(ids, others, recommend.OTHER_LEAF)
    block = recommend._Others(ids[order], others[order])
    exact = recommend._bounds(keys, keys, block.lo, block.hi)
    cut = np.median(exact, axis=1)
    leaves = rng.permutation(len(block.lo))
    left, bound, room = block._rough_bounds(keys, cut, leaves)
    assert set(np.flatnonzero((exact >= cut[:, None]).any(axis=0))) <= set(left)
    assert (bound >= exact[:, left]).all()
    assert (bound - 2 * room[:, None] <= exact[:, left]).all()
    block._sharpen(bound, np.ones(len(left), bool), room, keys, bound[:, 0] - room, left)
    assert (bound[:, 0] == exact[:, left[0]]).all()


def test_many_partitions_do_not_multiply_copies():
    """Pairs of little work are not cut further: with 200 partitions no more copies travel than the work calls for."""
    k, o = recommend.block_counts(1_200_000, 900_000, 200)
    assert 64 <= k * o <= 200 and k + o <= 70
    k, o = recommend.block_counts(7_200_000, 5_400_000, 200)
    assert k * o >= 400 and k + o <= 60


def test_factors_are_worked_out_once(spark, smoke_dir):
    """Counting the factors does not read the tables a second time."""
    from reelspark.plans import queries as Q

    for name in ("topn_users", "topn_items", "topn_subset", "topn_batch"):
        plan = Q.QUERIES[name](spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
        assert "o_custkey" not in plan, name


def test_pruned_top_n_merges_no_wave_twice(spark, monkeypatch):
    """Buckets go in few waves, and what the last one finds is not stored before it is nested."""
    from reelspark.operators import pruned

    rng, stored, plain = np.random.default_rng(8), [], pruned.staged
    monkeypatch.setattr(pruned, "staged", lambda df, name, *a: stored.append(name) or plain(df, name, *a))
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<float>")
    users, items = frame(rng.normal(size=(40, 3))), frame(rng.normal(size=(600, 3)))
    got, work = pruned.pruned_top_n(users, items, 600, bucket_rows=30)  # all are wanted: no bucket can go
    waves = work.count()
    assert waves <= 3 and stored.count("norm-best") == waves - 1
    assert sorted(map(str, got.collect())) == sorted(map(str, recommend.top_n(users, items, 600).collect()))


def _fitted_like(rng, rows, rank=10):
    """Like fitted factors: non-negative, many zeros, norms alike."""
    return np.maximum(rng.normal(0.5, 0.5, (rows, rank)), 0)


@pytest.mark.parametrize("n", [1, 10, 60])
def test_directions_give_the_plain_top_n(monkeypatch, n):
    """Where boxes rule out little, groups of keys of like direction do: same results, few scores."""
    rng, cells, used = np.random.default_rng(n), [], []
    keys, others, ids = _fitted_like(rng, 6_000), _fitted_like(rng, 60_000), rng.permutation(60_000) - 7
    others[500:540], others[900:3_000:2] = others[500], others[901:3_001:2] * (1 + 1e-9)  # ties and scores hardly apart
    plain, scored = recommend.best_of_block, recommend._ByNorm._scored

    def counted(k, o, *rest):
        cells.append(len(k) * len(o))
        return plain(k, o, *rest)

    def counted_too(self, k, cols, *rest):
        used.append(len(k) * len(cols))
        return scored(self, k, cols, *rest)

    monkeypatch.setattr(recommend, "best_of_block", counted)
    monkeypatch.setattr(recommend._ByNorm, "_scored", counted_too)
    got = _searched(keys, others, ids, n)
    assert sum(cells) + sum(used) < 0.15 * len(keys) * len(others)
    some = slice(0, len(keys), 131)
    assert got[some] == _plain(keys[some], others, ids, n)


@pytest.mark.parametrize("signs", [False, True])
def test_directions_heed_what_is_seen_and_what_is_enough(signs):
    rng = np.random.default_rng(9)
    keys, others, ids = _fitted_like(rng, 700, 8), _fitted_like(rng, 9_000, 8), rng.permutation(9_000)
    if signs:
        keys, others = keys - 0.4, others - 0.4
    known = rng.random((700, 9_000)) < 0.3
    known[:, np.argsort(-others.sum(axis=1))[:60]] = True  # the best for all
    known[3] = True
    known[5, 4:] = True
    assert _searched(keys, others, ids, 9, known) == _plain(keys, others, ids, 9, known)
    want = _plain(keys, others, ids, 9)
    least = np.array([w[4][1] for w in want])
    got = _searched(keys, others, ids, 9, None, least)
    assert [[x for x in g if x[1] >= low] for g, low in zip(got, least)] == [[x for x in w if x[1] >= low] for w, low in zip(want, least)]


def test_directions_leave_out_nothing_that_is_wanted(monkeypatch):
    """Also for single keys, keys all alike or opposite, others of one norm, and few or odd values."""
    monkeypatch.setattr(recommend, "SCORED", 0.5)  # nearly every block turns
    rng = np.random.default_rng(11)
    for draw in (lambda s: rng.normal(size=s), lambda s: rng.integers(-2, 3, s) / 4, lambda s: _fitted_like(rng, *s), lambda s: np.exp(3 * rng.normal(size=s))):
        keys, others, ids = draw((600, 5)), draw((4_000, 5)), rng.permutation(4_000)
        keys[300:400] = keys[300]
        keys[400:420] = -keys[380]
        keys[0], others[:10] = 0, 0
        assert _searched(keys, others, ids, 7) == _plain(keys, others, ids, 7)


def test_the_strongest_others_bound_what_pairs_return(spark, monkeypatch):
    """Large jobs: same lists, and hardly more than n rows of a key come from all blocks together."""
    rng, given, plain = np.random.default_rng(12), [], recommend.nested
    monkeypatch.setattr(recommend, "PAIR_SCORES", 1)
    monkeypatch.setattr(recommend, "nested", lambda found, *a: given.append(found) or plain(found, *a))
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, features array<float>")
    users, items = frame(_fitted_like(rng, 300)), frame(np.concatenate([_fitted_like(rng, 3_000), np.repeat(_fitted_like(rng, 3), 200, axis=0)]))
    for n in (1, 10):
        got = recommend.top_n(users, items, n, key_blocks=2, other_blocks=6)
        assert given[-1].count() < 2.5 * n * 300
        monkeypatch.setattr(recommend, "STRONGEST", 0)
        want = recommend.top_n(users, items, n, key_blocks=2, other_blocks=6)
        assert given[-1].count() == 6 * n * 300
        monkeypatch.setattr(recommend, "STRONGEST", 1 << 16)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    some = items.limit(100)  # fewer strong ones than are wanted: no bound
    assert recommend.top_n(users, some, 10).selectExpr("sum(size(recommendations))").first()[0] == 3_000
