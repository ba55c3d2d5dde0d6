"""Top-N recommendation from factor tables, unnesting and catalog join.

Exact top-N has to look at every (key, other) pair, but not to score it.  One plan
serves every size: both factor tables are dealt by a hash of the id to blocks of
bounded size, each block is one packed row, and every pair of a key block and an other
block is a row of its own, dealt to the tasks by the pair's number: an explicit
partition count follows the pairs, so all cores score whichever side is the larger.
Blocks are large, so that few copies of them travel.  At most N rows per key leave a
pair; Spark merges them with a window that it cuts to N before the shuffle.

Within a block, halving along the widest coordinate puts neighbours together in leaves
of bounded size.  The box of a leaf bounds every score in it: the sum over the rank of
the larger product with a corner, added in the order in which scores are added, so that
rounding cannot lift a score above its bound.  Leaves are worked off by falling bound,
a leaf of keys at a time, and a key skips the leaves that its N-th score so far rules
out (at a tie: those that have no smaller id).
A matrix product gives these bounds, lifted by its rounding; where that may hide a tie
they are worked out exactly.  Halving keeps equal rows in the order of their ids, so a tie
reaches few leaves.

Where boxes rule out little (fitted factors of many coordinates), the others are taken one
by one instead, by falling norm: keys go in small groups of like direction, and an other
shorter than a group's lowest wanted score (a unit of key) or too far from its middle
direction for its norm is out for all of them.  Others that were best for earlier keys
are scored first, so that this score is high from the start.

A matrix product (``mapInArrow``) names the candidates of some leaves, with a margin for
its rounding; only these are scored again, as sums of the rank's products in the
order of the rank, in float64.  So a score does not depend on how the tables are cut
into blocks.  The order is score descending, then the smaller id, within blocks and
between them.  Nothing is collected or broadcast by hand; the only driver-side
figures are counts.

In large jobs every block of keys first meets the others of the largest norms: the N-th score
there is a bound below which a key wants nothing, so that pairs leave few rows to merge.

Rows that a key has seen can be left out: they travel with their block pair, packed,
and are masked before the cut, so that N unseen ones remain.

The nested form is Spark ML's: (key, recommendations array<struct<other, rating>>).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.staging import staged
from reelspark.session import ensure_checkpoint_dir, spark_context

#: Largest blocks, and the smallest that rows are cut to for the sake of more tasks.
KEY_BLOCK_ROWS, OTHER_BLOCK_ROWS = 1 << 18, 1 << 20
LEAST_KEY_ROWS, LEAST_OTHER_ROWS = 256, 4_096
#: Rows of a leaf on either side.
KEY_LEAF, OTHER_LEAF = 256, 128
#: Pairs wanted for each shuffle partition, pairs that a task scores at most, seen rows that a pair holds on average at most.
PAIRS_PER_PARTITION, PAIRS_PER_TASK, SEEN_PER_PAIR = 2, 8, 1 << 21
#: Pairs that are enough where each has no more scores than that: more of them only send more copies, and leaves of small blocks are wide.
FEW_PAIRS, PAIR_SCORES = 64, 1 << 34
#: Others of the largest norms that give each key its first bound: at most, and one in so many.
STRONGEST, STRONG_SHARE = 1 << 16, 64
#: Copies of all others beyond which these are cut instead, unless the keys are too many.
COPIES = 32
#: Scores held at once (twice as many where leaves rule out little after some steps), finds of a key (on average) that wait to be merged, those steps.
SCORE_CELLS, WAITING, STEPS = 1 << 18, 2, 16
#: Leaves up to which rough bounds are looked through for ties more than once.
FEW_LEAVES = 1_024
#: For a matrix product in a number format: the share of |key| * |other|, a term of the sum, that two
#: of its scores can be moved by, and what is lost where numbers are too small for the format.
ROUNDING = {np.float32: (1.3e-7, 1e-37), np.float64: (1e-13, 0.0)}
#: Norms from which products are not trusted to single precision.
LARGE = 1e18
#: Keys of a group of like direction (fewer, more or the first guess, by the others it leaves), and others whose norms are taken as equal.
GROUPS, GROUP, NORM_STEP = (8, 128), 32, 512
#: Shares of the others (one in so many) that a group leaves when it is halved or doubled.
MANY, FEW = 32, 128
#: Others scored first for all keys at most, and the share of all scores (one in so many) after which directions decide.
FIRST, SCORED = 4_096, 8
#: Norms between which directions decide, and rounding of a product with a middle direction, a term and a unit of norm.
MIDDLE, ROOM = (1e-12, 1e12), 4e-7
_LAST_ID = np.iinfo(np.int64).max


def _check_n(n: int) -> int:
    if n is None or int(n) < 0:
        raise ValueError(f"number of recommendations must be non-negative, got {n!r}")
    return int(n)


def leaf_order(ids: np.ndarray, features: np.ndarray, leaf: int) -> np.ndarray:
    """The order of rows in which every ``leaf`` rows in turn are neighbours, by id; of equal rows
    in several leaves the smaller ids come first."""
    order, parts = np.argsort(ids, kind="stable"), [(0, len(ids))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo <= leaf:
            continue
        here = features[order[lo:hi]]
        spread = here.max(axis=0, initial=-np.inf) - here.min(axis=0, initial=np.inf)
        if not (spread > 0).any():
            continue
        half = leaf * (-(-(hi - lo) // leaf) // 2)
        value = here[:, int(np.argmax(spread))]
        middle = np.partition(value, half)[half]
        side = np.sign(value - middle) if np.isfinite(middle) else np.zeros(hi - lo)
        order[lo:hi] = np.concatenate([order[lo:hi][side == x] for x in (-1, 0, 1)])  # rows of a side stay in their order
        parts += [(lo, lo + half), (lo + half, hi)]
    return order


def _width(factors: DataFrame) -> str:
    """The number format of packed features."""
    return "<f8" if factors.schema["features"].dataType.elementType.typeName() == "double" else "<f4"


def packed_blocks(dealt: DataFrame, count: int, name: str, leaf: int, by: str = "block") -> DataFrame:
    """(block, id, features, more doubles) -> one packed row a block, its rows by leaf, as ``name``."""
    width = _width(dealt)
    more = [c for c in dealt.columns if c not in (by, "id", "features")]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows["id"].to_numpy()
        features = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["features"].chunks]).astype(width).reshape(len(ids), -1)
        order = leaf_order(ids, features, leaf)
        cells = {"ids": ids[order].astype("<i4"), "features": features[order], **{c: rows[c].to_numpy()[order].astype("<f8") for c in more}}
        packed = pa.StructArray.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in cells.values()], names=list(cells))
        return pa.table({by: rows[by][:1], name: packed})

    fields = ", ".join(f"{c}: binary" for c in ("ids", "features", *more))
    # groups of bounded size; a count of partitions that is asked for stays as it is
    return dealt.repartition(count, by).groupBy(by).applyInArrow(pack, f"{by} bigint, {name} struct<{fields}>")


def _blocks(factors: DataFrame, count: int, name: str, leaf: int) -> DataFrame:
    """(id, features) -> one packed row a block: block and its rows, as ``name``."""
    more = [c for c in factors.columns if c not in ("id", "features")]
    dealt = factors.select(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block"), "id", "features", *more)
    return packed_blocks(dealt, count, name, leaf)


def unpacked(block: pa.StructScalar, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features (a row each, float64) of a packed block."""
    ids = np.frombuffer(block["ids"].as_buffer(), "<i4")
    return ids, np.frombuffer(block["features"].as_buffer(), width).astype("<f8").reshape(len(ids), -1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of rows of ``a`` with the rows of ``b`` beside them, summed in the order of the rank."""
    out = np.zeros(len(a))
    for f in range(a.shape[1]):
        out += a[:, f] * b[:, f]
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _form(norm: float):
    """The number format of products of rows up to this norm, and its rounding."""
    form = np.float32 if norm < LARGE else np.float64  # nan and infinite: float64
    return form, *ROUNDING[form]


def best_of_block(
    keys: np.ndarray, others: np.ndarray, ids: np.ndarray, n: int, seen: tuple[np.ndarray, np.ndarray] | None = None, least: np.ndarray | None = None
):
    """(row, column, score) of the n best others of each key: score descending, then
    smaller id.  ``seen``: rows and columns that do not count; ``least``: a score for each
    key below which nothing is wanted.

    Everything that could tie with the n-th score is ordered exactly before the cut.
    """
    norms, norm = _norms(keys), _norms(others).max(initial=0.0)
    form, share, lost = _form(max(norms.max(initial=0.0), norm))
    rough = keys.astype(form) @ others.astype(form).T
    if seen is not None:
        rough[seen] = -np.inf
    wanted, n, width = n, min(n, rough.shape[1]), rough.shape[1]
    room = share * (keys.shape[1] + 4) * norms * norm + lost * keys.shape[1] * (1 + norms + norm)
    cut = np.full(len(keys), -np.inf) if least is None else least

    def threshold(score: np.ndarray, rows=slice(None)) -> np.ndarray:
        """What the product of every score from ``score`` on reaches; masked ones do not."""
        low = np.nextafter((score - room[rows]).astype(form), form(-np.inf))
        return np.maximum(low, np.finfo(form).min)[:, None]

    reach = rough >= threshold(cut)
    some = np.flatnonzero(reach.any(axis=0))
    if 2 * max(n, len(some)) < width:  # the others are out for all keys
        rough, others, ids, reach, width = rough[:, some], others[some], ids[some], reach[:, some], len(some)
        n = min(n, width)
    else:
        some = None
    at = np.flatnonzero(reach)  # row by row
    row = at // width if width else at
    many = np.flatnonzero(np.bincount(row, minlength=len(rough)) > n)
    if len(many):
        part = rough if len(many) == len(rough) else rough[many]
        nth = np.partition(part, width - n, axis=1)[:, width - n]
        may = part >= threshold(np.maximum(nth, cut[many]), many)
        tied = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * n)
        if len(tied):  # whole rows are summed exactly; of those tied at the n-th score the smaller ids stay
            by_id = np.argsort(ids, kind="stable")
            exact, other = np.zeros((len(tied), width)), others[by_id]
            for f in range(keys.shape[1]):
                exact += keys[many[tied], f, None] * other[:, f]
            exact[~may[tied][:, by_id]] = -np.inf
            nth = np.partition(exact, width - n, axis=1)[:, width - n, None]
            level = exact == nth
            stay = (exact > nth) | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= n))
            may[tied[:, None], by_id] = stay & (exact > -np.inf)
        few = np.ones(len(rough), bool)
        few[many] = False
        in_part = np.flatnonzero(may)
        at = np.concatenate([at[few[row]], many[in_part // width] * width + in_part % width])
    row, col = np.divmod(at, max(1, width))
    score = exact_scores(keys[row], others[col])
    row, col, score, _ = _cut(row, col, score, ids, wanted)
    return row, col if some is None else some[col], score


def _cut(row: np.ndarray, col: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int):
    """The n best of each row, row by row, and their places among them; ``ids``: of the columns."""
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < n
    return row[keep], col[keep], score[keep], place[keep]


def _boxes(features: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the leaves."""
    starts = np.arange(0, len(features), leaf)
    return np.minimum.reduceat(features, starts, axis=0), np.maximum.reduceat(features, starts, axis=0)


def _bounds(key_lo: np.ndarray, key_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What no score of a key between the corners (a row each) passes in each leaf:
    the largest products, added as scores are."""
    out = np.zeros((len(key_lo), len(lo)))
    for f in range(lo.shape[1]):
        a, b = key_lo[:, f, None], key_hi[:, f, None]
        top = np.maximum(a * lo[:, f], a * hi[:, f])
        out += top if key_lo is key_hi else np.maximum(top, np.maximum(b * lo[:, f], b * hi[:, f]))
    return out


class _Others:
    """A block of others, ready to be searched."""

    def __init__(self, ids: np.ndarray, features: np.ndarray):
        self.ids, self.features = ids, features
        self.lo, self.hi = _boxes(features, OTHER_LEAF)
        middle = self.lo / 2 + self.hi / 2
        self.box = np.concatenate([middle, np.maximum(self.hi - middle, middle - self.lo)], axis=1)
        self.norm = _norms(np.maximum(np.abs(self.lo), np.abs(self.hi))).max(initial=0.0)
        form, _, _ = _form(self.norm)
        self.rough_box = np.ascontiguousarray(self.box.T.astype(form))
        self.first_id = np.minimum.reduceat(ids, np.arange(0, len(ids), OTHER_LEAF)).astype(np.int64)
        self.by_norm = None

    def columns(self, leaves: np.ndarray) -> np.ndarray:
        at = (leaves[:, None] * OTHER_LEAF + np.arange(OTHER_LEAF)).ravel()
        return at[at < len(self.ids)]

    def best(self, keys: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray] | None, least: np.ndarray | None):
        """(row, position, score) of the n best others of each of some neighbouring keys;
        ``known``: rows and positions that do not count, by position."""
        m = len(keys)
        if self.by_norm is not None and (best := self.by_norm.best(keys, n, known, least)) is not None:
            return best
        may_turn, scored = self.by_norm is None and len(self.lo) > SCORED and MIDDLE[0] < self.norm < MIDDLE[1], 0
        score, at = np.full((m, n), -np.inf), np.full((m, n), -1)
        floor = np.full(m, -np.inf) if least is None else least
        cut, cut_id = floor.copy(), np.full(m, _LAST_ID)
        coarse = _bounds(keys.min(axis=0)[None], keys.max(axis=0)[None], self.lo, self.hi)[0]
        left, bound, leaves, step, sift = np.lexsort((self.first_id, -coarse)), None, 1, 0, 1
        left = left[coarse[left] >= cut.min()]
        found, waiting, wide = [], 0, 1
        while len(left):
            take, left = left[:leaves], left[leaves:]
            rows = np.arange(m)
            if bound is not None:
                here, bound = bound[:, :leaves], bound[:, leaves:]
                self._sharpen(here, rough[:leaves], room, keys, cut, take)
                rough = rough[leaves:]
                rows = np.flatnonzero(self._may(here, cut[:, None], cut_id[:, None], take).any(axis=1))
            if len(rows):
                cols = self.columns(np.sort(take))
                seen = None if known is None else self._seen(known, rows, m, np.sort(take))
                r, c, s = best_of_block(keys[rows], self.features[cols], self.ids[cols], n, seen, cut[rows])
                found.append((rows[r], cols[c], s))
                waiting += len(r)
                scored += len(rows) * len(cols)
                step += 1
                if may_turn and SCORED * scored > m * len(self.ids) and len(left):  # leaves rule out little
                    self.by_norm, may_turn = _ByNorm(self.ids, self.features, np.unique(np.concatenate([at[at >= 0], *(f[1] for f in found)]))), False
                    if (best := self.by_norm.best(keys, n, known, least)) is not None:
                        return best
            if waiting and (waiting >= WAITING * m or step >= sift or not len(rows) or not len(left)):  # until then the cuts are too low, which loses nothing
                row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
                some = np.unique(row)
                of, place = np.nonzero(at[some] >= 0)
                held = some[of], at[some][of, place], score[some][of, place]
                row, col, value, place = _cut(*(np.concatenate(x) for x in zip(held, (row, col, value), strict=True)), self.ids, n)
                score[row, place], at[row, place] = value, col
                full = (at[:, -1] >= 0) & (score[:, -1] >= floor)
                cut = np.where(full, score[:, -1], floor)
                cut_id = np.where(full, self.ids[at[:, -1]], _LAST_ID)
                found, waiting = [], 0
            leaves = min(2 * leaves, max(1, wide * SCORE_CELLS // (m * OTHER_LEAF)))
            if bound is None:
                left = left[self._may(coarse[left], cut.min(), cut_id.max(), left)]
                left, bound, room = self._rough_bounds(keys, cut, left)
                rough = np.ones(len(left), bool)
            if step >= sift or not len(rows):  # after 1, 2, 4, 8, ... steps, or a vain one: a leaf that no key needs goes
                if step == 1 or len(left) <= FEW_LEAVES:
                    self._sharpen(bound, rough, room, keys, cut, left)
                may = self._may(bound, cut[:, None], cut_id[:, None], left).any(axis=0)
                wide = 2 if step >= STEPS and np.count_nonzero(may) > 0.9 * len(may) else 1
                left, bound, rough, sift = left[may], bound[:, may], rough[may], max(sift, 2 * step)
        row, place = np.nonzero(at >= 0)
        return row, at[row, place], score[row, place]

    def _rough_bounds(self, keys: np.ndarray, cut: np.ndarray, leaves: np.ndarray):
        """The leaves that a key may need, their bounds by a matrix product (key * middle + |key| * half
        a box, lifted by twice the rounding or less) and that rounding."""
        norms = _norms(keys)
        form, share, lost = _form(max(norms.max(initial=0.0), self.norm))
        both = np.concatenate([keys, np.abs(keys)], axis=1)
        room = 2 * share * (both.shape[1] + 4) * norms * self.norm + lost * both.shape[1] * (1 + norms + self.norm)
        if not np.isfinite(room).all():
            return leaves, _bounds(keys, keys, self.lo[leaves], self.hi[leaves]), np.zeros(len(keys))
        box = self.rough_box if form == self.rough_box.dtype else self.box.T.astype(form)
        rough = both.astype(form) @ box[:, leaves]
        low = np.nextafter((cut - room).astype(form), form(-np.inf))
        need = (rough >= low[:, None]).any(axis=0)
        return leaves[need], rough[:, need].astype("<f8") + room[:, None], room

    def _sharpen(self, bound: np.ndarray, rough: np.ndarray, room: np.ndarray, keys: np.ndarray, cut: np.ndarray, leaves: np.ndarray):
        """Works out the rough bounds of the leaves in which they may hide a tie with a cut."""
        at = np.flatnonzero(rough)
        over = (bound if len(at) == len(rough) else bound[:, at]) - cut[:, None]
        at = at[((over >= 0) & (over <= 2 * room[:, None])).any(axis=0)]
        if len(at):
            bound[:, at], rough[at] = _bounds(keys, keys, self.lo[leaves[at]], self.hi[leaves[at]]), False

    def _may(self, bound: np.ndarray, cut: np.ndarray, cut_id: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Which keys can still find something in which leaves."""
        return (bound > cut) | ((bound == cut) & (self.first_id[leaves] < cut_id))

    @staticmethod
    def _seen(known: tuple[np.ndarray, np.ndarray], rows: np.ndarray, m: int, leaves: np.ndarray):
        """Known rows and positions as rows and columns of some leaves (in their order; only the last may be short)."""
        row, position = known
        slot = np.full(m, -1)
        slot[rows] = np.arange(len(rows))
        lo, hi = (np.searchsorted(position, x * OTHER_LEAF) for x in (leaves, leaves + 1))
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        shift = np.repeat((np.arange(len(leaves)) - leaves) * OTHER_LEAF, hi - lo)
        r, c = slot[row[at]], position[at] + shift
        return r[r >= 0], c[r >= 0]


class _ByNorm:
    """A block of others by falling norm, searched by the directions of small groups of keys."""

    def __init__(self, ids: np.ndarray, features: np.ndarray, first: np.ndarray):
        norms = _norms(features)
        self.order = np.argsort(-norms, kind="stable")
        self.norms, self.ids, self.features = norms[self.order], ids[self.order], features[self.order]
        self.rows = self.features.astype(np.float32)
        self.columns = np.ascontiguousarray(self.rows.T)
        self.place = np.empty(len(ids), np.int64)
        self.place[self.order] = np.arange(len(ids))
        self.first, self.group = self.place[first], GROUP

    def best(self, keys: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray] | None, least: np.ndarray | None):
        """As of :class:`_Others`; None where directions do not decide."""
        norms = _norms(keys)
        if not ((norms > MIDDLE[0]) & (norms < MIDDLE[1])).all():
            return None
        if known is not None:
            known = known[0], self.place[known[1]]
        room = ROOM * (keys.shape[1] + 8)
        cut = self._first_cut(keys.astype(np.float32), n, known) - room * norms * self.norms[0]
        if least is not None:
            cut = np.maximum(cut, least)
        if not (cut > MIDDLE[0] * norms).all():
            return None
        unit = keys / norms[:, None]
        order = leaf_order(np.arange(len(keys)), unit, self.group)
        groups = [order[at : at + self.group] for at in range(0, len(order), self.group)]
        near, found = self._near(unit, cut / norms, groups, room), []
        left = sum(map(len, near)) / (len(groups) * len(self.ids))
        if left * MANY > 1 or left * FEW < 1:
            self.group = min(max(self.group // 2 if left * MANY > 1 else self.group * 2, GROUPS[0]), GROUPS[1])
        for rows, cols in zip(groups, near, strict=True):
            seen = self._seen(known, rows, len(keys), cols)
            found += [(rows[row], col, score) for row, col, score in self._scored(keys[rows], cols, n, seen, cut[rows], room * norms[rows])]
        row, col, score = (np.concatenate(x) for x in zip(*found, (rows[:0], rows[:0], norms[:0]), strict=True))
        enough = score >= cut[row]
        row, col, score, _ = _cut(row[enough], col[enough], score[enough], self.ids, n)
        new = np.unique(col)
        self.first = np.concatenate([new, self.first[~np.isin(self.first, new)]])[: max(4 * n, FIRST)]
        return row, self.order[col], score

    def _first_cut(self, keys: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """A product that n of the others scored first reach, for each key."""
        if len(self.first) < n:
            return np.full(len(keys), -np.inf)
        first = np.sort(self.first)
        rough = keys @ np.take(self.rows, first, axis=0).T
        if known is not None:
            at = np.minimum(np.searchsorted(first, known[1]), len(first) - 1)
            held = first[at] == known[1]
            rough[known[0][held], at[held]] = -np.inf
        parts = max(1, min(8, len(first) // (16 * n)))  # of the largest in each of many shares the n-th is hardly less
        width = len(first) // parts
        rough = rough[:, : parts * width].reshape(len(keys), parts, width).max(axis=1)
        return np.partition(rough, width - n, axis=1)[:, width - n].astype("<f8")

    def _near(self, unit: np.ndarray, least: np.ndarray, groups: list[np.ndarray], room: float) -> list[np.ndarray]:
        """For each group of keys (of length one) the others that can reach what a key wants: within an
        angle of the middle that is the group's width and what their norm leaves."""
        middle = np.array([unit[g].mean(axis=0) for g in groups])
        middle /= np.maximum(_norms(middle), 1e-6)[:, None]
        cos = np.array([(unit[g] @ c).min() for g, c in zip(groups, middle, strict=True)]) - 1e-12
        sin = np.sqrt(np.maximum(0.0, 1 - cos * cos)) + 1e-12
        low = np.array([least[g].min() for g in groups]) * (1 - 1e-9)
        some = np.searchsorted(-self.norms, -low, side="right")  # others of at least that norm
        middle, out, end = middle.astype(np.float32), [[] for _ in groups], int(some.max(initial=0))
        step = NORM_STEP * max(1, SCORE_CELLS // (NORM_STEP * len(groups)))
        for at in range(0, end, step):
            to = min(end, at + step)
            top = self.norms[at:to:NORM_STEP]  # falling: the largest of each run
            reach = low[:, None] * cos[:, None] - sin[:, None] * np.sqrt(np.maximum(0.0, top * top - low[:, None] ** 2)) - room * top
            reach[cos < 0] = -np.inf
            rough = middle @ self.columns[:, at:to]
            low_enough = np.repeat(np.nextafter(reach.astype(np.float32), np.float32(-np.inf)), NORM_STEP, axis=1)[:, : to - at]
            group, col = np.divmod(np.flatnonzero(rough >= low_enough), to - at)
            ends = np.searchsorted(group, np.arange(len(groups) + 1))
            for g, cols in enumerate(out):
                here = col[ends[g] : ends[g + 1]] + at
                cols.append(here if to <= some[g] else here[here < some[g]])
        return [np.concatenate(cols) if cols else np.zeros(0, np.int64) for cols in out]

    def _scored(self, keys: np.ndarray, cols: np.ndarray, n: int, seen: tuple[np.ndarray, np.ndarray] | None, cut: np.ndarray, room: np.ndarray):
        """(row, place, score) of some others for the keys of a group, run by run: all that reach
        what a key wants, or the n best of a run for each key where these are many."""
        single, step = keys.astype(np.float32), max(1, SCORE_CELLS // len(keys))
        for at in range(0, len(cols), step):
            here, hide = cols[at : at + step], None
            low = np.nextafter((cut - room * self.norms[here[0]]).astype(np.float32), np.float32(-np.inf))
            rough = np.take(self.rows, here, axis=0) @ single.T
            if seen is not None:
                some = (seen[1] >= at) & (seen[1] < at + len(here))
                hide = seen[0][some], seen[1][some] - at
                rough[hide[1], hide[0]] = -np.inf
            col, row = np.divmod(np.flatnonzero(rough >= low), len(keys))
            if len(row) > 4 * n * len(keys):  # many tie or the cut is low
                row, col, score = best_of_block(keys, self.features[here], self.ids[here], n, hide, cut)
            else:
                score = exact_scores(keys[row], np.take(self.features, here[col], axis=0))
            yield row, here[col], score

    @staticmethod
    def _seen(known: tuple[np.ndarray, np.ndarray] | None, rows: np.ndarray, m: int, cols: np.ndarray):
        """Known rows and places as rows of a group and positions among its others."""
        if known is None or not len(cols):
            return None
        slot = np.full(m, -1)
        slot[rows] = np.arange(len(rows))
        row, place = known
        at = np.minimum(np.searchsorted(cols, place), len(cols) - 1)
        held = (slot[row] >= 0) & (cols[at] == place)
        return slot[row[held]], at[held]


def _known(codes: np.ndarray, k_ids: np.ndarray, o_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of (key, other) codes, by row; unknown ids go."""
    out = []
    for ids, part in ((k_ids, codes >> 32), (o_ids, codes.astype("<i4"))):
        by_id = np.argsort(ids, kind="stable")
        at = np.minimum(np.searchsorted(ids, part, sorter=by_id), len(ids) - 1)
        out.append(np.where(ids[by_id[at]] == part, by_id[at], -1))
    row, position = (x[(out[0] >= 0) & (out[1] >= 0)] for x in out)
    order = np.lexsort((position, row))
    return row[order], position[order]


def score_pairs(n: int, key: str, other: str, key_width: str = "<f4", other_width: str = "<f4"):
    """Packed pairs of blocks (and what the keys have seen) -> the n best of each key in each pair.
    Keys may bring ``least``, a score below which they want nothing."""

    def score(batches):
        for b in batches:
            for i in range(b.num_rows):
                (k_ids, k), (o_ids, o) = unpacked(b["keys"][i], key_width), unpacked(b["others"][i], other_width)
                least = np.frombuffer(b["keys"][i]["least"].as_buffer(), "<f8") if "least" in b["keys"][i] else None
                row = position = None
                if "seen" in b.schema.names and b["seen"][i].is_valid:
                    row, position = _known(np.frombuffer(b["seen"][i].as_buffer(), "<i8"), k_ids, o_ids)
                others, kept, held = _Others(o_ids, o), [], 0
                for at in range(0, len(k), KEY_LEAF):
                    to, known = min(len(k), at + KEY_LEAF), None
                    if row is not None:
                        lo, hi = np.searchsorted(row, (at, to))
                        if hi > lo:
                            by = np.argsort(position[lo:hi], kind="stable")
                            known = row[lo:hi][by] - at, position[lo:hi][by]
                    r, p, s = others.best(k[at:to], n, known, None if least is None else least[at:to])
                    kept.append((k_ids[at + r], o_ids[p], s))
                    held += len(r)
                    if held >= SCORE_CELLS or to == len(k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names=[key, other, "score"])
                        kept, held = [], 0

    return score


def least_wanted(n: int, key_width: str, other_width: str):
    """Packed blocks of keys beside the strongest others -> the blocks, with ``least``: what n of these reach."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (_, k), (o_ids, o) = unpacked(b["keys"][i], key_width), unpacked(b["strong"][i], other_width)
                others, least = _Others(o_ids, o), np.full(len(k), -np.inf)
                for at in range(0, len(k), KEY_LEAF):
                    row, _, score = others.best(k[at : at + KEY_LEAF], n, None, None)
                    many = np.bincount(row, minlength=len(k[at : at + KEY_LEAF])) >= n
                    last = np.searchsorted(row, np.flatnonzero(many), side="right") - 1
                    least[at : at + KEY_LEAF][many] = score[last]
                cells = [b["keys"][i]["ids"], b["keys"][i]["features"], pa.scalar(least.astype("<f8").tobytes(), pa.binary())]
                packed = pa.StructArray.from_arrays([pa.array([c.as_py()], pa.binary()) for c in cells], names=["ids", "features", "least"])
                yield pa.RecordBatch.from_arrays([b["block"].slice(i, 1), packed], names=["block", "keys"])

    return run


def _with_least(asked: DataFrame, others: DataFrame, n: int, key_blocks: int, strongest: int, key_width: str) -> DataFrame:
    """Packed blocks of keys -> the same with ``least``."""
    norm = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    strong = others.select("id", "features").orderBy(norm.desc(), "id").limit(strongest)
    strong = packed_blocks(strong.select(F.lit(0).cast("bigint").alias("block"), "id", "features"), 1, "strong", OTHER_LEAF)
    strong = strong.select("strong", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(key_blocks - 1).cast("bigint"))).alias("block"))
    tasks = 2 * key_blocks  # few rows: room to spread
    met = asked.repartition(tasks, "block").join(strong.repartition(tasks, "block").hint("merge"), "block")
    run = least_wanted(n, key_width, _width(others))
    return met.select("block", "keys", "strong").mapInArrow(run, "block bigint, keys struct<ids: binary, features: binary, least: binary>")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_counts(n_keys: int, n_others: int, wide: int, least_pairs: int = 0) -> tuple[int, int]:
    """Blocks of either side: of bounded size, and pairs enough for all partitions where rows allow it."""
    enough = max(FEW_PAIRS, -(-n_keys * n_others // PAIR_SCORES))
    wanted = max(min(PAIRS_PER_PARTITION * wide, enough), least_pairs)
    fewest = max(1, -(-n_others // OTHER_BLOCK_ROWS))
    key_blocks = max(1, -(-n_keys // KEY_BLOCK_ROWS), min(-(-n_keys // LEAST_KEY_ROWS), -(-wanted // fewest), COPIES))
    return key_blocks, max(fewest, min(-(-n_others // LEAST_OTHER_ROWS), -(-wanted // key_blocks)))


def found_in_pairs(
    keys: DataFrame, others: DataFrame, n: int, key: str, other: str, key_blocks: int, other_blocks: int, seen: DataFrame | None = None,
    strongest: int = 0,
) -> DataFrame:
    """(key, other, score): the n best others of each key in each block of others.  ``keys`` may
    hold ``least``, ``seen`` holds the ints key and other.  ``strongest``: so many others of the
    largest norms are met first; what cannot be among a key's n best of all may then be missing."""
    pairs, wide = key_blocks * other_blocks, _partitions(keys)
    tasks = min(2 * pairs, max(2 * PAIRS_PER_PARTITION * wide, -(-pairs // PAIRS_PER_TASK)))  # few pairs: room to spread

    def every(count: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    asked = _blocks(keys, key_blocks, "keys", KEY_LEAF)
    if strongest:
        asked = _with_least(asked, others, n, key_blocks, strongest, _width(keys))
    asked = asked.select("keys", F.col("block").alias("kb"), every(other_blocks).alias("ob"))
    offered = _blocks(others, other_blocks, "others", OTHER_LEAF).select("others", F.col("block").alias("ob"), every(key_blocks).alias("kb"))
    number = (F.col("kb") * other_blocks + F.col("ob")).alias("pair")
    # a count of partitions that is asked for stays as it is; the rows are few and large
    asked = asked.select(number, "keys").repartition(tasks, "pair")
    offered = offered.select(number, "others").repartition(tasks, "pair")
    met = asked.join(offered.hint("merge"), "pair")
    columns = ["keys", "others"]
    if seen is not None:
        place = F.pmod(F.xxhash64(key), F.lit(key_blocks)) * other_blocks + F.pmod(F.xxhash64(other), F.lit(other_blocks))
        code = F.call_function("shiftleft", F.col(key).cast("bigint"), F.lit(32)).bitwiseOR(F.col(other).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
        known = seen.select(place.alias("pair"), code.alias("code")).repartition(tasks, "pair").groupBy("pair")
        # of a pair of blocks: at most one entry for each of its scores
        met = met.join(known.applyInArrow(_packed_codes, "pair bigint, seen binary").hint("merge"), "pair", "left")
        columns.append("seen")
    score = score_pairs(n, key, other, _width(keys), _width(others))
    return met.select(*columns).mapInArrow(score, f"{key} int, {other} int, score double")


def _packed_codes(rows: pa.Table) -> pa.Table:
    codes = np.unique(rows["code"].to_numpy()).astype("<i8")
    return pa.table({"pair": rows["pair"][:1], "seen": pa.array([codes.tobytes()], pa.binary())})


def top_n(
    keys: DataFrame, others: DataFrame, n: int = 10, key: str = "userId", other: str = "movieId",
    key_blocks: int | None = None, other_blocks: int | None = None, seen: DataFrame | None = None,
) -> DataFrame:
    """N1-N3 from factor tables (id int, features array<float>): the n best
    ``others`` of every key, nested.  With n = 0 or nothing to recommend, every
    key gets an empty list.  Block counts follow the row counts unless given;
    they change the work, never the result.

    ``seen``: (key, other) rows, repeated ones and unknown ids allowed, that are not
    recommended; the n best of the others remain, and a key that has seen all gets an
    empty list.
    """
    n = _check_n(n)
    others = staged(others.select("id", "features"), "factors") if n else others  # counted, then dealt
    n_others = others.count() if n else 0
    empty = F.array().cast(f"array<struct<{other}:int,rating:float>>")
    if not n_others:
        return keys.select(F.col("id").alias(key), empty.alias("recommendations"))
    keys, n_seen = staged(keys.select("id", "features"), "factors"), 0
    if seen is not None:
        k, o = F.col(key).cast("int"), F.col(other).cast("int")
        seen = staged(seen.filter(k.isNotNull() & o.isNotNull()).select(k.alias(key), o.alias(other)), "seen")  # counted, then dealt
        n_seen = seen.count()
    n_keys = max(1, keys.count())
    counts = block_counts(n_keys, n_others, _partitions(keys), -(-n_seen // SEEN_PER_PAIR))
    key_blocks, other_blocks = key_blocks or counts[0], other_blocks or counts[1]
    # with rows left out, the strongest would have to be counted without them
    strongest = min(STRONGEST, n_others // STRONG_SHARE) if seen is None and n_keys * n_others >= PAIR_SCORES else 0
    found = found_in_pairs(keys, others, n, key, other, key_blocks, other_blocks, seen, strongest if strongest >= n else 0)
    lists = nested(found, n, key, other)
    if seen is None:
        return lists
    every_key = keys.select(F.col("id").alias(key)).join(lists, key, "left")
    return every_key.select(key, F.coalesce("recommendations", empty).alias("recommendations"))


def nested(found: DataFrame, n: int, key: str, other: str) -> DataFrame:
    """(key, other, score) rows, one a pair -> the n best of each key, nested."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(other).asc())
    top = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", other, "score")))  # n entries at most
    return top.groupBy(key).agg(
        F.transform(listed, lambda r: F.struct(r[other].alias(other), r["score"].cast("float").alias("rating"))).alias("recommendations")
    )


def _subset(factors: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The factors of the wanted keys, worked out once."""
    some = factors.join(keys.select(F.col(col).alias("id")).distinct(), "id", "left_semi")
    ensure_checkpoint_dir(some.sparkSession)
    return some if spark_context(some.sparkSession) is None else some.checkpoint()


def recommend_for_all_users(model: ALSModel, n: int = 10, exclude_seen: DataFrame | None = None) -> DataFrame:
    """(userId, recommendations array<struct<movieId, rating>>).
    ``exclude_seen``: ratings whose movies are not recommended to their users again."""
    return top_n(model.userFactors, model.itemFactors, n, model.getUserCol(), model.getItemCol(), seen=exclude_seen)


def recommend_for_all_items(model: ALSModel, n: int = 10, exclude_seen: DataFrame | None = None) -> DataFrame:
    """(movieId, recommendations array<struct<userId, rating>>)."""
    return top_n(model.itemFactors, model.userFactors, n, model.getItemCol(), model.getUserCol(), seen=exclude_seen)


def recommend_for_users(model: ALSModel, users: DataFrame, n: int = 10, exclude_seen: DataFrame | None = None) -> DataFrame:
    """Top-N for the users in ``users`` (any number of them).
    Users unknown to the model get no row (N7: empty in, empty out)."""
    col = model.getUserCol()
    return top_n(_subset(model.userFactors, users, col), model.itemFactors, n, col, model.getItemCol(), seen=exclude_seen)


def recommend_for_items(model: ALSModel, items: DataFrame, n: int = 10, exclude_seen: DataFrame | None = None) -> DataFrame:
    """N3 mirrored: top-N users for the items in ``items``."""
    col = model.getItemCol()
    return top_n(_subset(model.itemFactors, items, col), model.userFactors, n, col, model.getUserCol(), seen=exclude_seen)


def unnest(
    recs: DataFrame, key: str = "userId", item: str = "movieId", score: str = "predicted_rating",
    rank: str | None = None,
) -> DataFrame:
    """One row per (key, item, score) from the nested form; with ``rank``
    also the 1-based position in the user's list (best first)."""
    if rank is None:
        return recs.select(key, F.inline("recommendations")).select(
            key, F.col(item), F.col("rating").alias(score)
        )
    return recs.select(key, F.posexplode("recommendations").alias("_pos", "_r")).select(
        key, (F.col("_pos") + 1).alias(rank), F.col(f"_r.{item}").alias(item), F.col("_r.rating").alias(score)
    )


def attach_movies(flat: DataFrame, movies: DataFrame, score: str = "predicted_rating") -> DataFrame:
    """Add title and genres; items missing from the catalog are dropped.
    Spark broadcasts the catalog when its measured size allows it."""
    keep = [c for c in flat.columns if c not in ("movieId", score)]
    return flat.join(movies.select("movieId", "title", "genres"), "movieId").select(
        *keep, "movieId", "title", "genres", score
    )


def user_recommendations(model: ALSModel, movies: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """N3-N5 for any number of users:
    (userId, rank, movieId, title, genres, predicted_rating), rank 1 = best.

    Not globally sorted: a global sort would re-run the whole upstream plan
    to sample range bounds.  Order by (userId, rank) when presenting."""
    flat = unnest(recommend_for_users(model, users, n), rank="rank")
    return attach_movies(flat, movies)


def recommendations_for_user(model: ALSModel, movies: DataFrame, user_id: int, n: int = 10) -> DataFrame:
    """N3-N5 for one user, as the reference returns it:
    (movieId, title, genres, predicted_rating), best first."""
    spark = movies.sparkSession
    users = spark.createDataFrame([(int(user_id),)], f"{model.getUserCol()} int")
    flat = unnest(recommend_for_users(model, users, n))
    return (
        attach_movies(flat, movies)
        .select("movieId", "title", "genres", "predicted_rating")
        .orderBy(F.desc("predicted_rating"), "movieId")
    )


def batch_recommendations(model: ALSModel, movies: DataFrame, n: int = 20) -> DataFrame:
    """Top-N for every user with movie info:
    (userId, movieId, title, genres, score), unsorted."""
    return batch_from(recommend_for_all_users(model, n), movies)


def batch_from(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """N6 from nested recommendations."""
    flat = unnest(recs, score="score")
    return attach_movies(flat, movies, score="score").select("userId", "movieId", "title", "genres", "score")
