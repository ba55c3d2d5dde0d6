"""Jaccard similarity join of word shingles as a metric-space join.

Distance is 1 - Jaccard, a metric, of the documents' shingle sets.  Equal sets are
one node.  Sets of unrelated texts are all at distance 1 from each other, so far
pivots say nothing; the join works from near pivots inward, and is exact:

* Outer pivots are the single shingles.  A set's distance to the pivot {s} is
  1 - 1 / size if it holds s and 1 if not, so its nearest pivots are its own
  shingles, ties broken by one order for all: rare ones first.  Its Voronoi region
  is that of its first shingle.  Within the radius e = 1 - threshold, a neighbour
  can miss floor(size * e) of its shingles, so a set is replicated to the regions
  of its first floor(size * e) + 1 shingles: linked sets meet in one of them.
* Inner pivots are documents: in every region its hub (the member of most company)
  and its smallest node.  The sets' parities (one bit a cell of the hashes) differ in
  no more cells than the sets in shingles, so they bound a distance from below; where
  this bound leaves a link possible, and the sizes too, the distance is computed on
  the whole sets.  Members within e are linked.
* In regions that then still hold several components every member outside the main one
  names its nearest possible neighbour, by parities, in one block of its ring in one
  region.  The named pairs are checked on the whole sets and components merged, in two
  turns (largest region first, then the smallest): what hangs together mostly does now,
  for no more pairs than members.
* A region that still holds several components is joined whole, a large one in
  rings around the empty set: sizes of linked sets differ by the factor 1 - e at most, so
  they lie in the same or in neighbouring rings, and members outside the main
  component are replicated to these.  Rings are cut into blocks; in a pair of
  blocks pairs of one component are left out, and pairs that the triangle
  inequality over either document pivot (distances known, or known to lie between
  two bounds), the sizes or the parities, on fewer cells first, rule out.  What remains is checked on the
  whole sets, so only texts that may have a link are shingled again and shuffled.

Components of the links are all that is asked for, so members of one component are
not compared with each other; no link between two components is lost.

The order of shingles comes from counts of those that stand early by hash: hot
ones (bitmaps of a fixed size) go last.  Any one order gives the same result.

Edge cases: texts without a word (null, empty, blank) have no shingle and no link;
texts of fewer than ``SHINGLE`` words are one shingle of all their words; repeated
rows and equal sets are linked; a null doc_id counts as larger than any; texts of
any length are shingled whole; an empty table gives no rows; further columns may
have any name and are not read.  Shingles are told apart by 64-bit hashes, sets by
128 bits.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import bitmap, has_bits, mix64, slices, staged, table
from reelspark.llm.components import merged

SHINGLE = 3
#: Least similarity of a link, in percent.
PERCENT = 90
#: Documents of a shingle from which it moves to a later class of the order; bits of a class's bitmap (8 MB each).
HOT, BITS = (2, 8, 64, 1024), 26
#: Turns in which members name their nearest.
TURNS = 2
#: Share by which more shingles are counted than a set is replicated to.
WIDER = 1.25
#: Members of a block; bits of a set's parities: twice its size, as a power of 2 within these.
BLOCK, PARITY = 256, (6, 15)
#: Cells of the parities that are one where every member of a region brings them.
COARSER = 4
#: Bytes of text shingled, and of it held as numbers, at once; bytes of parities compared at once; nodes a task remembers.
SLICE, PIECE, HELD, MEMORY_NODES = 8 << 20, 2 << 20, 8 << 20, 200_000

_A, _R = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95
_KNOWN = [np.zeros(0, np.uint64)] * 2
#: Bounds of the distances to a region's two document pivots.
_BOUNDS = ("hub_least", "hub_most", "low_least", "low_most")
_LOWER = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R ** i and R ** -i for i below n (at least), modulo 2 ** 64; kept between calls."""
    if len(_KNOWN[0]) < n:
        for i, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), np.uint64(base))
            steps[0] = 1
            _KNOWN[i] = np.cumprod(steps)
    return _KNOWN[0], _KNOWN[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of lower-cased text whose blanks are spaces.

    A word's bytes are digits of a number modulo 2 ** 64, so running sums give the
    hashes of all words at once; about ``PIECE`` bytes are held as numbers.
    """
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE) % (len(raw) + 1)
        b = np.frombuffer(raw, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[True], b == 32, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(b))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
        hashes.append(mix64((sums[last] - sums[first]) * down[first]))
        places.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of n words of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    word, place = word_hashes(b" ".join(parts).translate(_LOWER))
    ends = np.searchsorted(place, np.cumsum([0, *[len(x) + 1 for x in parts]]))
    runs = np.full(max(0, len(word) - n + 1), np.uint64(n))
    for i in range(n):
        runs = mix64(runs * _A + word[i : len(runs) + i])
    out = []
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(runs[a : z - n + 1]))
            continue
        whole = np.full(min(1, z - a), np.uint64(z - a))
        for i in range(a, z):
            whole = mix64(whole * _A + word[i])
        out.append(whole)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets (sorted, distinct)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def node_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def ranges(size: int, percent: int) -> int:
    """Regions a set goes to: one more than the shingles a linked set can miss."""
    return size * (100 - percent) // 100 + 1


def identities(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, node, n_shingles, cells (parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            sets = shingle_sets(b.column(1).to_pylist(), shingle)
            columns = [pa.array(map(node_of, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "node", "n_shingles", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, n_shingles long, cells binary")


def _sets_once(batches: Iterator[pa.RecordBatch], at: int, shingle: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Nodes and sets of the batches' texts; copies that a task has just seen are left out."""
    seen: set[bytes] = set()
    for b in slices(batches, SLICE):
        nodes, sets = [], []
        for s in shingle_sets(b.column(at).to_pylist(), shingle):
            node = node_of(s)
            if node is None or node in seen:
                continue
            if len(seen) >= MEMORY_NODES:
                seen.clear()
            seen.add(node)
            nodes.append(node)
            sets.append(s)
        yield nodes, sets


def hot_shingles(docs: DataFrame, percent: int, shingle: int) -> list[np.ndarray]:
    """Bitmaps of the shingles of many documents, among those that stand early by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_once(batches, 0, shingle):
            early = [s[: int(WIDER * ranges(len(s), percent))] for s in sets]
            if early:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(early).view(np.int64))], names=["s"])

    counts = docs.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT[0])
    counts = staged(counts, "join-hot")
    low = F.call_function("shiftleft", F.col("s"), F.lit(64 - BITS))  # the order is by the high bits
    return [bitmap(counts.filter(F.col("n") >= n), low, BITS) for n in HOT]


def first_shingles(sets: list[np.ndarray], hot: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The first shingles of each set, by class (how many of the bitmaps hold it), then hash."""

    def held(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return has_bits(bits, s << np.uint64(64 - BITS), BITS)

    wanted = [ranges(len(s), percent) for s in sets]
    # mostly the first class fills the places: then later shingles and the other bitmaps are not asked
    early = [s[: 2 * k] for s, k in zip(sets, wanted, strict=True)]
    ends = np.cumsum([0, *map(len, early)])
    rare = ~held(np.concatenate(early), hot[0])
    out = []
    for i, (s, k) in enumerate(zip(sets, wanted, strict=True)):
        first = early[i][rare[ends[i] : ends[i + 1]]][:k]
        if len(first) < k:
            heat = sum(held(s, bits).astype(np.int8) for bits in hot)
            first = s[np.argsort(heat, kind="stable")[:k]]
        out.append(first)
    return out


def memberships(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(text) -> key, node, size: a row for each region a set is replicated to."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, percent, shingle))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for nodes, sets in _sets_once(batches, 0, shingle):
            if not nodes:
                continue
            first = first_shingles(sets, hot, percent)
            n = [len(f) for f in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(np.array(nodes, object), n), pa.binary()), pa.array(np.repeat([len(s) for s in sets], n), pa.int64())],
                names=["key", "node", "size"],
            )

    return docs.select("text").mapInArrow(run, "key long, node binary, size long")


def regions(rows: DataFrame) -> DataFrame:
    """Memberships -> key, node, size, n, low, hub of the regions of two sets or more.

    A region's hub is its member of most company (of largest summed regions).  Regions
    of the same members are joined once.
    """
    everyone = Window.partitionBy("key")
    once = rows.repartition("key").dropDuplicates(["key", "node"])
    told = once.select("key", "node", "size", F.min("node").over(everyone).alias("low"), F.max("node").over(everyone).alias("high"), F.count("*").over(everyone).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(everyone).alias("who"))
    members = staged(told.filter("low <> high").drop("high"), "join-members")
    firsts = members.filter("node = low").groupBy("low", "n", "who").agg(F.min("key").alias("key"))
    members = members.drop("who").join(firsts.select("key"), "key", "left_semi")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    return staged(members.join(hubs, "key"), "join-regions")


def _texts(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each of the nodes: that of the smallest id that has it."""
    reps = staged(ids.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("rep")), "join-reps")
    wanted = reps.select(F.col("rep").alias("doc_id")).distinct()
    known = docs.filter(F.col("doc_id").isNotNull()).join(wanted, "doc_id", "left_semi")
    if not reps.filter(F.col("rep").isNull()).isEmpty():  # sets that only rows without an id have
        known = known.unionByName(docs.filter(F.col("doc_id").isNull()))
    return known.select("text")


def parities(s: np.ndarray) -> bytes:
    """One bit a cell of the hashes: whether it holds an odd number of the set's shingles."""
    k = min(PARITY[1], max(PARITY[0], (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(cells: list[bytes], width: int) -> np.ndarray:
    """Parities brought to ``width`` bytes (cells a power of two apart are one), as 64-bit words."""
    out = np.empty((len(cells), width), np.uint8)
    for i, c in enumerate(cells):
        row = np.frombuffer(c, np.uint8)
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, width), axis=0)
    return out.view(np.uint64)


def coarser(cells: DataFrame) -> DataFrame:
    """(node, cells) with parities of a ``COARSER``-th of the cells: a weaker bound, in fewer bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            few = [folded([c], max(8, len(c) // COARSER)).tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(few, pa.binary())], names=["node", "cells"])

    return cells.select("node", "cells").mapInArrow(run, "node binary, cells binary")


def _sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(text) -> node, members (packed shingles) of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, sets in _sets_once(batches, 0, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return texts.mapInArrow(run, "node binary, members binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _sides(pairs: DataFrame, told: DataFrame, column: str) -> DataFrame:
    """(a, b) with the column of both nodes beside them, as x and y."""
    for c, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(told.select(F.col("node").alias(c), F.col(column).alias(name)), c)
    return pairs


def bounded(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, sizes) -> a, b, sizes, differ: in how many cells the parities differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            apart = np.zeros(b.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                both = folded([x, y], min(len(x), len(y)))
                apart[i] = np.bitwise_count(both[0] ^ both[1]).sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(apart)], names=["a", "b", "sizes", "differ"])

    return _sides(pairs, cells, "cells").select("a", "b", "sizes", "x", "y").mapInArrow(run, "a binary, b binary, sizes long, differ long")


def measured(pairs: DataFrame, docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(a, b) -> a, b, shared, size_a, size_b: the exact intersection of the sets."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = staged(nodes, "join-nodes")
    sets = staged(_sets(_texts(docs, ids, nodes), nodes, shingle), "join-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            x, y = ([np.frombuffer(m, np.uint64) for m in b.column(c).to_pylist()] for c in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(common, x, y), pa.int64()), pa.array(map(len, x), pa.int64()), pa.array(map(len, y), pa.int64())],
                names=["a", "b", "shared", "size_a", "size_b"],
            )

    return _sides(pairs.select("a", "b"), sets, "members").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, shared long, size_a long, size_b long")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return pairs.filter(100 * F.col("shared") >= percent * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def _near_sizes(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Columns of a packed block: nodes, whether outside the main component, roots (two numbers each), parities, sizes and bounds of distances."""
    node, root, cells = (rows.field(c).to_pylist() for c in ("node", "root", "cells"))
    roots = np.frombuffer(b"".join(root), np.uint64).reshape(len(root), -1)
    numbers = [rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("size", *_BOUNDS)]  # null: nan
    return np.array(node, object), rows.field("out").to_numpy(zero_copy_only=False), roots, cells, *numbers


def _packed() -> Column:
    return F.collect_list(F.struct("node", (F.col("root") != F.col("main")).alias("out"), "root", "size", "cells", *_BOUNDS))  # about a block's rows


def _rings(members: DataFrame, percent: int, block: int, turn: int | None = None) -> DataFrame:
    """Members with their ring, its number of blocks and their block."""
    seat = members.withColumn("ring", F.floor(F.log(F.col("size")) / F.lit(np.log(100 / percent) + 1e-9)).cast("int"))
    sizes = seat.groupBy("key", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = F.xxhash64("node") if turn is None else F.xxhash64("node", F.lit(turn))
    return seat.join(sizes, ["key", "ring"]).withColumn("block", F.pmod(dealt, F.col("blocks")).cast("int"))


def _possible(ours: tuple[np.ndarray, ...], asks: tuple[np.ndarray, ...], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ours, row of asks, cells that differ) of the pairs of different components that
    nothing rules out; the asking member is outside the main component."""
    near = (100 - percent) / 100 + 1e-9
    (_, _, root, cells, *numbers), (_, out, q_root, q_cells, *q_numbers) = ours, asks
    (size, *known), (q_size, *q_known) = ([x[None, :] for x in numbers], [x[:, None] for x in q_numbers])
    could = (root[None] != q_root[:, None]).any(axis=2) & out[:, None]
    could &= 100 * np.minimum(size, q_size) >= percent * np.maximum(size, q_size)
    for least, most in ((0, 1), (2, 3)):  # nan: not known
        could &= ~(known[least] - q_known[most] > near) & ~(q_known[least] - known[most] > near)
    asked, of = np.nonzero(could)
    widths, apart = np.minimum(*(np.fromiter(map(len, c), int)[i] for c, i in ((cells, of), (q_cells, asked)))), np.zeros(len(of), np.int64)
    for width in np.unique(widths).tolist():  # sizes of a pair are near each other, those of a region need not be
        at = np.flatnonzero(widths == width)
        (o, o_at), (q, q_at) = (np.unique(x[at], return_inverse=True) for x in (of, asked))
        mine, theirs = folded([cells[i] for i in o], width), folded([q_cells[i] for i in q], width)
        for a in range(0, len(at), HELD // width):  # parities differ in no more bits than the sets in shingles
            part = slice(a, a + HELD // width)
            apart[at[part]] = np.bitwise_count(mine[o_at[part]] ^ theirs[q_at[part]]).sum(axis=1, dtype=np.int64)
    still = (100 - percent) * (size[0, of] + q_size[asked, 0]) >= (100 + percent) * apart
    return of[still], asked[still], apart[still]


def _named(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    a, b = (pa.array([end(p) for p in zip(x, y, strict=True)], pa.binary()) for end in (max, min))
    return pa.RecordBatch.from_arrays([a, b, pa.array(sizes.astype(np.int64))], names=["a", "b", "sizes"])


def near_pairs(members: DataFrame, cells: DataFrame, percent: int, block: int, turn: int) -> DataFrame:
    """The members of :func:`ring_pairs` -> pairs (a, b): each member outside the main component
    and the nearest possible neighbour, by parities, in its block of its home region.  That is
    its largest open region, in odd turns its smallest."""
    place = F.col("n") if turn % 2 == 0 else -F.col("n")
    homes = members.groupBy("node").agg(F.max(F.struct(place.alias("place"), "key", "n", "root", "main", "size", *_BOUNDS)).alias("home"))
    seat = _rings(homes.select("node", "home.*").drop("place"), percent, block, turn).join(cells, "node")  # a row a node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ours = _unpacked(b.column(0)[i].values)
                of, asked, apart = _possible(ours, ours, percent)
                order = np.lexsort((apart, asked))
                first = order[np.flatnonzero(np.diff(asked[order], prepend=-1))]
                of, asked = of[first], asked[first]
                yield _named(ours[0][of], ours[0][asked], ours[4][of] + ours[4][asked])

    return seat.groupBy("key", "ring", "block").agg(_packed().alias("members")).select("members").mapInArrow(run, "a binary, b binary, sizes long").select("a", "b").distinct()


def ring_pairs(members: DataFrame, cells: DataFrame, percent: int, block: int) -> DataFrame:
    """(key, n, node, root, main, size and bounds of the distances to hub and low) -> pairs
    (a, b, sizes) of different components that nothing rules out; unknown bounds are null.

    A region of ``block`` members at most meets itself as it is.  In the others a ring
    takes sizes up to the factor 1 - e apart; members outside the region's main
    component ask their ring and both beside it.
    """
    members = members.join(cells, "node")
    small = members.filter(F.col("n") <= block).groupBy("key").agg(_packed().alias("ours")).select("ours", F.col("ours").alias("asked"))
    seat = _rings(members.filter(F.col("n") > block), percent, block)
    met = seat.groupBy("key", "ring", "block", "blocks").agg(_packed().alias("ours"))
    asks = seat.filter("root <> main").groupBy("key", "ring", "block").agg(_packed().alias("asked"))
    asks = asks.withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    asks = asks.join(seat.select("key", "ring", "blocks").distinct(), ["key", "ring"]).select("key", "ring", "asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = asks.join(met, ["key", "ring", "block"]).select("ours", "asked").unionByName(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ours, asks = _unpacked(b.column(0)[i].values), _unpacked(b.column(1)[i].values)
                of, asked, _ = _possible(ours, asks, percent)
                x, y = ours[0][of], asks[0][asked]
                once = ~ours[1][of] | np.fromiter(map(operator.gt, y, x), bool, len(y))  # two members outside ask each other
                yield _named(x[once], y[once], (ours[4][of] + asks[4][asked])[once])

    return both.mapInArrow(run, "a binary, b binary, sizes long").distinct()


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the regions of several components, with their root and the region's main component: that of most members."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = placed.groupBy("key", "root").agg(F.count("*").alias("held")).groupBy("key").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("roots"))
    return placed.join(held.filter("roots > 1").select("key", F.col("most.root").alias("main")), "key")


def linked_components(docs: DataFrame, ids: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) and their identities -> (node, root): components of the links, for
    every set but the smallest node of its component and those without a link."""
    members = regions(memberships(docs, percent, shingle))
    cells = staged(ids.filter(F.col("node").isNotNull()).select("node", "cells").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "join-cells")
    size = members.select("node", "size").distinct()
    led = members.select("key", "node", "size", F.explode(F.array("hub", "low")).alias("pivot")).filter("node <> pivot")
    led = led.join(size.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size")), "pivot").filter(_near_sizes("size", "pivot_size", percent))
    led = led.select(*_ordered("node", "pivot"), (F.col("size") + F.col("pivot_size")).alias("sizes")).distinct()
    told = staged(bounded(led, cells), "join-bounded")
    open_pairs = (100 - percent) * F.col("sizes") >= (100 + percent) * F.col("differ")
    seen = staged(measured(told.filter(open_pairs).select("a", "b"), docs, ids, shingle), "join-measured")
    roots = merged(None, _linked(seen, percent))
    exact = 1 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    least = 2 * F.col("differ") / (F.col("sizes") + F.col("differ"))
    away = seen.select("a", "b", exact.alias("least"), exact.alias("most")).unionByName(told.filter(~open_pairs).select("a", "b", least.alias("least"), F.lit(1.0).alias("most")))
    # of two members hub and low are the pair itself
    placed = staged(_open(members.filter("n > 2"), roots), "join-open")
    for pivot in ("hub", "low"):
        d = away.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "least", "most")
        placed = placed.join(d, (F.greatest("node", pivot) == F.col("_a")) & (F.least("node", pivot) == F.col("_b")), "left").drop("_a", "_b")
        for bound in ("least", "most"):
            placed = placed.withColumn(f"{pivot}_{bound}", F.when(F.col("node") == F.col(pivot), 0.0).otherwise(F.col(bound))).drop(bound)
    bounds, tried = staged(placed.drop("root", "main", "hub", "low"), "join-bounds"), seen.select("a", "b")
    for turn in range(TURNS):
        first = near_pairs(_open(bounds, roots), cells, percent, BLOCK, turn).join(tried, ["a", "b"], "left_anti")
        found = staged(measured(staged(first, "join-first"), docs, ids, shingle), "join-near")
        roots, tried = merged(roots, _linked(found, percent)), tried.unionByName(found.select("a", "b"))
    more = ring_pairs(_open(bounds, roots), staged(coarser(cells), "join-coarser"), percent, BLOCK).join(tried, ["a", "b"], "left_anti")
    more = staged(bounded(more, cells).filter(open_pairs).select("a", "b"), "join-pairs")  # by all cells
    return merged(roots, staged(_linked(measured(more, docs, ids, shingle), percent), "join-more"))


def linked_documents(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, node, n_shingles, root, component_id for every row.

    ``component_id`` is the smallest doc_id of the component.  Ids may be null or
    repeat; ``root`` tells components apart (null for texts without a word).
    """
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    ids = staged(identities(docs, shingle), "join-ids")
    rooted = linked_components(docs, ids, percent, shingle)
    per_set = ids.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    per_set = staged(per_set.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-sets")
    named = per_set.join(per_set.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    out = ids.join(named, "node", "left")
    return out.select("doc_id", "node", "n_shingles", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
