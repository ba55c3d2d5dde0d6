"""Near duplicates by DartMinHash signatures, banded candidates and exact checks.

A text is the weighted set of its runs of ``SHINGLE`` words, weighted by how often
each occurs.  Similarity is weighted Jaccard, sum of minima over sum of maxima
(plain Jaccard where no run repeats).

Signature: every element owns the region [0, weight) x [0, infinity) of a plane.
Darts, drawn by hash alone, fall on it like rain (one a unit of area), so two
texts share the darts of the region they share.  Each dart has a rank (its
height) and a hashed coordinate; a coordinate's signature is the earliest dart.
Heights up to about ln(k) + 3 darts a coordinate are thrown at once and doubled
in the rare case that a coordinate got none, so the work follows the number of
elements, not elements times coordinates.  Two signatures agree in a coordinate
with probability equal to the similarity.

``BANDS`` bands of ``ROWS`` coordinates give buckets.  In each bucket the members
are paired with its hub and its smallest text only, and every pair is checked
exactly on the whole texts.  Where a bucket then still holds several components,
members outside the main one are compared with those of the others by longer
signatures, in blocks of arrays, and pairs whose estimate does not clearly miss
the threshold are checked exactly too.  Families of copies thus cost a few pairs a
member, and no chain of links inside a bucket is lost.  Classes are the connected
components of the checked links.  Equal texts are one node throughout, so copies
are never paired.

Edge cases: texts without a word (null, empty, blank) are alone; texts of fewer
than ``SHINGLE`` words are one run; a class is named by its smallest doc_id, a
null id counting as larger than any; repeated rows belong to the same class; an
empty table gives none; texts of any length are shingled whole; further columns
may have any name and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import mix64, slices, staged, table
from reelspark.llm.components import merged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Coordinates of the longer signatures, deviations of their estimate that count as a clear miss, members of a block.
SKETCH, SIGMAS, BLOCK = 1024, 3.5, 512
#: Members of open buckets that a task compares.
TOGETHER = 4096
#: Coordinates that tell unlike texts apart before all are compared.
ROUGH = 64
#: Words a worker remembers the hash of.
MEMORY_WORDS = 150_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Upper ends of the counts 0, 1, 2, ... of a Poisson variable of mean 1, on 64 bits.
_POISSON = (np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 16)])]) * 2.0**64 * (1 - 2.0**-52)).astype(np.uint64)


class WordHash(dict):
    """Word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = h
        return h


_WORDS = WordHash()


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of runs of n words, how often each occurs)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix64(h * _C[0] + w[i : len(w) - n + 1 + i])
    ids, counts = np.unique(h, return_counts=True)
    return ids, counts.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two weighted sets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][ia], b[1][ib]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def throw(ids: np.ndarray, weights: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, dart) of all darts that fall on the elements below ``height``."""
    cells = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(ids)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix64(ids[of] + nth.astype(np.uint64) * _C[1])
    wide = weights[of] - nth  # the part of the cell that the element covers, 1 but for its last cell
    floors = max(1, int(np.ceil(height)))
    if floors > 1:
        floor = np.tile(np.arange(floors), len(cell))
        cell, wide = np.repeat(cell, floors), np.repeat(wide, floors)
    else:
        floor = np.zeros(len(cell), np.int64)
    square = mix64(cell + floor.astype(np.uint64) * _C[2])
    count = np.searchsorted(_POISSON, square, side="right")
    at = np.repeat(np.arange(len(square)), count)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix64(square[at] + (turn + 1).astype(np.uint64) * _C[3])
    rank = floor[at] + (dart >> np.uint64(11)) * 2.0**-53
    inside = (rank < height) & ((mix64(dart + _C[4]) >> np.uint64(11)) * 2.0**-53 < wide[at])
    return rank[inside], dart[inside]


def dart_minhash(ids: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k signature values of a weighted set (at least one element of weight > 0)."""
    height = 2.0 ** np.ceil(np.log2(k * (np.log(k) + 3) / weights.sum()))
    while True:
        rank, dart = throw(ids, weights, height)
        order = np.argsort(rank, kind="stable")
        dart = dart[order]
        coordinate = (mix64(dart + _C[5]) % np.uint64(k)).astype(np.int64)
        hit, first = np.unique(coordinate, return_index=True)
        if len(hit) == k:
            return dart[first]
        height *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.arange(1, bands + 1).astype(np.uint64) * _C[2]
    for r in range(rows):
        key = mix64(key * _C[0] + signature[r::rows][:bands])
    return key.view(np.int64)


def text_node(text: Column) -> Column:
    """Equal texts have equal nodes (16 bytes); null for texts without a word."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def bucket_rows(nodes: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, text) -> node, key: one row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys = [band_keys(dart_minhash(*shingles(t, shingle), bands * rows), bands, rows) for t in text]
            yield pa.RecordBatch.from_arrays([pa.array([n for n in node for _ in range(bands)], pa.binary()), pa.array(np.concatenate(keys))], names=["node", "key"])

    return nodes.select("node", "text").mapInArrow(run, "node binary, key long")


def _members(rows: DataFrame) -> DataFrame:
    """Bucket rows -> key, node, hub, low, n of the buckets with two texts or more.

    A bucket's hub is its member of most company: of largest summed bucket sizes.
    Copies of one text share more buckets with it than with each other.
    """
    several = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", "low")
    members = staged(rows.join(several, "key").distinct(), "near-members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    company = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("h"), F.count("*").alias("n"))
    return staged(members.join(hubs.select("key", F.col("h.node").alias("hub"), "n"), "key"), "near-led")


def check_pairs(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b) -> a, b, sim: the exact similarity of the whole texts of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in slices(batches):
            out = []
            for leader, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if leader != last:
                    last, known = leader, shingles(y, shingle)
                out.append(similarity(shingles(x, shingle), known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "sim"])

    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    sides = sides.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, sim double")


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def _one_text_each(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node, text) and wanted nodes -> node, text, once each.

    Of equal texts the row of the smallest id is fetched, so that copies are
    spread over the shuffle and dropped by it.
    """
    reps = docs.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("_rep"))
    reps = reps.join(nodes, "node", "left_semi").select(F.col("node").alias("_node"), "_rep")
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))
    return docs.join(reps, same).select("node", "text").dropDuplicates(["node"])


def _linked(checked: DataFrame, threshold: float) -> DataFrame:
    return checked.filter(F.col("sim") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sketches(texts: DataFrame, shingle: int, k: int) -> DataFrame:
    """(node, text) -> node, sketch: a signature of k coordinates, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [dart_minhash(*shingles(t, shingle), k).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node binary, sketch binary")


def _rims(placed: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float, shingle: int, k: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of buckets that still hold several components that could be
    linked: of members outside the main component with members of others.

    Sketches of a bucket are compared in blocks, as arrays; a pair is named only
    if the estimate is within ``SIGMAS`` deviations of the threshold and the
    similarities to the leaders allow it (1 - sim is a metric).
    """
    rooted = staged(placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    buckets = rooted.groupBy("key").agg(F.max_by("root", "to_hub").alias("main"), F.min("root").alias("first"), F.max("root").alias("last"))
    still = staged(rooted.join(buckets.filter("first <> last").select("key", "main"), "key"), "near-open")
    sketches = _sketches(texts.join(still.select("node").distinct(), "node", "left_semi"), shingle, k)
    seats = still.join(staged(sketches, "near-sketches"), "node").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    seats = seats.select("key", "node", "root", "main", "to_hub", "to_low", "sketch", "blocks")
    # buckets are mostly small: a task takes about TOGETHER members of many, and blocks of large ones apart
    tasks = max(1, -(-still.count() // TOGETHER))
    met = seats.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asks = seats.filter("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met, asks = (x.withColumn("task", F.pmod(F.xxhash64("key", "block"), F.lit(tasks))) for x in (met, asks))
    asks = asks.select([F.col(c).alias(f"q_{c}") for c in asks.columns])
    least, rough = (threshold - d * np.sqrt(threshold * (1 - threshold) / n) for d, n in ((SIGMAS, k), (5, ROUGH)))
    room = 1 - threshold + 1e-9

    def compare(ours: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(ours) and len(asked):
            ours = ours.sort_values(["key", "block"], ignore_index=True)
            sketch = np.frombuffer(b"".join(ours["sketch"]), "<u4").reshape(len(ours), k)
            root, node, hub, low = (ours[c].to_numpy() for c in ("root", "node", "to_hub", "to_low"))
            places = list(zip(ours["key"], ours["block"], strict=True))
            first = [i for i, x in enumerate(places) if not i or x != places[i - 1]]
            spots = {places[i]: (i, z) for i, z in zip(first, [*first[1:], len(places)], strict=True)}
            for q in asked.itertuples():
                i, z = spots.get((q.q_key, q.q_block), (0, 0))
                could = (root[i:z] != q.q_root) & (np.abs(hub[i:z] - q.q_to_hub) <= room) & (np.abs(low[i:z] - q.q_to_low) <= room)
                at, mine = i + np.flatnonzero(could), np.frombuffer(q.q_sketch, "<u4")
                at = at[(sketch[at, :ROUGH] == mine[:ROUGH]).mean(axis=1) >= rough]
                agree = (sketch[at] == mine).mean(axis=1)
                for other in node[at[agree >= least]]:
                    a.append(max(other, q.q_node))
                    b.append(min(other, q.q_node))
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return met.groupBy("task").cogroup(asks.groupBy("q_task")).applyInPandas(compare, "a binary, b binary").distinct()


def linked_components(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, text) -> (node, root): components of the checked links, for
    every text but the smallest node of its component and those without a link."""
    members = _members(staged(bucket_rows(docs.filter(F.col("node").isNotNull()), shingle, bands, rows), "near-buckets"))
    led = members.select("key", "node", F.explode(F.array("hub", "low")).alias("leader"))
    pairs = staged(led.filter("node <> leader").select(*_pair("node", "leader")).distinct(), "near-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = staged(_one_text_each(docs, nodes), "near-texts")
    seen = staged(check_pairs(pairs, texts, shingle), "near-checked")
    placed = members
    for leader in ("hub", "low"):
        sims = seen.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("sim").alias(f"to_{leader}"))
        placed = placed.join(sims, (F.greatest("node", leader) == F.col("_a")) & (F.least("node", leader) == F.col("_b")), "left").drop("_a", "_b")
        placed = placed.withColumn(f"to_{leader}", F.coalesce(f"to_{leader}", F.lit(1.0)))
    roots = merged(None, _linked(seen, threshold))
    more = _rims(placed.select("key", "node", "n", "to_hub", "to_low"), roots, texts, threshold, shingle)
    more = staged(more.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")
    if more.isEmpty():
        return roots
    return merged(roots, _linked(staged(check_pairs(more, texts, shingle), "near-checked"), threshold))


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, node, root, class_id, class_size for every row.

    ``class_id`` is the smallest doc_id of the class, ``node`` the text's identity and
    ``root`` the class's: ids may be null or repeat, so unlike classes can share a class_id.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_node(F.col("text")).alias("node"), "text")
    rooted = linked_components(docs, threshold, shingle, bands, rows)
    ids = staged(docs.select("doc_id", "node"), "near-ids")
    per_text = ids.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    per_text = staged(per_text.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-texts")
    classes = per_text.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    named = per_text.join(classes, "root").select("node", "root", "class_id", "class_size")
    out = ids.join(named, "node", "left").withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select("doc_id", "node", "root", "class_id", F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class (that of its smallest id, then node), with the columns it came with.

    A row travels as one struct, so columns may have any name.  Texts without a
    word are nobody's copies and all stay.
    """
    judged = staged(near_classes(docs.select("doc_id", "text"), threshold), "near-classes")
    named = judged.filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # repeated ids can give several texts, repeated rows several times the same: one goes on
    chosen = named.groupBy("root", "class_id").agg(F.min("node").alias("keep"), F.count("*").alias("rows"))
    chosen = chosen.select("keep", "rows", F.col("class_id").alias("class"))
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text_node(docs["text"]).alias("node"), docs["doc_id"].cast("bigint").alias("id"))
    kept = carried.join(chosen, (F.col("node") == F.col("keep")) & F.col("id").eqNullSafe(F.col("class")))
    once = kept.filter("rows = 1").select("doc.*")
    several = kept.filter("rows > 1").dropDuplicates(["node", "id"]).select("doc.*")
    return once.unionByName(several).unionByName(carried.filter(F.col("node").isNull()).select("doc.*"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_size")
