"""Repeated passages by suffix order and previous factors.

A byte position has an earlier match of ``LENGTH`` bytes if its longest previous
factor is that long: in suffix order, where suffixes that share their first
``LENGTH`` bytes stand together, the neighbour of smaller position (previous or
next smaller value) is that match.  With ``keep_first`` exactly the positions
with an earlier match are removed (with the bytes their match covers); without
it also those with a later one.  Positions are ordered by doc_id, text hash, byte.

Suffixes are never sorted as a whole.  Each start is dealt to a group by an
anchor, the smallest hash among the ``ANCHOR``-byte strings of its window; equal
windows have equal anchors, so all matches meet in one group.

1. Every document is cut into runs of neighbouring starts with the same anchor
   string at the same place (a few rows for each kilobyte).
2. Per anchor, a partial aggregate counts runs and compares their content.
   Anchors met once are done: none of their starts repeats.
3. Anchors whose runs are all equal are done too: every start has the same matches.
4. Only the starts of the other anchors go on (rims of passages, lines shorter than
   ``LENGTH``).  They are cut into runs again, by a ``LONG_ANCHOR`` that shorter lines
   cannot share, and carry their bytes.  Groups of up to ``GROUP_RUNS`` runs are solved
   in tasks of bounded size: starts whose string's hash occurs twice are put into
   suffix order, and previous/next smaller positions tell the matches.  For the
   starts of larger groups Spark puts the order together itself: one row a start,
   keyed by a 128-bit hash of its string, counted and compared with the first.

Edge cases: null text is empty; texts shorter than ``LENGTH`` lose nothing;
repeated rows (same id and text) share their result, and count as copies of each
other unless the first is kept; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import mix64, slices, staged, table

LENGTH = 200
ANCHOR = 48
LONG_ANCHOR = 112
#: Runs of one anchor that are solved together in a task, and bytes of a task.
GROUP_RUNS = 20_000
TASK_BYTES = 1 << 20
#: Bytes of documents looked at together.
BLOCK = 1 << 19
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def string_hashes(raw: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of each wanted length, by start."""
    h, n, at = raw.astype(np.uint64) + np.uint64(1), 1, 0
    powers, out = {}, {}
    while True:  # only the powers of two that make up a wanted length are kept
        if any(want & n for want in lengths):
            powers[n] = h
        if 2 * n > max(lengths):
            break
        h = h[:-n] * _STEP[at] + h[n:] if len(h) > n else h[:0]
        n, at = 2 * n, at + 1
    for want in lengths:
        got, done, k = None, 0, 0
        for p in sorted(powers, reverse=True):
            if want & p:
                size = max(0, len(raw) - want + 1)
                part = powers[p][done : done + size]
                got = part if got is None else got * _STEP[-1 - k] + part
                done, k = done + p, k + 1
        out[want] = got
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, m = 1, x
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - n : width - n + len(x) - width + 1])


def anchor_runs(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Documents one after the other in ``raw``, ending at ``ends`` ->
    (document, first start in it, starts after the first, anchor, content) of all runs."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    hashes = string_hashes(raw, {anchor, length})
    marks = mix64(hashes[anchor])
    least = sliding_min(marks, length - anchor + 1)
    whole = hashes[length]
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    start = np.flatnonzero(_has_room(len(raw), begins, sizes, length))
    if not len(start):
        return none, none, none, none, none
    doc = np.searchsorted(ends, start, side="right")
    v = least[start]
    # the anchor is the first smallest string: it changes with its value, or when the start passes it
    passed = marks[start[:-1]] == v[:-1]
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) | passed | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(fresh)
    widths = np.diff(np.append(first, len(start)))
    a, z = start[first], start[first + widths - 1]
    content = mix64(whole[a] * _STEP[1] + mix64(whole[z]) + widths.astype(np.uint64) * _STEP[2])
    return doc[first], a - begins[doc[first]], widths - 1, v[first].view(np.int64), content.view(np.int64)


def _has_room(n: int, begins: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether a window that starts here ends in the same document."""
    change = np.zeros(n + 1, np.int8)
    room = sizes >= length
    np.add.at(change, begins[room], 1)
    np.add.at(change, (begins + sizes - length + 1)[room], -1)
    return np.cumsum(change[:-1], dtype=np.int8) > 0


def _runs(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, BLOCK):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        doc, s, n, v, content = anchor_runs(np.frombuffer(b"".join(texts), np.uint8), ends, length, anchor)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(v), pa.array(content)],
            names=["doc", "tid", "s", "n", "anchor", "content"],
        )


def window_classes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The rank of each start in ``at`` in suffix order cut at ``length`` bytes: equal
    for equal strings, and in the order of the strings otherwise.

    One string of each hash is sorted; the others are compared with it byte by byte.
    """
    strings = np.lib.stride_tricks.sliding_window_view(raw, length)
    _, first, which = np.unique(string_hashes(raw, {length})[length][at], return_index=True, return_inverse=True)
    for i in range(0, len(at), 1 << 16):
        part = slice(i, i + (1 << 16))
        if not (strings[at[part]] == strings[at[first[which[part]]]]).all():  # two strings of one hash
            return _sorted_ranks(strings[at])
    return _sorted_ranks(strings[at[first]])[which]


def _sorted_ranks(strings: np.ndarray) -> np.ndarray:
    whole = np.ascontiguousarray(strings).view(np.dtype((np.void, strings.shape[1]))).ravel()
    return np.unique(whole, return_inverse=True)[1]


def matched(classes: np.ndarray, position: np.ndarray, keep_first: bool) -> np.ndarray:
    """Whether each suffix has an earlier match (or, without ``keep_first``, any).

    In suffix order, ties by position, the previous smaller position of a class
    is the neighbour before, a later match the neighbour after.
    """
    order = np.lexsort((position, classes))
    same = classes[order][1:] == classes[order][:-1]
    before = np.concatenate([[False], same])
    after = np.concatenate([same, [False]])
    out = np.empty(len(order), bool)
    out[order] = before if keep_first else before | after
    return out


def _spans(doc: np.ndarray, tid: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Starts, ascending in their document -> rows of neighbouring starts."""
    if not len(start):
        return pd.DataFrame({"doc": pd.Series([], dtype="int64"), "tid": pd.Series([], dtype="int64"), "a": pd.Series([], dtype="int32"), "z": pd.Series([], dtype="int32")})
    fresh = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (tid[1:] != tid[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return pd.DataFrame({"doc": doc[first], "tid": tid[first], "a": start[first].astype("int32"), "z": start[last].astype("int32")})


def _solve(df: pd.DataFrame, length: int, keep_first: bool) -> pd.DataFrame:
    """Runs of whole anchor groups, with their bytes -> repeated starts, as spans.

    Only starts whose string's hash occurs twice are put into suffix order.
    """
    df = df.sort_values(["doc", "tid", "s", "turn"], ignore_index=True)
    if keep_first:  # repeated rows are no copies of each other
        df = df.drop_duplicates(["doc", "tid", "s"], ignore_index=True)
    raw = np.frombuffer(b"".join(df["bytes"]), np.uint8)
    sizes, n = np.fromiter(map(len, df["bytes"]), np.int64, len(df)), df["n"].to_numpy() + 1
    row = np.repeat(np.arange(len(df)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[row] + inner
    _, which, times = np.unique(string_hashes(raw, {length})[length][at], return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[which] > 1)  # rows come in the order of positions
    hit = often[matched(window_classes(raw, at[often], length), often, keep_first)] if len(often) else often
    start = df["s"].to_numpy()[row[hit]] + inner[hit]
    return _spans(df["doc"].to_numpy()[row[hit]], df["tid"].to_numpy()[row[hit]], start)


def _join_docs(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return docs.join(lists, ["doc", "tid"], how)


def _stretches(runs: list) -> list[tuple[int, int]]:
    """Runs of starts -> the longest stretches a..z that they cover together."""
    out: list[list[int]] = []
    for s, n in sorted((r["s"], r["n"]) for r in runs):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, z) for a, z in out]


def _with_bytes(docs: DataFrame, runs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Runs -> runs of the same starts by the longer ``anchor``, with their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BLOCK):
            parts, owner, base = [], [], []
            for i, (text, own) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for a, z in _stretches(own):
                    parts.append(raw[a : z + length])
                    owner.append(i)
                    base.append(a)
            ends = np.cumsum([len(p) for p in parts])
            part, s, n, v, _ = anchor_runs(np.frombuffer(b"".join(parts), np.uint8), ends, length, anchor)
            take = pa.array(np.asarray(owner, np.int64)[part])
            strings = [parts[p][a : a + m + length] for p, a, m in zip(part.tolist(), s.tolist(), n.tolist(), strict=True)]
            start = (s + np.asarray(base, np.int64)[part]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(start), pa.array(n.astype(np.int32)), pa.array(v), pa.array(strings, pa.binary())],
                names=["doc", "tid", "s", "n", "anchor", "bytes"],
            )

    lists = runs.groupBy("doc", "tid").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    return _join_docs(docs, lists, "inner").select("doc", "tid", "text", "runs").mapInArrow(cut, "doc long, tid long, s int, n int, anchor long, bytes binary")


def _window_spans(runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Starts of the runs of large groups, ordered by Spark: one row a start."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 18):
            keys, rows, starts = [], [], []
            for i, (s, n, raw) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)):
                keys += [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n + 1)]
                rows += [i] * (n + 1)
                starts += range(s, s + n + 1)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(keys, pa.binary())], names=["doc", "tid", "s", "key"])

    rows = staged(runs.select("doc", "tid", "s", "n", "anchor", "bytes").mapInArrow(windows, "doc long, tid long, s int, key binary"), "suffix-windows")
    place = F.struct("doc", "tid", "s")
    keys = rows.groupBy("key").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1")
    hit = rows.join(keys, "key")
    if keep_first:
        hit = hit.filter(~(place == F.col("first")))
    return hit.select("doc", "tid", F.col("s").alias("a"), F.col("s").alias("z"))


def repeated_starts(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, long_anchor: int = LONG_ANCHOR, keep_first: bool = False, group_runs: int | None = None,
) -> DataFrame:
    """(doc, tid, text) -> doc, tid, a, z: the starts a..z of repeated strings of ``length`` bytes."""
    group_runs = group_runs or GROUP_RUNS
    runs = docs.select("doc", "tid", "text").mapInArrow(lambda it: _runs(it, length, anchor), "doc long, tid long, s int, n int, anchor long, content long")
    runs = staged(runs, "suffix-runs")
    met = runs.groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("low"), F.max("content").alias("high")).filter("times > 1")
    met = met.select("anchor", (F.col("low") == F.col("high")).alias("equal"))
    cand = staged(runs.select("doc", "tid", "s", "n", "anchor").join(met, "anchor"), "suffix-repeats")
    equal = cand.filter("equal")
    if keep_first:
        place = F.struct("doc", "tid", "s")
        first = equal.groupBy("anchor").agg(F.min(place).alias("first"))
        equal = equal.join(first, "anchor").filter(~(place == F.col("first")))
    found = equal.select("doc", "tid", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("z"))
    # repeated rows are one row in the lists; each document row that joins brings its own bytes
    rims = cand.filter(~F.col("equal")).select("doc", "tid", "s", "n").distinct()
    pieces = staged(_with_bytes(docs, rims, length, long_anchor), "suffix-pieces")
    large = staged(pieces.groupBy("anchor").agg(F.count("*").alias("times")).filter(F.col("times") > group_runs).select("anchor"), "suffix-large")
    total = pieces.agg(F.sum("n"), F.count("*")).first()
    tasks = max(1, -(-((total[0] or 0) + length * total[1]) // TASK_BYTES))
    dealt = pieces.join(large, "anchor", "left_anti").withColumn("turn", F.monotonically_increasing_id())
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
    solved = dealt.groupBy("task").applyInPandas(lambda df: _solve(df, length, keep_first), "doc long, tid long, a int, z int")
    found = found.unionByName(solved)
    if not large.isEmpty():
        found = found.unionByName(_window_spans(pieces.join(large, "anchor", "left_semi"), length, keep_first))
    return found


def with_text_id(docs: DataFrame) -> DataFrame:
    """Documents with ``doc`` and ``tid``, neither null, that name an id and text; a null id stands at 0."""
    named = F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "tid": named})


def removed_ranges(starts: list, length: int) -> list[tuple[int, int]]:
    """Spans of starts -> the maximal byte ranges that their strings cover."""
    out: list[list[int]] = []
    for a, z in sorted((x["a"], x["z"]) for x in starts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return [(a, z) for a, z in out]


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in ranges:
        parts.append(raw[at:a])
        at = z
    return b"".join([*parts, raw[at:]])


def _marked(docs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Documents (with doc and tid) with ``starts``, their repeated starts."""
    found = repeated_starts(docs, length, keep_first=keep_first)
    lists = staged(found.groupBy("doc", "tid").agg(F.collect_list(F.struct("a", "z")).alias("starts")), "suffix-found")
    return _join_docs(docs, lists, "left")


def removal_digest(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ranges = removed_ranges(starts, length)
                kept = _kept(raw, ranges)
                rows.append((len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = _marked(with_text_id(docs.select("doc_id", "text")), length, keep_first)
    return marked.select(F.col("doc_id").cast("bigint"), "text", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _at_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges, less what would cut a character in two."""
    out = []
    for a, z in ranges:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents with later copies of passages cut out, the first kept, and n_chars to match.

    Other columns come as they were; a document that a cut leaves blank goes.
    """
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with doc, tid or starts
    base = with_text_id(docs.select("doc_id", "text", *[docs[c].alias(n) for c, n in own.items()]))
    marked = _marked(base, length, True).select(*[F.col(n).alias(c) for c, n in own.items()], F.col("starts").alias("_starts"))
    names, at, found_at = docs.columns, docs.columns.index("text"), len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, keep = [], []
            for text, starts in zip(b.column(at).to_pylist(), b.column(found_at).to_pylist(), strict=True):
                cut = text
                if starts:
                    raw = text.encode("utf-8", "surrogatepass")
                    cut = _kept(raw, _at_characters(raw, removed_ranges(starts, length))).decode("utf-8", "surrogatepass")
                texts.append(cut)
                keep.append(not starts or bool(cut.strip()))
            cols = list(b.columns[:found_at])
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                old = cols[i].to_pylist()
                cols[i] = pa.array([o if s is None or t is None else len(t) for o, s, t in zip(old, b.column(found_at).to_pylist(), texts, strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return marked.mapInArrow(run, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
