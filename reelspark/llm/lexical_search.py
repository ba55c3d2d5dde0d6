"""Ranked lexical search of many items at once, by shared partial scores.

A document's score for an item is the sum, over the item's distinct terms, of an
integer weight that depends on term and document only.  Items share terms, so
sums are shared: terms that occur in the same items become one set, and among the
items (each a list of sets, commonest first) neighbours that stand together in two
items or more are merged round by round into larger shared sets.  What comes out
is a graph without cycles: leaves are terms, inner nodes shared term sets, roots
the items.  Over a batch of documents every node is one row of partial scores,
materialised once, level by level, and used by all nodes above it.

Items are dealt to waves of about ``WAVE_TERMS`` terms, so that a graph and the
vocabulary it needs, which reach every task, have a bounded size.  For each wave
the documents are read once to count their terms (kept as numbers of the wave's
terms), then scored from those numbers.  Every task keeps the best ``k``
documents of each item, which Spark merges.

Everything is 64-bit integer arithmetic but the logarithm of a term's weight.

Edge cases: null and empty texts have no term, count in no statistic and score
nothing; items with a null or empty text get no row; rows that share an item_id
(null included) are one item with the terms of all; repeated documents are each
ranked; a null doc_id comes after all others of its score; texts of any length
are read whole; empty tables give no row; further columns may have any name.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import slices, staged, table

K = 50
#: Terms of a wave, counted once for each item that has them; an item is never cut.
WAVE_TERMS = 1 << 18
#: Cells (nodes x documents) that a task holds.
CELLS = 4 << 20
#: Bytes of text counted at once.
SLICE = 8 << 20
#: Documents that a task scores, at least.
TASK_DOCS = 8192

_KEPT = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEPT else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


@dataclass
class Graph:
    """``terms``: the leaves in order; ``levels``: per level (first node, children one
    after the other, where each node's children begin); ``roots``: each item's node."""

    terms: list[bytes]
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    nodes: int
    roots: np.ndarray

    def totals(self, leaves: np.ndarray) -> np.ndarray:
        """Rows of the terms' scores -> rows of the items' scores (a column a document)."""
        at = np.zeros((self.nodes, leaves.shape[1]), np.int64)
        at[: len(self.terms)] = leaves
        for first, children, starts in self.levels:
            at[first : first + len(starts)] = np.add.reduceat(at[children], starts, axis=0)
        return at[self.roots]


def _merge_neighbours(lists: list[list[int]], fresh: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """One round: neighbours that stand together in two lists or more become one number."""
    count = Counter(pair for x in lists for pair in zip(x, x[1:]))
    good = {pair: c for pair, c in count.items() if c > 1}
    if not good:
        return lists, {}
    made: dict[tuple[int, int], int] = {}
    out = []
    for x in lists:
        # of overlapping pairs the one that more items share goes first
        taken = [False] * len(x)
        begins = set()
        for i in sorted((i for i in range(len(x) - 1) if (x[i], x[i + 1]) in good), key=lambda i: (-good[x[i], x[i + 1]], i)):
            if not taken[i] and not taken[i + 1]:
                taken[i] = taken[i + 1] = True
                begins.add(i)
        y, i = [], 0
        while i < len(x):
            if i in begins:
                y.append(made.setdefault((x[i], x[i + 1]), fresh + len(made)))
                i += 1
            else:
                y.append(x[i])
            i += 1
        out.append(y)
    return out, {n: pair for pair, n in made.items()}


def share(items: list[list[bytes]]) -> Graph:
    """Distinct terms of each item -> the graph that adds them up."""
    where: dict[bytes, list[int]] = {}
    for i, terms in enumerate(items):
        for t in terms:
            where.setdefault(t, []).append(i)
    alike: dict[tuple[int, ...], list[bytes]] = {}
    for t in sorted(where):
        alike.setdefault(tuple(where[t]), []).append(t)
    terms = [t for group in alike.values() for t in group]
    parts: dict[int, list[int]] = {}  # inner node -> its children
    lists: list[list[int]] = [[] for _ in items]
    first = dict(zip(alike, np.cumsum([0, *map(len, alike.values())]).tolist(), strict=False))
    fresh = len(terms)
    for owners in sorted(alike, key=lambda o: (-len(o), o)):  # sets of most items come first in every list
        node, size = first[owners], len(alike[owners])
        if len(owners) == 1:  # nobody else's: leaves of the item itself
            lists[owners[0]].extend(range(node, node + size))
            continue
        if size > 1:
            parts[fresh] = list(range(node, node + size))
            node, fresh = fresh, fresh + 1
        for i in owners:
            lists[i].append(node)
    while True:
        lists, made = _merge_neighbours(lists, fresh)
        if not made:
            break
        parts.update({n: list(pair) for n, pair in made.items()})
        fresh += len(made)
    roots = np.zeros(len(items), np.int64)
    for i, x in enumerate(lists):
        roots[i], fresh = fresh, fresh + 1
        parts[int(roots[i])] = x
    return _levelled(terms, parts, roots)


def _levelled(terms: list[bytes], parts: dict[int, list[int]], roots: np.ndarray) -> Graph:
    """Nodes renumbered level by level, so that a level is added up at once."""
    depth = {i: 0 for i in range(len(terms))}
    for n in sorted(parts):  # children have smaller numbers
        depth[n] = 1 + max((depth[c] for c in parts[n]), default=0)
    number = {i: i for i in range(len(terms))}
    levels, free = [], len(terms)
    for level in range(1, max(depth.values(), default=0) + 1):
        here = [n for n in sorted(parts) if depth[n] == level]
        children = [number[c] for n in here for c in parts[n]]
        starts = np.cumsum([0, *[len(parts[n]) for n in here[:-1]]])
        levels.append((free, np.array(children, np.int64), starts.astype(np.int64)))
        for n in here:
            number[n] = free
            free += 1
    return Graph(terms, levels, free, np.array([number[int(r)] for r in roots], np.int64))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, SLICE):
        rows = [(i, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms_of(x))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "term"])


def graphs(items: DataFrame, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """(item_id, text) -> one row a wave: wave, item_ids, graph (packed)."""
    terms = items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(_item_terms, "item_id long, term binary")
    per_item = staged(terms.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "search-items")
    waves = max(1, -(-(per_item.agg(F.sum(F.size("terms"))).first()[0] or 0) // wave_terms))

    def build(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("item_id", na_position="last")
        g = share([list(t) for t in df["terms"]])
        ids = [None if pd.isna(i) else int(i) for i in df["id_text"]]
        return pd.DataFrame({"wave": [key[0]], "item_ids": [ids], "graph": [pickle.dumps(g)]})

    dealt = per_item.select(F.pmod(F.xxhash64("item_id"), F.lit(waves)).cast("int").alias("wave"), "item_id", F.col("item_id").cast("string").alias("id_text"), "terms")
    return staged(dealt.groupBy("wave").applyInPandas(build, "wave int, item_ids array<long>, graph binary"), "search-graphs")


def _postings(shared):
    """(doc_id, text) -> doc_id, n and the wave's terms with their counts, of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        number = {t: i for i, t in enumerate(terms)}
        for b in slices(batches, SLICE):
            texts = [(t or "").encode("utf-8", "surrogatepass").translate(_TERMS) for t in b.column(1).to_pylist()]
            coded = pc.split_pattern(pa.array([b" \x00 ".join(texts)], pa.large_binary()), b" ").flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()  # no term holds a zero byte: it stands between documents
            kind = np.array([-3 if w == b"" else -2 if w == b"\x00" else number.get(w, -1) for w in known], np.int64)
            ids = kind[coded.indices.to_numpy()]
            doc = np.cumsum(ids == -2)
            n = np.bincount(doc[ids >= -1], minlength=len(texts))
            mine = ids >= 0
            pair, tf = np.unique(doc[mine] * max(1, len(terms)) + ids[mine], return_counts=True)
            of, term = pair // max(1, len(terms)), (pair % max(1, len(terms))).astype(np.int32)
            cut = np.searchsorted(of, np.arange(len(texts) + 1)) * 4
            term, tf = term.tobytes(), tf.astype(np.int32).tobytes()
            some = np.flatnonzero(n)
            parts = [pa.array([x[cut[i] : cut[i + 1]] for i in some], pa.binary()) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(n[some]), *parts], names=["doc_id", "n", "terms", "tf"])

    return run


def _holding(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_scores(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of terms that occur tf times in documents of n terms."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _scored(shared, k: int, cells: int):
    """Postings -> the k best documents of each item among the task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, item_ids, w, n_docs, n_terms = shared.value
        width = max(1, cells // graph.nodes)
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))  # item, document, null id, score
        least = np.ones(len(item_ids), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, width):
                part = b.slice(at, width)
                terms, tfs = (part.column(c).to_pylist() for c in (2, 3))
                column = np.repeat(np.arange(part.num_rows), [len(t) // 4 for t in terms])
                term, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (terms, tfs))
                n = part.column(1).to_numpy()
                leaves = np.zeros((len(graph.terms), part.num_rows), np.int64)
                leaves[term, column] = term_scores(w[term], tf, n[column], n_docs, n_terms)
                total = graph.totals(leaves)
                item, hit = np.nonzero(total >= least[:, None])
                ids, null = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                new = (item, ids[hit], null[hit], total[item, hit])
                item, doc, null, score = (np.concatenate(x) for x in zip(kept, new, strict=True))
                order = np.lexsort((doc, null, -score, item))
                place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
                order = order[place < k]
                kept = tuple(x[order] for x in (item, doc, null, score))
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(least)) == k)
                ends = np.searchsorted(kept[0], full, side="right") - 1
                least[full] = kept[3][ends]  # later documents can still win a tie by their id
        item, doc, null, score = kept
        ids = pa.array(item_ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([ids, pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    plans = graphs(items, wave_terms)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for wave in [r[0] for r in plans.select("wave").orderBy("wave").collect()]:
        row = plans.filter(F.col("wave") == wave).first()  # of bounded size
        graph = pickle.loads(row["graph"])
        sent = spark.sparkContext.broadcast(graph.terms)
        postings = staged(texts.mapInArrow(_postings(sent), "doc_id long, n long, terms binary, tf binary"), "search-postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        held = postings.select("terms").mapInArrow(_holding(len(graph.terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        w = np.zeros(len(graph.terms), np.int64)
        for r in held.collect():  # a row a term of the wave at most
            w[r["term"]] = weight(n_docs, r["df"])
        sent = spark.sparkContext.broadcast((graph, row["item_ids"], w, n_docs, n_terms))
        # a task returns k documents an item, so it reads many more than k
        best = postings.coalesce(max(1, n_docs // TASK_DOCS)).mapInArrow(_scored(sent, k, CELLS), "item_id long, doc_id long, score long")
        found = found.unionByName(staged(best, "search-best"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: DuckDB: every item's terms against every document's.
ORACLE = rf"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM words WHERE len(terms) > 0),
occurrences AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM occurrences, sizes GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark WHERE text IS NOT NULL),
lengths AS (SELECT row_id, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM words, sizes WHERE len(terms) > 0),
scores AS (
  SELECT a.item_id, l.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN occurrences o USING (term) JOIN lengths l USING (row_id)
  GROUP BY a.item_id, l.row_id, l.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {K}
"""
