"""Toxicity by classifier chains.

Categories are predicted one after the other by linear models; each later model
also gets the probabilities of the earlier ones.  In fitting, those
probabilities are out-of-fold (a model never scored the rows it was fitted on),
so later models learn from what they will meet.

Inputs of the linear models are hashed words with their beginnings and ends, for
languages that inflect (present or not).  Of all buckets those are kept whose rate in toxic and other documents differs by ``MIN_Z``
standard errors and that occur in ``MIN_DOCS`` documents, ``MAX_TERMS`` at most
by that z: words seen once or twice say nothing and would only add up in long
texts.

The tables label one category, ``toxic``.  The chain's earlier categories are
degrees of it, drawn from the labels and the kept buckets: ``severe`` (toxic,
with at least as many tell-tale words as the median toxic document) and
``pervasive`` (toxic, tell-tale words make up at least their median share).

Fitting takes a bounded sample of labelled documents (about ``SAMPLE``, by a hash
of the id; equal texts count once) in one task of that size; the model has a
bounded size and is broadcast.  The rarer class is taken whole up to half of the
sample, the other fills the rest, so a rare label is learnt from all its rows;
probabilities are brought back to the classes' true shares by the rates they were
taken at.  Scoring covers every whole document.

Edge cases: null and empty texts have no word and get the base rate; without a
toxic label, without any other, with fewer than ``MIN_DOCS`` documents of either,
or without a word that tells them apart, no document is rejected; repeated rows are
scored alike; rows without an id are scored but never learnt from; very long texts
are scored whole; an empty table gives no rows; ``classify`` reads doc_id and text
only, and ``keep_clean`` returns all columns, whatever their names, as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices, table, unit_hash
from reelspark.llm.text_features import part_buckets

CATEGORIES = ("severe", "pervasive", "toxic")
WORD_BITS = 22
SAMPLE = 12_000
MIN_Z, MIN_DOCS, MAX_TERMS = 6.0, 10, 2_000
FOLDS = 3
PASSES = 200
RATE = 0.5
PENALTY = 1e-4
THRESHOLD = 0.5


@dataclass
class Chain:
    """``terms`` are the kept buckets in order; ``weights[c]`` has a weight for
    each, then one for each earlier category's probability, then the bias.
    ``rates`` are the shares of toxic and of other documents that were learnt from."""

    terms: np.ndarray
    weights: list[np.ndarray]
    rates: tuple[float, float] = (1.0, 1.0)

    def probabilities(self, hits: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """hits: positions in ``terms``; rows: the document of each.  n x categories."""
        out = np.zeros((n, len(self.weights)))
        for c, w in enumerate(self.weights):
            k = len(self.terms)
            z = w[-1] + np.bincount(rows, w[:k][hits], n) + out[:, :c] @ w[k : k + c]
            out[:, c] = _sigmoid(z)
        toxic, other = self.rates  # every category is a degree of the last
        weight = out[:, -1] / toxic + (1 - out[:, -1]) / other
        return np.minimum(1.0, out / toxic / weight[:, None])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def positions(terms: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket lists -> (position in terms, document) of each kept bucket."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, ids in enumerate(found):
        at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
        at = at[terms[at] == ids]
        hits.append(at)
        rows.append(np.full(len(at), row))
    return np.concatenate(hits), np.concatenate(rows)


def pick_terms(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose rate differs most surely between the classes (each list holds a bucket once)."""
    total, pos = np.zeros(1 << WORD_BITS, np.int32), np.zeros(1 << WORD_BITS, np.int32)
    for ids, toxic in zip(found, y, strict=True):
        total[ids] += 1
        if toxic:
            pos[ids] += 1
    terms = np.flatnonzero(total >= MIN_DOCS)
    total, pos = total[terms], pos[terms]
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    rate = total / len(y)
    error = np.sqrt(np.maximum(1e-12, rate * (1 - rate) * (1 / n1 + 1 / n0)))
    z = np.abs(pos / n1 - (total - pos) / n0) / error
    best = np.argsort(-z, kind="stable")[:MAX_TERMS]
    return np.sort(terms[best[z[best] >= MIN_Z]])


def fit_linear(hits: np.ndarray, rows: np.ndarray, n: int, k: int, extra: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by AdaGrad over all rows at once."""
    w, g = np.zeros(k + extra.shape[1] + 1), None
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(PASSES):
        p = _sigmoid(w[-1] + np.bincount(rows, w[:k][hits], n) + extra @ w[k:-1])
        e = (p - y) / n
        d = np.concatenate([np.bincount(hits, e[rows], k), extra.T @ e, [e.sum()]])
        d[:-1] += PENALTY * w[:-1] / 100
        g = d * d if g is None else g + d * d
        w -= RATE * d / np.sqrt(g + 1e-12)
    return w


def fit_chain(found: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray) -> Chain:
    n = len(found)
    silent = Chain(np.zeros(0, np.int64), [np.array([0.0] * c + [-35.0]) for c in range(len(CATEGORIES))])
    if min(np.sum(toxic > 0), np.sum(toxic <= 0)) < MIN_DOCS:
        return silent
    terms = pick_terms(found, toxic)
    if not len(terms):  # nothing tells the classes apart
        return silent
    hits, rows = positions(terms, found)
    k = len(terms)
    sign = np.bincount(hits, toxic[rows], k) / np.maximum(1, np.bincount(hits, minlength=k)) > toxic.mean()
    tell = np.bincount(rows, sign[hits], n)
    share = tell / np.maximum(1, [len(f) for f in found])
    bad = toxic > 0
    severe = bad & (tell >= np.median(tell[bad]))
    pervasive = bad & (share >= np.median(share[bad]))
    weights, earlier = [], np.zeros((n, 0))
    for y in (severe, pervasive, bad):
        y = y.astype(float)
        weights.append(fit_linear(hits, rows, n, k, earlier, y))
        held = np.zeros(n)
        for f in range(FOLDS):
            out = folds == f
            inside = ~out[rows]
            keep = np.flatnonzero(~out)
            if not len(keep) or not out.any():
                continue
            renumber = np.cumsum(~out) - 1
            w = fit_linear(hits[inside], renumber[rows[inside]], len(keep), k, earlier[keep], y[keep])
            z = w[-1] + np.bincount(rows, w[:k][hits], n) + earlier @ w[k:-1]
            held[out] = _sigmoid(z)[out]
        earlier = np.column_stack([earlier, held])
    return Chain(terms, weights)


def _bucket_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [part_buckets(t, WORD_BITS).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["doc_id", "found", "toxic"])


def class_rates(toxic: int, other: int, sample: int) -> tuple[float, float]:
    """Shares of toxic and of other documents to learn from, about ``sample`` in all:
    the rarer class whole up to half of it, the other in what is left."""
    few, many = sorted((toxic, other))
    taken = min(few, sample // 2)
    by_size = (taken / max(1, few), min(1.0, (sample - taken) / max(1, many)))
    return by_size if toxic <= other else by_size[::-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """(doc_id, text) and (doc_id, toxic) -> the chain."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    counted = labels.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    rates = class_rates(*counted, sample)
    rate = F.when(F.col("toxic") > 0, rates[0]).otherwise(rates[1])
    chosen = labels.filter(unit_hash(F.col("doc_id"), seed=3) < rate).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    made = rows.select(F.col("doc_id").cast("bigint"), "text", "toxic").mapInArrow(_bucket_lists, "doc_id long, found binary, toxic int").distinct()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "found", "toxic"]).drop_duplicates(["found", "toxic"])
        found = [np.frombuffer(x, np.int32) for x in df["found"]]
        folds = (df["doc_id"].to_numpy() * 2654435761 >> 7) % FOLDS
        c = fit_chain(found, df["toxic"].to_numpy(dtype=float), folds)
        return pd.DataFrame({"terms": [c.terms.tobytes()], "weights": [[w.tolist() for w in c.weights]]})

    got = made.groupBy(F.lit(0).alias("one")).applyInPandas(run, "terms binary, weights array<array<double>>").collect()
    if not got:
        return fit_chain([], np.zeros(0), np.zeros(0))
    return Chain(np.frombuffer(got[0]["terms"], np.int64), [np.asarray(w) for w in got[0]["weights"]], rates)


def judge_texts(texts: list[str | None], chain: Chain) -> np.ndarray:
    found = [part_buckets(t, WORD_BITS) for t in texts]
    hits, rows = positions(chain.terms, found)
    return chain.probabilities(hits, rows, len(found))


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, text) -> doc_id, p_severe, p_pervasive, p_toxic for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = judge_texts(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain does not call toxic, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = judge_texts(b.column(at).to_pylist(), shared.value)
            yield b.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = classify(docs, chain)
    return out.select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
