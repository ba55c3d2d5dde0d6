"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score(x) = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so the pairwise interactions of all features cost time linear in them.  Inputs:
words hashed to 2 ** WORD_BITS buckets, valued by the root of their share of the
text and scaled to length 1; one feature for the bin of each structure statistic;
one for the bin of the metadata (n_chars).  All from the whole text.

Fitting: a bounded sample of labelled documents (about ``SAMPLE``, by a hash of
the id) is featurised by Spark where it lies and fitted by AdaGrad in one task
of that bounded size; the model has a fixed size and is broadcast.  Scoring
covers every document.

Edge cases: null and empty texts have structure features only and get a score;
a document without a label is scored like any other; repeated rows and labels
are learnt from once; without both labels the score is the share
of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import held_out, slices, table, unit_hash
from reelspark.llm.text_features import BINS, STATISTICS, WORDS, buckets, structure

WORD_BITS = 15
RANK = 8
SAMPLE = 12_000
EPOCHS = 6
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.7
#: Documents of a step.
STEP = 64
_STRUCTURE_AT = 1 << WORD_BITS
_META_AT = _STRUCTURE_AT + BINS * len(STATISTICS)
_META_BINS = 24
SIZE = _META_AT + _META_BINS + 1


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, values); the words share one unit of length, as do the structure features."""
    text = text or ""
    words = WORDS.findall(text.lower())
    ids, counts = buckets(words, WORD_BITS)
    values = np.sqrt(counts / max(1, counts.sum()))
    bins = structure(text, WORDS.findall(text))
    more = [_STRUCTURE_AT + BINS * i + b for i, b in enumerate(bins)]
    more.append(_META_AT + (_META_BINS if n_chars is None else min(_META_BINS - 1, int(np.log2(1 + max(0, n_chars))))))
    weight = 1 / np.sqrt(len(more))
    return np.concatenate([ids, np.asarray(more)]).astype(np.int32), np.concatenate([values, np.full(len(more), weight)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose features lie one after the other from ``starts``."""
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[ids] * x, starts)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """AdaGrad over steps of documents; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32))
    rate = float(y.mean()) if len(y) else 0.5
    if rate in (0.0, 1.0) or not len(y):
        m.bias, m.v[:] = float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), 0
        return m
    m.bias = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), STEP):
            step = order[a : a + STEP]
            lengths = np.array([len(rows[i][0]) for i in step])
            ids = np.concatenate([rows[i][0] for i in step])
            x = np.concatenate([rows[i][1] for i in step])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = m.v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = m.bias + np.add.reduceat(m.w[ids] * x, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            err = ((sigmoid(z) - y[step]) / len(step)).astype(np.float32)
            e = np.repeat(err, lengths) * x
            touched, at = np.unique(ids, return_inverse=True)
            dw = np.bincount(at, e, len(touched)).astype(np.float32) + DECAY * m.w[touched]
            pull = e[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(at, pull[:, f], len(touched)) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * m.v[touched]
            db = float(err.sum())
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += db * db
            m.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            m.v[touched] -= RATE * dv / np.sqrt(gv[touched])
            m.bias -= RATE * db / np.sqrt(gb)
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        made = [features(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary()), b.column(3)],
            names=["doc_id", "ids", "x", "label"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Machine:
    """(doc_id, text, n_chars) and (doc_id, label) rows to learn from -> the machine.

    About ``sample`` labelled rows are learnt from; only those reach the one
    task that fits, as feature lists.
    """
    labels = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.filter(unit_hash(F.col("doc_id"), seed=2) < share).select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    made = rows.select("doc_id", "text", F.col("n_chars").cast("bigint"), "label").mapInArrow(_featurise, "doc_id long, ids binary, x binary, label int").distinct()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "ids"])
        lists = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(df["ids"], df["x"], strict=True)]
        m = fit_machine(lists, df["label"].to_numpy(dtype=np.float32), epochs)
        return pd.DataFrame({"bias": [m.bias], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    got = made.groupBy(F.lit(0).alias("one")).applyInPandas(run, "bias double, w binary, v binary").collect()
    if not got:
        return fit_machine([], np.zeros(0, np.float32))
    return Machine(got[0]["bias"], np.frombuffer(got[0]["w"], np.float32), np.frombuffer(got[0]["v"], np.float32).reshape(SIZE, RANK))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, text, n_chars) -> doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            made = [features(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]]).astype(np.int64)
            z = m.raw(np.concatenate([i for i, _ in made]), np.concatenate([x for _, x in made]), starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(z.astype(np.float64)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col("n_chars").cast("bigint")).mapInArrow(run, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    machine = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
