"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the character n-grams of every language: each
slot is a bit mask over the languages, an n-gram sets its language's bit in
``HASHES`` slots, and the AND of an n-gram's slots is the set of all languages
that contain it.  A text is decided by per-language popcounts of its n-grams'
masks.  A language's plane answers yes by chance with probability fill ** HASHES,
so a count c of n n-grams is corrected to (c - n * f) / (1 - f).

Learning: n-grams of a bounded sample of labelled texts (``SAMPLE`` per language
at most, by a hash of the row) are counted by Spark.  A language holds an n-gram
if it makes up ``MIN_SHARE`` of the language's n-grams and ``MIN_RATIO`` of its
largest share in any language; at most 1 / MIN_SHARE n-grams a language can do
so, which bounds the filter whatever the input.

Edge cases: null text and text without a letter give ``und`` with score 0; ties
go to the language first by code point; with no labelled text at all every
document is ``und``; texts are judged whole, in bounded slices of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import held_out, mix64, slices, table, unit_hash

UNKNOWN = "und"
SAMPLE = 2_000
MIN_SHARE = 1e-5
MIN_RATIO = 0.25
HASHES = 2
#: Slots of the filter for each n-gram in it.
SLOTS_PER_GRAM = 16
#: Languages of a word of a mask; a slot has as many words as they need.
WORD = 64
#: Characters looked at together.
CHARS = 1 << 19

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(codes: np.ndarray) -> np.ndarray:
    """The 3-grams around each letter but the first and last code, other characters read as one blank."""
    c = np.where(letter_table()[codes], codes, 0).astype(np.uint64)
    g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return g[c[1:-1] > 0]


def text_grams(text: str) -> Iterator[np.ndarray]:
    """The grams of a whole text in bounded parts, blanks around it."""
    codes = np.concatenate([[0], code_points(text), [0]]).astype(np.uint32)
    for a in range(0, len(codes) - 2, CHARS):
        g = grams(codes[a : a + CHARS + 2])
        if len(g):
            yield g


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, text) -> lang, gram, n; counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(text_grams(text or ""))
            for lang, parts in by_lang.items():
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """``slots[i]`` is the mask of languages in slot i, or a row of words of it for more than ``WORD``."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    def masks(self, g: np.ndarray) -> np.ndarray:
        out = np.full((len(g), *self.slots.shape[1:]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in _places(g, len(self.slots)):
            out &= self.slots[i]
        return out


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    """Language k's bit of each mask."""
    word = masks if masks.ndim == 1 else masks[:, k // WORD]
    return (word >> np.uint64(k % WORD)) & np.uint64(1)


def _places(g: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = mix64(g)
    for _ in range(HASHES):
        yield (h & np.uint64(slots - 1)).astype(np.int64)
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15))


def build_filter(held: dict[str, np.ndarray]) -> Filter:
    """Language -> its n-grams."""
    languages = sorted(held)
    most = max((len(g) for g in held.values()), default=1)
    size, words = 1 << max(10, int(SLOTS_PER_GRAM * most - 1).bit_length()), max(1, -(-len(languages) // WORD))
    slots = np.zeros(size if words == 1 else (size, words), dtype=np.uint64)
    for k, lang in enumerate(languages):
        plane = slots if words == 1 else slots[:, k // WORD]
        for i in _places(held[lang], size):
            np.bitwise_or.at(plane, i, np.uint64(1 << k % WORD))
    fill = np.array([_bit(slots, k).mean() for k in range(len(languages))])
    return Filter(languages, slots, fill**HASHES)


def learn(docs: DataFrame, sample: int = SAMPLE, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> Filter:
    """(doc_id, text, lang) rows to learn from -> the filter.

    Rows whose hash lies under sample / rows-of-the-language are learnt from:
    about ``sample`` texts a language, chosen by their values alone.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return build_filter({})
    share = F.create_map(*[x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chosen = rows.filter(unit_hash(F.col("doc_id"), F.col("text"), seed=1) < share[F.col("lang")])
    counts = count_grams(chosen)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("by"))
    kept = top.select("gram", "top", F.explode("by").alias("b")).filter((F.col("b.share") >= min_share) & (F.col("b.share") >= min_ratio * F.col("top")))
    rows_ = kept.groupBy("b.lang").agg(F.collect_list("gram").alias("grams")).collect()
    held = {lang: np.zeros(0, np.uint64) for lang in per_lang}
    held |= {r["lang"]: np.asarray(r["grams"], dtype=np.int64).astype(np.uint64) for r in rows_}
    return build_filter(held)


def judge(text: str | None, f: Filter) -> tuple[str, float]:
    """(language, score): the score is the language's part of all corrected counts."""
    n, counts = 0, np.zeros(len(f.languages))
    for g in text_grams(text or ""):
        m = f.masks(g)
        n += len(g)
        counts += [np.count_nonzero(_bit(m, k)) for k in range(len(f.languages))]
    if n == 0 or not f.languages:
        return UNKNOWN, 0.0
    real = np.clip((counts - n * f.false_positive) / np.maximum(1e-9, 1 - f.false_positive), 0, None)
    best = int(real.argmax())
    return f.languages[best], float(real[best] / real.sum()) if real.sum() > 0 else 0.0


def identify(docs: DataFrame, f: Filter) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in slices(batches):
            found = [judge(t, f) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    f = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, f).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
