"""Phrase collocations by best-first branch and bound over prefix counts.

A phrase of 2 to ``LONGEST`` words is a candidate if it occurs ``MIN_COUNT`` times
in its language.  Cut after k words into parts that occur l and r times, it
scores floor(1000 * a * n / (l * r)) (a: its own count, n: all words of the
language); the lowest-scoring cut counts.  As a <= r at every cut, a phrase that
begins with a word of count f scores at most floor(1000 * n / f): the count of a
prefix bounds its whole subtree, and likewise the count of the last word.

So words are expanded in order of that bound, rarest first.  The frontier of a
language is a count ``theta``; a round counts the phrases that begin or end with
a word of the frontier, which gives every candidate with both its end words in
the frontier, all parts it can be cut into, and all phrases one word longer.  No
phrase beyond the frontier scores above floor(1000 * n / (theta + 1)); once
``TOP`` survivors score strictly more, the language is settled, ties included.
Otherwise its frontier grows by what is missing and only the new phrases are
counted.

Growth of a phrase is cut where a pair inside it is known not to be frequent.
Words of the frontier and frequent pairs reach the tasks as bitmaps of a fixed
size; a false bit only counts a phrase more, which the exact counts then drop.

A candidate goes if a longer one holds its words and occurs as often
(``CONTAINED`` percent); a phrase one word longer is at least as frequent as any
longer one, so only those are compared.

Edge cases: null texts are empty, a null lang is ``und``; a text without a word
adds nothing; repeated rows count each time; texts of any length are read whole;
phrases never cross pieces or documents; fewer than ``TOP`` survivors give fewer
rows and an empty table gives none; further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import bitmap, has_bits, mix64, slices, staged, table

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
CONTAINED = 100
#: Words of a language in its first frontier, for each phrase asked for.
FIRST_WORDS = 16
#: Bits of the bitmaps that reach every task: 8 MB of words, 16 MB of pairs.
WORD_BITS, PAIR_BITS = 26, 27
#: Bytes of text counted at once.
SLICE = 16 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PIECES = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_LOWER[0] + _PIECES + b"\t", _LOWER[1] + b"\n" * len(_PIECES) + b" ")


def words_of(texts: list[str]) -> pa.Array:
    """The words of the texts in order; a line feed stands between pieces.  Empty words are skipped by the callers."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_TABLE)
    return pc.split_pattern(pa.array([raw.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten()


def _texts_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    for b in slices(batches, SLICE):
        lang = pc.fill_null(b.column(0), "und")
        text = pc.fill_null(b.column(1), "")
        for name in pc.unique(lang).to_pylist():
            yield name, text.filter(pc.equal(lang, name)).to_pylist()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _texts_by_lang(batches):
        counted = words_of(texts).value_counts()
        word, n = counted.field("values"), counted.field("counts")
        keep = pc.and_(pc.not_equal(word, b""), pc.not_equal(word, b"\n"))
        word, n = word.filter(keep).cast(pa.string()), n.filter(keep)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), word, n], names=["lang", "phrase", "n"])


def word_bitmap(words: DataFrame) -> np.ndarray:
    return bitmap(words, F.xxhash64("lang", "phrase"), WORD_BITS)


def pair_hash(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    return mix64(a * _ODD + z)


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (b.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(a, z).view(np.int64))], names=["h"])

    ends = [F.xxhash64("lang", F.element_at(F.split("phrase", " "), at)) for at in (1, 2)]
    return bitmap(pairs.select(*ends).mapInArrow(run, "h long"), F.col("h"), PAIR_BITS)


def _numbered(lang: str, texts: list[str], frequent: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts as numbers of words (0 between pieces, 1 for words that are not
    frequent), the words by number and their hashes, which are Spark's xxhash64(lang, word)."""
    coded = words_of(texts).dictionary_encode()
    known = coded.dictionary
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known.to_pylist()), np.uint64, len(known))
    keep = has_bits(frequent, h, WORD_BITS)
    number = np.ones(len(known), np.int64)
    number[pc.equal(known, b"\n").to_numpy(zero_copy_only=False)] = 0
    empty = pc.equal(known, b"").to_numpy(zero_copy_only=False)
    number[empty] = -1
    keep &= number == 1
    number[keep] = np.arange(2, 2 + keep.sum())
    ids = number[coded.indices.to_numpy()]
    text = pa.concat_arrays([pa.array([b"\n", b"\x00"], pa.large_binary()), known.filter(pa.array(keep)).cast(pa.large_binary())])
    return ids[ids >= 0], text, np.concatenate([np.zeros(2, np.uint64), h[keep]])


def _count_phrases(shared, lengths: tuple[int, ...]):
    """Phrases of the wanted lengths that begin or end in the frontier and did not in the last one.

    Phrases are told apart by the numbers of their words, exactly, not by hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for lang, texts in _texts_by_lang(batches):
            ids, text, h = _numbered(lang, texts, s["frequent"])
            real = np.arange(len(h)) > 1
            inside, before = (has_bits(s[x], h, WORD_BITS) & real for x in ("frontier", "counted"))
            for words, count in _phrases(ids, h, inside, before, s["pairs"], lengths):
                phrase = pc.binary_join_element_wise(*[text.take(pa.array(w)) for w in words], pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(count)], names=["lang", "phrase", "n"])

    return run


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of whole numbers (each below its size) and their counts."""
    if math.prod(sizes) >= 1 << 62:  # would pass 64 bits when packed
        rows, count = np.unique(np.column_stack(columns), axis=0, return_counts=True)
        return list(rows.T), count
    key = columns[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        key = key * size + column
    key, count = np.unique(key, return_counts=True)
    out: list[np.ndarray] = []
    for size in reversed(sizes[1:]):
        out.append(key % size)
        key = key // size
    return [key, *reversed(out)], count


def _phrases(ids: np.ndarray, h: np.ndarray, inside: np.ndarray, before: np.ndarray, pairs: np.ndarray | None, lengths: tuple[int, ...]):
    """(words of each distinct phrase, its count) of every wanted length.

    With ``pairs``, a phrase goes on only through pairs that may be frequent: a pair
    with a word of the frontier has been counted, others are taken as they are.
    """
    pair = (ids[:-1] > 1) & (ids[1:] > 1)
    if pairs is not None:
        at = np.flatnonzero(pair & (inside[ids[:-1]] | inside[ids[1:]]))
        pair[at] = has_bits(pairs, pair_hash(h[ids[at]], h[ids[at + 1]]), PAIR_BITS)
    v, number = len(h), np.zeros(0, np.int64)
    if max(lengths) > 2:  # longer phrases are made of numbered pairs, and a last word if they are odd
        at = np.flatnonzero(pair)
        code, inverse = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)
        number = np.zeros(len(pair), np.int64)  # of the pair that starts here, where it is alive
        number[at] = inverse
    alive = pair
    for m in range(2, max(lengths) + 1):
        if m > 2:
            alive = alive[:-1] & pair[m - 2 :]
        if m not in lengths:
            continue
        a, z = ids[: len(alive)], ids[m - 1 :]
        at = np.flatnonzero(alive & (inside[a] | inside[z]) & ~(before[a] | before[z]))
        if not len(at):
            continue
        if m == 2:
            yield _distinct([ids[at], ids[at + 1]], [v, v])
            continue
        columns, sizes = [number[at + j] for j in range(0, m - 1, 2)], [len(code)] * (m // 2)
        found, count = _distinct([*columns, ids[at + m - 1]], [*sizes, v]) if m % 2 else _distinct(columns, sizes)
        words = [w for c in found[: m // 2] for w in (code[c] // v, code[c] % v)]
        yield [*words, *found[m // 2 :]], count


def _frequent(rows: DataFrame, min_count: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) on exact decimals (counts below 10 ** 15)."""
    a, n, l, r = (x.cast("decimal(15,0)") for x in (a, n, l, r))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (a * n), l * r)


def survivors(phrases: DataFrame, words: DataFrame, state: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates with both end words in the
    frontier that no longer phrase swallows; words and phrases are (lang, phrase, f)."""
    split = F.split("phrase", " ")
    ends = phrases.withColumn("w", split).withColumn("m", F.size("w"))
    last = [words.select("lang", F.col("phrase").alias(f"_{i}"), F.col("f").alias(f"f_{i}")) for i in (0, 1)]
    ends = ends.withColumn("_0", F.element_at("w", 1)).withColumn("_1", F.element_at("w", -1))
    near = ends.join(last[0], ["lang", "_0"]).join(last[1], ["lang", "_1"]).join(state, "lang")
    near = near.filter((F.col("f_0") <= F.col("theta")) & (F.col("f_1") <= F.col("theta")))
    part = lambda x, a, n: F.array_join(F.slice(x, a, n), " ")
    cuts = near.select("lang", "phrase", "n", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n", "a", "k", part("w", F.lit(1), F.col("k")).alias("head"), part("w", F.col("k") + 1, F.col("m")).alias("tail"))
    every = words.unionByName(phrases)
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    lowest = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    longer = ends.filter("m > 2").select("lang", "f", F.explode(F.array(part("w", F.lit(1), F.col("m") - 1), part("w", F.lit(2), F.col("m")))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < contained * F.col("a")))
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST, contained: int = CONTAINED, first_words: int = FIRST_WORDS) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language."""
    spark = docs.sparkSession
    texts = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    counts = staged(texts.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "phrase-words")
    words = staged(counts.filter(F.col("f") >= min_count), "phrase-frequent")
    totals = staged(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    # words by count: how many of a language a frontier takes
    steps = staged(words.groupBy("lang", "f").agg(F.count("*").alias("k")), "phrase-steps")
    upto = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    steps = staged(steps.withColumn("upto", F.sum("k").over(upto)), "phrase-steps")

    def frontier(wanted: DataFrame) -> DataFrame:
        """(lang, n, want) -> lang, n, want, theta: the smallest count that takes ``want`` words (or all)."""
        of = wanted.join(steps, "lang").groupBy("lang", "n", "want")
        theta = F.coalesce(F.min(F.when(F.col("upto") >= F.col("want"), F.col("f"))), F.max("f"))
        return staged(of.agg(theta.alias("theta"), F.max("f").alias("largest")), "phrase-frontier")

    state = frontier(totals.withColumn("want", F.lit(first_words * top).cast("bigint")))
    shared = {"frequent": word_bitmap(words), "counted": np.zeros(1 << (WORD_BITS - 3), np.uint8), "pairs": None}
    phrases, pairs = None, None
    while True:
        shared["frontier"] = word_bitmap(words.join(state, "lang").filter("f <= theta"))

        def counted(lengths):
            sent = spark.sparkContext.broadcast(dict(shared))  # of fixed size
            return staged(_frequent(texts.mapInArrow(_count_phrases(sent, lengths), "lang string, phrase string, n long"), min_count), "phrase-counts")

        shared["pairs"] = None
        new = counted((2,))
        pairs = new if pairs is None else pairs.unionByName(new)
        if longest > 2:
            shared["pairs"] = pair_bitmap(pairs)
            new = new.unionByName(counted(tuple(range(3, longest + 1))))
        phrases = new if phrases is None else phrases.unionByName(new)
        found = staged(survivors(phrases, words, state.select("lang", "n", "theta"), contained), "phrase-survivors")
        above = found.join(state.select("lang", "theta", "largest"), "lang").filter(F.col("score") > F.floor(1000 * F.col("n") / (F.col("theta") + 1)))
        sure = above.groupBy("lang").agg(F.count("*").alias("sure"))
        judged = state.join(sure, "lang", "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
        judged = staged(judged.withColumn("open", (F.col("theta") < F.col("largest")) & (F.col("sure") < top)), "phrase-judged")
        if judged.filter("open").isEmpty():
            break
        # as many more words as the survivors so far ask for: twice at least, 16 times at most
        more = F.greatest(F.lit(2.0), F.least(F.lit(16.0), F.lit(2.0 * top) / F.greatest(F.col("sure"), F.lit(1))))
        shared["counted"] = shared["frontier"]
        state = frontier(judged.select("lang", "n", F.when(F.col("open"), F.ceil(F.col("want") * more)).otherwise(F.col("want")).cast("bigint").alias("want")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
