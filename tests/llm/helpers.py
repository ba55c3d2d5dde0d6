"""Small document tables with every awkward row, and plain versions of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("doc", "tid", "node", "key", "block", "rank", "size", "hash", "times", "edge", "starts", "_node", "_doc", "salt", "row", "target", "root")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(words):
        n = rng.randrange(vocabulary)
        out.append("".join("bdfgklmnprst"[n * k % 11] + "aeiou"[(n // k) % 5] for k in (1, 3, 7)))
    return " ".join(out)


def awkward(seed: int = 0) -> list[tuple]:
    """Null and empty fields, repeated rows, repeated and null ids, very long and non-ASCII texts, ties."""
    base, long = prose(seed, 120), prose(seed + 1, 6000)
    passage = prose(seed + 2, 60)
    rows = [
        (1, base, "en", "a", len(base)), (1, base, "en", "a", len(base)),
        (2, base, "en", "b", None), (None, base, None, "b", 3),
        (3, None, "en", "a", None), (4, "", "de", None, 0), (5, "   \n\t", "de", None, 5),
        (6, long, "en", "a", len(long)), (7, long + " end", "en", "c", 1),
        (8, base.replace(base.split()[50], "changed"), "fr", "c", 2),
        (9, "Ünï " + passage + " ça", "fr", "b", 4), (10, "x " + passage + " y z", "fr", "b", 4),
        (11, "aaaa" * 300, "en", "a", 1200), (12, "one two", "en", "a", 7), (13, "one two", "en", "a", 7),
        (14, "!!! 123 ???", "en", "d", 11), (-5, "日本語テスト 𝒳 é", "ja", "d", 11), (1, "another text for the id one", "en", "a", 9),
        (2**62, prose(seed + 3, 30), "en", "a", 1),
    ]
    rows += [(100 + i, prose(seed + 10 + i, 40 + i), "en" if i % 2 else "de", "abc"[i % 3], i) for i in range(25)]
    return rows


def documents(spark, rows=None, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHING]) if extra else df


def shingle_counts(text: str | None, n: int = 5) -> dict:
    words = (text or "").encode().split()
    n = min(n, len(words))
    out: dict = {}
    for i in range(len(words) - n + 1 if words else 0):
        k = tuple(words[i : i + n])
        out[k] = out.get(k, 0) + 1
    return out


def weighted_jaccard(a: dict, b: dict) -> float:
    low = sum(min(v, b.get(k, 0)) for k, v in a.items())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def repeated_bytes(texts: list[str | None], length: int, keep_first: bool) -> list[list[bool]]:
    """Which bytes lie in a string of ``length`` bytes that starts anywhere else (or earlier)."""
    raws = [(t or "").encode() for t in texts]
    places: dict = {}
    for i, r in enumerate(raws):
        for s in range(len(r) - length + 1):
            places.setdefault(r[s : s + length], []).append((i, s))
    out = [[False] * len(r) for r in raws]
    for where in places.values():
        for i, s in (where[1:] if keep_first else where if len(where) > 1 else []):
            out[i][s : s + length] = [True] * length
    return out
