"""Features of whole texts for the linear and factorised models: hashed words and structure."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

WORDS = re.compile(r"\w+")
#: Words a worker remembers the hash of.
MEMORY_WORDS = 150_000


class WordHash(dict):
    """Word -> bucket of 2 ** bits; emptied when full."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        h = (h ^ (h >> 13)) & self.mask
        if len(word) <= 48:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = h
        return h


class WordParts(dict):
    """Word -> buckets (int32 bytes) of the word, its beginnings and its ends; emptied when full."""

    def __init__(self, bits: int, starts: tuple[int, ...] = (4, 5, 6), ends: tuple[int, ...] = (4, 5)):
        super().__init__()
        self.bits, self.starts, self.ends = bits, starts, ends

    def __missing__(self, word: str) -> bytes:
        n, mask = len(word), (1 << self.bits) - 1
        parts = [word, *["^" + word[:k] for k in self.starts if n >= k], *[word[-k:] + "$" for k in self.ends if n >= k]]
        out = np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & mask for p in parts], dtype=np.int32).tobytes()
        if n <= 48:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = out
        return out


_PARTS: dict[int, WordParts] = {}


def part_buckets(text: str | None, bits: int) -> np.ndarray:
    """Distinct buckets of the parts of a text's words, ascending."""
    known = _PARTS.setdefault(bits, WordParts(bits))
    words = set(WORDS.findall((text or "").lower()))
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32)).astype(np.int64)


_HASHES: dict[int, WordHash] = {}


def word_hash(bits: int) -> WordHash:
    return _HASHES.setdefault(bits, WordHash(bits))


def buckets(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and how often each occurs."""
    h = np.fromiter(map(word_hash(bits).__getitem__, words), dtype=np.int64, count=len(words))
    return np.unique(h, return_counts=True)


def _byte_classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 sentence mark, 6 other ASCII mark, 7 line end, 8 beyond ASCII."""
    c = np.zeros(256, dtype=np.int64)
    c[33:127] = 6
    c[65:91], c[97:123], c[48:58], c[[32, 9]] = 1, 2, 3, 4
    c[[ord(x) for x in ".,;:?'\"-"]] = 5
    c[[10, 13]], c[128:] = 7, 8
    return c


_CLASSES = _byte_classes()
#: Structure statistics, in order; each gives one of BINS buckets.
STATISTICS = (
    "bytes", "words", "lines", "word length", "upper", "digit", "sentence marks", "other marks", "beyond ascii",
    "distinct words", "commonest word", "doubled words", "repeated lines", "words a line", "longest word", "bars", "shouts",
)
BINS = 12


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(1 + x)))


def _share_bin(x: float) -> int:
    """Finer near 0, where shares of a text tell most."""
    return min(BINS - 1, int(BINS * min(1.0, max(0.0, x)) ** 0.5))


def structure(text: str, words: list[str]) -> list[int]:
    """The bin of each statistic of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(raw))
    k = np.bincount(_CLASSES[raw], minlength=9)
    letters = max(1, k[1] + k[2] + k[8])
    w = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    doubled = sum(map(str.__eq__, words, words[1:]))
    return [
        _log_bin(n / 16),
        _log_bin(len(words) / 4),
        _log_bin(len(lines)),
        min(BINS - 1, int(sum(map(len, words)) / w)),
        _share_bin(k[1] / letters),
        _share_bin(k[3] / n),
        _share_bin(k[5] / n),
        _share_bin(k[6] / n),
        _share_bin(k[8] / n),
        _share_bin(len(count) / w),
        _share_bin(max(count.values(), default=0) / w),
        _share_bin(doubled / w),
        _share_bin(1 - len(set(lines)) / len(lines) if lines else 0.0),
        _log_bin(len(words) / max(1, len(lines))),
        _log_bin(max(map(len, count), default=0)),
        _share_bin(text.count("|") / w),
        _share_bin(text.count("!") / w),
    ]
