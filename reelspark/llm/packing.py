"""Packing documents into sequences: best-fit decreasing with a segment tree.

Tokens come from ``tokenizers`` with a vocabulary file named by path.  Its
pre-tokenizer cuts a text into pieces that are encoded one by one, so each
worker keeps the ids of pieces it has met (a bounded table, emptied when full)
and only encodes new ones; tests hold this against encoding whole texts.

A document's ids (and an end id) are first cut into full windows, which are
sequences of their own.  The rest (shorter than a window) are dealt by a
written salt to groups of about ``GROUP_PIECES``, whose number grows with the
input, and each group is packed by itself: longest piece first, into the open
sequence with the least room that still takes it, found in a segment tree over
room 0..window.  A group leaves about one loosely filled sequence.

Sequences are padded to the window, except at a power of two: a text that fills
one exactly needs no padding.

Edge cases: null and empty texts have the end id only and are packed like any
other; repeated rows are packed each on its own; ties in length go by doc_id,
then checksum; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices, staged, table

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Remainders packed together by one task.
GROUP_PIECES = 50_000
#: Pieces a Python worker remembers, and the longest it keeps.
MEMORY_PIECES, MEMORY_LENGTH = 400_000, 48

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the vocabulary's pre-tokenizer keeps (fixed by the vocabulary file).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose folding, normal form or class may differ between libraries, and the start of special tokens.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
_BLANKS = re.compile(r"[ \t\r\n]+")


def _other(text: str) -> bool:
    return "<|" in text or not text.isascii() and bool(_OTHER.search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PieceIds(dict):
    """Piece -> ids as little-endian uint32 bytes, encoded when first met; emptied when full."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        coded = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())
        ids = struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := self.model.tokenize(coded)) else b""
        if len(piece) <= MEMORY_LENGTH:
            if len(self) >= MEMORY_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    Texts of plain Latin letters are cut into pieces here and only new pieces
    go to the model; chunks with any other character go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.tokenizer)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not _other(text):
            return self._plain(text)
        # the pre-tokenizer never joins what a blank parts
        return b"".join(self._whole(c) if _other(c) else self._plain(c) for c in _BLANKS.split(text))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the full windows and of the rest."""
    return [(a // 4, len(x) // 4, zlib.crc32(x)) for a in range(0, len(ids), 4 * window) if (x := ids[a : a + 4 * window])]


def tokenize(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> pieces of at most ``window`` ids, with a salt for dealing them to groups."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        count = TaskContext.get().partitionId() * 7919
        for b in slices(batches, 2 << 20):
            doc_ids = b.column(0).to_pylist()
            rows = []
            for doc, text in zip(doc_ids, b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                for start, length, crc in cut(ids, window):
                    rows.append((doc, start, length, crc, len(ids) // 4, count))
                    count += 1
            cols = list(zip(*rows, strict=True))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, _PIECES)


class Room:
    """Segment tree over the room that open sequences have left: counts per
    room, and the least room that is at least a given length."""

    def __init__(self, window: int):
        self.size = 1 << int(window).bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i, tree = room + self.size, self.tree
        while i:
            tree[i] += 1
            i >>= 1

    def tightest(self, length: int) -> int:
        """The least room >= length of an open sequence; -1 if there is none."""
        i, tree = length + self.size, self.tree
        if tree[i]:
            return length
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        i, tree = room + self.size, self.tree
        while i:
            tree[i] -= 1
            i >>= 1
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Lengths in falling order -> the sequence and offset of each."""
    room, sequence, offset, made = Room(window), [], [], 0
    for n in lengths:
        left = room.tightest(n)
        if left < 0:
            s, left, made = made, window, made + 1
        else:
            s = room.take(left)
        sequence.append(s)
        offset.append(window - left)
        if left > n:
            room.add(left - n, s)
    return sequence, offset


def group_count(pieces: DataFrame, per_group: int) -> int:
    return max(1, -(-pieces.count() // per_group))


def pack(pieces: DataFrame, window: int = WINDOW, per_group: int = GROUP_PIECES) -> DataFrame:
    """Written pieces -> pieces with sequence_id and offset.

    Full windows are sequences by themselves: even ids made of the salt, which
    no other piece has in its task.  Groups number theirs from their own range.
    """
    rest = pieces.filter(F.col("length") < window)
    n = group_count(rest, per_group)
    group = F.pmod(F.xxhash64("salt", "doc_id", "ids_crc32"), F.lit(n))

    def fit(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "ids_crc32", "start"], ascending=[False, True, True, True])
        sequence, offset = best_fit(df["length"].tolist(), window)
        out = df[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = (int(key[0]) << 32 | 1 << 62) + np.asarray(sequence, dtype="int64")
        out["offset"] = np.asarray(offset, dtype="int64")
        return out

    packed = rest.withColumn("grp", group).repartition(n, "grp").groupBy("grp").applyInPandas(fit, _PACKED)
    full = pieces.filter(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return full.select(*[c.split()[0] for c in _PACKED.split(", ")]).unionByName(packed)


def packed_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, per_group: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, text) -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = staged(tokenize(docs, path or vocabulary_path(), window, end_id), "pack-pieces")
    return pack(pieces, window, per_group)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
