"""Helpers the operators of this subpackage share: tables, written stages, labels, batches."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import ensure_checkpoint_dir

#: Words as the contracts count them: runs of anything but space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Remainder of crc32(doc_id) mod 4 whose documents are held out from learning.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read
    back: cuts the lineage, survives lost executors, is read column by column."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for documents kept from learning; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` each (one row at
    least), so that working memory does not follow the length of a batch."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = np.zeros(b.num_rows)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += np.nan_to_num(pc.binary_length(c).to_numpy(zero_copy_only=False).astype("float64"))
        part = (np.cumsum(sizes) // max_bytes).astype(int)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for a, z in itertools.pairwise(cuts):
            yield b.slice(a, z - a)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def bitmap(rows: DataFrame, hashes: Column, size: int) -> np.ndarray:
    """A bitmap of 2 ** size bits (as bytes), one set for each leading ``size`` bits that
    the hashes have.  Its non-zero 64-bit words are sent, 2 ** (size - 6) at most."""
    h = F.shiftrightunsigned(hashes, 64 - size)
    cells = rows.select(F.shiftright(h, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")).alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[got["cell"].to_numpy()] = got["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


def has_bits(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Whether the bits that the leading ``size`` bits of the hashes name are set."""
    at = h >> np.uint64(64 - size)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
