"""Results that can be replaced under their readers.

A result is written to a version folder of its own; then one empty marker file beside
it is created, which is the commit.  Readers take the highest version that has a marker:
before the marker they see the last one, and a write that dies leaves nothing they
could see.  The last ``keep`` versions stay for readers that have already resolved one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import SparkSession

_MARKER = re.compile(r"^(\d{12})-([0-9a-f]{32})\.published$")


def files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path (any store that Spark writes to)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, hadoop


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions under ``path``, oldest first."""
    fs, where, _ = files(spark, path)
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    return [n.removesuffix(".published") for n in names if _MARKER.match(n)]


def latest(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest published version, None if there is none."""
    known = versions(spark, path)
    return f"{path}/{known[-1]}" if known else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Write a new version with ``write(folder)``, publish it, drop all but the last ``keep``; its folder.

    Two writers at once publish two versions; the later number, then name, is the newest.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    fs, where, hadoop = files(spark, path)
    known = versions(spark, path)
    number = int(known[-1].split("-")[0]) + 1 if known else 0
    name = f"{number:012d}-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    fs.create(hadoop.Path(where, f"{name}.published"), False).close()  # the commit
    for old in versions(spark, path)[:-keep]:
        fs.delete(hadoop.Path(where, f"{old}.published"), False)  # first out of sight, then gone
        fs.delete(hadoop.Path(where, old), True)
    return f"{path}/{name}"


def publish_model(model: ALSModel, path: str, keep: int = 2) -> str:
    """S11 under readers: the model as a new version."""
    spark = model.userFactors.sparkSession
    return publish(spark, path, lambda folder: model.write().save(folder), keep)


def load_latest_model(spark: SparkSession, path: str) -> ALSModel:
    """The newest published model."""
    folder = latest(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no published model under {path}")
    return ALSModel.load(folder)
