"""Tables written once to the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from reelspark.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of its own: the lineage is cut, lost executors cost nothing done.
    ``by``: its last column, by whose values the table is partitioned."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for intermediate tables")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
