"""CSV files read once into good rows and rejects.

A value that does not parse, or a row with too few or too many fields, becomes null in
Spark's permissive reading and is lost from sight.  Here the declared schema has a
corrupt-record column beside it, and one read writes one Parquet table of good rows and
rejects (partitioned by which they are), so nothing is parsed twice and both sides add
up.  A reject keeps its file, its text where the parser kept it, and its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_CORRUPT = "_corrupt_record"


@dataclass
class Parsed:
    """``good``: rows of the schema; ``rejects``: the same columns with file, line and
    reason (``unparsable`` or ``no <column>``)."""

    good: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """One row: good, rejected."""
        sides = self.good.select(F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(self.rejects.select(F.lit(0).alias("g"), F.lit(1).alias("r")))
        return sides.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("good"), F.coalesce(F.sum("r"), F.lit(0)).alias("rejected"))

    def reasons(self) -> DataFrame:
        return self.rejects.groupBy("reason").agg(F.count("*").alias("rows"))


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, out: str, required: tuple[str, ...] = (), header: bool = True) -> Parsed:
    """Parse ``path`` once and write good rows and rejects below ``out`` (replacing it).

    Rejected are rows that do not parse as ``schema`` and rows in which a ``required``
    column is null.  A header must name the schema's columns in this order.
    """
    wide = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    raw = spark.read.schema(wide).option("header", header).option("enforceSchema", False).option("escape", '"')
    rows = raw.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).csv(path)
    reason = F.when(F.col(_CORRUPT).isNotNull(), F.lit("unparsable"))
    for c in required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"no {c}"))
    names = schema.fieldNames()
    told = rows.select(*names, F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("line"), reason.alias("reason"))
    told = told.withColumn("side", F.when(F.col("reason").isNull(), "good").otherwise("rejects"))
    # good rows need neither their file nor their text
    told = told.withColumn("file", F.when(F.col("side") == "rejects", F.col("file")))
    told.write.mode("overwrite").partitionBy("side").parquet(out)
    back = spark.read.schema(told.schema).parquet(out)
    return Parsed(back.filter("side = 'good'").select(*names), back.filter("side = 'rejects'").drop("side"))
