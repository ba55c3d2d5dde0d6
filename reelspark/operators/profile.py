"""Profiling a ratings / movies table as single aggregate jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from reelspark.operators.prepare import density_flags


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, num_rows), one partial-aggregated count per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(name).alias("table_name"), "num_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order (top-k, not a full sort)."""
    if n < 0:
        raise ValueError("n must be non-negative")
    return df.orderBy(*order_by).limit(n)


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample stddev, min, max per numeric column, typed.

    One aggregate job over all columns; the result is unpivoted to one row
    per column: (column_name, n, mean, stddev, min_value, max_value).
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cols = columns or numeric
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(F.col(c)).alias(f"{c}__n"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__stddev"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"{c}__n").alias("n"),
                    F.col(f"{c}__mean").alias("mean"),
                    F.col(f"{c}__stddev").alias("stddev"),
                    F.col(f"{c}__min").alias("min_value"),
                    F.col(f"{c}__max").alias("max_value"),
                )
                for c in cols
            ]
        )
    )
    return wide.select(rows.alias("r")).select("r.*")


def missing_counts(df: DataFrame, include_nan: bool = True) -> DataFrame:
    """Per column, how many rows are null (or NaN, for float columns)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        bad = c.isNull()
        if include_nan and isinstance(f.dataType, NumericType):
            if isinstance(f.dataType, (FloatType, DoubleType)):
                bad = bad | F.isnan(c)
        out.append(F.count_if(bad).alias(f.name))
    return df.agg(*out)


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """(rating, count) ordered by rating; the null rating is a group too."""
    return ratings.groupBy("rating").count().orderBy(F.col("rating").asc_nulls_first())


def data_reduction(ratings_clean: DataFrame, min_user_ratings: int = 20, min_movie_ratings: int = 20) -> DataFrame:
    """Rows before and after the density filter and the reduction in %,
    in one aggregate over the flagged rows."""
    flagged = density_flags(ratings_clean, min_user_ratings, min_movie_ratings)
    return flagged.agg(
        F.count(F.lit(1)).alias("original_rows"), F.count_if(F.col("keep")).alias("filtered_rows")
    ).select(
        "original_rows",
        "filtered_rows",
        # null (not an error) when there is nothing to reduce
        (F.try_divide((F.col("original_rows") - F.col("filtered_rows")).cast("double"), F.col("original_rows"))
         * 100.0).alias("reduction_pct"),
    )
