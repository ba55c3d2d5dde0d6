"""The offline pipeline as one composed job graph.

ratings, movies
  -> clean (R1) -> calendar features (R2) -> density filter (R7)
  -> reproducible split (R8) -> ALS fit (M1) -> predictions + RMSE/MAE (M2-M6)
  -> batch top-N with movie info (N6)
with the Parquet/model sinks of the reference (S9-S11).

Nothing is collected except the single-row metrics.  The raw ratings are parsed
once: cleaned rows go to Parquet, from which the density filter's counts and rows
are read column by column.  The prepared ratings are labelled train/test and
written as a Parquet table partitioned by the label; both halves are read back
(partition pruning).  Each written table cuts the lineage: a lost executor
recomputes from files, not from the raw text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import model as M
from reelspark.operators import prepare, recommend, versions
from reelspark.operators.staging import staged
from reelspark.sources import io
from reelspark.sources.schemas import with_int_ids

# fixed values: the folder names of the stored data
DATA_DIR = "preprocessed_data"
RATINGS_DIR = "ratings_data"
MOVIES_DIR = "movies_data"
MODEL_DIR = "model"
RECS_DIR = "user_recommendations"


@dataclass
class TrainingResult:
    model: ALSModel
    metrics: DataFrame  # one row: rmse, mae, n
    train: DataFrame
    test: DataFrame
    recommendations: DataFrame  # (userId, movieId, title, genres, score)


def prepare_ratings(ratings: DataFrame, min_user_ratings: int = 20, min_movie_ratings: int = 20) -> DataFrame:
    """R1 -> R2 -> R7."""
    clean = prepare.drop_incomplete(ratings)
    return prepare.add_time_features(prepare.density_filter(clean, min_user_ratings, min_movie_ratings))


def run_training(
    spark: SparkSession,
    ratings: DataFrame,
    movies: DataFrame,
    out_dir: str,
    top_n: int = 20,
    seed: int = 42,
    weights=(0.8, 0.2),
    min_user_ratings: int = 20,
    min_movie_ratings: int = 20,
    recs_user_buckets: int | None = None,
    **als_params,
) -> TrainingResult:
    """Run the whole offline pipeline, writing under ``out_dir`` (a shared
    folder on a cluster): preprocessed_data/clean_ratings,
    preprocessed_data/ratings_data/split={train,test},
    preprocessed_data/movies_data, model/, user_recommendations/.

    Ids that are no 32-bit integers fail the job (ALS would merge them)."""
    data_dir = os.path.join(out_dir, DATA_DIR)
    clean_path, ratings_path = os.path.join(data_dir, "clean_ratings"), os.path.join(data_dir, RATINGS_DIR)
    movies_path = os.path.join(data_dir, MOVIES_DIR)
    io.write_parquet(prepare.drop_incomplete(with_int_ids(ratings, "userId", "movieId")), clean_path)
    dense = prepare_ratings(io.read_parquet(spark, clean_path), min_user_ratings, min_movie_ratings)
    labelled = prepare.label_split(dense, weights, seed, names=("train", "test"))
    io.write_parquet(labelled, ratings_path, partition_by=["split"])
    ordered = with_int_ids(movies, "movieId").repartitionByRange("movieId").sortWithinPartitions("movieId")
    io.write_parquet(ordered, movies_path)  # sorted, so that a lookup by id skips row groups
    stored = io.read_parquet(spark, ratings_path)
    train = stored.filter(F.col("split") == "train").drop("split")
    test = stored.filter(F.col("split") == "test").drop("split")
    catalog = io.read_parquet(spark, movies_path)

    als_params.setdefault("seed", seed)
    fitted = M.fit_als(train, **als_params)
    M.save_model(fitted, os.path.join(out_dir, MODEL_DIR))

    metrics = M.error_metrics(M.predict(fitted, test))
    recs_path = os.path.join(out_dir, RECS_DIR)
    recs = recommend.batch_recommendations(fitted, catalog, top_n)
    if recs_user_buckets:
        recs = recs.withColumn("user_bucket", user_bucket(F.col("userId"), recs_user_buckets))
        # a bucket's rows meet in one task and file, its users one after the other
        recs = recs.repartition(recs_user_buckets, "user_bucket").sortWithinPartitions("user_bucket", "userId")
        io.write_parquet(recs, recs_path, partition_by=["user_bucket"])
    else:
        io.write_parquet(recs, recs_path)
    stored = io.read_parquet(spark, recs_path)
    if recs_user_buckets:
        stored = stored.drop("user_bucket")
    return TrainingResult(fitted, metrics, train, test, stored)


def user_bucket(user_id, buckets: int):
    """S10 layout: the directory a user's recommendations are written to."""
    return F.pmod(user_id, F.lit(int(buckets)))


def refresh_recommendations(recs: DataFrame, path: str, buckets: int) -> list[int]:
    """S10/N6 again after a new model: rewrite only the buckets in which a user's list
    changed, appeared or went; their numbers, in order (none: nothing is written).

    Each user's list is reduced to a fingerprint (its rows' hashes summed, and their
    count) on both sides, and one outer join finds the users that differ.
    """
    spark = recs.sparkSession
    new = recs.select("userId", "movieId", "title", "genres", "score").withColumn("user_bucket", user_bucket(F.col("userId"), buckets))
    fs, where, hadoop = versions.files(spark, path)
    if not fs.exists(where):
        stored = new.limit(0)
    else:
        stored = spark.read.schema(new.schema).parquet(path)

    def prints(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64("movieId", "title", "genres", "score").cast("decimal(20,0)")
        return df.groupBy("userId", "user_bucket").agg(F.struct(F.sum(h), F.count("*")).alias(name))

    both = prints(new, "new").join(prints(stored, "old"), ["userId", "user_bucket"], "full")
    differ = both.filter(~F.col("new").eqNullSafe(F.col("old")))
    changed = sorted(r[0] for r in differ.select("user_bucket").distinct().collect())  # as many as buckets at most
    if not changed:
        return []
    rows = new.filter(F.col("user_bucket").isin(changed)).repartition(len(changed), "user_bucket").sortWithinPartitions("user_bucket", "userId")
    rows = staged(rows, "recs-changed")  # read no bucket that is being replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_bucket").parquet(path)
    left = {r[0] for r in rows.select("user_bucket").distinct().collect()}
    for gone in set(changed) - left:  # no user of the bucket is left
        fs.delete(hadoop.Path(where, f"user_bucket={gone}"), True)
    return changed


def read_user_recommendations(
    spark: SparkSession, path: str, user_id: int, buckets: int | None = None
) -> DataFrame:
    """One user's stored recommendations, best first.  With the bucketed
    layout (``buckets`` as written) only that user's bucket directory is
    read (partition pruning); without it the userId filter is pushed to the
    Parquet scan."""
    stored = io.read_parquet(spark, path)
    cond = F.col("userId") == int(user_id)
    if buckets:
        cond = (F.col("user_bucket") == int(user_id) % int(buckets)) & cond  # % is non-negative like pmod
    stored = stored.filter(cond)
    if "user_bucket" in stored.columns:  # bucketed layout read without its bucket count: no pruning
        stored = stored.drop("user_bucket")
    return stored.orderBy(F.desc("score"), "movieId")


def main(argv: list[str] | None = None) -> None:
    """Batch entry point: ``python -m reelspark.plans.training`` or
    ``spark-submit reelspark/plans/training.py`` with CSV or Parquet inputs."""
    import argparse
    import json

    p = argparse.ArgumentParser(description="Prepare ratings, train ALS, write model and top-N recommendations.")
    p.add_argument("--ratings", required=True, help="ratings CSV (header) or Parquet path")
    p.add_argument("--movies", required=True, help="movies CSV (header) or Parquet path")
    p.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    p.add_argument("--format", choices=("csv", "parquet"), default="csv")
    p.add_argument("--top-n", type=int, default=20)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--min-user-ratings", type=int, default=20)
    p.add_argument("--min-movie-ratings", type=int, default=20)
    p.add_argument("--max-iter", type=int, default=10)
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName("reelspark-training").getOrCreate()
    if a.format == "csv":
        ratings, movies = io.read_ratings_csv(spark, a.ratings), io.read_movies_csv(spark, a.movies)
    else:
        ratings, movies = io.read_parquet(spark, a.ratings), io.read_parquet(spark, a.movies)
    res = run_training(spark, ratings, movies, a.out, top_n=a.top_n, seed=a.seed,
                       min_user_ratings=a.min_user_ratings, min_movie_ratings=a.min_movie_ratings,
                       max_iter=a.max_iter)
    m = res.metrics.first()
    print(json.dumps({"rmse": m.rmse, "mae": m.mae, "n_test": m.n, "out": a.out}))


if __name__ == "__main__":
    main()
