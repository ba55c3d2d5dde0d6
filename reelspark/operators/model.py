"""ALS training, prediction and error metrics (Spark ML)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import ensure_checkpoint_dir

#: User and item blocks: fixed, since ALS seeds its factors block by block and
#: the model would change with the cluster otherwise.
NUM_BLOCKS = 10


def make_als(
    rank: int = 10,
    max_iter: int = 10,
    reg_param: float = 0.1,
    nonnegative: bool = True,
    cold_start_strategy: str = "drop",
    implicit_prefs: bool = False,
    seed: int = 42,
    num_blocks: int = NUM_BLOCKS,
    checkpoint_interval: int = 2,
    user_col: str = "userId",
    item_col: str = "movieId",
    rating_col: str = "rating",
) -> ALS:
    """M1 estimator: explicit-feedback, non-negative ALS with the reference's
    hyper-parameters and an explicit seed, 10 x 10 blocks whatever the cluster.

    Iterations 0, 2, 4, ... are checkpointed: a lost executor replays two
    iterations at most."""
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg_param,
        userCol=user_col,
        itemCol=item_col,
        ratingCol=rating_col,
        coldStartStrategy=cold_start_strategy,
        nonnegative=nonnegative,
        implicitPrefs=implicit_prefs,
        seed=seed,
        checkpointInterval=checkpoint_interval,
    )
    return als.setNumUserBlocks(num_blocks).setNumItemBlocks(num_blocks)


def fit_als(train: DataFrame, als: ALS | None = None, **params) -> ALSModel:
    """M1: fit ALS on ``train``.

    The input is persisted (memory, spilling to disk) for the fit only, since
    ALS reads it once per side; the iteration lineage is cut in the
    checkpoint directory of the session.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    if als is None:
        als = make_als(**params)
    cached = train.select(als.getUserCol(), als.getItemCol(), als.getRatingCol()).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        return als.fit(cached)
    finally:
        cached.unpersist()


def predict(model: ALSModel, df: DataFrame) -> DataFrame:
    """M2/M3: add ``prediction``; with the "drop" cold-start strategy rows of
    unseen users or items are removed."""
    return model.transform(df)


def valid_predictions(predictions: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """M4: drop NaN and null predictions."""
    p = F.col(prediction_col)
    return predictions.filter(p.isNotNull() & ~F.isnan(p))


def error_metrics(
    predictions: DataFrame, label_col: str = "rating", prediction_col: str = "prediction"
) -> DataFrame:
    """M5/M6: RMSE and MAE (and the row count) in one aggregate job."""
    valid = valid_predictions(predictions, prediction_col)
    err = F.col(label_col).cast("double") - F.col(prediction_col).cast("double")
    return valid.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_predictor_metrics(labelled: DataFrame, key: str = "movieId", label: str = "split") -> DataFrame:
    """M5/M6 of predicting each test row by its key's mean train rating:
    (rmse, mae, n); keys without a train row predict nothing.

    One pass over ``labelled`` (rating and a train/test label).  Rows are first
    counted by (key, rating), which Spark combines map-side, so a hot key
    costs one row per distinct rating.
    """
    train, test = (F.count_if(F.col(label) == side) for side in ("train", "test"))
    counts = labelled.groupBy(key, F.col("rating").cast("double").alias("rating")).agg(train.alias("n_train"), test.alias("n_test"))
    means = counts.groupBy(key).agg(
        (F.sum(F.col("rating") * F.col("n_train")) / F.nullif(F.sum("n_train"), F.lit(0))).cast("float").cast("double").alias("mean"),
        F.collect_list(F.struct("rating", "n_test")).alias("rows"),  # one entry per distinct rating
    )
    rows = means.filter(F.col("mean").isNotNull()).select("mean", F.explode("rows").alias("r"))
    err, n = F.col("r.rating") - F.col("mean"), F.col("r.n_test")
    total = F.sum(n)
    return rows.agg(
        F.sqrt(F.sum(err * err * n) / F.nullif(total, F.lit(0))).alias("rmse"), (F.sum(F.abs(err) * n) / F.nullif(total, F.lit(0))).alias("mae"), F.coalesce(total, F.lit(0)).alias("n")
    )


def save_model(model: ALSModel, path: str) -> None:
    """Write the model, replacing an existing one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> ALSModel:
    """Read a saved model."""
    return ALSModel.load(path)
