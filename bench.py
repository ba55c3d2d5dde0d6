"""Bench: time every named query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (all rows produced,
nothing sent to the driver).  The ALS fit is timed on its own before the
model-based queries.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from reelspark.plans import queries as Q
    from reelspark.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, driver_memory="16g")
    # Untimed warm-up: every query once on a smaller data set (sf0.01 when
    # present), so the timings below are steady-state (JIT-compiled) rather
    # than JVM start-up.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR") or next(
        (d for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.001") if os.path.isdir(d)), ""
    )
    warmed = os.path.isdir(warm_dir) and os.environ.get("BENCH_WARMUP", "1") != "0"
    if warmed:
        for name in only or list(Q.QUERIES):
            Q.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        Q._MODELS.clear()  # the timed run must fit its own model

    timings: dict[str, float] = {}
    names = only or list(Q.QUERIES)
    model_based = {"als_predictions", "als_metrics", "recommend_all_users", "recommend_all_items",
                   "recommend_user_subset", "recommend_one_user", "batch_recommendations"}
    for name in names:
        if name in model_based and "als_fit" not in timings:
            t0 = time.perf_counter()
            Q.fitted_model(spark, sf_dir)
            timings["als_fit"] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)

    # table: prepare (fixture + clean + density filter + split, persisted as
    # the reference caches train/test), ALS fit, predict + RMSE + MAE, batch
    # top-20 with movie info.
    from reelspark.operators import model as M
    from reelspark.operators import recommend
    from reelspark.plans.training import prepare_ratings
    from reelspark.operators.prepare import label_split
    from reelspark.sources import fixtures as fx
    from reelspark.sources.io import persist

    t0 = time.perf_counter()
    dense = persist(label_split(prepare_ratings(fx.ratings(spark, sf_dir)), (0.8, 0.2), 42))
    dense.count()
    train = dense.filter("split = 'train'").drop("split")
    test = dense.filter("split = 'test'").drop("split")
    timings["pipeline_prepare"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    fitted = M.fit_als(train)
    timings["pipeline_als_fit"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    M.error_metrics(M.predict(fitted, test)).collect()
    timings["pipeline_predict_rmse_mae"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    recommend.batch_recommendations(fitted, fx.movies(spark, sf_dir), 20).write.format("noop").mode(
        "overwrite").save()
    timings["pipeline_batch_top20"] = round(time.perf_counter() - t0, 3)
    dense.unpersist()

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "warmup": warm_dir if warmed else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
