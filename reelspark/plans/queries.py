"""Named queries over the driver's tables (``sf_dir``/<table>.parquet).

Each callable takes (spark, sf_dir) and returns a DataFrame.  Most only declare
a plan; the top-N ones count their factor tables to cut them into blocks, and the
model-based ones fit the model when they are built.  Inputs are the fixture tables of ``reelspark.sources.fixtures``,
derived from part/orders/lineitem by Spark, so every query's work grows
with the data.  ``reelspark.plans.oracle`` holds the equivalent SQL for the
deterministic ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.operators import catalog, dense_ids, display, inexact, model, prepare, profile, pruned, rating_state, recommend, title_index
from reelspark.operators.staging import staged
from reelspark.session import app_key, ensure_checkpoint_dir, sf_path
from reelspark.sources import fixtures as fx
from reelspark.sources import quarantine
from reelspark.sources.schemas import RATINGS_SCHEMA

# query parameters (shared with the oracle SQL)
SEARCH_QUERY = "red"
PHRASE = " (a.k.a. Brand#1"
GENRE = "Brand#1"
MOVIE_ID = 42
LIMIT = 20
SIMILAR_LIMIT = 10
TOP_GENRES = 12
REC_N = 10
BATCH_N = 20
FIXTURE_RECS = 5
PREVIEW_N = 5
TIME_ZONE = "UTC"
HOME_N = 12
DETAILS_SIMILAR = 8
LEAST_LIKE = 60
USER_ID = 1
SUBSET_STEP = 10
BATCHES = 3
WIDE_ID = 3_000_000_019
SPLIT_SEED = 42
SPLIT_WEIGHTS = (0.8, 0.2)


def _movies(spark, sf):
    return fx.movies(spark, sf)


def _ratings_n(spark, sf):
    return fx.ratings_with_nulls(spark, sf)


def _clean(spark, sf):
    return prepare.add_time_features(prepare.drop_incomplete(_ratings_n(spark, sf)), time_zone=TIME_ZONE)


def _dense(spark, sf):
    return prepare.density_filter(_clean(spark, sf))


def _split(spark, sf):
    return prepare.hash_split(_dense(spark, sf), SPLIT_WEIGHTS, SPLIT_SEED)


def _dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# --- profiling ---------------------------------------------------------------


def q_row_counts(spark, sf):
    return profile.row_counts({"ratings": _ratings_n(spark, sf), "movies": _movies(spark, sf)})


def q_ratings_preview(spark, sf):
    return _dbl(profile.preview(_ratings_n(spark, sf), ["userId", "movieId"], PREVIEW_N), "rating")


def q_movies_preview(spark, sf):
    return profile.preview(_movies(spark, sf), ["movieId"], PREVIEW_N)


def round_significant(c, digits: int = 9):
    """Round to ``digits`` significant digits (engines differ in the last
    bits of a sample standard deviation)."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    return F.when(c.isNull() | (c == 0), c).otherwise(F.round(c / scale, digits - 1) * scale)


def q_rating_summary(spark, sf):
    s = profile.numeric_summary(_ratings_n(spark, sf))
    return s.withColumn("stddev", round_significant(F.col("stddev")))


def q_missing_ratings(spark, sf):
    return profile.missing_counts(_ratings_n(spark, sf))


def q_missing_movies(spark, sf):
    return profile.missing_counts(_movies(spark, sf), include_nan=False)


def q_rating_histogram(spark, sf):
    return _dbl(profile.rating_histogram(_ratings_n(spark, sf)), "rating")


def q_data_reduction(spark, sf):
    return profile.data_reduction(_clean(spark, sf))


# --- preparation -------------------------------------------------------------


def q_clean_ratings(spark, sf):
    return _dbl(prepare.drop_incomplete(_ratings_n(spark, sf)), "rating")


def q_time_features(spark, sf):
    return _dbl(_clean(spark, sf), "rating")


def q_user_stats(spark, sf):
    return prepare.user_stats(_clean(spark, sf))


def q_movie_stats(spark, sf):
    return prepare.movie_stats(_clean(spark, sf))


def q_active_users(spark, sf):
    return prepare.active_users(_clean(spark, sf))


def q_popular_movies(spark, sf):
    return prepare.popular_movies(_clean(spark, sf))


def q_dense_ratings(spark, sf):
    return _dbl(_dense(spark, sf), "rating")


def q_train_split(spark, sf):
    return _dbl(_split(spark, sf)[0], "rating")


def q_test_split(spark, sf):
    return _dbl(_split(spark, sf)[1], "rating")


# --- catalog -----------------------------------------------------------------


def q_genre_lists(spark, sf):
    m = catalog.with_genre_list(_movies(spark, sf))
    return m.select(
        "movieId", F.array_join("genre_list", ",").alias("genre_list"), F.size("genre_list").alias("num_genres")
    )


def q_genre_text(spark, sf):
    return catalog.with_genre_text(_movies(spark, sf)).select("movieId", "genres_clean")


def q_distinct_genres(spark, sf):
    return catalog.distinct_genres(_movies(spark, sf))


def q_genres_sorted(spark, sf):
    return catalog.genres_sorted(_movies(spark, sf))


def q_genres_top12(spark, sf):
    return catalog.top_genres(_movies(spark, sf), TOP_GENRES)


def q_search_title(spark, sf):
    return catalog.search_titles(_movies(spark, sf), SEARCH_QUERY, LIMIT)


def q_search_title_count(spark, sf):
    return catalog.with_result_count(catalog.search_titles(_movies(spark, sf), SEARCH_QUERY, LIMIT))


def _indexed_search(spark, sf, query: str):
    folder = f"{ensure_checkpoint_dir(spark)}/titles-{uuid.uuid4().hex}"
    title_index.build(_movies(spark, sf), folder)
    return title_index.search(spark, folder, query, LIMIT)


def q_search_title_indexed(spark, sf):
    """``search_title`` through the trigram index instead of a scan of all titles."""
    return _indexed_search(spark, sf, SEARCH_QUERY)


def q_search_phrase_indexed(spark, sf):
    """A longer string: several posting lists whose places must fit together."""
    return _indexed_search(spark, sf, PHRASE)


def q_genre_movies_title(spark, sf):
    return catalog.movies_by_genre(_movies(spark, sf), GENRE, LIMIT, "title")


def q_genre_movies_year(spark, sf):
    return catalog.movies_by_genre(_movies(spark, sf), GENRE, LIMIT, "year")


def q_genre_movies_exact(spark, sf):
    return catalog.movies_by_genre(_movies(spark, sf), GENRE, LIMIT, "title", match="exact")


def q_genre_statistics(spark, sf):
    return catalog.genre_statistics(_movies(spark, sf))


def q_genre_statistics_exact(spark, sf):
    return catalog.genre_statistics(_movies(spark, sf), match="exact")


def q_genre_count(spark, sf):
    return catalog.genre_count(_movies(spark, sf), GENRE)


def q_genre_share(spark, sf):
    return catalog.genre_share(catalog.genre_statistics(_movies(spark, sf)))


def q_movie_by_id(spark, sf):
    return catalog.movie_by_id(fx.movie(spark, sf, MOVIE_ID), MOVIE_ID)


def q_catalog_head(spark, sf):
    return catalog.catalog_head(_movies(spark, sf), LIMIT)


def q_similar_by_genre(spark, sf):
    m = _movies(spark, sf)
    return catalog.similar_by_genre(m, m.select("movieId"), SIMILAR_LIMIT)


def q_similar_by_genre_exact(spark, sf):
    m = _movies(spark, sf)
    return catalog.similar_by_genre(m, m.select("movieId"), SIMILAR_LIMIT, match="exact")


def q_similar_one(spark, sf):
    return catalog.similar_to(_movies(spark, sf), MOVIE_ID, SIMILAR_LIMIT)


# --- display / enrichment ----------------------------------------------------


def q_display_titles(spark, sf):
    d = display.with_shown_year(display.with_display_columns(_movies(spark, sf)))
    return d.select("movieId", "year", "clean_title", "shown_year")


def q_placeholder_poster(spark, sf):
    return display.with_display_columns(_movies(spark, sf)).select("movieId", "poster_url")


def q_genre_tags(spark, sf):
    return display.with_genre_tags(_movies(spark, sf)).select("movieId", "genre_tags")


def q_lookup_key(spark, sf):
    return display.with_lookup_key(_movies(spark, sf)).select("movieId", "lookup_key")


def q_enriched_display(spark, sf):
    return display.enrich(_movies(spark, sf), fx.metadata(spark, sf))


def q_inexact_lookup(spark, sf):
    """Every movie's lookup title misspelt, and the search result of the title most like it."""
    k, branch = F.col("lookup_key"), F.col("movieId") % 4
    wrong = (
        F.when(branch == 0, F.concat(F.substring(k, 1, 2), F.substring(k, 4, 1000000)))
        .when(branch == 1, F.concat(k, F.lit("es")))
        .when(branch == 2, F.concat(F.lit("The "), k))
        .otherwise(F.translate(k, "ae", "ea"))
    )
    m = display.with_lookup_key(_movies(spark, sf)).select("movieId", wrong.alias("wrong_title"))
    return inexact.with_closest_metadata(m, fx.metadata(spark, sf), "wrong_title", LEAST_LIKE)


# --- page-level compositions (each reference route's data, display-ready) ---


def q_movie_details(spark, sf):
    m = _movies(spark, sf)
    return display.enrich_page(catalog.movie_by_id(m, MOVIE_ID), fx.metadata(spark, sf))


def q_search_display(spark, sf):
    m = _movies(spark, sf)
    return display.enrich_page(catalog.search_titles(m, SEARCH_QUERY, LIMIT), fx.metadata(spark, sf))


def q_home_display(spark, sf):
    m = _movies(spark, sf)
    return display.enrich_page(catalog.catalog_head(m, HOME_N), fx.metadata(spark, sf))


def q_genre_page_year(spark, sf):
    m = _movies(spark, sf)
    return display.enrich_page(catalog.movies_by_genre(m, GENRE, LIMIT, "year"), fx.metadata(spark, sf))


def q_similar_display(spark, sf):
    return display.enrich_page(catalog.similar_to(_movies(spark, sf), MOVIE_ID, DETAILS_SIMILAR), fx.metadata(spark, sf))


# --- recommendations without a model (deterministic nested input) -----------


def fixture_recommendations(spark, sf) -> DataFrame:
    """Nested recommendations shaped like ALS output, from the dense ratings:
    each user's FIXTURE_RECS best-rated movies (ties by movieId)."""
    d = _dense(spark, sf)
    w = Window.partitionBy("userId").orderBy(F.desc("rating"), "movieId")
    top = d.select("userId", "movieId", "rating", F.row_number().over(w).alias("rn")).filter(
        F.col("rn") <= FIXTURE_RECS
    )
    # each group holds at most FIXTURE_RECS rows (rn filter above), so the
    # list is bounded whatever the user's number of ratings
    return top.groupBy("userId").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "movieId", "rating"))),
            lambda s: F.struct(s["movieId"].alias("movieId"), s["rating"].alias("rating")),
        ).alias("recommendations")
    )


def q_recs_unnest_join(spark, sf):
    flat = recommend.unnest(fixture_recommendations(spark, sf))
    out = recommend.attach_movies(flat, _movies(spark, sf))
    return display.with_shown_rating(_dbl(out, "predicted_rating"))


def q_error_metrics(spark, sf):
    labelled = prepare.label_split(_dense(spark, sf), SPLIT_WEIGHTS, SPLIT_SEED)
    m = model.mean_predictor_metrics(labelled)
    return m.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


# --- top-N over factors derived from the tables (exact) ------------------------


def q_topn_users(spark, sf):
    recs = recommend.top_n(fx.user_factors(spark, sf), fx.item_factors(spark, sf), REC_N)
    return _dbl(recommend.unnest(recs, rank="rank"), "predicted_rating")


def q_topn_items(spark, sf):
    recs = recommend.top_n(fx.item_factors(spark, sf), fx.user_factors(spark, sf), REC_N, "movieId", "userId")
    return _dbl(recommend.unnest(recs, key="movieId", item="userId", rank="rank"), "predicted_rating")


def q_topn_subset(spark, sf):
    users = fx.user_factors(spark, sf)
    some = users.filter(F.pmod("id", F.lit(SUBSET_STEP)) == 0)
    recs = recommend.top_n(some, fx.item_factors(spark, sf), REC_N)
    return _dbl(recommend.attach_movies(recommend.unnest(recs, rank="rank"), _movies(spark, sf)), "predicted_rating")


def q_topn_batch(spark, sf):
    recs = recommend.top_n(fx.user_factors(spark, sf), fx.item_factors(spark, sf), BATCH_N)
    return _dbl(recommend.batch_from(recs, _movies(spark, sf)), "score")


def q_topn_unseen(spark, sf):
    """The best movies that a user has not rated (among the dense ratings)."""
    recs = recommend.top_n(fx.user_factors(spark, sf), fx.item_factors(spark, sf), REC_N, seen=_dense(spark, sf).select("userId", "movieId"))
    return _dbl(recommend.unnest(recs, rank="rank"), "predicted_rating")


def q_topn_pruned(spark, sf):
    """The same as ``topn_users``, without scoring the buckets of movies that cannot matter."""
    recs, _ = pruned.pruned_top_n(fx.user_factors(spark, sf), fx.item_factors(spark, sf), REC_N)
    return _dbl(recommend.unnest(recs, rank="rank"), "predicted_rating")


# --- sources and upkeep ---------------------------------------------------------


def q_csv_quarantine(spark, sf):
    """The ratings as CSV files with bad fields planted, parsed once: rows by what became of them."""
    r, m = _ratings_n(spark, sf), F.col("movieId")
    user = F.when(m % 37 == 0, F.concat(F.lit("u"), F.col("userId"))).when(m % 43 == 2, F.lit(None)).otherwise(F.col("userId").cast("string"))
    rating = F.when(m % 41 == 1, F.lit("four")).otherwise(F.col("rating").cast("string"))
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    r.select(user.alias("userId"), m.cast("string").alias("movieId"), rating.alias("rating"), F.col("timestamp").cast("string").alias("timestamp")).write.option("header", True).csv(f"{folder}/in")
    parsed = quarantine.read_csv(spark, f"{folder}/in", RATINGS_SCHEMA, f"{folder}/out", required=("userId", "movieId"))
    good = parsed.good.agg(F.count("*").alias("rows")).select(F.lit("good").alias("outcome"), "rows").filter("rows > 0")
    return good.unionByName(parsed.reasons().select(F.col("reason").alias("outcome"), "rows"))


def q_dense_user_ids(spark, sf):
    """Customer numbers far beyond int as dense ids in their order."""
    ids = spark.read.parquet(sf_path(sf, "orders")).select((F.col("o_custkey").cast("bigint") * WIDE_ID).alias("customer"))
    return dense_ids.dense_ids(ids, "customer")


def _appended(spark, sf, key: str, batches):
    """The state after these batches of the cleaned ratings, appended one after the other."""
    folder, clean = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}", _clean(spark, sf)
    for b in batches:
        state = rating_state.append(clean.filter(F.pmod(F.col("movieId") + F.col("userId"), F.lit(BATCHES)) == b), key, folder)
    return state


def q_user_stats_appended(spark, sf):
    return rating_state.statistics(_appended(spark, sf, "userId", range(BATCHES)), "userId")


def q_rating_histogram_appended(spark, sf):
    return rating_state.histogram(_appended(spark, sf, "movieId", range(BATCHES)))


def q_users_turned_active(spark, sf):
    """Users who reach 20 ratings with the last batch."""
    before, last = _appended(spark, sf, "userId", range(BATCHES - 1)), _appended(spark, sf, "userId", range(BATCHES - 1, BATCHES))
    return rating_state.crossed(before, rating_state.merged(before, last)).withColumnRenamed("key", "userId")


# --- model-based (rows-only checks) -----------------------------------------

_MODELS: dict = {}
_PARTS: dict = {}


def _stored_split(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Train and test rows, prepared once per application and data folder and read back
    from one table: the fit and the predictions do not prepare the ratings again.
    The calendar features, which neither the filter nor the split reads, are added last."""
    key = (app_key(spark), sf)
    if key not in _PARTS:
        dense = prepare.density_filter(prepare.drop_incomplete(_ratings_n(spark, sf)))
        _PARTS[key] = staged(prepare.label_split(dense, SPLIT_WEIGHTS, SPLIT_SEED), "split", by="split")
    parts = [_PARTS[key].filter(F.col("split") == part).drop("split") for part in ("train", "test")]
    return [prepare.add_time_features(part, time_zone=TIME_ZONE) for part in parts]


def fitted_model(spark: SparkSession, sf: str, train: DataFrame | None = None):
    """Fit (once per application and data folder) the reference's ALS on
    the training split (``train``: its rows, where they are stored already)."""
    key = (app_key(spark), sf)
    if key not in _MODELS:
        _MODELS[key] = model.fit_als(_split(spark, sf)[0] if train is None else train)
    return _MODELS[key]


def q_als_predictions(spark, sf):
    train, test = _stored_split(spark, sf)
    p = model.predict(fitted_model(spark, sf, train), test)
    return _dbl(p, "rating", "prediction")


def q_als_metrics(spark, sf):
    train, test = _stored_split(spark, sf)
    return model.error_metrics(model.predict(fitted_model(spark, sf, train), test))


def q_recommend_all_users(spark, sf):
    return recommend.unnest(recommend.recommend_for_all_users(fitted_model(spark, sf), REC_N))


def q_recommend_all_items(spark, sf):
    return recommend.unnest(
        recommend.recommend_for_all_items(fitted_model(spark, sf), REC_N), key="movieId", item="userId"
    )


def q_recommend_user_subset(spark, sf):
    train, test = _stored_split(spark, sf)
    return recommend.user_recommendations(fitted_model(spark, sf, train), _movies(spark, sf), test, REC_N)


def q_recommend_one_user(spark, sf):
    return recommend.recommendations_for_user(fitted_model(spark, sf), _movies(spark, sf), USER_ID, REC_N)


def q_batch_recommendations(spark, sf):
    return recommend.batch_recommendations(fitted_model(spark, sf), _movies(spark, sf), BATCH_N)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "row_counts": q_row_counts,
    "ratings_preview": q_ratings_preview,
    "movies_preview": q_movies_preview,
    "rating_summary": q_rating_summary,
    "missing_ratings": q_missing_ratings,
    "missing_movies": q_missing_movies,
    "rating_histogram": q_rating_histogram,
    "data_reduction": q_data_reduction,
    "clean_ratings": q_clean_ratings,
    "time_features": q_time_features,
    "user_stats": q_user_stats,
    "movie_stats": q_movie_stats,
    "active_users": q_active_users,
    "popular_movies": q_popular_movies,
    "dense_ratings": q_dense_ratings,
    "train_split": q_train_split,
    "test_split": q_test_split,
    "genre_lists": q_genre_lists,
    "genre_text": q_genre_text,
    "distinct_genres": q_distinct_genres,
    "genres_sorted": q_genres_sorted,
    "genres_top12": q_genres_top12,
    "search_title": q_search_title,
    "search_title_count": q_search_title_count,
    "search_title_indexed": q_search_title_indexed,
    "search_phrase_indexed": q_search_phrase_indexed,
    "genre_movies_title": q_genre_movies_title,
    "genre_movies_year": q_genre_movies_year,
    "genre_movies_exact": q_genre_movies_exact,
    "genre_statistics": q_genre_statistics,
    "genre_statistics_exact": q_genre_statistics_exact,
    "genre_count": q_genre_count,
    "genre_share": q_genre_share,
    "movie_by_id": q_movie_by_id,
    "catalog_head": q_catalog_head,
    "similar_by_genre": q_similar_by_genre,
    "similar_by_genre_exact": q_similar_by_genre_exact,
    "similar_one": q_similar_one,
    "display_titles": q_display_titles,
    "placeholder_poster": q_placeholder_poster,
    "genre_tags": q_genre_tags,
    "lookup_key": q_lookup_key,
    "enriched_display": q_enriched_display,
    "inexact_lookup": q_inexact_lookup,
    "movie_details": q_movie_details,
    "search_display": q_search_display,
    "home_display": q_home_display,
    "genre_page_year": q_genre_page_year,
    "similar_display": q_similar_display,
    "recs_unnest_join": q_recs_unnest_join,
    "error_metrics": q_error_metrics,
    "topn_users": q_topn_users,
    "topn_items": q_topn_items,
    "topn_subset": q_topn_subset,
    "topn_batch": q_topn_batch,
    "topn_unseen": q_topn_unseen,
    "topn_pruned": q_topn_pruned,
    "csv_quarantine": q_csv_quarantine,
    "dense_user_ids": q_dense_user_ids,
    "user_stats_appended": q_user_stats_appended,
    "rating_histogram_appended": q_rating_histogram_appended,
    "users_turned_active": q_users_turned_active,
    "als_predictions": q_als_predictions,
    "als_metrics": q_als_metrics,
    "recommend_all_users": q_recommend_all_users,
    "recommend_all_items": q_recommend_all_items,
    "recommend_user_subset": q_recommend_user_subset,
    "recommend_one_user": q_recommend_one_user,
    "batch_recommendations": q_batch_recommendations,
}
