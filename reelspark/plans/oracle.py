"""Equivalent SQL (DuckDB dialect) for the deterministic named queries.

Every statement starts from the same prelude of CTEs that derives the
fixture tables from the driver's views (part, orders, lineitem), mirroring
``reelspark.sources.fixtures`` and the preparation operators, and then
answers one query by brute force.  Model-based queries (ALS) have no SQL
form and are absent here.
"""

from __future__ import annotations

import re

from reelspark.functions.titles import WHITE_SPACE
from reelspark.plans import queries as Q
from reelspark.sources import fixtures as fx


def _lit(text: str) -> str:
    """A SQL string literal (single quotes doubled)."""
    return "'" + str(text).replace("'", "''") + "'"


_SEARCH = _lit(Q.SEARCH_QUERY)
_GENRE = _lit(Q.GENRE)
# search_titles returns nothing for an empty query; genre_count is 0 for the
# sentinel and the empty genre, which are never in the genre list
_SEARCH_PRED = f"contains(title, {_SEARCH})" if Q.SEARCH_QUERY else "false"
_GENRE_LISTED = "true" if Q.GENRE not in ("(no genres listed)", "") else "false"

_TRAIN_BOUND = int(round(Q.SPLIT_WEIGHTS[0] / sum(Q.SPLIT_WEIGHTS) * 2**32))
_SENT = "'(no genres listed)'"
_WS = _lit(WHITE_SPACE)


def _terms(key: str, steps: tuple[int, ...], mod: int) -> str:
    """The fixture's factors as a list: multiples of 1/8."""
    parts = [f"((({key} * {a}) % {mod} + {mod}) % {mod} - {mod // 2}) / 8.0" for a in steps]
    return "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in parts) + "]"

PRELUDE = f"""
WITH movies AS (
  SELECT CAST(p_partkey AS INTEGER) AS movieId,
    CASE p_partkey % 10
      WHEN 0 THEN p_name
      WHEN 1 THEN concat('(', CAST(p_size AS VARCHAR), ') ', p_name, ' (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')')
      WHEN 2 THEN concat(p_name, ' (a.k.a. ', p_brand, ') (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')')
      WHEN 3 THEN concat(p_name, ' (TV Series)')
      WHEN 4 THEN concat(p_name, ' and the ', p_name, ' of the ', p_type, ' ', p_name, ' (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')')
      ELSE concat(p_name, ' (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')') END AS title,
    CASE WHEN p_partkey % 17 = 0 THEN {_SENT}
      WHEN p_size % 3 = 0 THEN p_type
      WHEN p_size % 3 = 1 THEN concat(p_type, '|', p_brand)
      ELSE concat(p_brand, '|', p_type, '|', CASE WHEN p_partkey % 2 = 0 THEN 'Even' ELSE 'Odd' END) END AS genres
  FROM part
),
ratings AS (
  SELECT CAST(o_custkey AS INTEGER) AS userId, CAST(l_partkey AS INTEGER) AS movieId,
    CAST(ceil(min(l_quantity) / 5) / 2 AS FLOAT) AS rating,
    CAST(floor(epoch(min(o_orderdate))) AS BIGINT) AS "timestamp"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey
),
ratings_n AS (
  SELECT userId, movieId, CASE WHEN movieId % 50 = 0 THEN NULL ELSE rating END AS rating, "timestamp" FROM ratings
),
clean AS (
  SELECT userId, movieId, rating, "timestamp",
    strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime,
    CAST(year(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS year,
    CAST(month(make_timestamp("timestamp" * 1000000)) AS INTEGER) AS month,
    CAST(dayofweek(make_timestamp("timestamp" * 1000000)) + 1 AS INTEGER) AS dayofweek
  FROM ratings_n WHERE rating IS NOT NULL AND userId IS NOT NULL AND movieId IS NOT NULL
),
user_stats AS (
  SELECT userId, count(rating) AS num_ratings, avg(CAST(rating AS DOUBLE)) AS avg_rating FROM clean GROUP BY userId
),
movie_stats AS (
  SELECT movieId, count(rating) AS num_ratings, avg(CAST(rating AS DOUBLE)) AS avg_rating FROM clean GROUP BY movieId
),
dense AS (
  SELECT movieId, userId, rating, "timestamp", datetime, year, month, dayofweek FROM clean
  WHERE userId IN (SELECT userId FROM user_stats WHERE num_ratings >= 20)
    AND movieId IN (SELECT movieId FROM movie_stats WHERE num_ratings >= 20)
),
split AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', '{Q.SPLIT_SEED}', CAST(userId AS VARCHAR), CAST(movieId AS VARCHAR),
      CAST("timestamp" AS VARCHAR))), 1, 8) AS BIGINT) AS bucket
  FROM dense
),
train AS (SELECT * EXCLUDE (bucket) FROM split WHERE bucket < {_TRAIN_BOUND}),
test AS (SELECT * EXCLUDE (bucket) FROM split WHERE bucket >= {_TRAIN_BOUND}),
disp AS (
  SELECT movieId, title, genres, found, cand,
    CASE WHEN found THEN trim(split_part(title, '(', 1), {_WS}) ELSE coalesce(title, '') END AS dt
  FROM (
    SELECT movieId, title, genres,
      split_part(split_part(title, '(', -1), ')', 1) AS cand,
      coalesce(contains(title, '(') AND contains(title, ')')
        AND regexp_full_match(split_part(split_part(title, '(', -1), ')', 1), '[0-9]+'), false) AS found
    FROM movies)
),
display AS (
  SELECT movieId, title, genres,
    CASE WHEN found THEN cand ELSE 'N/A' END AS year,
    CASE WHEN ct = '' THEN 'Untitled Movie' ELSE ct END AS clean_title,
    concat('https://via.placeholder.com/300x450/',
      (['FF6B6B', '4ECDC4', '45B7D1', 'FFA07A', '98D8C8', 'F7DC6F', 'BB8FCE', '85C1E9'])[((movieId % 8) + 8) % 8 + 1],
      '/FFFFFF?text=', substr(replace(replace(replace(title, ' ', '+'), '(', ''), ')', ''), 1, 20)) AS placeholder
  FROM (SELECT *, CASE WHEN length(dt) > 40 THEN concat(substr(dt, 1, 37), '...') ELSE dt END AS ct FROM disp)
),
metadata AS (
  SELECT trim(split_part(m.title, '(', 1), {_WS}) AS query_title,
    r.result_rank,
    CAST(m.movieId AS BIGINT) * 10 + r.result_rank AS tmdb_id,
    concat('Overview of ', m.title) AS overview,
    concat(CAST(1950 + CAST(m.movieId AS BIGINT) % 70 AS VARCHAR), '-01-0', CAST(r.result_rank AS VARCHAR)) AS release_date,
    CAST(p.p_size % 10 + r.result_rank / 4 AS DOUBLE) AS vote_average,
    CAST(p.p_size * 7 + r.result_rank AS BIGINT) AS vote_count,
    CAST(p.p_retailprice / r.result_rank AS DOUBLE) AS popularity,
    CASE WHEN m.movieId % 4 = 0 THEN ''
      WHEN m.movieId % 4 = 1 THEN NULL
      ELSE concat('/', replace(p.p_brand, '#', ''), '_', CAST(m.movieId AS VARCHAR), '_', CAST(r.result_rank AS VARCHAR), '.jpg')
    END AS poster_path
  FROM movies m JOIN part p ON m.movieId = p.p_partkey
  JOIN (SELECT 1 AS result_rank UNION ALL SELECT 2) r ON true
  WHERE m.movieId % 3 <> 0
),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_title ORDER BY result_rank, tmdb_id) AS rn
    FROM metadata WHERE query_title IS NOT NULL) WHERE rn = 1
),
enriched AS (
  SELECT d.movieId, d.title, d.genres, d.year, d.clean_title,
    CASE WHEN b.poster_path IS NOT NULL AND b.poster_path <> '' THEN concat('https://image.tmdb.org/t/p/w500', b.poster_path)
         ELSE d.placeholder END AS poster_url,
    b.tmdb_id, b.overview, b.release_date, b.vote_average, b.vote_count, b.popularity
  FROM display d LEFT JOIN best b ON trim(split_part(d.title, '(', 1), {_WS}) = b.query_title
),
genre_vocab AS (
  SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM movies
),
listed AS (
  SELECT genre FROM genre_vocab WHERE genre <> {_SENT} AND genre <> ''
),
genre_stats AS (
  SELECT l.genre, CAST(count(*) AS BIGINT) AS num_movies
  FROM listed l JOIN movies m ON contains(m.genres, l.genre)
  GROUP BY l.genre
)
"""


def _sig(x: str, digits: int = 9) -> str:
    scale = f"pow(10.0, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} ELSE round({x} / {scale}, {digits - 1}) * {scale} END"


def _summary_row(c: str) -> str:
    x = f'CAST("{c}" AS DOUBLE)'
    return (
        f"SELECT '{c}' AS column_name, count(\"{c}\") AS n, avg({x}) AS mean, {_sig(f'stddev_samp({x})')} AS stddev, "
        f"min({x}) AS min_value, max({x}) AS max_value FROM ratings_n"
    )


def _genre_movies(pred: str, order: str) -> str:
    return f"SELECT movieId, title, genres FROM movies WHERE {pred} ORDER BY {order} LIMIT {Q.LIMIT}"


def _similar(pred: str, limit: int = Q.SIMILAR_LIMIT, target: int | None = None) -> str:
    where = f" AND movieId = {target}" if target is not None else ""
    return f"""
SELECT target_id, movieId, title, genres, CAST(similar_rank AS INTEGER) AS similar_rank FROM (
  SELECT c.*, row_number() OVER (PARTITION BY target_id ORDER BY movieId, title NULLS FIRST, genres NULLS FIRST) AS similar_rank
  FROM (
    SELECT t.target_id, m.movieId, m.title, m.genres
    FROM (SELECT movieId AS target_id,
            list_filter(string_split(genres, '|'), lambda g: g <> {_SENT})[1] AS fg
          FROM movies WHERE genres IS NOT NULL{where}) t
    JOIN movies m ON m.movieId <> t.target_id AND (t.fg IS NULL OR {pred})
  ) c
) WHERE similar_rank <= {limit}
"""


def _topn(key: str, other: str, where: str = "") -> str:
    """Every user with every item, ranked for each ``key``: score descending, smaller id first."""
    users = f"SELECT DISTINCT CAST(o_custkey AS INTEGER) AS userId, {_terms('o_custkey', fx.USER_FACTORS, fx.USER_MOD)} AS uf FROM orders WHERE o_custkey IS NOT NULL"
    items = f"SELECT DISTINCT CAST(p_partkey AS INTEGER) AS movieId, {_terms('p_partkey', fx.ITEM_FACTORS, fx.ITEM_MOD)} AS mf FROM part WHERE p_partkey IS NOT NULL"
    return (
        f"SELECT userId, movieId, score, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {other}) AS INTEGER) AS rank "
        f"FROM (SELECT userId, movieId, list_dot_product(uf, mf) AS score FROM ({users}) u JOIN ({items}) i ON true{where})"
    )


def _trigrams(title: str) -> str:
    """The distinct trigrams of a folded title, two blanks around it."""
    text = f"('  ' || translate({title}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '  ')"
    return f"list_distinct(list_transform(range(1, length({text}) - 1), lambda i: substr({text}, i, 3)))"


_BODIES: dict[str, str] = {
    "row_counts": "SELECT 'ratings' AS table_name, count(*) AS num_rows FROM ratings_n "
    "UNION ALL SELECT 'movies', count(*) FROM movies",
    "ratings_preview": 'SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, "timestamp" FROM ratings_n '
    f"ORDER BY userId NULLS FIRST, movieId NULLS FIRST LIMIT {Q.PREVIEW_N}",
    "movies_preview": f"SELECT movieId, title, genres FROM movies ORDER BY movieId NULLS FIRST LIMIT {Q.PREVIEW_N}",
    "rating_summary": " UNION ALL ".join(_summary_row(c) for c in ("userId", "movieId", "rating", "timestamp")),
    "missing_ratings": 'SELECT CAST(count_if(userId IS NULL) AS BIGINT) AS userId, CAST(count_if(movieId IS NULL) AS BIGINT) AS movieId, '
    'CAST(count_if(rating IS NULL OR isnan(rating)) AS BIGINT) AS rating, CAST(count_if("timestamp" IS NULL) AS BIGINT) AS "timestamp" FROM ratings_n',
    "missing_movies": "SELECT CAST(count_if(movieId IS NULL) AS BIGINT) AS movieId, CAST(count_if(title IS NULL) AS BIGINT) AS title, "
    "CAST(count_if(genres IS NULL) AS BIGINT) AS genres FROM movies",
    "rating_histogram": 'SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS "count" FROM ratings_n GROUP BY rating',
    "data_reduction": "SELECT o AS original_rows, f AS filtered_rows, "
    "CASE WHEN o = 0 THEN NULL ELSE CAST(o - f AS DOUBLE) / o * 100.0 END AS reduction_pct "
    "FROM (SELECT (SELECT count(*) FROM clean) AS o, (SELECT count(*) FROM dense) AS f)",
    "clean_ratings": 'SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, "timestamp" FROM ratings_n '
    "WHERE rating IS NOT NULL AND userId IS NOT NULL AND movieId IS NOT NULL",
    "time_features": 'SELECT userId, movieId, CAST(rating AS DOUBLE) AS rating, "timestamp", datetime, year, month, '
    "dayofweek FROM clean",
    "user_stats": "SELECT * FROM user_stats",
    "movie_stats": "SELECT * FROM movie_stats",
    "active_users": "SELECT userId FROM user_stats WHERE num_ratings >= 20",
    "popular_movies": "SELECT movieId FROM movie_stats WHERE num_ratings >= 20",
    "dense_ratings": 'SELECT movieId, userId, CAST(rating AS DOUBLE) AS rating, "timestamp", datetime, year, month, '
    "dayofweek FROM dense",
    "train_split": 'SELECT movieId, userId, CAST(rating AS DOUBLE) AS rating, "timestamp", datetime, year, month, '
    "dayofweek FROM train",
    "test_split": 'SELECT movieId, userId, CAST(rating AS DOUBLE) AS rating, "timestamp", datetime, year, month, '
    "dayofweek FROM test",
    "genre_lists": "SELECT movieId, array_to_string(string_split(genres, '|'), ',') AS genre_list, "
    "CAST(len(string_split(genres, '|')) AS INTEGER) AS num_genres FROM movies",
    "genre_text": "SELECT movieId, replace(genres, '|', ' ') AS genres_clean FROM movies",
    "distinct_genres": "SELECT genre FROM genre_vocab",
    "genres_sorted": "SELECT genre FROM listed ORDER BY genre NULLS FIRST",
    "genres_top12": f"SELECT genre FROM listed ORDER BY genre NULLS FIRST LIMIT {Q.TOP_GENRES}",
    "search_title": f"SELECT movieId, title, genres FROM movies WHERE {_SEARCH_PRED} "
    f"ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT}",
    "search_title_indexed": f"SELECT movieId, title, genres FROM movies WHERE {_SEARCH_PRED} "
    f"ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT}",
    "search_phrase_indexed": f"SELECT movieId, title, genres FROM movies WHERE contains(title, {_lit(Q.PHRASE)}) "
    f"ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT}",
    "search_title_count": f"SELECT *, count(*) OVER () AS \"count\" FROM (SELECT movieId, title, genres FROM movies "
    f"WHERE {_SEARCH_PRED} ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT})",
    "genre_movies_title": _genre_movies(f"contains(genres, {_GENRE})", "title NULLS FIRST, movieId NULLS FIRST, genres NULLS FIRST"),
    "genre_movies_year": _genre_movies(
        f"contains(genres, {_GENRE})",
        r"regexp_replace(title, '.*\((\d{4})\).*', '\1', 'g') DESC NULLS LAST, movieId NULLS FIRST, genres NULLS FIRST",
    ),
    "genre_movies_exact": _genre_movies(
        f"list_contains(string_split(genres, '|'), {_GENRE})", "title NULLS FIRST, movieId NULLS FIRST, genres NULLS FIRST"
    ),
    "genre_statistics": "SELECT genre, num_movies FROM genre_stats",
    "genre_statistics_exact": "SELECT genre, CAST(count(*) AS BIGINT) AS num_movies FROM ("
    "SELECT movieId, unnest(list_distinct(string_split(genres, '|'))) AS genre FROM movies) "
    f"WHERE genre <> {_SENT} AND genre <> '' GROUP BY genre",
    "genre_count": f"SELECT {_GENRE} AS genre, CAST(CASE WHEN {_GENRE_LISTED} AND EXISTS (SELECT 1 FROM movies WHERE "
    f"list_contains(string_split(genres, '|'), {_GENRE})) THEN (SELECT count(*) FROM movies WHERE "
    f"contains(genres, {_GENRE})) ELSE 0 END AS BIGINT) AS num_movies",
    "genre_share": "SELECT *, round_even(share_pct, 1) AS share_pct_shown FROM (SELECT genre, num_movies, "
    "num_movies / (SELECT max(num_movies) FROM genre_stats) * 100.0 AS share_pct FROM genre_stats)",
    "movie_by_id": f"SELECT movieId, title, genres FROM movies WHERE movieId = {Q.MOVIE_ID} "
    "ORDER BY title NULLS FIRST, genres NULLS FIRST LIMIT 1",
    "catalog_head": f"SELECT movieId, title, genres FROM movies ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT}",
    "similar_by_genre": _similar("contains(m.genres, t.fg)"),
    "similar_by_genre_exact": _similar("list_contains(string_split(m.genres, '|'), t.fg)"),
    "similar_one": _similar("contains(m.genres, t.fg)", Q.SIMILAR_LIMIT, Q.MOVIE_ID),
    "topn_users": "SELECT userId, rank, movieId, score AS predicted_rating FROM ("
    + _topn("userId", "movieId") + f") WHERE rank <= {Q.REC_N}",
    "topn_items": "SELECT movieId, rank, userId, score AS predicted_rating FROM ("
    + _topn("movieId", "userId") + f") WHERE rank <= {Q.REC_N}",
    "topn_subset": "SELECT r.userId, r.rank, r.movieId, m.title, m.genres, r.score AS predicted_rating FROM ("
    + _topn("userId", "movieId") + f") r JOIN movies m ON m.movieId = r.movieId WHERE rank <= {Q.REC_N} "
    f"AND ((userId % {Q.SUBSET_STEP}) + {Q.SUBSET_STEP}) % {Q.SUBSET_STEP} = 0",
    "csv_quarantine": "SELECT outcome, count(*) AS rows FROM (SELECT CASE WHEN movieId % 37 = 0 AND userId IS NOT NULL OR movieId % 41 = 1 THEN 'unparsable' "
    "WHEN movieId % 43 = 2 OR userId IS NULL THEN 'no userId' WHEN movieId IS NULL THEN 'no movieId' ELSE 'good' END AS outcome FROM ratings_n) GROUP BY outcome",
    "dense_user_ids": f"SELECT customer, CAST(dense_rank() OVER (ORDER BY customer) - 1 AS INTEGER) AS dense FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) * {Q.WIDE_ID} AS customer FROM orders WHERE o_custkey IS NOT NULL)",
    "user_stats_appended": "SELECT * FROM user_stats",
    "rating_histogram_appended": 'SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS "count" FROM clean GROUP BY rating',
    "users_turned_active": "SELECT userId, count(*) AS num_ratings FROM clean GROUP BY userId HAVING count(*) >= 20 "
    f"AND count_if(((movieId + userId) % {Q.BATCHES} + {Q.BATCHES}) % {Q.BATCHES} < {Q.BATCHES - 1}) < 20",
    "topn_pruned": "SELECT userId, rank, movieId, score AS predicted_rating FROM ("
    + _topn("userId", "movieId") + f") WHERE rank <= {Q.REC_N}",
    "topn_unseen": "SELECT userId, rank, movieId, score AS predicted_rating FROM ("
    + _topn("userId", "movieId", " WHERE (userId, movieId) NOT IN (SELECT (userId, movieId) FROM dense)") + f") WHERE rank <= {Q.REC_N}",
    "topn_batch": "SELECT r.userId, r.movieId, m.title, m.genres, r.score FROM ("
    + _topn("userId", "movieId") + f") r JOIN movies m ON m.movieId = r.movieId WHERE rank <= {Q.BATCH_N}",
    "display_titles": "SELECT movieId, year, clean_title, nullif(year, 'N/A') AS shown_year FROM display",
    "placeholder_poster": "SELECT movieId, placeholder AS poster_url FROM display",
    "genre_tags": "SELECT movieId, array_to_string(list_filter(string_split(genres, '|'), "
    f"lambda g: g <> {_SENT}), '|') AS genre_tags FROM movies",
    "lookup_key": f"SELECT movieId, trim(split_part(title, '(', 1), {_WS}) AS lookup_key FROM movies",
    "enriched_display": "SELECT * FROM enriched",
    "inexact_lookup": f"""
, wrong AS (
  SELECT movieId, CASE movieId % 4 WHEN 0 THEN substr(k, 1, 2) || substr(k, 4) WHEN 1 THEN k || 'es'
    WHEN 2 THEN 'The ' || k ELSE translate(k, 'ae', 'ea') END AS wrong_title
  FROM (SELECT movieId, trim(split_part(title, '(', 1), {_WS}) AS k FROM movies)
),
asked AS (SELECT DISTINCT wrong_title, {_trigrams('wrong_title')} AS qg FROM wrong WHERE wrong_title <> ''),
known AS (SELECT query_title, tmdb_id, {_trigrams('query_title')} AS tg FROM best WHERE query_title <> ''),
pairs AS (
  SELECT wrong_title, query_title, tmdb_id, shared, len(qg) + len(tg) - shared AS either
  FROM (SELECT *, len(list_intersect(qg, tg)) AS shared FROM asked JOIN known
        ON 100 * least(len(qg), len(tg)) >= {Q.LEAST_LIKE} * greatest(len(qg), len(tg)))
),
near AS (
  SELECT *, CAST(shared AS DOUBLE) / either AS score,
    row_number() OVER (PARTITION BY wrong_title ORDER BY CAST(shared AS DOUBLE) / either DESC, query_title) AS rank
  FROM pairs WHERE 100 * shared >= {Q.LEAST_LIKE} * either
)
SELECT w.movieId, w.wrong_title, n.query_title, n.score, n.tmdb_id
FROM wrong w LEFT JOIN (SELECT * FROM near WHERE rank = 1) n ON w.wrong_title = n.wrong_title
""",
    "movie_details": f"SELECT * FROM enriched WHERE movieId = {Q.MOVIE_ID} "
    "ORDER BY title NULLS FIRST, genres NULLS FIRST LIMIT 1",
    "search_display": f"SELECT * FROM enriched WHERE {_SEARCH_PRED} "
    f"ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.LIMIT}",
    "home_display": "SELECT * FROM enriched "
    f"ORDER BY movieId NULLS FIRST, title NULLS FIRST, genres NULLS FIRST LIMIT {Q.HOME_N}",
    "genre_page_year": f"SELECT * FROM enriched WHERE contains(genres, {_GENRE}) ORDER BY "
    r"regexp_replace(title, '.*\((\d{4})\).*', '\1', 'g') DESC NULLS LAST, movieId NULLS FIRST, genres NULLS FIRST "
    f"LIMIT {Q.LIMIT}",
    "similar_display": "SELECT s.target_id, e.*, s.similar_rank FROM ("
    + _similar("contains(m.genres, t.fg)", Q.DETAILS_SIMILAR, Q.MOVIE_ID)
    + ") s JOIN enriched e ON s.movieId = e.movieId",
    "recs_unnest_join": f"""
SELECT t.userId, t.movieId, m.title, m.genres, CAST(t.rating AS DOUBLE) AS predicted_rating,
  round(CAST(t.rating AS DOUBLE), 1) AS shown_rating
FROM (SELECT userId, movieId, rating, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) AS rn
      FROM dense) t
JOIN movies m ON t.movieId = m.movieId
WHERE t.rn <= {Q.FIXTURE_RECS}
""",
    "error_metrics": """
SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, count(*) AS n FROM (
  SELECT CAST(t.rating AS DOUBLE) - CAST(m.prediction AS DOUBLE) AS e
  FROM test t JOIN (SELECT movieId, CAST(avg(CAST(rating AS DOUBLE)) AS FLOAT) AS prediction FROM train GROUP BY movieId) m
    ON t.movieId = m.movieId
  WHERE m.prediction IS NOT NULL AND NOT isnan(m.prediction)
)
""",
}

def _nullsafe_concat(sql: str) -> str:
    """Rewrite ``concat(a, b, ...)`` as ``(a || b || ...)``: DuckDB's concat
    skips NULL arguments, Spark's (like ``||``) returns NULL."""
    out, i = [], 0
    pat = re.compile(r"\bconcat\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i : m.start()])
        j, depth, quoted, args, cur = m.end(), 1, False, [], []
        while depth:
            c = sql[j]
            if quoted:
                quoted = c != "'"
                cur.append(c)
            elif c == "'":
                quoted = True
                cur.append(c)
            elif c == "(":
                depth += 1
                cur.append(c)
            elif c == ")":
                depth -= 1
                if depth:
                    cur.append(c)
            elif c == "," and depth == 1:
                args.append("".join(cur))
                cur = []
            else:
                cur.append(c)
            j += 1
        args.append("".join(cur))
        out.append("(" + " || ".join(_nullsafe_concat(a.strip()) for a in args) + ")")
        i = j


ORACLE_SQL: dict[str, str] = {name: _nullsafe_concat(PRELUDE + body) for name, body in _BODIES.items()}
