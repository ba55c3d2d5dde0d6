"""Searches, URL rules, mixing, packing and the pipeline against plain versions."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import exact_topk, hilbert_ann, mixing, packing, url_rules
from reelspark.llm.queries import ORACLE_SQL, QUERIES
from reelspark.llm.vectors import best, usable

from .helpers import awkward, documents, prose

VECTORS = "vec_id long, embedding array<float>"


def _vectors(n=600, dim=16, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 40 + 0.1 * x
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    for i in range(40, 90):  # ties: the same vector many times
        rows[i] = (i, rows[40][1])
    nan, inf = float("nan"), float("inf")
    rows += [(5000, None), (5020, [nan] * dim), (5040, [inf] + [0.0] * (dim - 1)), (5050, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (5100, [0.0] * dim), (5200, [])]
    rows += [(50, rows[50][1])]  # a repeated row
    return rows


def _brute(rows, step, k, skip_zero, number):
    use = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (skip_zero and not any(v)):
            continue
        use.setdefault(i, np.array([number(x) for x in v]))
    out = {}
    for q in use:
        if q % step == 0:
            s = sorted(((-float(use[q] @ use[d]), d) for d in use if d != q))[:k]
            out[q] = s
    return out


# --- exact search -----------------------------------------------------------------


@pytest.mark.parametrize("clusters", [0, 12])
def test_exact_search_matches_brute_force(spark, clusters):
    rows = _vectors(clusters=clusters)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", block string, rank int")
    vectors = exact_topk.whole_numbers(usable(df, skip_zero=False))
    got = {}
    for r in exact_topk.top_products(vectors, F.col("vec_id") % 50 == 0, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = _brute(rows, 50, 5, False, lambda x: math.floor(256 * x))
    assert got == {q: [(i + 1, s, d) for i, (s, d) in enumerate(v)] for q, v in want.items()}


def test_bounds_leave_cells_out_and_none_too_many():
    rng = np.random.default_rng(2)
    pivots = rng.normal(size=(12, 8)) * 50
    of = rng.integers(0, 12, 2000)
    x = pivots[of] + rng.normal(size=(2000, 8))
    away = np.linalg.norm(x - pivots[of], axis=1)
    sums = {"n": np.bincount(of, minlength=12), "radius": np.array([away[of == c].max() for c in range(12)]), "norm": np.array([np.linalg.norm(x[of == c], axis=1).max() for c in range(12)])}
    needed = exact_topk.needed_cells(pivots, sums, sums, 5)
    assert needed.mean() < 0.7
    for i in range(0, 2000, 37):
        top = [j for j in np.argsort(-(x @ x[i])) if j != i][:5]
        assert needed[of[i]][of[top]].all()


def test_exact_search_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], VECTORS)
    got = exact_topk.top_products(exact_topk.whole_numbers(usable(df, False)), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 256 * 128 + 512 * 128), (1, 1, 0, 256 * 128 + 512 * 128)]
    assert exact_topk.top_products(usable(df.limit(0), False), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        exact_topk.top_products(usable(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], VECTORS), False), F.lit(True))


def test_best_orders_ties_by_id_whatever_the_place():
    rng = np.random.default_rng(0)
    q = rng.normal(size=(7, 33))
    d = np.repeat(rng.normal(size=(5, 33)), 30, axis=0)
    ids = rng.permutation(150)
    got = best(np.arange(1000, 1007), q, ids, d, 20)
    for i in range(7):
        mine = got["vec_id"][got["query_id"] == 1000 + i]
        want = sorted(range(150), key=lambda j: (-(q[i] * d[j]).sum(), ids[j]))[:20]
        assert list(mine) == [ids[j] for j in want]


# --- approximate search ---------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = hilbert_ann.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ranks_follow_the_keys(spark):
    keys = [(c, int(k), a, r) for c in range(3) for r, k in enumerate(np.random.default_rng(c).integers(0, 9, 50)) for a in ((False, True) if r % 7 == 0 else (False,))]
    got = {(r.curve, r.asks, r.row): r["rank"] for r in hilbert_ann.ranks(spark.createDataFrame(keys, "curve int, key long, asks boolean, row long"), 50).collect()}
    for c in range(3):
        data = sorted((k, r) for cc, k, a, r in keys if cc == c and not a)
        for place, (_, r) in enumerate(data):
            assert got[c, False, r] == place
        for cc, k, a, r in keys:
            if cc == c and a:  # a query stands behind the data of its key
                assert got[c, True, r] == sum(x[0] <= k for x in data)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 32)) * rng.uniform(0.5, 2, (5000, 1))  # norms differ: largest product is not nearest point
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    found = hilbert_ann.neighbours(usable(df, True), F.col("vec_id") % 20 == 0, block=256)
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r["rank"], r.score)
    x = np.array([r[1] for r in rows])
    hits = []
    for q in range(0, 5000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[:20]
        hits.append(len(set(top) & set(got[q])) / 20)
        order = sorted(got[q], key=lambda i: got[q][i][0])
        assert [got[q][i][0] for i in order] == list(range(1, 21))
        assert np.allclose([got[q][i][1] for i in order], s[order], rtol=1e-12) and q not in got[q]
    assert np.mean(hits) >= 0.9


def test_search_edge_rows(spark):
    rows = _vectors(200)
    got = {}
    for r in hilbert_ann.neighbours(usable(spark.createDataFrame(rows, VECTORS), True), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = _brute(rows, 20, 20, True, float)  # one block holds all: exact
    assert got == {q: [d for _, d in v] for q, v in want.items()}
    assert hilbert_ann.neighbours(usable(spark.createDataFrame([], VECTORS), True), F.lit(True)).count() == 0


# --- urls -------------------------------------------------------------------------------


def _plain_judgement(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    hits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(hits)[1:]) if hits else (host, path, None, None)


URLS = [
    "https://a.example.com/en/1", "http://www.example.com/en/2?x=1", "https://EXAMPLE.com/EN/1", "https://x.net/es/9#f", "https://net/fr/",
    "https://notnet/es/1", "https://x.org/es/5", None, "", "no scheme", "://", "ftp://u@h.com:80/p//q?a://b", "https://m.www.example.com/en/",
    "https://com/", "https://example.com", "https://example.com?en/", "https://x.net/en/1", "a\nb://x.com/\n?", "HTTPS://İ.com/é", "https://x.com/" + "p/" * 3000,
] + [f"https://h{i % 4}.example.{['com', 'net', 'org'][i % 3]}/{['en', 'es', 'fr'][i % 5 % 3]}/{i}" for i in range(200)]


def test_urls_follow_the_curated_rules_then_the_mined(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, tokens string, label string")
    got = {(r.page_id, r.host, r.path): r for r in url_rules.judge_urls(df).collect()}
    assert url_rules.judge_urls(df).count() == len(rows)
    for i, u in rows:
        host, path, rule, verdict = _plain_judgement(u)
        r = got[i, host, path]
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
        assert r.verdict in ("allow", "block")
        if verdict is None and r.mined_rule is None:
            assert r.verdict == "allow"


def test_mined_rules_match_plain_counting(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    tokens = {r.url: set(r.t) for r in df.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    labelled = [(sorted(tokens[u]), v) for u in URLS if (v := _plain_judgement(u)[3])]
    rules = url_rules.mine_rules(spark.createDataFrame(labelled, "tokens array<string>, label string"), 0.05, 0.9).collect()
    assert rules
    for r in rules:
        with_tokens = [v for t, v in labelled if set(r.tokens) <= set(t)]
        assert np.isclose(r.confidence, with_tokens.count(r.verdict) / len(with_tokens)) and r.confidence >= 0.9
        assert np.isclose(r.support, with_tokens.count(r.verdict) / len(labelled)) and r.support >= 0.05 and len(r.tokens) <= 3
    some = spark.createDataFrame([(u, sorted(t)) for u, t in tokens.items() if u is not None], "url string, tokens array<string>")
    frame = spark.createDataFrame(rules)
    decided = {r.url: r.mined for r in url_rules.match_rules(some, frame).collect()}
    for u, t in tokens.items():
        fits = [r for r in rules if set(r.tokens) <= t]
        if u is None or not fits:
            assert u not in decided
            continue
        top = max(fits, key=lambda r: (r.confidence, r.support, len(r.tokens), r.rule_id))
        assert decided[u].rule_id == top.rule_id and decided[u].verdict == top.verdict


def test_rules_of_long_urls_match_plain_counting(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        common = [f"common{j:02}" for j in range(14) if rng.random() < 0.95] if i % 3 else ["common00", "common01"]
        rare = [f"rare{j}" for j in range(8) if rng.random() < 0.25]
        block = ("rare0" in rare and "rare1" in rare) or "rare2" in rare
        rows.append((common + rare + [f"own{i}"], "block" if block ^ (rng.random() < 0.05) else "allow"))
    assert sum(len(t) > url_rules.MAX_BASKET + 1 for t, _ in rows) > 40
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.04, 0.9, 3).collect()
    words = sorted({x for t, _ in rows for x in t if not x.startswith("own")})
    sets = [(frozenset(t), label) for t, label in rows]
    want = {}
    for n in (1, 2, 3):
        for c in itertools.combinations(words, n):
            labels = [label for t, label in sets if t.issuperset(c)]
            for verdict in ("allow", "block"):
                k = labels.count(verdict)
                if k >= 0.04 * len(rows) and k >= 0.9 * len(labels):
                    want[c, verdict] = (k / len(labels), k / len(rows))
    kept = {
        (c, v): x
        for (c, v), x in want.items()
        if not any(want.get((s, v), (0,))[0] >= x[0] for n in range(1, len(c)) for s in itertools.combinations(c, n))
    }
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in rules}
    assert len(rules) == len(got) and got.keys() == kept.keys() and any("rare" in x for c, _ in got for x in c)
    assert all(np.allclose(got[k], kept[k], atol=1e-12) for k in got)


def test_urls_of_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([(1, "https://x.org/a"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge_urls(df).collect()} == {"allow"}
    assert url_rules.judge_urls(df.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def _plain_targets(sizes):
    """Capped shares by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, "d": 2000, None: 70}, {"z": 5}, {"a": 1, "b": 1, "c": 1000, "d": 0}])
def test_targets_match_repeated_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)


def test_mixture_meets_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = awkward() + [(9000 + i, prose(i, rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "q", None]), 0) for i in range(800)]
    docs = documents(spark, rows, extra=True)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mixture(docs.repartition(3)).collect()}
    taken, target, longest = {}, {}, {}
    for r in got:
        assert again[r.doc_id, r.source, r.size] == r.taken
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    want = _plain_targets({s: sum(r.size for r in got if r.source == s) for s in target})
    for s in target:
        assert np.isclose(target[s], want[s])
        # a repeated row is taken as often as its twin
        assert abs(taken[s] - target[s]) <= 2 * longest[s]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.doc_id, r.source, r.text] = times.get((r.doc_id, r.source, r.text), 0) + 1
    assert sum(times.values()) == sum(r.times for r in got)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, smoke_dir, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(smoke_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{smoke_dir}/{f}')")
    df = QUERIES[name](spark, smoke_dir)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


# --- packing -----------------------------------------------------------------------------------


def test_pieces_hold_every_id_once_and_fit(spark):
    rows = awkward()
    docs = documents(spark, rows, extra=True)
    got = packing.packed_documents(docs, per_group=9).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    tokenizer = packing.encoder(packing.vocabulary_path()).tokenizer
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(doc, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], key=key) == sorted(want, key=key)
    assert packing.packed_documents(docs.limit(0)).count() == 0


ODD = ["it's DON'T '\u2019s 12³ x\x00y\x1c\x85z", "a<|endoftext|>b <|startoftext|> <|", "İstanbul ΣΑΣ ﬁ é é", "日本語 🎉🎉 a\u200bb", "ſtraße ŉ ǅ ª²½ \xa0\xad", "'s'S'll 'LL", "\r\n\t", "a" * 5000]


@pytest.mark.parametrize("text", ODD)
def test_pieces_encode_like_whole_texts(text):
    e = packing.encoder(packing.vocabulary_path())
    assert e.encode(text) == e._whole(text)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    sequence, offset = packing.best_fit(lengths, 100)
    room = []
    for n, s, o in zip(lengths, sequence, offset, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[s] == min(fits) and o == 100 - room[s]
            room[s] -= n
        else:
            assert s == len(room) and o == 0
            room.append(100 - n)


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, smoke_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.count()
        now = stage(spark, now, smoke_dir).persist()
        if name != "packing":
            assert now.columns == docs.columns
        if name in ("toxicity", "near_dedup", "suffix_dedup"):
            assert now.count() <= before
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = now.groupBy(columns).count().collect()
    got = corpus_pipeline.run(spark, smoke_dir).groupBy(columns).count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_pipeline_of_awkward_rows(spark, tmp_dir):
    import corpus_pipeline

    documents(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() > 0
    empty = f"{tmp_dir}/empty"
    documents(spark).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_are_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and "pipeline" in __spark_entry__.queries()
