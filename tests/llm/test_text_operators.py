"""Language, near and suffix duplicates, quality and toxicity against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import components, language_id, near_dedup, quality_fm, suffix_dedup, toxicity
from reelspark.llm.common import held_out
from reelspark.llm.queries import QUERIES

from .helpers import CLASHING, awkward, documents, prose, repeated_bytes, shingle_counts, weighted_jaccard


# --- language -----------------------------------------------------------------


def test_filter_has_no_false_negatives_and_masks_name_all_languages():
    rng = np.random.default_rng(1)
    held = {lang: rng.integers(0, 1 << 60, 500).astype(np.uint64) for lang in ("de", "en", "fr")}
    shared = held["de"][:50]
    held["en"] = np.concatenate([held["en"], shared])
    f = language_id.build_filter(held)
    for k, lang in enumerate(f.languages):
        assert ((f.masks(held[lang]) >> np.uint64(k)) & np.uint64(1)).all()
    assert ((f.masks(shared) & np.uint64(0b11)) == 0b11).all()
    strange = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    for k in range(3):
        rate = ((f.masks(strange) >> np.uint64(k)) & np.uint64(1)).mean()
        assert abs(rate - f.false_positive[k]) < 0.01


def test_more_languages_than_a_word_has_bits(spark):
    names = [f"l{k:03}" for k in range(130)]
    rows = [(k, " ".join(chr(0x4E00 + 40 * k + j) * 3 for j in range(30)), lang) for k, lang in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = language_id.learn(docs)
    assert f.languages == names
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, f).collect()} == dict(enumerate(names))


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = prose(3, 300) + " Ünï 12"
    whole = np.concatenate(list(language_id.text_grams(text)))
    monkeypatch.setattr(language_id, "CHARS", 7)
    assert (np.concatenate(list(language_id.text_grams(text))) == whole).all()


def test_language_edge_rows(spark):
    docs = documents(spark, extra=True)
    f = language_id.learn(docs)
    got = language_id.identify(docs, f).collect()
    assert len(got) == docs.count()
    by_text = [(r.lang_pred, r.score) for r in got]
    assert all(0 <= s <= 1 and (lang == "und" or lang in f.languages) for lang, s in by_text)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {3, 4, 5, 14}
    empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), f).count() == 0


def test_language_held_out_accuracy(spark, smoke_dir):
    got = QUERIES["op1_language_id"](spark, smoke_dir.replace("sf0.001", "sf0.01"))
    docs = spark.read.parquet(smoke_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97


# --- near duplicates ------------------------------------------------------------


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.integers(0, 4, 300) * 0.75, rng.integers(0, 4, 300) * 0.75
    k = 2048
    a, b = (near_dedup.dart_minhash(ids[w > 0], w[w > 0], k) for w in (wa, wb))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)


@pytest.mark.parametrize("n", [1, 7, 20_000])
def test_signatures_fill_every_coordinate(n):
    ids = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = near_dedup.dart_minhash(ids, np.ones(n), 64)
    assert len(s) == 64 and (s == near_dedup.dart_minhash(ids, np.ones(n), 64)).all()


def _near_rows():
    rng = random.Random(4)
    rows = awkward()
    for family in range(6):
        words = prose(500 + family, 150).split()
        for i in range(12):
            w = list(words)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((1000 + family * 50 + i, " ".join(w), "en", "f", 0))
    # a chain: neighbours are near, the ends are not
    words = prose(900, 200).split()
    for i in range(8):
        rows.append((2000 + i, " ".join(words[i * 4 : i * 4 + 120]), "en", "f", 0))
    return rows


def test_near_classes_match_brute_force(spark):
    rows = _near_rows()
    docs = documents(spark, rows, extra=True)
    got = {}
    for r in near_dedup.near_classes(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    sets = [shingle_counts(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and weighted_jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    want = {}
    for i, (doc, *_) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        known = [m for m in mates if m is not None]
        want.setdefault(doc, set()).add((min(known) if sets[i] and known else doc, len(mates) if sets[i] else 1))
    assert got == want


def test_keep_one_keeps_one_of_each_class_and_the_columns(spark):
    rows = _near_rows()
    docs = documents(spark, rows, extra=True)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = near_dedup.near_classes(docs)
    with_words = classes.filter(F.col("node").isNotNull()).select("root").distinct().count()
    blank = classes.filter(F.col("node").isNull()).count()
    assert kept.count() == with_words + blank
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_keep_one_leaves_clashing_columns_alone(spark):
    names = ("_node", "_id", "_keep", "_rows", "_class", "node", "id", "keep", "rows", "class", "root", "class_id", "doc")
    docs = documents(spark).select("*", *[F.lit(f"x{c}").alias(c) for c in names])
    kept = near_dedup.keep_one(docs).collect()
    assert kept and all(r[c] == f"x{c}" for r in kept for c in names)
    plain = near_dedup.keep_one(documents(spark)).select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, ((r.doc_id, r.text) for r in plain)))


def test_keep_one_keeps_classes_that_share_a_class_id(spark):
    rows = _near_rows()
    alone = [prose(5000 + i, 60) for i in range(6)]
    rows += [(None, t, "en", "n", 0) for t in alone] + [(None, alone[0], "en", "n", 0)]  # classes without an id
    for i in range(6):  # a repeated id: an unlike text beside a family
        family = prose(5100 + i, 150)
        rows += [(4000 + i, prose(5200 + i, 80), "en", "u", 0), (4000 + i, family, "en", "u", 0), (4100 + i, family + " end", "en", "u", 0)]
    sets = [shingle_counts(t) for _, t, *_ in rows]
    classes: list[set] = []
    for i in range(len(rows)):
        if sets[i]:
            mates = [c for c in classes if any(weighted_jaccard(sets[i], sets[j]) >= 0.8 for j in c)]
            classes = [c for c in classes if c not in mates] + [{i}.union(*mates)]
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one(documents(spark, rows, extra=True)).collect()]
    for c in classes:
        low = min((rows[i][0] for i in c if rows[i][0] is not None), default=None)
        left = [k for k in kept if k[1] in {rows[i][1] for i in c}]
        assert len(left) == 1 and left[0] in {rows[i][:2] for i in c if rows[i][0] == low}
    assert len(kept) == len(classes) + sum(not s for s in sets)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 301: 300}


# --- repeated passages ------------------------------------------------------------


def _suffix_rows():
    rng = random.Random(8)
    rows = awkward(7)
    shared = [prose(700 + i, 45) for i in range(4)]
    for i in range(30):
        parts = [prose(800 + i, rng.randrange(0, 30)), rng.choice(shared), prose(850 + i, 10), rng.choice(shared) if i % 3 else ""]
        rows.append((3000 + i, " ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("length,anchor,long_anchor,group", [(200, 48, 160, 4000), (200, 32, 190, 1), (40, 12, 12, 3), (40, 8, 40, 9)])
def test_removal_matches_brute_force(spark, length, anchor, long_anchor, group):
    rows = _suffix_rows()
    docs = suffix_dedup.with_text_id(documents(spark, rows))
    found = suffix_dedup.repeated_starts(docs.select("doc", "tid", "text"), length, anchor, long_anchor, group_runs=group)
    got = {}
    for r in found.collect():
        got.setdefault((r.doc, r.tid), []).append({"a": r.a, "z": r.z})
    keys = [(r.doc, r.tid) for r in docs.select("doc", "tid", "text").collect()]
    order = [r.text for r in docs.select("text").collect()]
    for key, text, mask in zip(keys, order, repeated_bytes(order, length, False), strict=True):
        cover = [False] * len(mask)
        for a, z in suffix_dedup.removed_ranges(got.get(key), length):
            cover[a:z] = [True] * (z - a)
        assert cover == mask, (key, (text or "")[:50])


def test_digest_is_of_the_kept_bytes(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([prose(1, 80), prose(2, 20) + prose(1, 80), None, "", "é" * 150 + prose(5, 9), "é" * 150])]
    got = {r.doc_id: r for r in suffix_dedup.removal_digest(documents(spark, rows, extra=True)).collect()}
    masks = repeated_bytes([r[1] for r in rows], 200, False)
    for (i, text, *_), mask in zip(rows, masks, strict=True):
        raw = (text or "").encode()
        kept = bytes(b for b, gone in zip(raw, mask, strict=True) if not gone)
        runs = sum(m and not p for p, m in zip([False, *mask], mask))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), sum(mask), runs)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group", [4000, 1])
def test_keep_first_leaves_one_copy(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", group)
    passage = prose(77, 60)
    rows = [(i, f"{prose(60 + i, 25)} {passage} {prose(90 + i, 25)}", "en", "s", 9) for i in range(6)]
    docs = documents(spark, rows, extra=True)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 6
    texts = {r.doc_id: r.text for r in out.collect()}
    assert passage in texts[0] and not any(passage in texts[i] for i in range(1, 6))
    assert all(len(texts[i]) < len(rows[i][1]) - len(passage) + 60 for i in range(1, 6))
    assert texts[0] == rows[0][1]
    sizes = {r.doc_id: r.n_chars for r in out.collect()}
    assert all(sizes[i] == len(texts[i]) for i in range(1, 6)) and sizes[0] == 9
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [4000, 1])
def test_keep_first_spares_repeated_rows(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", group)
    passage = prose(177, 80)
    first, other = f"{prose(160, 25)} {passage} {prose(161, 25)}", f"{prose(162, 25)} {passage[:380]} {prose(163, 25)}"
    rows = [(0, first, "en", "s", 0), (0, first, "en", "s", 0), (1, other, "en", "s", 0), (1, other, "en", "s", 0)]
    out = sorted((r.doc_id, r.text) for r in suffix_dedup.without_repeats(documents(spark, rows)).collect())
    assert [t for i, t in out if i == 0] == [first, first]
    rest = [t for i, t in out if i == 1]
    cut = bytes(b for b, gone in zip(other.encode(), repeated_bytes([first, other], 200, True)[1], strict=True) if not gone)
    assert len(rest) == 2 and rest[0] == rest[1] == cut.decode() and passage[:380] not in rest[0]


def test_keep_first_matches_brute_force_and_stays_text(spark):
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(_suffix_rows())]  # ids in order of the rows
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    masks = repeated_bytes([r[1] for r in rows], 200, True)
    for (i, text, *_), mask in zip(rows, masks, strict=True):
        if not any(mask):
            assert out[i] == text
            continue
        raw = text.encode()
        cut = bytes(b for b, gone in zip(raw, mask, strict=True) if not gone).decode("utf-8", "ignore")
        if i in out:
            assert out[i].encode("utf-8").startswith(cut.encode()[:10]) and abs(len(out[i]) - len(cut)) <= 4
        else:
            assert not cut.strip()


def test_window_classes_are_those_of_the_strings():
    raw = np.frombuffer((prose(1, 50) + prose(1, 50) + "abab" * 90).encode(), np.uint8)
    for length in (5, 8, 33, 200):
        at = np.arange(len(raw) - length + 1)
        classes = suffix_dedup.window_classes(raw, at, length)
        strings = [raw[i : i + length].tobytes() for i in at]
        assert len(set(zip(classes.tolist(), strings))) == len(set(strings)) == len(set(classes.tolist()))


# --- quality ----------------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    ids, x = rng.choice(quality_fm.SIZE, 30, replace=False), rng.normal(size=30)
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(30) for j in range(i))
    assert np.isclose(m.raw(ids, x, np.array([0]))[0], 0.3 + m.w[ids] @ x + pairs)


def test_quality_learns_an_interaction_and_scores_every_row(spark):
    rows = awkward()
    docs = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(r[0], int(i % 2)) for i, r in enumerate(rows)] + [(None, 1), (5, None)], "doc_id long, label int")
    got = quality_fm.score(docs, quality_fm.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality_fm.score(docs, quality_fm.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    one = quality_fm.fit(docs, labels.withColumn("label", F.lit(1)))
    assert all(r.score > 0.99 for r in quality_fm.score(docs, one).collect())
    assert quality_fm.score(docs.limit(0), one).count() == 0


def test_quality_held_out(spark, smoke_dir):
    sf = smoke_dir.replace("sf0.001", "sf0.01")
    got = QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in got if a.quality for b in got if not b.quality]
    assert np.mean(pairs) > 0.9


# --- toxicity ------------------------------------------------------------------------


def test_rare_toxic_documents_are_learnt_beyond_the_sample(spark):
    """40 toxic documents of 20,000 and a sample of 2,000: a class-blind sample would hold four."""
    n = 20_000
    rows = [(i, prose(i, 30) + (" grolb snark" if i % 500 == 0 else "")) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 500 == 0)) for i in range(n)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, sample=2_000)
    assert chain.rates[0] == 1.0 and chain.rates[1] < 0.1
    told = {r.doc_id: r.p_toxic >= toxicity.THRESHOLD for r in toxicity.classify(docs, chain).collect()}
    assert sum(told[i] for i in range(0, n, 500)) >= 36
    assert sum(told[i] for i in range(n) if i % 500) < 0.01 * n


def test_sample_rates_keep_the_rarer_class_and_the_bound():
    assert toxicity.class_rates(10, 90, 1_000) == (1.0, 1.0)
    assert toxicity.class_rates(40, 19_960, 2_000) == (1.0, 1_960 / 19_960)
    assert toxicity.class_rates(9_000, 1_000, 2_000) == (1_000 / 9_000, 1.0)
    assert toxicity.class_rates(6_000, 6_000, 2_000) == (1_000 / 6_000, 1_000 / 6_000)
    assert toxicity.class_rates(0, 0, 10)[0] == 0.0


def test_probabilities_return_to_the_true_shares():
    """Odds learnt at rates (1, r) are r times too high."""
    w = [np.array([0.7, -1.0]), np.array([0.4, 0.3, -0.5]), np.array([1.2, 0.2, 0.1, 0.1])]
    at = (np.array([0]), np.array([1]), 2)
    raw = toxicity.Chain(np.array([5]), w).probabilities(*at)
    back = toxicity.Chain(np.array([5]), w, (1.0, 0.25)).probabilities(*at)
    odds = raw[:, -1] / (1 - raw[:, -1])
    assert np.allclose(back[:, -1], 0.25 * odds / (1 + 0.25 * odds))


def test_chain_finds_planted_words_and_spares_others(spark):
    bad = ["grumvex", "zorbit", "quaxling"]
    rows = []
    for i in range(400):
        text = prose(2000 + i, 60)
        if i % 5 == 0:
            text += f" {bad[i % 3]} {bad[(i + 1) % 3]}s"
        rows.append((i, text, "en", "s", 0))
    docs = documents(spark, rows + awkward(), extra=True)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.classify(docs.filter(F.col("source") == "s"), chain).collect()}
    held = [i for i in range(300, 400)]
    assert all(got[i].p_toxic >= toxicity.THRESHOLD for i in held if i % 5 == 0)
    assert all(got[i].p_toxic < toxicity.THRESHOLD for i in held if i % 5)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.filter(F.col("source") == "s").collect()} == {i for i in range(400) if i % 5}
    assert kept.filter((F.col("source") != "s") | F.col("source").isNull()).count() == len(awkward())


def test_without_labels_nothing_is_rejected(spark):
    docs = documents(spark)
    even = spark.createDataFrame([(100 + i, i % 2) for i in range(20)], "doc_id long, toxic int")  # no word tells them apart
    assert toxicity.keep_clean(docs, even).count() == docs.count()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, labels).count() == docs.count()
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_later_links_are_fitted_on_out_of_fold_probabilities(monkeypatch):
    """What later models get of a row never comes from a model that was fitted on it."""
    rng = np.random.default_rng(3)
    y = (rng.random(90) < 0.4).astype(float)
    found = [np.unique(np.append(rng.integers(0, 3000, 40), [3000] * int(t and i % 9 > 0)).astype(np.int64)) for i, t in enumerate(y)]  # one telling word
    folds = np.arange(90) % toxicity.FOLDS
    seen = []
    real = toxicity.fit_linear

    def watch(hits, rows, n, k, extra, target):
        seen.append((n, extra.shape[1], extra.copy()))
        return real(hits, rows, n, k, extra, target)

    monkeypatch.setattr(toxicity, "fit_linear", watch)
    chain = toxicity.fit_chain(found, y, folds)
    full = [s for s in seen if s[0] == 90]
    assert [s[1] for s in full] == [0, 1, 2] and len(chain.weights) == 3
    assert len(seen) == 3 * (1 + toxicity.FOLDS)
    # earlier probabilities differ from those of the final model on its own rows
    hits, rows = toxicity.positions(chain.terms, found)
    assert not np.allclose(full[1][2][:, 0], chain.probabilities(hits, rows, 90)[:, 0], atol=1e-12)


def test_held_out_rule(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h"))
    for r in df.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_clashing_names_cover_the_helpers():
    assert {"doc", "tid", "node"} <= set(CLASHING)
