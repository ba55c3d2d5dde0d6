"""Jaccard join, collocations and lexical search against plain versions of what they return."""

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import collocations, jaccard_join, lexical_search
from reelspark.llm.common import bitmap, has_bits

from .helpers import awkward, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_components(rows, percent):
    sets = [plain_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((str(rows[i][0]), len(s), least.get(find(i))) for i, s in enumerate(sets)), key=str)


def joined(docs, percent):
    return sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(docs, percent).collect()), key=str)


def near_rows():
    """Families without a base, a chain, a passage that unlike texts share, and the awkward rows."""
    rng, rows = random.Random(5), awkward()
    for family in range(6):
        base = prose(300 + family, 140).split()
        for i in range(14):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"Edit{rng.randrange(40)}"
            rows.append((1000 + family * 50 + i, " ".join(w), "en", "f", 0))
    words = prose(900, 220).split()
    rows += [(2000 + i, " ".join(words[i * 3 : i * 3 + 150]), "en", "f", 0) for i in range(10)]
    passage = prose(901, 60)
    rows += [(3000 + i, passage + " " + prose(910 + i, 20 + 3 * i), "en", "f", 0) for i in range(25)]
    rows += [(3100 + i, "same few words", "en", "f", 0) for i in range(5)]
    return rows


@pytest.mark.parametrize("percent", [90, 50])
def test_components_match_all_pairs(spark, percent):
    rows = near_rows()
    assert joined(documents(spark, rows, extra=True), percent) == plain_components(rows, percent)


def test_crowded_regions_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "HOT", (2, 3, 4, 5))
    rows = near_rows()
    assert joined(documents(spark, rows), 80) == plain_components(rows, 80)


def test_pairs_checked_follow_the_members_of_a_group(spark, monkeypatch):
    """A long chain of texts, each linked with seven on either side: few of the links are looked at."""
    checked, plain = [], jaccard_join.measured
    monkeypatch.setattr(jaccard_join, "measured", lambda pairs, *rest: (checked.append(pairs.count()), plain(pairs, *rest))[1])
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[i : i + 150]), "en", "f", 0) for i in range(110)]
    assert joined(documents(spark, rows), 90) == plain_components(rows, 90)
    assert sum(checked[1:]) <= 3 * len(rows)


def test_parities_of_long_sets_stay_sharp_beside_a_short_one():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:2600], rng.integers(0, 2**63, 400).astype(np.uint64)])) for _ in range(4)] + [base[:15]]
    ids = np.arange(10, dtype=np.uint64).reshape(5, 2)
    ours = (np.array([i.tobytes() for i in ids], object), np.ones(5, bool), ids, [jaccard_join.parities(s) for s in sets], np.array([len(s) for s in sets], float), *[np.full(5, np.nan)] * 4)
    assert len(jaccard_join._possible(ours, ours, 90)[0]) == 0
    assert len(jaccard_join._possible(ours, ours, 60)[0]) == 12


def test_join_of_empty_tables_and_of_wordless_texts(spark):
    assert jaccard_join.linked_documents(documents(spark).limit(0)).count() == 0
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n", "en", "a", 0), (None, "", "en", "a", 0)]
    assert joined(documents(spark, rows), 90) == [("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("None", 0, None)]


def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    raw = ("  " + prose(1, 500) + "  ünï x").encode()
    whole, place = jaccard_join.word_hashes(raw)
    assert len(whole) == len(raw.split()) and [raw[p : p + 3] for p in place[:5]] == [w[:3] for w in raw.split()[:5]]
    monkeypatch.setattr(jaccard_join, "PIECE", 7)
    assert (jaccard_join.word_hashes(raw)[0] == whole).all()
    assert len(set(whole.tolist())) == len(set(raw.split()))


def plain_phrases(rows, top, least, longest, percent=100):
    out = []
    for lang in {("und" if x is None else x) for x, _ in rows}:
        n, seen = 0, Counter()
        for x, t in rows:
            if (x or "und") != lang:
                continue
            for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
                w = re.findall("[^\x20\x09]+", piece)
                n += len(w)
                seen.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        chosen = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in chosen.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * seen[p[i : i + m]]}
        scored = []
        for p, a in chosen.items():
            if p not in gone:
                s, k = min((1000 * a * n // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y, n) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def phrase_rows():
    rng, rows = random.Random(2), [(x[2], x[1]) for x in awkward()]
    common = [f"w{i}" for i in range(30)]
    for i in range(260):
        w = [rng.choice(common) for _ in range(25)]
        for name in ("new york city hall", "Alpha beta", "one two three four five six"):
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = name.split()
        text = " ".join(w) + (". " if i % 3 else "\t") + " ".join(rng.choice(common) for _ in range(9)) + ",ÉTÉ  x\n"
        rows.append((("en", "de", None)[i % 3], text))
    return rows


@pytest.mark.parametrize("kw", [{"top": 5}, {"top": 40, "longest": 3}, {"top": 10_000}, {"top": 12, "contained": 60}])
def test_phrases_match_plain_counting(spark, kw):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").select("*", F.lit("x").alias("phrase"), F.lit("y").alias("n"))
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=12, first_words=1, **kw).collect())
    assert got and got == plain_phrases(rows, kw["top"], 12, kw.get("longest", 5), kw.get("contained", 100))


def test_phrases_of_empty_and_rare_tables(spark):
    assert collocations.collocations(documents(spark).limit(0)).count() == 0
    assert collocations.collocations(documents(spark, [(1, "a b a b", "en", "s", 0), (2, None, None, "s", 0)])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 10**11 + 7, 10**13 + 9, 10**12 + 1, 10**11 + 7
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(collocations.score(*map(F.col, "anlr"))).first()[0] == 1000 * a * n // (l * r)


def test_packed_rows_are_told_apart_when_they_pass_64_bits():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    small, big = collocations._distinct(columns, [4] * 3), collocations._distinct(columns, [1 << 30] * 3)
    assert all((x == y).all() for x, y in zip([*small[0], small[1]], [*big[0], big[1]], strict=True))


def test_bitmap_holds_what_was_put_in(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    bits = bitmap(df, F.col("h"), 16)
    h = np.array([r.h for r in df.collect()], np.int64).view(np.uint64)
    assert has_bits(bits, h, 16).all() and np.unpackbits(bits).sum() == len(set((h >> np.uint64(48)).tolist()))
    assert not bitmap(df.limit(0), F.col("h"), 10).any()


def plain_search(docs, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    known = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t in docs]
    known = [(d, c) for d, c in known if c]
    n_docs, n_terms = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        rows = []
        for d, c in known:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def search_rows():
    docs = [(x[0], x[1]) for x in awkward()] + [(500 + i, prose(40 + i, 30 + i, 60)) for i in range(60)]
    items = [(i, prose(70 + i // 2, 8, 60) + (" extra word" if i % 2 else "")) for i in range(20)]
    items += [(3, "ünï ça 123"), (None, "base TEXT id"), (99, None), (98, "..."), (97, "日本語テスト one-two"), (96, prose(0, 120))]
    return docs, items


@pytest.mark.parametrize(("k", "wave", "cells", "tasks"), [(50, 1 << 18, 4 << 20, 8192), (3, 25, 500, 5)])
def test_search_matches_plain_scoring(spark, monkeypatch, k, wave, cells, tasks):
    monkeypatch.setattr(lexical_search, "TASK_DOCS", tasks)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rows, asked = search_rows()
    docs = documents(spark, [(d, t, "en", "s", 0) for d, t in rows], extra=True)
    items = spark.createDataFrame(asked, "item_id long, text string").select("*", F.lit("x").alias("terms"), F.lit("y").alias("wave"))
    got = sorted((tuple(r) for r in lexical_search.search(docs, items, k, wave).collect()), key=str)
    assert got == plain_search(rows, asked, k)


def test_shared_sets_are_added_up_once(spark):
    rng = random.Random(1)
    stems = [[f"s{j}_{i}".encode() for i in range(6)] for j in range(4)]
    items = [sorted({t for stem in rng.sample(stems, 2) for t in stem} | {f"own{i}".encode()}) for i in range(30)]
    graph = lexical_search.share(items)
    assert graph.nodes < len(graph.terms) + 30 + 12
    assert sum(len(children) for _, children, _ in graph.levels) < sum(map(len, items)) / 2
    number = {t: i for i, t in enumerate(graph.terms)}
    leaves = np.arange(len(number) * 5).reshape(len(number), 5) ** 2
    want = np.array([leaves[[number[t] for t in x]].sum(axis=0) for x in items])
    assert (pickle.loads(pickle.dumps(graph)).totals(leaves) == want).all()


def test_search_of_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.select("doc_id", F.lit("..").alias("text")), items).count() == 0


def test_coarser_parities_bound_from_below_in_a_quarter_of_the_bytes(spark):
    """What members bring to every region: fewer cells than the set's, never more that differ than shingles do."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 20, 300, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10 + 1).astype(np.uint64)])) for s in sets]
    cells = spark.createDataFrame([(bytes([i]), jaccard_join.parities(s)) for i, s in enumerate(sets)], "node binary, cells binary")
    few = {r.node[0]: bytes(r.cells) for r in jaccard_join.coarser(cells).collect()}
    for i, s in enumerate(sets):
        assert len(few[i]) == max(8, len(jaccard_join.parities(s)) // 4)
        for j, t in enumerate(sets):
            apart = []
            for x, y in ((few[i], few[j]), (jaccard_join.parities(s), jaccard_join.parities(t))):
                both = jaccard_join.folded([x, y], min(len(x), len(y)))
                apart.append(int(np.bitwise_count(both[0] ^ both[1]).sum()))
            assert apart[0] <= apart[1] <= len(np.setxor1d(s, t))


def test_parities_are_no_column_of_region_rows(spark):
    """A member names its nearest from one row of its own, which its parities join: region rows hold none."""
    cells = {b"a": (1 << 64) - 1, b"b": (1 << 64) - 2, b"c": 0, b"d": 7}
    told = spark.createDataFrame([(n, c.to_bytes(8, "little")) for n, c in cells.items()], "node binary, cells binary")
    rows = [(k, size, n, r, b"c" * 16, 30, None, None, None, None) for k, size in ((1, 3), (2, 4)) for n, r in ((b"a", b"a" * 16), (b"b", b"b" * 16), (b"c", b"c" * 16), (b"d", b"c" * 16))]
    members = spark.createDataFrame(rows, "key long, n long, node binary, root binary, main binary, size long, hub_least double, hub_most double, low_least double, low_most double")
    for turn in (0, 1):
        assert [(bytes(r.a), bytes(r.b)) for r in jaccard_join.near_pairs(members, told, 90, 256, turn).collect()] == [(b"b", b"a")]
    assert [(bytes(r.a), bytes(r.b), r.sizes) for r in jaccard_join.ring_pairs(members, told, 90, 256).collect()] == [(b"b", b"a", 60)]
