"""N-gram join, substring dedup and components against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import make, prose

from lacuna.llm import runtime
from lacuna.llm import ngram_join as ngram_module
from lacuna.llm import substring_dedup as substring_dedup_module
from lacuna.llm.components import connected_components
from lacuna.llm.ngram_join import keep_one, ngram_join
from lacuna.llm.substring_dedup import levels, repeated_levels, substring_dedup



def shingle_sets(rows, size):
    out = {}
    for i, text, _ in rows:
        words = (text or "").encode().lower().split()
        out[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    return out


def brute_components(sets, percent):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                moved = True
    return label


def test_ngram_join(spark, corpus):
    for size, percent in ((3, 90), (5, 80), (1, 50)):
        membership, _ = ngram_join(make(spark, corpus), size, percent)
        sets = shingle_sets(corpus, size)
        want = brute_components(sets, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in membership.collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(120):
        words = list(base)
        for j in range(k % 4):
            words[(k * 7 + j * 53) % 200] = f"e{k}.{j}"
        rows.append((k, " ".join(words), "s"))
    membership, links = ngram_join(make(spark, rows), 3, 90)
    want = brute_components(shingle_sets(rows, 3), 90)
    assert {r.doc_id: r.component_id for r in membership.collect()} == want
    assert links.count() < 120 * 119 / 4


def templates(n, words, vocabulary, changes, rng):
    """Texts that differ from one template in some words."""
    base, rows = [f"t{k}" for k in range(words)], []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(1, words - 1), changes):
            own[at] = f"v{rng.randrange(vocabulary)}" if vocabulary else f"u{k}.{at}"
        rows.append((k, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize(("words", "vocabulary", "changes"), [(25, 0, 1), (25, 40, 1), (150, 0, 6), (150, 30, 6), (150, 30, 2)])
def test_templates_make_few_candidates(spark, monkeypatch, words, vocabulary, changes):
    rng, made = random.Random(2), {}
    rows = templates(300, words, vocabulary, changes, rng)
    real = ngram_module.stash
    monkeypatch.setattr(ngram_module, "stash", lambda df, name: made.setdefault((name, len(made)), real(df, name)))
    membership, _ = ngram_join(make(spark, rows), 3, 90)
    want = brute_components(shingle_sets(rows, 3), 90)
    assert {r.doc_id: r.component_id for r in membership.collect()} == want
    named, some = (next(df for (k, _), df in made.items() if k == name) for name in ("named", "some"))
    if changes != 2:
        asks = named.where("long AND outside AND 100 * (n - pos) div 90 + (n - pos) - n >= n").count()
        assert asks == 0 and some.count() < 40 * len(rows)


def test_join_of_hot_ends_and_many_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_module, "HOT_PAIRS", 7)
    monkeypatch.setattr(ngram_module, "LONG", 3)
    rng = random.Random(5)
    rows = [(500 + k, t, s) for k, t, s in templates(60, 120, 20, 1, rng)] + [(900 + k, t, s) for k, t, s in templates(30, 60, 5, 3, rng)]
    rows += [(k, prose(rng, 30) + " " + prose(rng, k), "s") for k in range(40)]
    for size, percent in ((3, 90), (2, 60), (5, 80)):
        membership, _ = ngram_join(make(spark, rows), size, percent)
        assert {r.doc_id: r.component_id for r in membership.collect()} == brute_components(shingle_sets(rows, size), percent)


def test_overlap_by_blocks():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 80))).astype(np.uint64) for _ in range(2))
        common = len(np.intersect1d(a, b))
        for percent in (10, 50, 90):
            linked = 100 * common >= percent * (len(a) + len(b) - common)
            assert {ngram_module.overlap(a, b, percent, block) for block in (1, 7, 1024)} == {common if linked else None}


def test_join_edges(spark):
    empty = make(spark, [])
    assert ngram_join(empty)[0].count() == 0
    rows = make(spark, [(None, "a b c", "s"), (None, "a b c", "s"), (4, "a b c", None), (2, "A B C", "s"), (2, "A B C", "s")])
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join(rows)[0].collect()), key=str)
    assert got == sorted([(None, None), (None, None), (4, 2), (2, 2), (2, 2)], key=str)


def test_keep_one(spark, corpus):
    docs = make(spark, corpus)
    kept = keep_one(docs)
    want = brute_components(shingle_sets(corpus, 5), 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 100), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_substrings(rows, length):
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, corpus):
    for length in (50, 7, 2):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(make(spark, corpus), length).collect()}
        assert got == brute_substrings(corpus, length)


def test_substring_levels_and_hot_windows(spark, monkeypatch):
    assert [levels(n) for n in (50, 100, 7, 3, 2)] == [[13, 25, 50], [13, 25, 50, 100], [4, 7], [2, 3], [2]]
    rng = random.Random(8)
    hot, rare = prose(rng, 64), prose(rng, 55)
    texts = [f"{prose(rng, 9)} {hot} {prose(rng, 5)}" for _ in range(60)] + [f"{prose(rng, 20)} {rare}" for _ in range(2)]
    texts += [hot[: len(hot) // 2] + " " + prose(rng, 40), prose(rng, 300), " ".join(hot.split()[:30] + rare.split()[:30])] + ["x"] * 40
    rows = [(k if k % 9 else None, t, "s") for k, t in enumerate(texts)]
    named = [(k, t, s) for k, t, s in rows if k is not None]
    for keys in (1, 8, 4096):
        monkeypatch.setattr(runtime, "HOT_KEYS", keys)
        monkeypatch.setattr(substring_dedup_module, "BROADCAST_FIRSTS", 0)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(make(spark, rows)).collect() if r.doc_id is not None}
        assert got == brute_substrings(named, 50)


def test_spread_join(spark, monkeypatch):
    rows = [("a", k) for k in range(50)] + [("b", 1), ("c", 2), (None, 3)]
    frame = spark.createDataFrame(rows, "key string, v int")
    lookup = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B")], "key string, n long, name string")
    for keys in (1, 3, 4096):
        monkeypatch.setattr(runtime, "HOT_KEYS", keys)
        for few in (0, 10):
            got = {(r.v, r.name) for r in runtime.spread_join(frame, lookup, ["key"], "n", "left", few).collect()}
            assert got == {(v, {"a": "A", "b": "B"}.get(k)) for k, v in rows}
            assert runtime.spread_join(frame, lookup, ["key"], "n", few=few).count() == 51


def test_substring_edges(spark):
    assert substring_dedup(make(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (3, text + " tail", "s"), (9, None, "s")]
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(make(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 60), (5, 60), (None, 0), (3, 0), (9, 0)], key=str)


def test_levels_double(spark):
    shared = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "a b " + shared + " c", "s"), (2, shared + " d", "s"), (3, "x " + " ".join(f"w{k}" for k in range(6)), "s")]
    got = defaultdict(set)
    for r in repeated_levels(make(spark, rows), 5).collect():
        got[r.length].add((r.doc_id, r.start))
    assert set(got) == {5, 10, 20}
    assert got[20] == {(1, k + 2) for k in range(11)} | {(2, k) for k in range(11)}
    assert {(3, 1), (3, 2)} <= got[5] and not any(d == 3 for d, _ in got[10])
