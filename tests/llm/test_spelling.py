"""Spelling variants against a plain count and all pairs of equal or next lengths."""

import random
import zlib
from collections import Counter

from llm_helpers import make

from lacuna.llm import spelling

ALPHABET = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in [*(text or ""), "\n"]:
            if c in ALPHABET:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    n = plain_words(docs)
    deleted = {}
    for w in n:
        for k in range(len(w)):
            deleted.setdefault((len(w), k, w[:k] + w[k + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for ws in deleted.values():
        for w in ws:
            near[w].update(x for x in ws if x != w)
    for w in n:
        for k in range(len(w)):
            x = w[:k] + w[k + 1 :]
            if x in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}


def test_dense_neighbourhoods(spark):
    """Three letters only, so bigrams repeat within words and ties are everywhere."""
    rng = random.Random(8)
    made = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(900)]
    docs = [(k, " ".join(w for w in made for _ in range(rng.choice((0, 1, 1, 2, 5))))) for k in range(6)]
    want = plain(docs)
    assert max(v[3] for v in want.values()) > 8
    assert found(spark, docs) == want


def test_prefixes_meet_for_every_edit():
    rng = random.Random(4)
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 12)))
        k, c = rng.randrange(len(w)), rng.choice("abcd")
        near = {w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]} - {w}
        order = {a + b: rng.randrange(6) for a in "abcd" for b in "abcd"}
        order = {g: r for r, g in enumerate(sorted(order, key=lambda g: (order[g], g)))}
        for x in near:
            if len(x) < 5:
                continue
            assert one_edit(w, x)
            a, b = sorted((w, x), key=len)
            own, longer = spelling.keys_of(b, order)
            assert spelling.keys_of(a, order)[0] & (longer if len(b) > len(a) else own)


def test_edges(spark):
    long_run = "xy" * 1_000
    docs = [(1, None), (2, ""), (None, "Naïve naïve NAïVE naÏve"), (3, f"{long_run} {long_run} {long_run} {long_run}a"), (3, f"{long_run}a {long_run}a"), (3, f"{long_run}a"), (4, "chain " * 40 + "chains " * 12 + "chaims " * 5), (4, "chain " * 40)]
    want = plain(docs)
    got = found(spark, docs)
    assert got == want
    assert got["chaims"][1] == "chain"
    assert found(spark, []) == {}
    clash = spark.createDataFrame([(7, "alpha alpha alpha", 5, "w")], "doc_id long, text string, n long, word string")
    assert [(r.word, r.n) for r in spelling.variants(clash).collect()] == [("alpha", 3)]


def test_groups(spark):
    rows = [(k, t, "s") for k, t in enumerate(["colour " * 9, "color " * 4, "colours " * 3, "other " * 3])]
    out = {r.word: (r.root, r.group_words, r.group_n) for r in spelling.variant_groups(spelling.variants(make(spark, rows))).collect()}
    assert out == {"colour": ("colour", 3, 16), "color": ("colour", 3, 16), "colours": ("colour", 3, 16), "other": ("other", 1, 3)}


def test_query_on_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op13_spelling_variants(spark, data).collect()}
    assert got == plain(docs)
