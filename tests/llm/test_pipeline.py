"""The pipeline against its stages by brute force, and its row accounting."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from llm_helpers import make, prose
from pyspark.sql import functions as F
from test_duplicates import brute_components, shingle_sets
from test_rules_lines_mixing import brute_rules
from test_whole_mixing import edf

import corpus_pipeline as P
from lacuna.llm import packing
from lacuna.llm.runtime import stash


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stash(stage(spark, docs, data), name)
        assert docs.columns == columns
        assert docs.count() <= before if name in ("quality_rules", "near_duplicates") else docs.count() == before
        before = docs.count()
    packed = P.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    whole = P.run(spark, data)
    assert whole.columns == packed.columns
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(packed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def brute_pipeline(rows):
    """The documents left after the first four stages, in mixed order, in plain Python."""

    def fine(text):
        n, chars, symbols, lines, dup, rep = brute_rules(text)
        return n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and 2 * dup <= lines and 3 * n <= chars <= 10 * n

    rows = [r for r in rows if fine(r[1])]
    pages, on = Counter(r[2] or "" for r in rows), Counter()
    for _, text, host in rows:
        for line in {x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")}:
            on[host or "", line] += 1
    gone = {k for k, n in on.items() if n >= 2 and 100 * n > 5 * pages[k[0]]}
    rows = [(i, "\n".join(x for x in t.split("\n") if (h or "", x) not in gone), h) for i, t, h in rows]
    component = brute_components(shingle_sets([r for r in rows if r[0] is not None], 5), 80)
    rows = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    sources = {}
    for r in sorted(rows, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] if r[0] is not None else -1)):
        sources.setdefault(r[2] or "", []).append(r)
    names = sorted(sources)
    ns = [math.isqrt(len(sources[s])) for s in names]
    slots = {(k, j): t for t, k, j in edf(ns)}
    placed = []
    for k, s in enumerate(names):
        for rank, r in enumerate(sources[s]):
            block = rank // 8
            placed.append((block // ns[k] * sum(ns) + slots[k, block % ns[k]], rank, r))
    return [r for *_, r in sorted(placed, key=lambda x: x[:2])]


def test_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.randrange(55, 400)) + f"\n{prose(rng, 6)}", f"s{k % 3}" if k % 4 else "hot") for k in range(120)]
    rows = [(i, t + ("\nfooter of a site" if s == "s1" and i % 2 else ""), s) for i, t, s in rows]
    rows += [(200 + k, rows[7][1].replace(rows[7][1].split()[3 + k], "other"), "s0") for k in range(25)]
    rows += [(300 + k, rows[9][1], "s2") for k in range(9)] + [(5, rows[5][1], rows[5][2])] * 2
    rows += [(400, None, "s0"), (401, "", "s0"), (402, "few words", "s1"), (403, "# $ % " * 60, "s1"), (404, "same line here\n" * 40, "s1")]
    rows += [(None, prose(rng, 80), "s0"), (None, prose(rng, 90), None), (405, prose(rng, 70), None), (406, prose(rng, 20_000), "s2")]
    odd = {"_src": 1, "row": 2, "mix": 3, "_cut": 4, "ledger": 5, "place": 6, "class": 7, "id": 8, "line_dedup_": 9}
    make(spark, rows).withColumns({k: F.lit(v) for k, v in odd.items()}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    monkeypatch.setattr(P, "STAGES", [*P.STAGES[:-1], ("packing", lambda spark, docs, sf_dir: (kept.append(docs), P.packed(spark, docs, sf_dir))[1])])
    got = P.run(spark, str(tmp_path)).collect()
    mixed = [(r.doc_id, r.text) for r in kept[0].collect()]  # in file order
    want = brute_pipeline(rows)
    assert mixed == [(i, t) for i, t, _ in want]
    assert all(r.n_chars == len(r.text) for r in kept[0].collect()) and set(odd) <= set(kept[0].columns)

    ids = packing.WordTokenizer(packing.tokenizer_file()).encode([t for _, t, _ in want])
    lengths = Counter((i, len(x) // 4 + 1) for (i, _, _), x in zip(want, ids, strict=True))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == lengths
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        assert [a for a, _ in sorted(pieces)] == [sum(n for b, n in pieces if b < a) for a, _ in sorted(pieces)] and sum(n for _, n in pieces) <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    # Of the pieces of one length, those of documents that come first are dealt first.
    at, dealt = {i: k for k, (i, *_) in enumerate(want)}, defaultdict(list)
    for r in got:
        if lengths[r.doc_id, r.doc_tokens] == 1 and r.doc_id is not None:
            dealt[r.length].append((at[r.doc_id], r.start, r.sequence_id))
    assert all([s for *_, s in sorted(x)] == sorted(s for *_, s in x) for x in dealt.values())
