"""Quality rules, line dedup and mixing against SQL and brute force."""

from collections import Counter, defaultdict
from fractions import Fraction

from helpers import same_rows
from llm_helpers import make
from pyspark.sql import functions as F

from lacuna.llm import line_dedup, mixing, quality_rules
from lacuna.llm.quality_rules import ablation, ledger, mask_of



def brute_rules(text):
    words = (text or "").encode().split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark, corpus):
    odd = [(900, "a b c a b c a b c", "s"), (901, "é x ## <b>", "s"), (902, "x\ny\nx\n\n \n x", "s"), (903, "a b", "s"), (904, "a a a a", "s")]
    rows = corpus + odd
    got = {r.doc_id: tuple(r.ledger)[:6] for r in ledger(make(spark, rows)).collect()}
    for i, text, _ in rows:
        n, chars, symbols, lines, dup, rep = brute_rules(text)
        assert got[i] == (n, chars, symbols, lines, dup, rep), (i, text and text[:60])


def test_policies_and_ablation(spark, corpus):
    rows = ledger(make(spark, corpus))
    bits = [r.ledger.fail_bits for r in rows.collect()]
    for r in ablation(rows).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.failed, r.failed_alone, r.rows) == (sum(b & bit > 0 for b in bits), sum(b & mask_of("v1") == bit for b in bits), len(bits))
    kept = quality_rules.apply_policy(make(spark, corpus))
    assert kept.columns == make(spark, corpus).columns and kept.count() == sum(b & mask_of("v1") == 0 for b in bits)


def test_rules_edges(spark):
    assert ledger(make(spark, [])).count() == 0
    clash = make(spark, [(1, "x", "s")]).withColumn("ledger", F.lit(1)).withColumn("n_words", F.lit(2))
    assert quality_rules.apply_policy(clash, "base").columns == clash.columns


def test_queries_match_sql(spark, data, duck):
    same_rows(quality_rules.op7_quality_rules(spark, data), duck, quality_rules.OP7_SQL)
    same_rows(line_dedup.op3_line_dedup(spark, data), duck, line_dedup.OP3_SQL)
    same_rows(mixing.op1_mixing(spark, data), duck, mixing.OP1_SQL)


def brute_lines(rows, percent, least):
    pages, on = Counter(), Counter()
    for _, text, host in rows:
        pages[host or ""] += 1
        for x in {x for x in (text or "").split("\n") if x.strip()}:
            on[host or "", x] += 1
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None))
            continue
        gone = lambda x, h=host or "": on[h, x] >= least and 100 * on[h, x] > percent * pages[h]
        out.append((i, "\n".join(x for x in text.split("\n") if not (x.strip() and gone(x)))))
    return sorted(out, key=str)


def test_line_dedup(spark, corpus):
    rows = corpus + [(1000 + k, f"menu\n\nown {k}\nmenu" if k % 3 else "menu", "hot" if k % 2 else None) for k in range(30)]
    for percent, least in ((5, 5), (40, 2)):
        got = line_dedup.drop_lines(make(spark, rows), percent, least)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows, percent, least)
    assert line_dedup.drop_lines(make(spark, [])).count() == 0


def test_joined_path_equals_broadcast(spark, corpus, monkeypatch):
    rows = corpus + [(1000 + k, f"menu\nown {k}", "hot") for k in range(30)]
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    got = line_dedup.drop_lines(make(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows, 5, 2)


def test_mixing_lag(spark):
    sizes = {"a": 500, "b": 170, "c": 61, "d": 9}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, "t", s))
            k += 1
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}
    for block in (1, 4):
        got = mixing.mix(make(spark, rows), weights, block=block).select("doc_id", "mix.*").collect()
        assert sorted(r.position for r in got) == list(range(len(rows)))
        slots = {r.slot: r.source for r in got}
        assert len(slots) == len({(r.source, r.block) for r in got})
        for r in got:
            assert r.release <= r.slot < r.deadline
        total = sum(weights.values())
        full = min((n // block) / Fraction(int(weights[s]), int(total)) for s, n in sizes.items())
        done = Counter()
        for t in range(int(full)):
            done[slots[t]] += 1
            for s, w in weights.items():
                assert abs(done[s] - (t + 1) * Fraction(int(w), int(total))) < 1
        order = [r.doc_id for r in sorted(got, key=lambda r: r.position)]
        assert order == [r.doc_id for r in mixing.mixed_order(make(spark, rows), weights).collect()] or block != mixing.BLOCK


def test_mixing_edges(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    got = mixing.mix(make(spark, [(1, None, None), (1, None, None), (None, "x", ""), (2, "y", "z")])).select("doc_id", "mix.*").collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3] and {r.source for r in got} == {"", "z"}
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert len(by[""]) == 3


def test_clashing_columns(spark):
    odd = {"_host": 1, "_src": 2, "_hash": 3, "row": 4, "mix": 5, "_cut": 6, "bucket": 7, "a.b": 8}
    docs = make(spark, [(k, f"menu\nown {k}", "s") for k in range(12)]).withColumns({k: F.lit(v) for k, v in odd.items()})
    assert mixing.mixed_order(docs).columns == docs.columns
    placed = mixing.mix(docs)
    assert sorted(r.position for r in placed.select("mix.position").collect()) == list(range(12)) and placed.first()["a.b"] == 8
    cut = line_dedup.drop_lines(docs)
    assert cut.columns == [*docs.columns, "line_dedup"] and {r.text for r in cut.collect()} == {f"own {k}" for k in range(12)}
    assert quality_rules.apply_policy(docs.drop("a.b")).columns == docs.drop("a.b").columns
