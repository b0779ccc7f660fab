"""The purity gate's rounds, sketches against exact figures, audits of reads."""

import random
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from lacuna.operators import purity as P
from lacuna.operators import read_audit as RA
from lacuna.operators import sketches as S

LINEAGES = ("own", "b", "t")


def planted(rng, groups):
    """Cells of groups (size, place, scores by lineage)."""
    vectors, scores, cell = [], [], 0
    for n, place, means in groups:
        for _ in range(n):
            vectors.append((cell, [x + rng.gauss(0, 0.2) for x in place]))
            scores += [(cell, lineage, m + rng.gauss(0, 0.05)) for lineage, m in zip(LINEAGES, means, strict=True)]
            cell += 1
    return vectors, scores


GROUPS = [(40, (0, 0, 0), (1.0, 0.0, 0.1)), (40, (9, 0, 0), (0.9, 0.1, 0.0)), (40, (0, 9, 0), (0.8, 0.05, 0.05)), (30, (9, 9, 0), (0.2, 1.5, 0.0)), (30, (0, 0, 9), (0.1, 0.0, 0.9)), (30, (9, 0, 9), (-0.2, -0.1, -0.1))]


def by_corner(vectors):
    """A plain clustering, by rounded places."""
    return vectors.select(F.col("id").alias("cell"), F.array_join(F.transform("v", lambda x: F.round(x / 9).cast("int").cast("string")), ",").alias("cluster"))


def frames(spark, groups, seed=1):
    vectors, scores = planted(random.Random(seed), groups)
    return spark.createDataFrame(vectors, "id long, v array<double>"), spark.createDataFrame(scores, "cell long, lineage string, score double")


def test_planted_contaminants_go(spark):
    vectors, scores = frames(spark, GROUPS)
    cells, ledger = P.purify(vectors, scores, "own", by_corner)
    rows = [tuple(r) for r in ledger.orderBy("round").collect()]
    gone = {r.cell for r in cells.where("removed IS NOT NULL").collect()}
    assert gone == set(range(120, 180))  # both kinds, and not the cells of no lineage
    assert rows[-1][-1] and rows[-1][4] == 0 and not any(r[-1] for r in rows[:-1])
    assert rows[0][3] == 210 == sum(r[4] for r in rows) + rows[-1][3] == cells.count()
    for a, b in zip(rows, rows[1:], strict=False):
        assert b[3] == a[3] - a[4]


def test_rounds_end(spark):
    vectors, scores = frames(spark, GROUPS)
    cells, ledger = P.purify(vectors, scores, "own", by_corner, rounds=1)
    assert not ledger.first().settled and cells.count() == 210
    alone, book = P.purify(vectors.where("id < 40"), scores, "own", by_corner)
    assert [tuple(r)[1:] for r in book.collect()] == [(1, 0, 40, 0, True)] and alone.where("removed IS NULL").count() == 40
    empty = P.purify(vectors.limit(0), scores, "own", by_corner)
    assert empty[0].count() == 0 and empty[1].first().settled


def test_clusters_of_neighbours(spark):
    vectors, scores = frames(spark, [(14, *g[1:]) for g in GROUPS[:4]])
    cells, ledger = P.purify(vectors, scores, "own", lambda v: P.neighbour_clusters(v, 6), rounds=2)
    assert {r.cell for r in cells.where("removed IS NOT NULL").collect()} == set(range(42, 56))
    assert ledger.where("round = 2").first().settled


def test_closed_clusters_are_made_once(spark):
    vectors, scores = frames(spark, [(14, *g[1:]) for g in GROUPS] + [(9, (20, 20, 20), (0.3, 0.0, 0.4))])
    vectors = vectors.union(spark.createDataFrame([(900, None)], vectors.schema))
    made = []

    def counted(left):
        made.append(left)
        return P.chained_clusters(left)

    cells, ledger = P.purify(vectors, scores, "own", counted, closed=True)
    assert len(made) == 1 and ledger.count() > 1
    anew = P.purify(vectors, scores, "own", P.chained_clusters)
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, anew[1].collect()))
    assert {tuple(r) for r in cells.select("cell", "cluster", "removed").collect()} == {tuple(r) for r in anew[0].select("cell", "cluster", "removed").collect()}


def test_sketches_merge_within_bounds(spark):
    rng = random.Random(4)
    rows = [(k % 7, rng.choice("xy"), rng.randrange(4000), rng.gauss(0, 1)) for k in range(40_000)] + [(0, "x", None, None)]
    df = spark.createDataFrame(rows, "day int, kind string, user long, value double").repartition(13)
    daily = S.sketch(df, ["kind", "day"], "user", "value")
    once = {r.kind: r for r in S.read(S.sketch(df, ["kind"], "user", "value")).collect()}
    for r in S.read(S.merge(daily, ["kind"])).collect():
        users = {u for _, k, u, _ in rows if k == r.kind and u is not None}
        values = sorted(v for _, k, _, v in rows if k == r.kind and v is not None)
        assert r.rows == sum(k == r.kind for _, k, _, _ in rows)
        assert abs(r.about_distinct - len(users)) <= 0.05 * len(users)
        assert r.about_distinct == once[r.kind].about_distinct
        for q in (25, 50, 75):
            assert abs(sum(v <= r[f"q{q}"] for v in values) / len(values) - q / 100) < 0.03


def test_read_audits(spark):
    hits = [("s", 1, "a1", "one", "+", "anchor", 3), ("s", 1, "a1", "one", "+", "anchor", 9), ("s", 2, "a1", "one", "+", "anchor", 3), ("s", 2, "a2", "one", "+", "anchor", 5), ("s", 3, "f", "one", "-", "full", 0)]
    df = spark.createDataFrame(hits, "tag string, read long, probe string, target string, orientation string, kind string, offset int")
    assert {tuple(r) for r in RA.confident_reads(df, ["tag"], "read").collect()} == {("s", "one", "+", 1), ("s", "one", "-", 1)}
    assert {tuple(r) for r in RA.offset_summary(df, ["tag"]).collect()} == {("s", "a1", 3, 2, 3, 2 / 3), ("s", "a2", 1, 1, 5, 1.0), ("s", "f", 1, 1, 0, 1.0)}
    reads = spark.createDataFrame([("x", "ACGTT"), ("x", "ACCA"), ("x", "AGG"), ("x", None), ("x", "")], "lib string, seq string")
    got = {r.block: (round(r.entropy, 9), r.letters) for r in RA.block_entropy(reads, ["lib"], 2).collect()}

    def bits(letters):
        n = Counter(letters)
        return -sum(c / len(letters) * log2(c / len(letters)) for c in n.values())

    assert got == {0: (round((0 + bits("CCG")) / 2, 9), 6), 1: (round((bits("GCG") + bits("TA")) / 2, 9), 5), 2: (0.0, 1)}
    listed = spark.createDataFrame([("ACG",), ("TTT",)], "word string")
    assert tuple(RA.list_orientation(reads, listed, ["lib"], 3).first()) == ("x", 3, 1, 0, "forward")
    assert tuple(RA.usual_length(reads.where("seq <> ''"), ["lib"]).first()) == ("x", 5)


def test_tags_resolve_in_three_ranks(spark):
    from lacuna.operators.relational import resolve_tags

    names = spark.createDataFrame([("CD3_a",), ("CD3_b",), ("CD3",), ("CD34_x",), ("CD8A",), (None,), ("HLA_DR",)], "name string")
    wanted = spark.createDataFrame([("CD3",), ("CD34",), ("CD8",), ("HLA",), ("H",), ("none",), ("",), (None,), ("CD3",)], "tag string")
    got = {tuple(r) for r in resolve_tags(wanted, names).collect()}
    assert got == {("CD3", "CD3", "exact"), ("CD34", "CD34_x", "stem"), ("CD8", "CD8A", "prefix"), ("HLA", "HLA_DR", "stem"), ("H", "HLA_DR", "prefix"), ("none", None, "missing"), ("", None, "missing")}
