"""Known answers on small frames, and the traps where engines differ."""

import math

import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators import audit as A
from lacuna.operators import graph as G
from lacuna.operators import intervals as I
from lacuna.operators import matrix as M
from lacuna.operators import molecules as MO
from lacuna.operators import relational as R
from lacuna.operators import stats as ST
from lacuna.operators import subtypes as SU
from lacuna.sources import sinks
from lacuna.sources import text_formats as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_revcomp(spark):
    assert one(spark, Q.revcomp(F.lit("AGCGTA")), Q.revcomp(F.lit("AACGTN"))) == ("TACGCT", "NACGTT")


def test_cigar(spark):
    c = F.lit("41S12M3D87M10S")
    got = one(spark, F.size(Q.cigar_ops(c)), Q.ref_length(c), Q.query_length(c), Q.clip_length(c, "lead"), Q.clip_length(c, "trail"), Q.matched_length(c), Q.max_insertion(c))
    assert got == (5, 102, 150, 41, 10, 99, 0)


def test_ref_to_query(spark):
    (blocks,) = one(spark, Q.cigar_blocks(F.lit(101), F.lit("5S10M")))
    assert [tuple(b) for b in blocks] == [(95, 0, 5, "p"), (100, 5, 10, "A")]
    (plain,) = one(spark, Q.cigar_blocks(F.lit(101), F.lit("5S10M"), project=False))
    assert [tuple(b) for b in plain] == [(100, 5, 10, "A")]


def test_aligned_bases_win_over_clips(spark):
    # A hard clip takes no bases; a trailing clip lies where the alignment ends.
    (w,) = one(spark, Q.extract_window(F.lit(3), F.lit("2H4M2D2M2S"), F.lit("ACGTACGT"), 1, 13))
    assert (w.window, w.provenance, w.n_aligned) == (".ACGT..ACGT.", ".AAAA..AApp.", 6)


def test_hypergeometric(spark):
    p, whole = one(spark, S.hypergeom_tail(F.lit(20), F.lit(1000), F.lit(50), F.lit(100)), S.hypergeom_tail(F.lit(0), F.lit(10), F.lit(3), F.lit(4)))
    assert p == pytest.approx(6.38e-09, rel=1e-2) and whole == pytest.approx(1)


def test_binomial(spark):
    tail, all_, none = one(spark, S.binom_tail(F.lit(8), F.lit(10), F.lit(0.5)), S.binom_tail(F.lit(0), F.lit(3), F.lit(0.1)), S.binom_tail(F.lit(4), F.lit(3), F.lit(0.1)))
    assert (tail, all_, none) == (pytest.approx(56 / 1024), 1.0, 0.0)


def test_lgamma(spark):
    for x in (1, 2, 3.5, 50, 2000):
        assert one(spark, S.lgamma(F.lit(float(x))))[0] == pytest.approx(math.lgamma(x), abs=1e-9)


def test_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    got = [r.padj for r in ST.bh_fdr(df, "p", ties=["k"]).orderBy("k").collect()]
    assert got[:3] == pytest.approx([0.03, 0.04, 0.04]) and got[3] is None


@pytest.mark.parametrize(("values", "flagged", "width"), [([1, 2, 3, 4, 100], [100], 1), ([5, 5, 5, 5, 9], [], 1.788854), ([7, 7, 7], [], 0)])
def test_mad(spark, values, flagged, width):
    out = ST.mad_outlier(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", 5).collect()
    assert sorted(r.x for r in out if r.outlier) == flagged
    assert out[0].width == pytest.approx(width, abs=1e-6)


def test_clr(spark):
    assert one(spark, S.clr(F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))))[0] == pytest.approx([-0.693147, 0, 0.693147], abs=1e-6)


def test_three_enrichments(spark):
    three, one_ = F.lit(3.0), F.lit(1.0)
    got = one(spark, S.log2_enrichment(three, F.lit(2.0)), S.log2_enrichment(one_, F.lit(2.0)), S.log2_share(F.lit(0.75), F.lit(0.5)), S.log2_share(F.lit(0.25), F.lit(0.5)), S.fold_capped(F.lit(0.75), F.lit(0.5)), S.fold_capped(F.lit(0.25), F.lit(0.5)), S.log2_share(F.lit(0.0), F.lit(0.5)))
    assert got[:6] == pytest.approx((0.415037, -0.584963, 0.584963, -1, 1.5, 0.5), abs=1e-6) and got[6] is None


def test_jaccard_and_components(spark):
    sets = spark.createDataFrame([("0", i) for i in (1, 2, 3)] + [("1", i) for i in (2, 3, 4)] + [("2", 9)], "s string, i int")
    assert [(r.a, r.b, r.jaccard) for r in G.set_overlaps(sets, "s", "i").collect()] == [("0", "1", 0.5)]
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a int, b int")
    assert {(r.node, r.component) for r in G.components(nodes, edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)}


def test_truncated_cores(spark):
    cores = spark.createDataFrame([(1, "ACCATT"), (1, "ACCATTTCT"), (1, "ACCATTTCTT"), (2, "ACCATT")], "g int, core string")
    got = {(r.g, r.core): r.canon for r in MO.collapse_truncated(cores, ["g"]).collect()}
    assert set(v for (g, _), v in got.items() if g == 1) == {"ACCATTTCTT"} and got[2, "ACCATT"] == "ACCATT"


def test_implicit_zeros(spark):
    coo = spark.createDataFrame([("a", "g", 4.0), ("b", "g", 2.0)], "cell string, gene string, value double")
    n = spark.createDataFrame([(4,)], "n int")
    r = M.gene_moments(coo, n).first()
    assert (r["mean"], r["var"]) == (1.5, pytest.approx((16 + 4 - 4 * 2.25) / 3))


def test_rank_sum_with_zeros(spark):
    rows = spark.createDataFrame([("g", 3.0, "a"), ("g", 1.0, "b")], "gene string, value double, grp string")
    r = ST.rank_sum(rows, ["gene"], "value", "grp", {"a": F.lit(3), "b": F.lit(2)}).first()
    # Values a: 3,0,0; b: 1,0.  Ranks of a: 5, 2, 2.
    assert r.u == 9 - 6


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0)], "t double, df double").select(ST.t_two_sided("t", "df").alias("t"), ST.chi2_upper(F.lit(3.841459), F.lit(1.0)).alias("c"), ST.normal_two_sided(F.lit(1.959964)).alias("n")).first()
    assert (df.t, df.c, df.n) == (pytest.approx(0.073388, abs=1e-5), pytest.approx(0.05, abs=1e-6), pytest.approx(0.05, abs=1e-6))


def test_overlap_join_once(spark):
    a = spark.createDataFrame([(1, "k", 0, 100), (2, "k", 5, 5)], "i int, by string, s int, e int")
    b = spark.createDataFrame([(7, "k", 40, 60), (8, "k", 100, 120), (9, "z", 0, 9)], "j int, by string, s2 int, e2 int")
    assert [(r.i, r.j) for r in I.overlap_join(a, b, ["by"], ("s", "e"), ("s2", "e2"), 16).collect()] == [(1, 7)]


def test_depth_runs(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 5, 15), ("c", 20, 21)], "c string, s int, e int")
    assert sorted((r.lo, r.hi, r.depth) for r in I.depth(df, ["c"], "s", "e").collect()) == [(0, 5, 1), (5, 10, 2), (10, 15, 1), (15, 20, 0), (20, 21, 1)]


def test_find_all_overlapping(spark):
    assert one(spark, Q.find_all(F.lit("AAAA"), "AA"), Q.find_all(F.lit("A"), "AA")) == ([0, 1, 2], [])


def test_best_offset_leftmost(spark):
    best, none = one(spark, Q.best_offset(F.lit("ACGAACGT"), "ACGT", 5, 1), Q.best_offset(F.lit("TTTTTT"), "ACGA", 3, 1))
    assert (best.mismatches, best.offset) == (0, 4) and none is None


def test_registered_core_prefers_complete(spark):
    (r,) = one(spark, Q.registered_core(F.lit("TTACGTTTTTTTACG"), ["ACG"], F.lit(6), 6, 0, 5))
    assert (r.core, r.complete, r.offset) == ("TTTTT", True, 2)


def test_argmax_first_of_equals(spark):
    scores = {"a": F.lit(1.0), "b": F.lit(2.0), "c": F.lit(2.0)}
    assert one(spark, S.argmax_label(scores), S.argmax_label(scores, floor=3.0, default="none")) == ("b", "none")


def test_placeholders(spark):
    df = spark.createDataFrame([(None,), ("Unknown",), (" NA ",), ("21 DPI",)], "x string")
    assert [r.v for r in df.select(S.real(F.col("x")).alias("v")).where("v IS NOT NULL").collect()] == ["21 DPI"]


def test_persistence_needs_known_times(spark):
    seen = spark.createDataFrame([("c", "21 DPI", True), ("c", None, True), ("d", "21 DPI", False), ("d", "45 DPI", False)], "core string, tp string, strong boolean")
    assert [(r.core, r.evidence) for r in MO.persistence(seen, ["core"], "tp", "strong").collect()] == [("d", "weak")]


def test_margins_equal_sums(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "a string, b string")
    got = {(r.a, r.b): r.n for r in R.crosstab(df, "a", "b", margins=True).collect()}
    assert got["TOTAL", "TOTAL"] == 3 and got["x", "TOTAL"] == 2 and got["TOTAL", "p"] == 2


def test_fastq_keeps_whole_records(spark, tmp_path):
    (tmp_path / "r1.fastq").write_text("@a\nACGT\n+\nFFFF\n@b\nAC")
    got = T.parse_fastq(T.lines(spark, str(tmp_path))).collect()
    assert [(r.header, r.seq) for r in got] == [("@a", "ACGT")]


def test_mates_pair_within_their_files(spark, tmp_path):
    for lane, names in (("L1", "ab"), ("L2", "cd")):
        for mate, base in (("R1", "A"), ("R2", "T")):
            (tmp_path / f"{lane}_{mate}.fastq").write_text("".join(f"@{n}\n{base * 4}{n}\n+\nFFFFF\n" for n in names))
    every = T.parse_fastq(T.lines(spark, str(tmp_path)))
    mate = lambda k: every.where(F.col("file").endswith(f"_R{k}.fastq"))
    got = T.pair_reads(mate(1), mate(2)).collect()
    assert sorted((r.header, r.seq_r1, r.seq_r2) for r in got) == [(f"@{n}", f"AAAA{n}", f"TTTT{n}") for n in "abcd"]


def test_lines_are_counted_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    rows = T.lines(spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert sorted((r.line, r.value) for r in rows) == [(k, f"line {k}") for k in range(5000)]


def test_reports_hold_every_row(spark, tmp_path):
    table = spark.range(500).select(F.concat(F.lit("a|"), "id").alias("name"), "id")
    sinks.write_markdown("Title", [("One", table), ("Two", table.limit(1))], str(tmp_path / "md"))
    got = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert got[:2] == ["# Title", ""] and sum(x.startswith("| a\\|") for x in got) == 501 and got.index("## Two") > 500


def test_paired_t(spark):
    rows = spark.createDataFrame([("g", u, arm, v) for u, a, b in (("x", 3.0, 1.0), ("y", 5.0, 2.0), ("z", 4.0, 0.5)) for arm, v in (("A", a), ("B", b))], "gene string, unit string, arm string, v double")
    r = ST.paired(rows, ["gene"], "unit", "arm", "v", "A", "B", 3).first()
    d = [2.0, 3.0, 3.5]
    m = sum(d) / 3
    sd = (sum((x - m) ** 2 for x in d) / 2) ** 0.5
    assert (r.log2fc, r.t, r.df) == (pytest.approx(m), pytest.approx(m / (sd / 3**0.5)), 2)


def test_whole_table_ranks(spark):
    from lacuna.operators import ranges

    values = [(k, float((k * 7919) % 1000) // 3) for k in range(2000)]
    df = spark.createDataFrame(values, "k int, v double")
    want = {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in values))}
    assert {r.k: r.rank for r in ranges.global_rank(df, "v", ["k"], "rank").collect()} == {k: n + 1 for k, n in want.items()}
    tiles = {r.k: r.tile for r in ranges.ntile(df, 7, "v", ["k"], "tile").collect()}
    big = [286] * 5 + [285] * 2
    assert [sum(t == n + 1 for t in tiles.values()) for n in range(7)] == big
    ps = [(g, k, ((k * 37) % 50) / 1000 if k % 5 else None) for g in "ab" for k in range(80)] + [("c", 0, 0.0), ("c", 1, float("nan"))]
    got = {(r.g, r.k): r.padj for r in ST.bh_fdr(spark.createDataFrame(ps, "g string, k int, p double"), "p", ["g"]).collect()}
    for g in "abc":
        own = sorted((p, k) for h, k, p in ps if h == g and p is not None and p == p)
        for n, (p, k) in enumerate(own):
            assert got[g, k] == pytest.approx(min(1.0, min(q * len(own) / (i + 1) for i, (q, _) in enumerate(own) if i >= n)))


def test_fasta_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", "ACGT" * 40), ("c2", "A" * 60)], "name string, seq string")
    sinks.write_lines(T.write_fasta_lines(contigs).coalesce(1), str(tmp_path / "f"))
    assert {tuple(r) for r in T.parse_fasta(T.lines(spark, str(tmp_path / "f"))).collect()} == {tuple(r) for r in contigs.collect()}


def test_recipe_drift(spark, tmp_path):
    path = str(tmp_path / "step")
    sinks.write_checkpoint(spark.range(3), path, {"min_genes": 200})
    assert sinks.read_checkpoint(spark, path, {"min_genes": 200}).count() == 3
    with pytest.raises(sinks.RecipeDrift, match="min_genes"):
        sinks.read_checkpoint(spark, path, {"min_genes": 300})


def test_missing_columns_and_rows(spark):
    with pytest.raises(R.MissingColumns, match="nope"):
        R.require_columns(spark.range(1), ["id", "nope"])
    with pytest.raises(LookupError):
        R.require_rows(spark.range(0), "symbol")


def test_partition_count_does_not_matter(spark, data):
    from lacuna.plans import catalog

    rows = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, catalog.queries()["q2_qc_ledger"](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows[0] == rows[1]


def test_gates_and_grid(spark):
    rows = [("a", 2.0, 0.001, 0.004), ("b", -1.5, 0.01, 0.02), ("c", 0.4, 0.01, 0.02), ("d", 3.0, 0.04, 0.2), ("e", 0.0, 0.0, 0.0), ("f", 1.0, None, None)]
    tested = spark.createDataFrame(rows, "gene string, log2fc double, pval double, padj double")
    got = ST.gate_lists(tested, "gene", 0.05, 0.5, 2).collect()
    assert {(r.gate, r.direction, r.gene, r.ready) for r in got} == {("raw", "up", "a", True), ("raw", "up", "d", True), ("raw", "down", "b", False), ("fdr", "up", "a", False), ("fdr", "down", "b", False)}
    grid = {(r.alpha, r.least_fold): (r.raw, r.fdr, r.of) for r in ST.threshold_grid(tested, [0.05, 0.005], [0.0, 1.0]).collect()}
    assert grid == {(0.05, 0.0): (5, 4, 5), (0.05, 1.0): (3, 2, 5), (0.005, 0.0): (2, 2, 5), (0.005, 1.0): (1, 1, 5)}


def test_subtype_calls(spark):
    means = spark.createDataFrame([("x", "A1", 1.0), ("x", "A2", 0.6), ("x", "B", 0.1), ("y", "A1", 0.2), ("y", "A2", 0.2), ("y", "B", 0.21), ("z", "B", -0.1), ("z", "A1", -0.5)], "c string, p string, v double")
    calls = SU.call(SU.family_means(means, "c", "p", "v", {"A": ["A1", "A2"]}), "c", 0.05)
    assert {r.c: (r.top, r.subtype) for r in calls.collect()} == {"x": ("A", "A"), "y": ("B", "Unresolved"), "z": ("B", "Unresolved")}
    split = SU.split(calls, means, "c", "p", "v", "A", ("A1", "A high"), ("A2", "A low"), 0.3)
    assert {r.c: r.subtype for r in split.collect()} == {"x": "A high", "y": "Unresolved", "z": "Unresolved"}
    flags = spark.createDataFrame([("x", 20.0), ("y", None)], "c string, m double")
    assert {r.c: r.subtype for r in SU.overridden(split, flags, "c", [(F.col("m") > 17, "QC")]).collect()} == {"x": "QC", "y": "Unresolved", "z": "Unresolved"}
    scores = spark.createDataFrame([("x", 1, "A", 1.0), ("x", 1, "B", 1.0), ("x", 2, "B", 3.0), ("x", 3, "A", 2.0)], "c string, u int, p string, v double")
    assert [(r.vote, round(r.dominant_frac, 3)) for r in SU.votes(scores, "c", "u", "p", "v").collect()] == [("A", 0.667)]


def test_arms_within_batches(spark):
    rows = [("l1", "k", "t1")] * 3 + [("l1", "i", "t2")] * 2 + [("l2", "i", "t1")] * 4 + [("unknown", "k", "t1"), ("l2", "p", "t1")]
    df = spark.createDataFrame(rows, "lib string, who string, tp string")
    arm = F.when(F.col("who") == "k", "b").when(F.col("who") == "i", "a")
    assert {tuple(r) for r in A.within_batch(df, arm, "lib", 2).collect()} == {("l1", 2, 3, True), ("l2", 4, 0, False)}
    assert {tuple(r) for r in A.shared_levels(df, arm, "who", "tp", 3).collect()} == {("t1", 1, 1, True), ("t2", 0, 0, False)}


def test_partial_matches_of_reads_shorter_than_the_longest_overlap(spark):
    from lacuna.operators import molecules as MO

    reads = spark.createDataFrame([("nine", "CCCGGGTTT"), ("ten", "ACCCGGGTTT"), ("eight", "CCGGGTTT"), ("whole", "AAACCCGGGTT"), ("none", None)], "read_id string, seq string")
    cores = spark.createDataFrame([("AAACCCGGGTTT",)], "core string")
    got = {(r.read_id, r.bases) for r in MO.partial_matches(reads, cores, 12, 9).collect()}
    assert got == {("nine", 9), ("ten", 10), ("whole", 11)}


def test_partial_overlaps_of_short_documents(spark, tmp_path):
    import duckdb
    from helpers import same_rows

    from lacuna.plans import catalog

    texts = ["qwertyuiopasdfghjklzxcvbnm", "dfghjklzxcvb"[3:], "asdfghjklz"[:9], "dfghjklzxc", "fghjklzxc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert any(r for r in same_rows(catalog.queries()["sp16_partial_overlap"](spark, str(tmp_path)), con, catalog.oracle_sql()["sp16_partial_overlap"]))


def test_overlaps_of_repeated_spans(spark):
    from itertools import product

    a = [(k % 3 if k % 7 else None, k, k % 5, k % 5 + k % 4) for k in range(60)]
    b = [(k % 3, k, k % 6 - 3, k % 6) for k in range(40)]
    left, right = spark.createDataFrame(a, "g int, i int, s int, e int"), spark.createDataFrame(b, "g int, j int, t int, f int")
    want = sorted((x[1], y[1]) for x, y in product(a, b) if x[0] == y[0] and x[3] > x[2] < y[3] and y[2] < x[3])
    for join in (I.overlap_join, I.overlap_join_of_repeats):
        assert sorted((r.i, r.j) for r in join(left, right, ["g"], ("s", "e"), ("t", "f"), 2).collect()) == want


def test_a_gene_set_is_cut_below_the_explode(spark):
    made = spark.createDataFrame([("s\tname\ta\t\tb",), ("t\tnone",)], "value string")
    sets = T.parse_gmt(made)
    assert [tuple(r) for r in sets.collect()] == [("s", "name", "a"), ("s", "name", "b")]
    assert "split(" not in sets._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_fraction_expressing_counts_rows_of_single_pairs(spark):
    coo = spark.createDataFrame([(1, 7, 2.0), (2, 7, 1.0), (3, 7, 0.0), (1, 8, 5.0), (4, 8, 1.0), (9, 8, 1.0)], "cell long, gene long, value double")
    cells = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (4, "a"), (5, "b"), (9, None)], "cell long, kind string")
    plain, rows = M.fraction_expressing(coo, cells, "kind"), M.fraction_expressing(coo, cells, "kind", single=True)
    got = {tuple(r) for r in rows.select("kind", "gene", "n_expressing", "n_cells").collect()}
    assert got == {("a", 7, 2, 4), ("a", 8, 2, 4), ("b", 8, 1, 3)}
    assert got == {tuple(r) for r in plain.select("kind", "gene", "n_expressing", "n_cells").collect()}
    # No row is held by its cell once more.
    assert "distinct" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_contrast_reads_lines_once_and_totals_meet_in_no_window(spark, data):
    from lacuna.plans import catalog

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan(catalog.queries()["q15_contrast_run"](spark, data))
    bulk = spark.createDataFrame([("x", 1, 30.0), ("x", 2, 10.0), ("y", 1, 0.0), (None, 1, 4.0)], "rep string, gene long, value double")
    cpm = M.log_cpm(bulk, ["rep"])
    assert "Window" not in plan(cpm)
    got = {(r.rep, r.gene): r.logcpm for r in cpm.collect()}
    assert got == pytest.approx({("x", 1): math.log2(750001), ("x", 2): math.log2(250001), ("y", 1): 0.0, (None, 1): math.log2(1000001)})
