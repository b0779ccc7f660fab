"""Composite queries built from the operators (Q), and supplementary ones (SU)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators import audit as A
from lacuna.operators import graph as G
from lacuna.operators import intervals as I
from lacuna.operators import matrix as M
from lacuna.operators import molecules as MO
from lacuna.operators import probes as PR
from lacuna.operators import read_audit as RA
from lacuna.operators import receptors as RC
from lacuna.operators import relational as R
from lacuna.operators import stats as ST
from lacuna.plans.aggregates import DOMINANT, QC, TYPED, labels, qc
from lacuna.plans.basic import RULES, RULES_SQL, spans
from lacuna.plans.bindings import ALN, CELLS, CONTIGS, COO, MOL, READS, SEQ, alignments, cells, contigs, coo, molecules, reads, sequences
from lacuna.plans.registry import query
from lacuna.plans.statistics_queries import BRANDS, HYPER, OVERLAP, UPDOWN, bulk, ora_counts, overlaps, r6, rank_sums, two_arms, welch_parts

W = Window


@query("q1_ingest_assign", f"WITH {CELLS}, {COO} SELECT cell, library, CASE WHEN balance < 0 THEN 'Unknown' ELSE animal END AS animal, count(gene) AS genes, coalesce(sum(value), 0) AS total FROM cells LEFT JOIN coo USING (cell) GROUP BY 1, 2, 3")
def q1(t):
    named = cells(t).withColumn("animal", F.when(F.col("balance") < 0, "Unknown").otherwise(F.col("animal")))
    return named.join(coo(t), "cell", "left").groupBy("cell", "library", "animal").agg(F.count("gene").alias("genes"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


LEDGER = f"""WITH {QC}, white AS (SELECT DISTINCT cell FROM coo JOIN part ON gene = p_partkey WHERE p_brand = 'Brand#1' AND p_size <= 5 AND value >= 1), a AS (SELECT median(ln(1 + total)) AS med, median(ln(1 + n_features)) AS fmed, stddev_samp(ln(1 + total)) AS sd, stddev_samp(ln(1 + n_features)) AS fsd FROM m),
 b AS (SELECT median(abs(ln(1 + total) - med)) AS mad, median(abs(ln(1 + n_features) - fmed)) AS fmad, any_value(a) AS a FROM m, a),
 f AS (SELECT cell, pct_flagged > 30 AS mito, abs(ln(1 + total) - a.med) > 3 * CASE WHEN mad > 0 THEN mad ELSE a.sd END OR abs(ln(1 + n_features) - a.fmed) > 3 * CASE WHEN fmad > 0 THEN fmad ELSE a.fsd END AS outlier, cell IN (SELECT cell FROM white) AS exempt FROM m, b)"""


@query("q2_qc_ledger", f"{LEDGER} SELECT cell, CASE WHEN mito THEN 'mito' WHEN outlier THEN 'outlier' ELSE 'pass' END AS reason, exempt, (mito OR outlier) AS would_drop, NOT (mito OR outlier) OR exempt AS kept FROM f")
def q2(t):
    """The quality pass: metrics, robust outliers, a fixed rule, exemptions, reasons."""
    m = ST.mad_outlier(qc(t), "log1p_total", 3, out="low").drop("med", "mad", "width")
    m = ST.mad_outlier(m, "log1p_n_features", 3, out="few")
    rare = t.part.where("p_brand = 'Brand#1' AND p_size <= 5").select(F.col("p_partkey").alias("gene"))
    exempt = coo(t).where("value >= 1").join(rare, "gene", "left_semi").select("cell").distinct().withColumn("exempt", F.lit(True))
    m = R.lookup(m, exempt, ["cell"], {"exempt": False})
    mito, outlier = F.col("pct_flagged") > 30, F.col("low") | F.col("few")
    return m.select("cell", F.when(mito, "mito").when(outlier, "outlier").otherwise("pass").alias("reason"), "exempt", (mito | outlier).alias("would_drop"), (~(mito | outlier) | F.col("exempt")).alias("kept"))


@query("q3_label_transitions", f"WITH {TYPED} SELECT type AS before, CASE WHEN support < 6 THEN 'Unassigned' ELSE type END AS after, count(*) AS n FROM lab GROUP BY 1, 2")
def q3(t):
    after = F.when(F.col("support") < 6, "Unassigned").otherwise(F.col("type"))
    return R.crosstab(labels(t).select(F.col("type").alias("before"), after.alias("after")), "before", "after")


@query("q4_receptor_resolve", f"""WITH {CONTIGS}, c AS (SELECT user_id, day, bool_or(chain IN ('TRA', 'TRB')) AS ab, bool_or(chain IN ('TRG', 'TRD')) AS gd, count(DISTINCT chain) AS n FROM contigs WHERE productive GROUP BY 1, 2)
 SELECT user_id, day, CASE WHEN ab AND gd THEN 'held' WHEN gd AND n = 2 THEN 'gamma-delta' WHEN ab THEN 'alpha-beta' ELSE 'unresolved' END AS call FROM c""")
def q4(t):
    chains = contigs(t).where("productive").groupBy("user_id", "day").agg(F.collect_set("chain").alias("c"))
    has = lambda *names: F.exists("c", lambda x: x.isin(*names))
    ab, gd = has("TRA", "TRB"), has("TRG", "TRD")
    return chains.select("user_id", "day", F.when(ab & gd, "held").when(gd & (F.size("c") == 2), "gamma-delta").when(ab, "alpha-beta").otherwise("unresolved").alias("call"))


@query("q5_subtype_table", f"""WITH {CELLS}, {COO}, x AS (SELECT library, p_type AS type, sum(value) / (SELECT count(*) FROM part q WHERE q.p_type = part.p_type) AS v FROM coo JOIN part ON gene = p_partkey JOIN cells USING (cell) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY v DESC, type) AS k FROM x)
 SELECT library, max(type) FILTER (k = 1) AS top, max(type) FILTER (k = 2) AS second, round(max(v) FILTER (k = 1) - max(v) FILTER (k = 2), 6) AS margin FROM r GROUP BY 1""")
def q5(t):
    sizes = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("size"))
    parts = t.part.join(sizes, "p_type").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("type"), "size")
    x = coo(t).join(parts, "gene").join(cells(t), "cell").groupBy("library", "type").agg((F.sum("value") / F.first("size")).alias("v"))
    top = R.best_per_key(x, ["library"], [F.desc("v"), F.col("type")], 2, "k")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return top.groupBy("library").agg(pick("type", 1).alias("top"), pick("type", 2).alias("second"), r6(pick("v", 1) - pick("v", 2)).alias("margin"))


@query("q6_cluster_flags", f"""WITH {QC}, c AS (SELECT n_name AS library, pct_flagged, pct_top FROM m JOIN customer ON cell = c_custkey JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT median(pct_top) AS med FROM c)
 SELECT library, CASE WHEN count(*) FILTER (pct_top > med) / count(*) >= 0.5 AND avg(pct_top) >= 1.05 * any_value(med) THEN 'doublet' WHEN median(pct_flagged) > 17 THEN 'high mito' ELSE 'ok' END AS flag FROM c, a GROUP BY 1""")
def q6(t):
    c = qc(t).join(cells(t), "cell")
    med = c.agg(F.median("pct_top").alias("med"))
    g = c.join(F.broadcast(med)).groupBy("library").agg((F.count_if(F.col("pct_top") > F.col("med")) / F.count(F.lit(1))).alias("both"), (F.avg("pct_top") / F.first("med")).alias("fold"), F.median("pct_flagged").alias("mito"))
    return g.select("library", F.when((F.col("both") >= 0.5) & (F.col("fold") >= 1.05), "doublet").when(F.col("mito") > 17, "high mito").otherwise("ok").alias("flag"))


@query("q7_graded_calls", f"WITH {MOL}, c AS (SELECT max(value) FILTER (library = 'error') AS ceiling FROM mol), g AS (SELECT library, CASE WHEN value > ceiling THEN 'high' WHEN value > ceiling * 0.5 THEN 'low' ELSE 'none' END AS grade FROM mol, c WHERE library <> 'error') SELECT library, grade, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY library), 6) AS share FROM g GROUP BY 1, 2")
def q7(t):
    m = molecules(t)
    top = m.where("library = 'error'").agg(F.max("value").alias("ceiling"))
    v, c = F.col("value"), F.col("ceiling")
    g = m.where("library <> 'error'").join(F.broadcast(top)).select("library", F.when(v > c, "high").when(v > c * 0.5, "low").otherwise("none").alias("grade"))
    return R.normalised(g, "library", "grade", "library").withColumn("share", r6("share"))


@query("q8_recovery_funnel", f"""WITH {READS}, a AS (SELECT * FROM reads WHERE length(seq) >= 34), c AS (SELECT doc_id, regexp_extract(seq, 'ACGC(.{{8}})GC', 1) AS core FROM a), d AS (SELECT doc_id, core FROM c WHERE core <> ''), e AS (SELECT DISTINCT doc_id, core FROM d), f AS (SELECT core FROM e GROUP BY 1 HAVING count(*) > 1)
 SELECT 'reads' AS stage, 0 AS turn, count(*) AS n FROM reads UNION ALL SELECT 'long enough', 1, count(*) FROM a UNION ALL SELECT 'with core', 2, count(*) FROM d UNION ALL SELECT 'molecules', 3, count(*) FROM e UNION ALL SELECT 'shared cores', 4, count(*) FROM f""")
def q8(t):
    every = reads(t)
    long = every.where("length(seq) >= 34")
    found = long.select("doc_id", F.regexp_extract("seq", "ACGC(.{8})GC", 1).alias("core")).where("core <> ''")
    mol = found.distinct()
    return R.funnel([("reads", every), ("long enough", long), ("with core", found), ("molecules", mol), ("shared cores", mol.groupBy("core").count().where("count > 1"))])


@query("q9_inventory", f"WITH {MOL}, n AS (SELECT max(k) AS floor FROM (SELECT core, count(*) AS k FROM mol WHERE library = 'error' GROUP BY 1)) SELECT core, string_agg(DISTINCT library, ';' ORDER BY library) AS libraries, count(DISTINCT ub) AS molecules, count(*) AS reads, count(*) > any_value(floor) AS above FROM mol, n WHERE library <> 'error' GROUP BY 1")
def q9(t):
    m = molecules(t)
    floor = m.where("library = 'error'").groupBy("core").count().agg(F.max("count").alias("floor"))
    return m.where("library <> 'error'").join(F.broadcast(floor)).groupBy("core").agg(R.set_text(F.col("library")).alias("libraries"), F.count_distinct("ub").alias("molecules"), F.count(F.lit(1)).alias("reads"), (F.count(F.lit(1)) > F.first("floor")).alias("above"))


@query("q10_independent_check", f"WITH {MOL}, cat AS (SELECT DISTINCT core, library FROM mol WHERE mate = 2) SELECT library, count(*) AS n, count(*) FILTER ((core, library) IN (SELECT (core, library) FROM cat)) AS agree FROM mol WHERE mate = 1 GROUP BY 1")
def q10(t):
    m = molecules(t)
    catalog = m.where("mate = 2").groupBy("core").agg(F.collect_set("library").alias("owners"))
    own = m.where("mate = 1").join(catalog, "core", "left")
    return own.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.array_contains("owners", F.col("library")), F.lit(False))).alias("agree"))


@query("q11_object_report", f"WITH {CELLS} SELECT 'cells' AS item, count(*) AS n FROM cells UNION ALL SELECT 'libraries', count(DISTINCT library) FROM cells UNION ALL SELECT 'duplicate keys', count(*) - count(DISTINCT cell) FROM cells UNION ALL SELECT 'placeholder levels', count(*) FILTER (lower(animal) IN ('', 'unknown', 'na')) FROM cells UNION ALL SELECT 'constant columns', " + " + ".join(f"CAST(count(DISTINCT {c}) <= 1 AS INTEGER)" for c in ("cell", "library", "tissue", "animal", "balance")) + " FROM cells")
def q11(t):
    c = cells(t)
    one = c.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("library").alias("libraries"), (F.count(F.lit(1)) - F.count_distinct("cell")).alias("duplicate keys"), F.count_if(S.is_placeholder(F.col("animal"))).alias("placeholder levels"))
    facts = one.unpivot([], one.columns, "item", "n")
    return facts.union(A.census(c).agg(F.count_if("constant").alias("n")).select(F.lit("constant columns").alias("item"), "n"))


@query("q12_share_outliers", f"WITH {CELLS}, {COO}, s AS (SELECT tissue, library, 100.0 * count(*) FILTER (balance < 0) / count(*) AS share FROM cells GROUP BY 1, 2), d AS (SELECT tissue, median(share) AS med FROM s GROUP BY 1) SELECT s.tissue, library, round(share, 6) AS share FROM s JOIN d ON s.tissue = d.tissue WHERE share > 1.5 * med AND share > 10 AND med > 0.5")
def q12(t):
    s = cells(t).groupBy("tissue", "library").agg((100.0 * F.count_if(F.col("balance") < 0) / F.count(F.lit(1))).alias("share"))
    return A.share_outliers(s, "tissue", "share", times=1.5).select("tissue", "library", r6("share").alias("share"))


@query("q13_confounding", f"WITH {CELLS}, f AS (SELECT 'library' AS factor, library AS level, count(DISTINCT tissue) AS arms FROM cells GROUP BY 2 UNION ALL SELECT 'animal', animal, count(DISTINCT tissue) FROM cells GROUP BY 2) SELECT factor, count(*) AS levels, count(*) FILTER (arms = 1) AS one_arm, count(*) = count(*) FILTER (arms = 1) AS perfect FROM f GROUP BY 1")
def q13(t):
    return A.confounding(cells(t), "tissue", ["library", "animal"])


@query("q14_contrast_manifest", f"""WITH {CELLS}, p AS (SELECT DISTINCT animal FROM cells), s AS (SELECT DISTINCT tissue FROM cells), m AS (SELECT animal, a.tissue AS side_a, b.tissue AS side_b FROM p, s a, s b WHERE a.tissue < b.tissue), n AS (SELECT animal, tissue, count(*) AS n, count(DISTINCT library) AS reps FROM cells GROUP BY 1, 2)
 SELECT m.*, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(x.n, 0) >= 3 AND coalesce(y.n, 0) >= 3 AS runnable, coalesce(x.reps, 0) >= 2 AND coalesce(y.reps, 0) >= 2 AS pseudobulk FROM m LEFT JOIN n x ON m.animal = x.animal AND side_a = x.tissue LEFT JOIN n y ON m.animal = y.animal AND side_b = y.tissue""")
def q14(t):
    """Every pair of arms in every population, sized and gated from one aggregation."""
    n = cells(t).groupBy("animal", "tissue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("library").alias("reps"))
    arms = n.select("tissue").distinct()
    pairs = arms.select(F.col("tissue").alias("side_a")).join(arms.select(F.col("tissue").alias("side_b")), F.expr("side_a < side_b"))
    m = n.select("animal").distinct().join(R.small(pairs))
    side = lambda x: n.select("animal", F.col("tissue").alias(f"side_{x}"), F.col("n").alias(f"n_{x}"), F.col("reps").alias(f"reps_{x}"))
    m = m.join(side("a"), ["animal", "side_a"], "left").join(side("b"), ["animal", "side_b"], "left").fillna(0, ["n_a", "n_b", "reps_a", "reps_b"])
    return m.select("animal", "side_a", "side_b", "n_a", "n_b", ((F.col("n_a") >= 3) & (F.col("n_b") >= 3)).alias("runnable"), ((F.col("reps_a") >= 2) & (F.col("reps_b") >= 2)).alias("pseudobulk"))


@query("q15_contrast_run")
def q15(t):
    """Both layers of one contrast with BH and gates."""
    rows = two_arms(t)
    bulk_layer = ST.bh_fdr(welch_parts(t, rows).withColumn("pval", ST.t_two_sided(F.col("t"), F.col("df"))), "pval").select("gene", F.lit("pseudobulk").alias("layer"), "pval", "padj")
    cell_layer = ST.bh_fdr(rank_sums(t, rows).withColumn("pval", ST.normal_two_sided(F.col("z"))), "pval").select("gene", F.lit("cell").alias("layer"), "pval", "padj")
    both = bulk_layer.union(cell_layer)
    return both.select("gene", "layer", F.round("pval", 9).alias("pval"), F.round("padj", 9).alias("padj"), (F.col("padj") < 0.05).alias("significant"))


@query("q16_over_representation", f"WITH {UPDOWN}, {BRANDS}, p AS (SELECT term, k, round({HYPER}, 7) AS p FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS i, count(*) OVER () AS s FROM p) SELECT term, k, p, round(least(1.0, min(p * s / i) OVER (ORDER BY i DESC)), 6) AS padj FROM r")
def q16(t):
    z = ora_counts(t)
    p = z.select("term", "k", F.round(S.hypergeom_tail(F.col("k"), F.col("m"), F.col("n"), F.col("q")), 7).alias("p"))
    return ST.bh_fdr(p, "p").withColumn("padj", r6("padj"))


@query("q17_reconcile_totals", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS up, count(*) FILTER (l_returnflag <> 'A') AS down, count(*) AS total, true AS ok FROM lineitem GROUP BY 1")
def q17(t):
    lists = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("up"), F.count_if(F.col("l_returnflag") != "A").alias("down"))
    totals = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"))
    return lists.join(totals, "l_suppkey").withColumn("ok", F.col("up") + F.col("down") == F.col("total"))


@query("q18_term_network", f"WITH RECURSIVE {OVERLAP}, k AS (SELECT a, b FROM y WHERE shared / (n_a + n_b - shared) >= 0.02), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(n, m) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), c AS (SELECT n, min(m) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size, count(*) = 1 AS isolated FROM c GROUP BY 1")
def q18(t):
    parts = G.components(t.nation.select(F.col("n_nationkey").alias("node")), overlaps(t).where("jaccard >= 0.02").select("a", "b"))
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("isolated", F.col("size") == 1)


@query("q19_read_classes", "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, 'Brand#' || (l_suppkey % 25 + 1) AS brand, CAST(l_quantity AS INTEGER) AS s FROM lineitem), h AS (SELECT r.k, r.l_partkey, r.brand, r.s, count(p_partkey) AS n FROM r LEFT JOIN part ON p_brand = r.brand AND p_size < r.s + 2 AND r.s < p_size + 5 GROUP BY 1, 2, 3, 4) SELECT CASE n WHEN 0 THEN 'intergenic' WHEN 1 THEN 'counted' ELSE 'ambiguous' END AS class, count(*) AS reads FROM h GROUP BY 1")
def q19(t):
    r = t.lineitem.selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_partkey", "concat('Brand#', l_suppkey % 25 + 1) AS p_brand", "CAST(l_quantity AS INT) AS rs").distinct().withColumn("re", F.col("rs") + 2)
    places = r.select("p_brand", "rs", "re").distinct()
    hits = I.overlap_join(places, spans(t), ["p_brand"], ("rs", "re"), ("s", "e"), 16).groupBy("p_brand", "rs").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return r.join(hits, ["p_brand", "rs"], "left").groupBy(F.when(n == 0, "intergenic").when(n == 1, "counted").otherwise("ambiguous").alias("class")).agg(F.count(F.lit(1)).alias("reads"))


@query("q20_position_classes", f"WITH {ALN} SELECT library, CASE WHEN pos < 50 THEN '5prime' WHEN pos >= 150 THEN '3prime' WHEN pos BETWEEN 90 AND 110 THEN 'gap' ELSE 'single' END AS class, count(*) AS n, count(*) FILTER (mapq < 10) AS lost_mapq, count(*) FILTER (mapq >= 10 AND flag & 256 <> 0) AS lost_secondary FROM aln GROUP BY 1, 2")
def q20(t):
    p = F.col("pos")
    kind = F.when(p < 50, "5prime").when(p >= 150, "3prime").when(p.between(90, 110), "gap").otherwise("single")
    low = F.col("mapq") < 10
    return alignments(t).groupBy("library", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("lost_mapq"), F.count_if(~low & ~S.lacks_bits(F.col("flag"), S.SECONDARY)).alias("lost_secondary"))


GENES = (("one", 20, 60), ("two", 55, 90), ("three", 110, 150))


@query("q20b_mapping_losses", f"""WITH {ALN}, g(name, lo, hi) AS (VALUES {", ".join(str(g) for g in GENES)}), a AS (SELECT *, row_number() OVER () AS i, pos + m1 + d + 35 - 1 AS last FROM aln),
 h AS (SELECT i, count(*) AS n, min(name) AS name FROM a JOIN g ON pos <= hi AND last >= lo GROUP BY 1),
 c AS (SELECT a.*, CASE WHEN n = 1 THEN concat('single:', h.name) WHEN n > 1 THEN 'multi overlap' WHEN last < 20 THEN '5prime' WHEN pos > 150 THEN '3prime' ELSE 'gap' END AS class FROM a LEFT JOIN h USING (i))
 SELECT library, class, count(*) AS reads, count(*) FILTER (flag & 2304 <> 0) AS lost_not_primary, count(*) FILTER (flag & 2304 = 0 AND mapq < 10) AS lost_mapq, count(*) FILTER (flag & 2304 = 0 AND mapq >= 10 AND class IN ('5prime', '3prime', 'gap')) AS lost_no_gene,
 count(*) FILTER (flag & 2304 = 0 AND mapq >= 10 AND class = 'multi overlap') AS lost_multi, count(*) FILTER (flag & 2304 = 0 AND mapq >= 10 AND starts_with(class, 'single')) AS counted FROM c GROUP BY 1, 2""")
def q20b(t):
    """Reads by what their span meets, each lost at the first of the steps or counted."""
    f = F.col("flag")
    last = F.col("pos") + Q.ref_length(F.col("cigar")) - 1
    a = alignments(t).withColumn("class", I.position_class(F.col("pos"), last, list(GENES)))
    primary, sure = f.bitwiseAND(F.lit(0x900)) == 0, F.col("mapq") >= 10
    single, multi = F.col("class").startswith("single"), F.col("class") == "multi overlap"
    kept = primary & sure
    return a.groupBy("library", "class").agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(~primary).alias("lost_not_primary"), F.count_if(primary & ~sure).alias("lost_mapq"), F.count_if(kept & ~single & ~multi).alias("lost_no_gene"),
        F.count_if(kept & multi).alias("lost_multi"), F.count_if(kept & single).alias("counted"),
    )


@query("q21_candidate_triage", f"WITH a AS (SELECT * FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) = 1), b AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) = 1), p AS (SELECT p_partkey, {RULES_SQL} AS class FROM part) SELECT CASE WHEN a.l_orderkey IS NULL THEN 'second only' WHEN b.l_orderkey IS NULL THEN 'first only' WHEN x.class = y.class THEN 'agree' ELSE 'differ' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey LEFT JOIN p x ON a.l_partkey = x.p_partkey LEFT JOIN p y ON b.l_partkey = y.p_partkey GROUP BY 1")
def q21(t):
    classes = t.part.select(F.col("p_partkey").alias("l_partkey"), S.first_match(F.col("p_brand"), RULES, "other").alias("class"))

    def best(flag, name):
        top = R.best_per_key(t.lineitem.where(F.col("l_returnflag") == flag), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber")])
        return top.join(classes, "l_partkey").select("l_orderkey", F.col("class").alias(name))

    both = best("A", "one").join(best("R", "two"), "l_orderkey", "full")
    verdict = F.when(F.col("one").isNull(), "second only").when(F.col("two").isNull(), "first only").when(F.col("one") == F.col("two"), "agree").otherwise("differ")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("q22_probe_validation", f"WITH {READS}, p(probe) AS (VALUES ('ACGTA'), ('GGTTA')), h AS (SELECT probe, i, doc_id FROM reads, p, range(0, 96) r(i) WHERE substr(seq, CAST(i + 1 AS BIGINT), 5) = probe) SELECT probe, CAST(i // 10 * 10 AS INTEGER) AS lo, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM h GROUP BY 1, 2")
def q22(t):
    probes = ["ACGTA", "GGTTA"]
    each = F.array(*(F.struct(F.lit(p).alias("probe"), Q.find_all(F.col("seq"), p).alias("found")) for p in probes))
    hits = reads(t).select("doc_id", F.inline(each)).select("doc_id", "probe", F.explode("found").alias("i"))
    return hits.groupBy("probe", F.expr("CAST(i div 10 * 10 AS INT)").alias("lo")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("q23_read_structure", f"WITH {READS} SELECT read_no, count(*) AS n, count(*) FILTER (contains(seq, 'GGG')) AS poly_g, round(avg(length(seq)), 6) AS mean_length, count(*) FILTER (starts_with(seq, 'A')) AS starts_a FROM reads GROUP BY 1")
def q23(t):
    return reads(t).groupBy("read_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(Q.longest_run(F.col("seq"), "G") >= 3).alias("poly_g"), r6(F.avg(F.length("seq"))).alias("mean_length"), F.count_if(F.col("seq").startswith("A")).alias("starts_a"))


@query("q24_truncate_mates", "WITH f AS (SELECT l_suppkey % 2 AS mate, l_suppkey // 2 AS pair, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rec, l_orderkey FROM lineitem), c AS (SELECT pair, min(n) AS least FROM (SELECT pair, mate, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1) SELECT f.pair, mate, CAST(count(*) AS BIGINT) AS kept, CAST(max(rec) + 1 AS BIGINT) AS records FROM f JOIN c ON f.pair = c.pair WHERE rec < least GROUP BY 1, 2")
def q24(t):
    rec = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    f = t.lineitem.select((F.col("l_suppkey") % 2).alias("mate"), F.expr("l_suppkey div 2").alias("pair"), rec.alias("rec"))
    least = f.groupBy("pair", "mate").count().groupBy("pair").agg(F.min("count").alias("least"))
    return f.join(least, "pair").where("rec < least").groupBy("pair", "mate").agg(F.count(F.lit(1)).alias("kept"), (F.max("rec") + 1).cast("long").alias("records"))


PROBES = (("a1", "one", "sense", "anchor", "ACGTA"), ("a2", "one", "sense", "anchor", "GGTTA"), ("f1", "one", "sense", "full", "ACGTACG"), ("b1", "two", "sense", "anchor", "CATTC"), ("b2", "two", "antisense", "anchor", "TTGCA"), ("f2", "two", "antisense", "full", "CATTCGA"))
CONTROLS = (("c1", "AAAA"), ("c2", "ACGTACGTACGT"))


_PROBE_SQL = ", ".join(str(p) for p in PROBES)


def _probe_hits(t, rows, schema):
    """Every place of the probes ``rows``, whose last column is ``letters``."""
    probes = t.spark.createDataFrame(list(rows), schema)
    tagged = reads(t).join(t.documents.select("doc_id", "lang"), "doc_id").select(F.struct("lang", (F.col("doc_id") * 100000 + F.col("read_no")).alias("k")).alias("r"), "seq")
    found = PR.find_all(tagged, probes, key="r", pattern="letters", strands=False)
    return found.join(F.broadcast(probes), "letters").select("r.*", "*").drop("r", "strand")


@query("q22b_confident_probes", f"""WITH {READS}, h AS (SELECT lang, doc_id * 100000 + read_no AS k, p.probe, p.target, p.orientation, p.kind FROM reads JOIN documents USING (doc_id), (VALUES {_PROBE_SQL}) p(probe, target, orientation, kind, letters), range(0, 100) r(i) WHERE substr(seq, CAST(i + 1 AS BIGINT), length(letters)) = letters),
 g AS (SELECT lang, target, orientation, k FROM h GROUP BY ALL HAVING bool_or(kind = 'full') OR count(DISTINCT probe) FILTER (kind = 'anchor') >= 2) SELECT lang, target, orientation, count(*) AS reads FROM g GROUP BY ALL""")
def q22b(t):
    """Reads with a whole probe of a target, or two of its anchors."""
    return RA.confident_reads(_probe_hits(t, PROBES, "probe string, target string, orientation string, kind string, letters string"), ["lang"], "k")


@query("q22c_control_verdicts", f"""WITH {READS}, h AS (SELECT lang, p.probe, i FROM reads JOIN documents USING (doc_id), (VALUES {", ".join(str(c) for c in CONTROLS)}) p(probe, letters), range(0, 100) r(i) WHERE substr(seq, CAST(i + 1 AS BIGINT), length(letters)) = letters),
 c AS (SELECT lang, probe, i, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT lang, probe, sum(n) OVER w AS hits, count(*) OVER w AS offsets, i AS mode, n FROM c WINDOW w AS (PARTITION BY lang, probe) QUALIFY row_number() OVER (PARTITION BY lang, probe ORDER BY n DESC, i) = 1)
 SELECT lang, probe, CAST(hits AS BIGINT) AS hits, offsets, CAST(mode AS INTEGER) AS mode, round(n / hits, 6) AS at_mode, CASE WHEN hits < 20 THEN 'absent' WHEN n / hits >= 0.5 THEN 'fixed' ELSE 'scattered' END AS verdict FROM m""")
def q22c(t):
    """Where control probes stand, and whether always in one place."""
    found = RA.offset_summary(_probe_hits(t, CONTROLS, "probe string, letters string"), ["lang"])
    return found.select("lang", "probe", "hits", "offsets", "mode", r6(F.col("at_mode")).alias("at_mode"), RA.control_verdict(F.col("hits"), F.col("at_mode"), 20, 0.5).alias("verdict"))


@query("q23b_read_layout", f"""WITH {READS}, p AS (SELECT lang, unnest(range(0, length(seq))) AS place, unnest(string_split(seq, '')) AS letter FROM reads JOIN documents USING (doc_id) WHERE seq <> ''), c AS (SELECT lang, place, letter, count(*) AS n FROM p GROUP BY ALL),
 e AS (SELECT lang, place, sum(n) AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM c GROUP BY ALL) SELECT lang, CAST(place // 10 AS INTEGER) AS block, round(avg(greatest(0, bits)), 6) AS entropy, CAST(sum(total) AS BIGINT) AS letters FROM e GROUP BY 1, 2""")
def q23b(t):
    """Entropy of the letters by blocks of ten places: constant parts of reads are low."""
    rows = reads(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    return RA.block_entropy(rows, ["lang"], 10).withColumn("entropy", r6(F.col("entropy")))


@query("q23c_list_orientation", f"""WITH {READS}, w AS (SELECT DISTINCT substr(seq, 1, 6) AS b FROM reads WHERE read_no = 0 AND length(seq) >= 6), s AS (SELECT lang, substr(seq, 1, 6) AS b FROM reads JOIN documents USING (doc_id) WHERE length(seq) >= 6),
 c AS (SELECT lang, count(*) AS reads, count(*) FILTER (b IN (SELECT b FROM w)) AS forward, count(*) FILTER (translate(reverse(b), 'ACGT', 'TGCA') IN (SELECT b FROM w)) AS reverse FROM s GROUP BY 1)
 SELECT *, CASE WHEN forward > reverse THEN 'forward' WHEN reverse > forward THEN 'reverse' ELSE 'either' END AS orientation FROM c""")
def q23c(t):
    """Whether reads begin with listed words as they are or turned round."""
    listed = reads(t).where("read_no = 0 AND length(seq) >= 6").select(F.substring("seq", 1, 6).alias("word"))
    return RA.list_orientation(reads(t).join(t.documents.select("doc_id", "lang"), "doc_id"), listed, ["lang"], 6)


@query("q25_chemistry_inference", f"""WITH {READS}, w AS (SELECT DISTINCT substr(seq, 1, 6) AS b FROM reads WHERE read_no = 0), c AS (SELECT doc_id, length(seq) AS len, count(*) AS n FROM reads GROUP BY 1, 2),
 m AS (SELECT doc_id, len FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len DESC) = 1), h AS (SELECT doc_id, round(count(*) FILTER (substr(seq, 1, 6) IN (SELECT b FROM w)) / count(*), 6) AS hit_rate FROM reads GROUP BY 1)
 SELECT doc_id, len, hit_rate FROM m JOIN h USING (doc_id)""")
def q25(t):
    """The usual length of a document's reads, and how many of all begin with a listed word."""
    listed = reads(t).where("read_no = 0").select(F.substring("seq", 1, 6).alias("b")).distinct().withColumn("hit", F.lit(1))
    every = reads(t).withColumn("b", F.substring("seq", 1, 6)).join(listed, "b", "left")
    rates = every.groupBy("doc_id").agg(r6(F.count("hit") / F.count(F.lit(1))).alias("hit_rate"))
    return RA.usual_length(reads(t), ["doc_id"]).join(rates, "doc_id").select("doc_id", "len", "hit_rate")


@query("q26_recovery_calls", f"WITH {CONTIGS}, c AS (SELECT user_id, day, count(DISTINCT chain) FILTER (productive) AS n, bool_or(NOT productive) AS bad FROM contigs GROUP BY 1, 2) SELECT CASE WHEN bad THEN 'quarantine' WHEN n >= 2 THEN 'confident' ELSE 'provisional' END AS call, CAST(n AS BIGINT) AS chains, count(*) AS cells FROM c GROUP BY 1, 2")
def q26(t):
    c = contigs(t).groupBy("user_id", "day").agg(F.count_distinct(F.when(F.col("productive"), F.col("chain"))).alias("n"), F.bool_or(~F.col("productive")).alias("bad"))
    return c.groupBy(F.when(F.col("bad"), "quarantine").when(F.col("n") >= 2, "confident").otherwise("provisional").alias("call"), F.col("n").alias("chains")).agg(F.count(F.lit(1)).alias("cells"))


@query("q27_receptor_breakout", f"WITH {CONTIGS} SELECT user_id, count(*) FILTER (chain IN ('TRA', 'TRB')) AS ab, count(*) FILTER (chain IN ('TRG', 'TRD')) AS gd, round(100.0 * count(*) FILTER (chain IN ('TRG', 'TRD')) / nullif(count(*), 0), 6) AS pct_gd, count(*) >= 20 AS reliable FROM contigs WHERE productive GROUP BY 1")
def q27(t):
    ab, gd = F.count_if(F.col("chain").isin("TRA", "TRB")), F.count_if(F.col("chain").isin("TRG", "TRD"))
    c = contigs(t).where("productive").groupBy("user_id").agg(ab.alias("ab"), gd.alias("gd"), F.count(F.lit(1)).alias("n"))
    return c.select("user_id", "ab", "gd", r6(S.ratio(F.col("gd"), F.col("n"), 100.0)).alias("pct_gd"), (F.col("n") >= 20).alias("reliable"))


@query("q28_elite_panel", f"WITH {CELLS}, {COO}, s AS (SELECT tissue, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT c.tissue, gene, sum(value) / any_value(n) AS v, count(DISTINCT cell) / any_value(n) AS frac FROM coo JOIN cells c USING (cell) JOIN s ON c.tissue = s.tissue GROUP BY 1, 2), e AS (SELECT * FROM m WHERE tissue = 'AFRICA') SELECT e.gene, round(any_value(e.v), 6) AS elite, round(any_value(e.frac), 6) AS fraction, count(*) FILTER (e.v > m.v) AS consistent FROM e JOIN m ON e.gene = m.gene AND m.tissue <> 'AFRICA' GROUP BY 1")
def q28(t):
    sizes = cells(t).groupBy("tissue").agg(F.count(F.lit(1)).alias("n"))
    m = coo(t).join(cells(t), "cell").join(sizes, "tissue").groupBy("tissue", "gene").agg((F.sum("value") / F.first("n")).alias("v"), (F.count_distinct("cell") / F.first("n")).alias("frac"))
    e = m.where("tissue = 'AFRICA'").select("gene", F.col("v").alias("elite"), F.col("frac").alias("fraction"))
    joined = e.join(m.where("tissue <> 'AFRICA'"), "gene")
    return joined.groupBy("gene").agg(r6(F.first("elite")).alias("elite"), r6(F.first("fraction")).alias("fraction"), F.count_if(F.col("elite") > F.col("v")).alias("consistent"))


@query("q29_guarded_write_back", "SELECT c_custkey AS cell, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('sub_', c_nationkey % 3) END AS sub, c_mktsegment <> 'BUILDING' AS outside FROM customer")
def q29(t):
    whole = t.customer.select(F.col("c_custkey").alias("cell"), (F.col("c_mktsegment") != "BUILDING").alias("outside"))
    part = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cell"), F.expr("concat('sub_', c_nationkey % 3)").alias("sub"))
    return R.write_back(whole, part, ["cell"], ["sub"]).withColumn("sub", F.when(F.col("outside") & F.col("sub").isNotNull(), F.raise_error("label outside its lineage")).otherwise(F.col("sub")))


@query("q30_gate_review", f"WITH {ALN}, v AS (SELECT count(*) FILTER (l_linenumber <= 3) AS old, count(*) FILTER (l_linenumber > 3) AS new, count(*) FILTER (l_linenumber <= 3 AND mapq >= 30) AS old_ok, count(*) FILTER (l_linenumber > 3 AND mapq >= 30) AS new_ok FROM aln) SELECT 'reads' AS gate, CASE WHEN new >= old THEN 'PASS' WHEN new >= 0.5 * old THEN 'CHECK' ELSE 'FAIL' END AS verdict FROM v UNION ALL SELECT 'quality', CASE WHEN new_ok / new >= old_ok / old THEN 'PASS' WHEN new_ok / new >= 0.9 * old_ok / old THEN 'CHECK' ELSE 'FAIL' END FROM v")
def q30(t):
    old, ok = F.col("l_linenumber") <= 3, F.col("mapq") >= 30
    v = alignments(t).agg(F.count_if(old).alias("old"), F.count_if(~old).alias("new"), F.count_if(old & ok).alias("old_ok"), F.count_if(~old & ok).alias("new_ok"))

    def verdict(name, now, was, slack):
        return F.struct(F.lit(name).alias("gate"), F.when(now >= was, "PASS").when(now >= slack * was, "CHECK").otherwise("FAIL").alias("verdict"))

    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return v.select(F.inline(F.array(verdict("reads", F.col("new"), F.col("old"), 0.5), verdict("quality", rate("new_ok", "new"), rate("old_ok", "old"), 0.9))))


@query("q31_recipe_drift", "WITH s AS (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS stored FROM events GROUP BY 1 UNION ALL SELECT 'types', CAST(count(DISTINCT event_type) AS VARCHAR) FROM events), w AS (SELECT event_type AS key, CAST(count(value) FILTER (value >= 1) AS VARCHAR) AS wanted FROM events GROUP BY 1 UNION ALL SELECT 'types', CAST(count(DISTINCT event_type) AS VARCHAR) FROM events) SELECT s.key, stored, wanted FROM s FULL JOIN w ON s.key = w.key WHERE stored IS DISTINCT FROM wanted")
def q31(t):
    """A recipe of counts by event type against that of the larger values alone: the keys
    on which they differ."""
    types = t.events.select(F.lit("types").alias("key"), "event_type").groupBy("key").agg(F.count_distinct("event_type").cast("string").alias("n"))
    counts = t.events.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("stored"), F.count_if(F.col("value") >= 1).cast("string").alias("wanted"))
    stored, wanted = counts.select("key", "stored").union(types), counts.select("key", "wanted").union(types)
    return stored.join(wanted, "key", "full").where(~F.col("stored").eqNullSafe(F.col("wanted")))


@query("q32_margin_decomposition", "WITH f AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1) SELECT CASE WHEN abs(a - r) < 0.02 * (a + r) THEN 'near tie' WHEN a > r THEN 'a wins' ELSE 'r wins' END AS call, count(*) AS n, round(avg(a - r), 6) AS mean_margin FROM f GROUP BY 1")
def q32(t):
    of = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0))
    f = t.lineitem.groupBy("l_suppkey").agg(of("A").alias("a"), of("R").alias("r"))
    a, r = F.col("a"), F.col("r")
    return f.groupBy(F.when(F.abs(a - r) < 0.02 * (a + r), "near tie").when(a > r, "a wins").otherwise("r wins").alias("call")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(a - r)).alias("mean_margin"))


@query("su1_cluster_fingerprint", f"WITH {CELLS}, o AS (SELECT animal, count(*) AS n FROM cells GROUP BY 1), e AS (SELECT animal, count(*) FILTER (balance > -900) AS n FROM cells GROUP BY 1) SELECT o.animal, o.n AS observed, e.n AS expected, abs(o.n - e.n) <= 2 AS ok FROM o JOIN e ON o.animal = e.animal")
def su1(t):
    c = cells(t)
    return A.fingerprint(c.groupBy("animal").count(), c.groupBy("animal").agg(F.count_if(F.col("balance") > -900).alias("count")), "animal", "count", 2)


@query("su2_replicate_support", f"WITH {CELLS}, n AS (SELECT tissue, animal, library, count(*) AS n FROM cells GROUP BY 1, 2, 3) SELECT tissue, animal, count(*) FILTER (n >= 2) AS replicates, count(*) FILTER (n >= 2) < 2 AS thin FROM n GROUP BY 1, 2")
def su2(t):
    return A.replicate_support(cells(t), ["tissue", "animal"], "library", 2)


@query("su3_analysis_ready", f"WITH {CELLS} SELECT cell, balance > 0 AND animal <> 'MACHINERY' AND NOT starts_with(library, 'NATION_1') AS ready FROM cells")
def su3(t):
    return cells(t).select("cell", ((F.col("balance") > 0) & (F.col("animal") != "MACHINERY") & ~F.col("library").startswith("NATION_1")).alias("ready"))


@query("su4_before_after", f"WITH {CELLS} SELECT library, count(*) FILTER (balance < 0) AS before, count(*) FILTER (balance < 1000) AS after, count(*) FILTER (balance < 1000) - count(*) FILTER (balance < 0) AS delta FROM cells GROUP BY 1")
def su4(t):
    c = cells(t).groupBy("library").agg(F.count_if(F.col("balance") < 0).alias("before"), F.count_if(F.col("balance") < 1000).alias("after"))
    return c.withColumn("delta", F.col("after") - F.col("before")).orderBy(F.desc("delta"), "library")


@query("su5_against_rest", f"WITH {CELLS}, m AS (SELECT tissue, library, avg(balance) AS v FROM cells GROUP BY 1, 2) SELECT tissue, library, round(v, 6) AS v, round((sum(v) OVER (PARTITION BY tissue) - v) / nullif(count(*) OVER (PARTITION BY tissue) - 1, 0), 6) AS rest FROM m")
def su5(t):
    m = cells(t).groupBy("tissue", "library").agg(F.avg("balance").alias("v"))
    return A.against_rest(m, "tissue", "library", "v").select("tissue", "library", r6("v").alias("v"), r6("rest").alias("rest"))


@query("su6_paired_units", "SELECT o_custkey, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2")
def su6(t):
    mean = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 6)
    g = t.orders.where("o_orderstatus IN ('F', 'O')").groupBy("o_custkey").agg(mean("F").alias("f"), mean("O").alias("o"), F.count_distinct("o_orderstatus").alias("n"))
    return g.where("n = 2").drop("n")


@query("su7_metadata_fallback", f"WITH {CELLS}, lib AS (SELECT library, min(animal) AS d FROM cells GROUP BY 1) SELECT cell, CASE WHEN balance >= 0 THEN animal ELSE d END AS animal, CASE WHEN balance >= 0 THEN 'object' ELSE 'library' END AS meta_source FROM cells JOIN lib USING (library)")
def su7(t):
    c = cells(t)
    own = c.where("balance >= 0").select("cell", F.col("animal").alias("v"))
    lib = c.groupBy("library").agg(F.min("animal").alias("d"))
    return R.ranked_lookup(c.select("cell", "library"), [("object", own, ["cell"], "v"), ("library", lib, ["library"], "d")], "animal", "meta_source", "none").drop("library")


@query("su9_panel_master", "SELECT p_brand AS panel, count(*) AS genes, count(*) FILTER (p_size <= 25) AS resolved, count(DISTINCT p_name) AS names, count(*) - count(DISTINCT p_name) AS repeated FROM part GROUP BY 1")
def su9(t):
    return t.part.groupBy(F.col("p_brand").alias("panel")).agg(F.count(F.lit(1)).alias("genes"), F.count_if(F.col("p_size") <= 25).alias("resolved"), F.count_distinct("p_name").alias("names"), (F.count(F.lit(1)) - F.count_distinct("p_name")).alias("repeated"))
