"""Aggregations, windows, sorts and set operations over the tables (AG, W, SO, ST, TM)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators import audit as A
from lacuna.operators import intervals as I
from lacuna.operators import matrix as M
from lacuna.operators import molecules as MO
from lacuna.operators import relational as R
from lacuna.operators import stats as ST
from lacuna.plans.basic import flag_scores, spans
from lacuna.plans.bindings import ALN, CELLS, COO, MOL, READS, SEQ, alignments, cells, coo, molecules, reads, sequences
from lacuna.plans.registry import query

W = Window


def part_gene(t, where="true"):
    return t.part.where(where).select(F.col("p_partkey").alias("gene"))


@query("ag1_value_counts", "SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1")
def ag1(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("ag2_value_shares", "SELECT o_orderpriority AS level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def ag2(t):
    return ag1(t).withColumn("pct", F.round(100 * ST.share("n", []), 6))


@query("ag3_named_aggregates", f"WITH {MOL} SELECT library, round(sum(value), 4) AS total, min(value) AS lowest, min_by(event_id, (ub, event_id)) AS first_event, count(DISTINCT cb) AS n_cb, max(value) AS highest FROM mol GROUP BY 1")
def ag3(t):
    return molecules(t).groupBy("library").agg(F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lowest"), F.min_by("event_id", F.struct("ub", "event_id")).alias("first_event"), F.count_distinct("cb").alias("n_cb"), F.max("value").alias("highest"))


@query("ag4_group_quantiles", "SELECT c_mktsegment AS g, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS med, round(quantile_cont(c_acctbal, 0.9), 6) AS q90, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1")
def ag4(t):
    b = "c_acctbal"
    return t.customer.groupBy(F.col("c_mktsegment").alias("g")).agg(F.round(F.avg(b), 6).alias("mean"), F.round(F.median(b), 6).alias("med"), F.round(F.percentile(b, F.lit(0.9)), 6).alias("q90"), F.round(F.stddev_samp(b), 6).alias("sd"))


@query("ag5_conditional_counts", "SELECT o_orderstatus AS g, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS rich, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 200000 AND o_orderpriority = '1-URGENT') AS both FROM orders GROUP BY 1")
def ag5(t):
    rich, urgent = F.col("o_totalprice") > 200000, F.col("o_orderpriority") == "1-URGENT"
    return t.orders.groupBy(F.col("o_orderstatus").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(rich).alias("rich"), F.count_if(urgent).alias("urgent"), F.count_if(rich & urgent).alias("both"))


@query("ag6_crosstab", f"WITH {CELLS} SELECT tissue, animal, count(*) AS n FROM cells GROUP BY 1, 2")
def ag6(t):
    return R.crosstab(cells(t), "tissue", "animal")


@query("ag7_crosstab_margins", f"WITH {CELLS} SELECT CASE WHEN grouping(tissue) = 1 THEN 'TOTAL' ELSE tissue END AS tissue, CASE WHEN grouping(animal) = 1 THEN 'TOTAL' ELSE animal END AS animal, count(*) AS n FROM cells GROUP BY CUBE (tissue, animal)")
def ag7(t):
    return R.crosstab(cells(t), "tissue", "animal", margins=True)


@query("ag8_crosstab_shares", f"WITH {CELLS} SELECT tissue, animal, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tissue), 6) AS share FROM cells GROUP BY 1, 2")
def ag8(t):
    return R.normalised(cells(t), "tissue", "animal", "tissue").withColumn("share", F.round("share", 6))


@query("ag9_composition_spread", f"WITH {CELLS}, x AS (SELECT tissue, animal, count(*) AS n FROM cells GROUP BY 1, 2) SELECT tissue, max(n) AS high, min(n) AS low, max(n) - min(n) AS spread, min_by(animal, (-n, animal)) AS high_in, min_by(animal, (n, animal)) AS low_in FROM x GROUP BY 1")
def ag9(t):
    return R.spread(R.crosstab(cells(t), "tissue", "animal"), "tissue", "animal", "n")


@query("ag10_distinct_counts", f"WITH {MOL} SELECT library, count(DISTINCT cb) AS cells, count(DISTINCT core) AS cores, count(DISTINCT CASE WHEN value > 50 THEN cb END) AS strong FROM mol GROUP BY 1")
def ag10(t):
    return molecules(t).groupBy("library").agg(F.count_distinct("cb").alias("cells"), F.count_distinct("core").alias("cores"), F.count_distinct(F.when(F.col("value") > 50, F.col("cb"))).alias("strong"))


@query("ag11_set_text", f"WITH {MOL} SELECT cb, coalesce(string_agg(DISTINCT library, ';' ORDER BY library) FILTER (value > 90), 'none') AS libraries FROM mol GROUP BY 1")
def ag11(t):
    return molecules(t).groupBy("cb").agg(R.set_text(F.when(F.col("value") > 90, F.col("library")), "none").alias("libraries"))


DOMINANT = "c AS (SELECT library, animal, count(*) AS n FROM cells GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY n DESC, animal) AS k, sum(n) OVER (PARTITION BY library) AS s FROM c)"


@query("ag12_mode_share", f"WITH {CELLS}, {DOMINANT} SELECT library, animal, n, round(n / s, 6) AS share FROM r WHERE k = 1")
def ag12(t):
    return R.dominant(cells(t), ["library"], "animal").withColumn("share", F.round("share", 6))


@query("ag13_purity", f"WITH {CELLS}, {DOMINANT} SELECT library, max(animal) FILTER (k = 1) AS dominant, round(max(n / s) FILTER (k = 1), 6) AS purity, max(animal) FILTER (k = 2) AS runner_up FROM r GROUP BY 1")
def ag13(t):
    first = R.dominant(cells(t), ["library"], "animal").select("library", F.col("animal").alias("dominant"), F.round("share", 6).alias("purity"))
    second = R.dominant(cells(t), ["library"], "animal", 2).select("library", F.col("animal").alias("runner_up"))
    return first.join(second, "library", "left")


@query("ag14_margin", "WITH f AS (SELECT l_suppkey, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, f) AS k FROM f) SELECT l_suppkey, concat('flag_', lower(max(f) FILTER (k = 1))) AS top, concat('flag_', lower(max(f) FILTER (k = 2))) AS runner_up, max(v) FILTER (k = 1) - max(v) FILTER (k = 2) AS margin FROM r GROUP BY 1")
def ag14(t):
    r = S.ranked_scores({n: F.col(n) for n in ("flag_a", "flag_n", "flag_r")})
    return flag_scores(t).withColumn("r", r).selectExpr("l_suppkey", "r[0].name AS top", "r[1].name AS runner_up", "r[0].score - r[1].score AS margin")


QC = f"""{COO}, q AS (SELECT cell, value, p_type = 'PROMO' AS flag, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS k FROM coo JOIN part ON gene = p_partkey),
 m AS (SELECT cell, sum(value) AS total, count(*) AS n_features, 100.0 * sum(CASE WHEN k <= 20 THEN value ELSE 0 END) / sum(value) AS pct_top, 100.0 * sum(CASE WHEN flag THEN value ELSE 0 END) / sum(value) AS pct_flagged FROM q GROUP BY 1)"""


def qc(t):
    return M.qc_metrics(coo(t), t.part.select(F.col("p_partkey").alias("gene"), (F.col("p_type") == "PROMO").alias("flag")))


@query("ag15_qc_metrics", f"WITH {QC} SELECT cell, total, n_features, round(ln(1 + total), 6) AS log1p_total, round(ln(1 + n_features), 6) AS log1p_n_features, round(pct_top, 6) AS pct_top, round(pct_flagged, 6) AS pct_flagged FROM m")
def ag15(t):
    r = lambda c: F.round(c, 6).alias(c)
    return qc(t).select("cell", "total", "n_features", r("log1p_total"), r("log1p_n_features"), r("pct_top"), r("pct_flagged"))


@query("ag16_panel_sum", f"WITH {COO}, p AS (SELECT cell, sum(value) AS v FROM coo JOIN part ON gene = p_partkey WHERE p_brand = 'Brand#1' GROUP BY 1) SELECT c_custkey AS cell, coalesce(v, 0.0) AS score FROM customer LEFT JOIN p ON c_custkey = cell")
def ag16(t):
    return M.panel_sum(coo(t), t.customer.select(F.col("c_custkey").alias("cell")), part_gene(t, "p_brand = 'Brand#1'"))


TYPED = f"{COO}, ty AS (SELECT cell, p_type AS type, sum(value) AS v, count(*) FILTER (value >= 30) AS support FROM coo JOIN part ON gene = p_partkey GROUP BY 1, 2), lab AS (SELECT * FROM ty QUALIFY row_number() OVER (PARTITION BY cell ORDER BY v DESC, type) = 1)"


def labels(t):
    """Each unit's type with the largest sum, and how many of its features support it."""
    by = coo(t).join(t.part, F.col("gene") == F.col("p_partkey")).groupBy("cell", F.col("p_type").alias("type")).agg(F.sum("value").alias("v"), F.count_if(F.col("value") >= 30).alias("support"))
    return R.best_per_key(by, ["cell"], [F.desc("v"), F.col("type")])


@query("ag17_marker_support", f"WITH {TYPED} SELECT type, count(*) AS cells, count(*) FILTER (support >= 3) AS pass, count(*) FILTER (support < 6) AS would_fail, median(support) AS med FROM lab GROUP BY 1")
def ag17(t):
    return labels(t).groupBy("type").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("support") >= 3).alias("pass"), F.count_if(F.col("support") < 6).alias("would_fail"), F.median("support").alias("med"))


@query("ag18_threshold_sweep", "SELECT o_orderstatus, CAST(th AS DOUBLE) AS threshold, count(*) AS of, count(*) FILTER (o_totalprice >= th) AS n FROM orders, (VALUES (1000), (50000), (100000), (250000)) v(th) GROUP BY 1, 2")
def ag18(t):
    return R.threshold_sweep(t.orders, "o_totalprice", [1000, 50000, 100000, 250000], ["o_orderstatus"])


@query("ag19_consistency", f"WITH {CELLS}, {COO}, m AS (SELECT tissue, gene, sum(value) AS v FROM coo JOIN cells USING (cell) GROUP BY 1, 2), e AS (SELECT gene, v FROM m WHERE tissue = 'ASIA') SELECT e.gene, count(*) FILTER (e.v > m.v) AS consistent, count(*) AS comparators FROM e JOIN m ON e.gene = m.gene AND m.tissue <> 'ASIA' GROUP BY 1")
def ag19(t):
    m = coo(t).join(cells(t), "cell").groupBy("tissue", "gene").agg(F.sum("value").alias("v"))
    elite = m.where("tissue = 'ASIA'").select("gene", F.col("v").alias("ev"))
    return elite.join(m.where("tissue <> 'ASIA'"), "gene").groupBy("gene").agg(F.count_if(F.col("ev") > F.col("v")).alias("consistent"), F.count(F.lit(1)).alias("comparators"))


@query("ag20_fraction_expressing", f"WITH {CELLS}, {COO}, n AS (SELECT tissue, count(*) AS n_cells FROM cells GROUP BY 1) SELECT c.tissue, gene, count(DISTINCT cell) AS n_expressing, max(n_cells) AS n_cells, round(count(DISTINCT cell) / max(n_cells), 6) AS fraction FROM coo JOIN cells c USING (cell) JOIN n ON c.tissue = n.tissue WHERE value > 0 GROUP BY 1, 2")
def ag20(t):
    return M.fraction_expressing(coo(t), cells(t), "tissue", single=True).withColumn("fraction", F.round("fraction", 6))


@query("ag21_pseudobulk", f"WITH {CELLS}, {COO}, k AS (SELECT library FROM cells GROUP BY 1 HAVING count(*) >= 5) SELECT library, gene, sum(value) AS value FROM coo JOIN cells USING (cell) WHERE library IN (SELECT library FROM k) GROUP BY 1, 2")
def ag21(t):
    return M.pseudobulk(coo(t), cells(t), "library", 5)


@query("ag22_histogram", "SELECT CAST(floor(l_extendedprice / 5000) * 5000 AS BIGINT) AS lo, count(*) AS n, count(*) = max(count(*)) OVER () AS modal FROM lineitem GROUP BY 1")
def ag22(t):
    bins = t.lineitem.groupBy((F.floor(F.col("l_extendedprice") / 5000) * 5000).alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    top = bins.agg(F.max("n").alias("most"))
    return bins.join(F.broadcast(top)).select("lo", "n", (F.col("n") == F.col("most")).alias("modal"))


@query("ag23_base_composition", f"WITH {READS} SELECT p AS position, count(*) FILTER (substr(seq, p, 1) = 'A') AS a, count(*) FILTER (substr(seq, p, 1) = 'C') AS c, count(*) FILTER (substr(seq, p, 1) = 'G') AS g, count(*) FILTER (substr(seq, p, 1) = 'T') AS t FROM reads, range(1, 101) x(p) WHERE p <= length(seq) GROUP BY 1")
def ag23(t):
    each = reads(t).select(F.posexplode(Q.letters(F.col("seq"))).alias("p", "b"))
    return each.groupBy((F.col("p") + 1).cast("long").alias("position")).agg(*(F.count_if(F.col("b") == x).alias(x.lower()) for x in "ACGT"))


@query("ag24_coverage", """WITH d AS (SELECT p_brand, x AS pos, count(*) AS depth FROM part, range(0, 64) r(x) WHERE x >= p_size AND x < p_size + 5 GROUP BY 1, 2)
 SELECT p_brand, CAST(sum(depth) AS BIGINT) AS bases, count(*) AS covered, count(*) FILTER (depth = 1) AS single, count(*) FILTER (depth > 1) AS multi FROM d GROUP BY 1""")
def ag24(t):
    runs = I.depth(spans(t), ["p_brand"], "s", "e").withColumn("w", (F.col("hi") - F.col("lo")).cast("long"))
    of = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("w"))), F.lit(0))
    return runs.groupBy("p_brand").agg(F.sum(F.col("w") * F.col("depth")).alias("bases"), of("depth > 0").alias("covered"), of("depth = 1").alias("single"), of("depth > 1").alias("multi"))


@query("ag25_funnel", "SELECT 'all' AS stage, 0 AS turn, count(*) AS n FROM orders UNION ALL SELECT 'open', 1, count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'open_rich', 2, count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def ag25(t):
    o = t.orders.where("o_orderstatus = 'O'")
    return R.funnel([("all", t.orders), ("open", o), ("open_rich", o.where("o_totalprice > 100000"))])


@query("ag26_safe_ratios", "SELECT p_partkey, round(p_retailprice / nullif(p_size - 10, 0), 6) AS r, round(1e6 * p_size / sum(p_size) OVER (), 6) AS per_million FROM part")
def ag26(t):
    whole = t.part.agg(F.sum("p_size").alias("s"))
    return t.part.join(F.broadcast(whole)).select("p_partkey", F.round(S.ratio(F.col("p_retailprice"), F.col("p_size") - 10), 6).alias("r"), F.round(S.ratio(F.col("p_size"), F.col("s"), 1e6), 6).alias("per_million"))


@query("ag27_two_level", f"WITH {CELLS}, x AS (SELECT tissue, library, count(DISTINCT animal) AS k FROM cells GROUP BY 1, 2) SELECT tissue, count(*) AS libraries, count(*) FILTER (k = 5) AS complete, round(avg(k), 6) AS mean_k FROM x GROUP BY 1")
def ag27(t):
    x = cells(t).groupBy("tissue", "library").agg(F.count_distinct("animal").alias("k"))
    return x.groupBy("tissue").agg(F.count(F.lit(1)).alias("libraries"), F.count_if(F.col("k") == 5).alias("complete"), F.round(F.avg("k"), 6).alias("mean_k"))


@query("w1_share_of_parent", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def w1(t):
    return t.orders.select("o_orderkey", F.round(ST.share("o_totalprice", ["o_custkey"]), 6).alias("share"))


@query("w2_best_hit", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) = 1")
def w2(t):
    return R.best_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber")]).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("w3_top_n", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 3")
def w3(t):
    return R.best_per_key(t.part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3, "rank").select("p_brand", "p_partkey", "rank")


PVALUES = "p AS (SELECT p_partkey AS gene, p_brand AS g, CASE WHEN p_size = 50 THEN NULL ELSE p_partkey * 37 % 1009 / 1009.0 END AS pval FROM part)"


def pvalues(t):
    return t.part.selectExpr("p_partkey AS gene", "p_brand AS g", "CASE WHEN p_size = 50 THEN NULL ELSE p_partkey * 37 % 1009 / 1009.0D END AS pval")


@query("w4_bh_fdr", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY g, pval IS NULL ORDER BY pval, gene) AS k, count(*) OVER (PARTITION BY g, pval IS NULL) AS m FROM p) SELECT gene, CASE WHEN pval IS NOT NULL THEN round(least(1.0, min(pval * m / k) OVER (PARTITION BY g, pval IS NULL ORDER BY k DESC)), 9) END AS padj FROM r")
def w4(t):
    return ST.bh_fdr(pvalues(t), "pval", ["g"]).select("gene", F.round("padj", 9).alias("padj"))


@query("w5_bonferroni", f"WITH {PVALUES} SELECT gene, round(least(1.0, pval * count(pval) OVER (PARTITION BY g)), 9) AS padj FROM p")
def w5(t):
    return ST.bonferroni(pvalues(t), "pval", ["g"]).select("gene", F.round("padj", 9).alias("padj"))


@query("w6_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / (stddev_samp(c_acctbal) OVER w + 1e-9), 6) AS z1, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) AS z0 FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def w6(t):
    z = ST.zscore(ST.zscore(t.customer, "c_acctbal", ["c_mktsegment"], out="z1"), "c_acctbal", ["c_mktsegment"], ddof=0, out="z0")
    return z.select("c_custkey", F.round("z1", 6).alias("z1"), F.round("z0", 6).alias("z0"))


@query("w7_log2_enrichment", f"""WITH {CELLS}, c AS (SELECT tissue, animal, count(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY tissue) AS r, sum(n) OVER (PARTITION BY animal) AS k, sum(n) OVER () AS s FROM c)
 SELECT tissue, animal, round(greatest(-2, least(2, log2((n + 1) / (r * k / s + 1)))), 6) AS a, round(log2((n / r) / (k / s)), 6) AS b, round(least(2, (n / r) / (k / s)), 6) AS c FROM s""")
def w7(t):
    c = R.crosstab(cells(t), "tissue", "animal")
    total = c.agg(F.sum("n").alias("s"))
    c = c.join(F.broadcast(total)).withColumn("r", F.sum("n").over(W.partitionBy("tissue"))).withColumn("k", F.sum("n").over(W.partitionBy("animal")))
    n, r, k, s = (F.col(x) for x in ("n", "r", "k", "s"))
    return c.select("tissue", "animal", F.round(S.log2_enrichment(n, r * k / s), 6).alias("a"), F.round(S.log2_share(n / r, k / s), 6).alias("b"), F.round(S.fold_capped(n / r, k / s), 6).alias("c"))


@query("w8_longest_run", f"WITH {READS} SELECT doc_id, read_no, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), 0) AS INTEGER) AS run FROM reads")
def w8(t):
    return reads(t).select("doc_id", "read_no", Q.longest_run(F.col("seq"), "G").alias("run"))


@query("w9_first_record", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def w9(t):
    return R.best_per_key(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("w10_cluster_outliers", """WITH m AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), x AS (SELECT median(v) AS med FROM m), y AS (SELECT median(abs(v - med)) AS mad, any_value(med) AS med FROM m, x), z AS (SELECT stddev_pop(v) AS sd FROM m)
 SELECT k, round(v, 6) AS v, v > med + 2 * CASE WHEN mad > 0 THEN mad ELSE sd END AS high FROM m, y, z""")
def w10(t):
    m = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    out = ST.mad_outlier(m, "v", 2)
    return out.select("k", F.round("v", 6).alias("v"), (F.col("v") > F.col("med") + 2 * F.col("width")).alias("high"))


@query("so1_custom_order", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INTEGER) AS ord FROM orders")
def so1(t):
    order = t.spark.createDataFrame([("P", 0), ("F", 1), ("O", 2)], "o_orderstatus string, ord int")
    return t.orders.join(R.small(order), "o_orderstatus").select("o_orderkey", "ord").orderBy("ord", "o_orderkey")


@query("so2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def so2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("so3_drop_duplicates", f"WITH {MOL} SELECT library, coalesce(nullif(ub, '2024-01-01'), concat('none_', event_id)) AS k, min(event_id) AS event_id FROM mol GROUP BY 1, 2")
def so3(t):
    keyed = molecules(t).withColumn("k", F.coalesce(F.nullif("ub", F.lit("2024-01-01")), F.concat(F.lit("none_"), "event_id")))
    return R.best_per_key(keyed, ["library", "k"], [F.col("event_id")]).select("library", "k", "event_id")


@query("so4_molecule_collapse", f"WITH {MOL}, pair AS (SELECT library, cb, ub, core, count(*) AS mates, max(value) AS v FROM mol GROUP BY 1, 2, 3, 4) SELECT library, cb, ub, max_by(core, (mates, v, core)) AS core, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(mates) AS BIGINT) AS n_reads FROM pair GROUP BY 1, 2, 3")
def so4(t):
    return MO.collapse(molecules(t), ["library", "cb", "ub"], "core", "value")


@query("so5_mate_evidence", f"WITH {MOL} SELECT library, cb, CASE WHEN count(DISTINCT mate) = 2 THEN 'both' WHEN min(mate) = 1 THEN 'R1 only' ELSE 'R2 only' END AS evidence FROM mol GROUP BY 1, 2")
def so5(t):
    return molecules(t).groupBy("library", "cb").agg(MO.mate_evidence(F.col("mate")).alias("evidence"))


@query("so6_near_duplicates", f"WITH {CELLS}, c AS (SELECT library, count(*) FILTER (balance > 0) AS a, count(*) FILTER (balance <= 0) AS b FROM cells GROUP BY 1) SELECT x.library AS one, y.library AS two FROM c x JOIN c y ON x.library < y.library WHERE abs(x.a - y.a) < 0.1 * greatest(x.a, y.a) AND abs(x.b - y.b) <= 0.1 * greatest(x.b, y.b)")
def so6(t):
    c = cells(t).groupBy("library").agg(F.count_if(F.col("balance") > 0).alias("a"), F.count_if(F.col("balance") <= 0).alias("b"))
    close = F.expr("x.library < y.library AND abs(x.a - y.a) < 0.1D * greatest(x.a, y.a) AND abs(x.b - y.b) <= 0.1D * greatest(x.b, y.b)")
    return c.alias("x").join(c.alias("y"), close).selectExpr("x.library AS one", "y.library AS two")


@query("so7_identical_columns", "SELECT 'l_linenumber' AS a, 'copy' AS b, true AS identical UNION ALL SELECT 'l_quantity', 'same_sum', false")
def so7(t):
    """Columns equal in every row: an order-free fold names candidates, rows decide."""
    df = t.lineitem.selectExpr("l_linenumber", "l_linenumber AS copy", "l_quantity", "51 - l_quantity AS same_sum")
    return A.identical_columns(df, [("l_linenumber", "copy"), ("l_quantity", "same_sum")])


TWINS = {"l_quantity": "l_quantity", "other": "51 - l_quantity", "amount": "CAST(l_quantity AS DECIMAL(20, 2))", "rare": "CASE WHEN l_partkey % 7 = 0 THEN l_returnflag END", "rare_too": "CASE WHEN l_partkey % 7 <> 0 THEN NULL ELSE l_returnflag END", "rarer": "CASE WHEN l_partkey % 14 = 0 THEN l_returnflag END", "none": "CASE WHEN l_partkey < 0 THEN 1 END", "none_too": "CASE WHEN l_suppkey < 0 THEN 'x' END"}
ALIASES = [("^rare$", "^rare_", "a flag under two names")]


def _twin_sql() -> str:
    names = list(TWINS)
    pairs = [f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {i + k + 1} AS j FROM c HAVING bool_and(CAST({a} AS VARCHAR) IS NOT DISTINCT FROM CAST({b} AS VARCHAR) OR coalesce(try_cast({a} AS DOUBLE) = try_cast({b} AS DOUBLE), false))" for i, a in enumerate(names) for k, b in enumerate(names[i + 1 :])]
    columns = ", ".join(f"{v} AS {k}" for k, v in TWINS.items())
    return f"""WITH c AS (SELECT {columns} FROM lineitem), p AS ({" UNION ALL ".join(pairs)}), f AS (SELECT * FROM p WHERE a NOT IN (SELECT b FROM p)),
 g AS (SELECT a, concat(a, ' == ', string_agg(b, ' == ' ORDER BY b)) AS "group", CAST(count(*) + 1 AS INTEGER) AS n_columns FROM f GROUP BY 1)
 SELECT "group", n_columns, a = 'none' AS all_null, CASE WHEN a = 'rare' THEN 'expected alias' ELSE 'REVIEW' END AS verdict FROM g"""


@query("so7b_twin_columns", _twin_sql())
def so7b(t):
    """All columns that agree in every row, null patterns too, with a verdict."""
    df = t.lineitem.selectExpr("l_orderkey", "l_linenumber", *(f"{v} AS {k}" for k, v in TWINS.items()))
    return A.twin_verdicts(A.twin_columns(df, ["l_orderkey", "l_linenumber"]), ALIASES, "^ADT_").drop("reason")


@query("so8_column_census", "SELECT 'c_mktsegment' AS name, count(*) - count(c_mktsegment) AS missing, count(*) FILTER (lower(trim(c_mktsegment)) IN ('', 'unknown', 'na', 'n/a', 'nan', 'none', 'null', 'unassigned')) AS placeholder, count(DISTINCT c_mktsegment) AS levels, count(DISTINCT c_mktsegment) <= 1 AS constant FROM customer UNION ALL SELECT 'c_name', count(*) - count(c_name), 0, count(DISTINCT c_name), count(DISTINCT c_name) <= 1 FROM customer")
def so8(t):
    return A.census(t.customer.select("c_mktsegment", "c_name"))


@query("so9_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def so9(t):
    return A.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("so10_duplicate_payloads", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def so10(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("st1_union_all", "SELECT c_custkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def st1(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.lit("c").alias("kind")).unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k")))


@query("st2_partition_sets", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT p_partkey AS k FROM part WHERE p_size > 25) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'b only' WHEN b.k IS NULL THEN 'a only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def st2(t):
    return R.compare_keys(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), t.part.where("p_size > 25").select(F.col("p_partkey").alias("k")), ["k"])


@query("st3_private_elements", "SELECT l_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1 UNION ALL SELECT c_custkey + 1000000000, min(c_nationkey) FROM customer GROUP BY 1")
def st3(t):
    a = R.private_to(t.lineitem, "l_partkey", "l_suppkey")
    return a.union(R.private_to(t.customer.select((F.col("c_custkey") + 1000000000).alias("l_partkey"), "c_nationkey"), "l_partkey", "c_nationkey"))


@query("st4_in_both", "SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def st4(t):
    of = lambda s: t.lineitem.where(F.col("l_suppkey") == s).select("l_partkey")
    return of(1).intersect(of(2))


@query("st5_completeness", "SELECT 'missing' AS side, 'nope' AS name UNION ALL SELECT 'extra', 'c_nationkey' UNION ALL SELECT 'extra', 'c_name'")
def st5(t):
    have, want = F.array(*map(F.lit, sorted(t.customer.columns))), F.array(*map(F.lit, ("c_custkey", "c_acctbal", "c_mktsegment", "nope")))
    one = t.spark.range(1)
    return one.select(F.lit("missing").alias("side"), F.explode(F.array_except(want, have)).alias("name")).union(one.select(F.lit("extra"), F.explode(F.array_except(have, want))))


@query("st6_conservation", "SELECT (SELECT sum(l_quantity) FROM lineitem) AS before, (SELECT sum(l_quantity) FROM lineitem) AS after, true AS conserved")
def st6(t):
    after = coo(t).agg(F.sum("value").alias("after"))
    return t.lineitem.agg(F.sum("l_quantity").alias("before")).join(after).withColumn("conserved", F.col("before") == F.col("after"))


@query("tm1_persistence", f"WITH {MOL}, w AS (SELECT cb, core, CAST(ub[9:10] AS INTEGER) // 8 AS tp, value > 50 AS strong FROM mol) SELECT cb, core, count(DISTINCT tp) FILTER (strong) AS timepoints, 'strong' AS evidence FROM w WHERE strong GROUP BY 1, 2 HAVING count(DISTINCT tp) > 1 UNION ALL SELECT cb, core, count(DISTINCT tp), 'weak' FROM w WHERE (cb, core) NOT IN (SELECT (cb, core) FROM w WHERE strong GROUP BY cb, core HAVING count(DISTINCT tp) > 1) GROUP BY 1, 2 HAVING count(DISTINCT tp) > 1")
def tm1(t):
    seen = molecules(t).select("cb", "core", F.expr("CAST(substring(ub, 9, 2) AS INT) div 8").alias("tp"), (F.col("value") > 50).alias("strong"))
    return MO.persistence(seen, ["cb", "core"], "tp", "strong")


@query("tm2_trajectory", "SELECT c_mktsegment AS animal, year(o_orderdate) AS tp, count(*) AS n, count(*) - lag(count(*)) OVER (PARTITION BY c_mktsegment ORDER BY year(o_orderdate)) AS change FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def tm2(t):
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("animal"), F.year("o_orderdate").cast("long").alias("tp")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(W.partitionBy("animal").orderBy("tp")))
