"""Statistics and matrix operators over the tables (M, MX)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import graph as G
from lacuna.operators import matrix as M
from lacuna.operators import molecules as MO
from lacuna.operators import receptors as RC
from lacuna.operators import relational as R
from lacuna.operators import stats as ST
from lacuna.plans.aggregates import QC, TYPED, labels, part_gene, qc
from lacuna.plans.bindings import CELLS, CONTIGS, COO, MOL, READS, cells, contigs, coo, molecules, reads
from lacuna.plans.registry import query

W = Window
r6 = lambda c: F.round(c, 6)


@query("m1_mad_outlier", f"WITH {QC}, v AS (SELECT cell, ln(1 + total) AS x FROM m), a AS (SELECT median(x) AS med, stddev_samp(x) AS sd FROM v), b AS (SELECT median(abs(x - med)) AS mad, any_value(med) AS med, any_value(sd) AS sd FROM v, a) SELECT cell, round(med, 6) AS med, round(mad, 6) AS mad, CASE WHEN mad > 0 THEN mad ELSE sd END > 0 AND abs(x - med) > 3 * CASE WHEN mad > 0 THEN mad ELSE sd END AS outlier FROM v, b")
def m1(t):
    return ST.mad_outlier(qc(t).select("cell", "log1p_total"), "log1p_total", 3).select("cell", r6("med").alias("med"), r6("mad").alias("mad"), "outlier")


@query("m2_normalise", f"WITH {COO} SELECT cell, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell) * 10000), 6) AS lognorm FROM coo")
def m2(t):
    return M.normalise(coo(t)).select("cell", "gene", r6("lognorm").alias("lognorm"))


@query("m3_log_cpm", f"WITH {CELLS}, {COO}, b AS (SELECT tissue, gene, sum(value) AS value FROM coo JOIN cells USING (cell) GROUP BY 1, 2) SELECT tissue, gene, round(log2(value / sum(value) OVER (PARTITION BY tissue) * 1e6 + 1), 6) AS logcpm FROM b")
def m3(t):
    return M.log_cpm(M.pseudobulk(coo(t), cells(t), "tissue", 1), ["tissue"]).select("tissue", "gene", r6("logcpm").alias("logcpm"))


TAGS = [f + s for f in "ANR" for s in "FO"]
TAG_SUMS = ", ".join(f"sum(CASE WHEN l_returnflag = '{x[0]}' AND l_linestatus = '{x[1]}' THEN l_quantity ELSE 0 END) AS t{k}" for k, x in enumerate(TAGS))


@query("m4_clr", f"WITH p AS (SELECT o_custkey AS cell, {TAG_SUMS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), l AS (SELECT cell, list_transform([{', '.join(f't{k}' for k in range(6))}], lambda x: ln(1 + x)) AS l FROM p) SELECT cell, unnest(range(0, 6)) AS tag, round(unnest(list_transform(l, lambda x: x - list_sum(l) / 6)), 6) AS clr FROM l")
def m4(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = [F.sum(F.when((F.col("l_returnflag") == x[0]) & (F.col("l_linestatus") == x[1]), F.col("l_quantity")).otherwise(0.0)) for x in TAGS]
    dense = joined.groupBy(F.col("o_custkey").alias("cell")).agg(F.array(*sums).alias("v"))
    return dense.select("cell", F.posexplode(S.clr(F.col("v"))).alias("tag", "clr")).select("cell", F.col("tag").cast("long").alias("tag"), r6("clr").alias("clr"))


@query("m5_log_transforms", "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS l1, round(log2(p_retailprice), 6) AS l2, round(-log10(greatest(p_size / 1000.0, 1e-300)), 6) AS nl, abs(p_size - 25) AS a, least(greatest(p_size, 10), 40) AS clipped FROM part")
def m5(t):
    x = F.col("p_retailprice")
    return t.part.select("p_partkey", r6(F.log1p(x)).alias("l1"), r6(F.log2(x)).alias("l2"), r6(S.minus_log10(F.col("p_size") / 1000.0)).alias("nl"), F.abs(F.col("p_size") - 25).alias("a"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"))


BRANDS = """ora AS (SELECT p_brand AS term, count(DISTINCT p_partkey) AS n, count(DISTINCT p_partkey) FILTER (p_partkey IN (SELECT gene FROM up)) AS k FROM part WHERE p_partkey IN (SELECT gene FROM bg) GROUP BY 1),
 z AS (SELECT term, n, k, (SELECT count(*) FROM bg) AS m, (SELECT count(*) FROM up WHERE gene IN (SELECT gene FROM bg)) AS q FROM ora)"""
UPDOWN = """bg AS (SELECT l_partkey AS gene FROM lineitem GROUP BY 1 HAVING count(*) >= 5), f AS (SELECT l_partkey AS gene, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a FROM lineitem GROUP BY 1),
 up AS (SELECT gene FROM f WHERE log2((r + 1) / (a + 1)) > 0.25)"""


def ora_counts(t):
    """Set sizes and overlaps, everything cut to the background first."""
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0))
    f = t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg(flag("R").alias("r"), flag("A").alias("a"), F.count(F.lit(1)).alias("seen"))
    bg = f.where("seen >= 5").withColumn("up", F.log2((F.col("r") + 1) / (F.col("a") + 1)) > 0.25)
    sizes = bg.agg(F.count(F.lit(1)).alias("m"), F.count_if("up").alias("q"))
    sets = t.part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene")).distinct().join(bg, "gene")
    return sets.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("k")).join(F.broadcast(sizes))


@query("m6_fold_enrichment", f"WITH {UPDOWN}, {BRANDS} SELECT term, k, n, round(k / nullif(q, 0), 6) AS gene_ratio, round(n / m, 6) AS bg_ratio, round((k / nullif(q, 0)) / (n / m), 6) AS fold FROM z")
def m6(t):
    k, q, n, m = (F.col(c).cast("double") for c in ("k", "q", "n", "m"))
    return ora_counts(t).select("term", "k", "n", r6(F.try_divide(k, q)).alias("gene_ratio"), r6(n / m).alias("bg_ratio"), r6(F.try_divide(F.try_divide(k, q), n / m)).alias("fold"))


HYPER = "least(1.0, list_sum(list_transform(range(greatest(k, 0, q + n - m), least(n, q) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(m - n + 1) - lgamma(q - i + 1) - lgamma(m - n - q + i + 1) - lgamma(m + 1) + lgamma(q + 1) + lgamma(m - q + 1)))))"


@query("m7_hypergeometric", f"WITH {UPDOWN}, {BRANDS} SELECT term, k, n, m, q, round({HYPER}, 7) AS p FROM z")
def m7(t):
    z = ora_counts(t)
    return z.select("term", "k", "n", "m", "q", F.round(S.hypergeom_tail(F.col("k"), F.col("m"), F.col("n"), F.col("q")), 7).alias("p"))


@query("m8_binomial", f"WITH {CELLS}, c AS (SELECT library, count(*) AS n, count(*) FILTER (balance < 0) AS k FROM cells GROUP BY 1), x AS (SELECT round(100.0 * count(*) FILTER (balance < 0) / count(*), 1) / 100 AS p FROM cells) SELECT library, n, k, round(CASE WHEN k = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))) END, 7) AS pval FROM c, x")
def m8(t):
    c = cells(t)
    p = c.agg((F.round(100.0 * F.count_if(F.col("balance") < 0) / F.count(F.lit(1)), 1) / 100).alias("p"))
    per = c.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("balance") < 0).alias("k")).join(F.broadcast(p))
    return per.select("library", "n", "k", F.round(S.binom_tail(F.col("k"), F.col("n"), F.col("p")), 7).alias("pval"))


CHI = f"WITH {CELLS}, c AS (SELECT tissue, animal, count(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY tissue) * sum(n) OVER (PARTITION BY animal) / sum(n) OVER () AS e FROM c)"


def chi_square(t):
    c = R.crosstab(cells(t), "tissue", "animal")
    total = c.agg(F.sum("n").alias("s"))
    e = F.sum("n").over(W.partitionBy("tissue")) * F.sum("n").over(W.partitionBy("animal")) / F.col("s")
    s = c.join(F.broadcast(total)).withColumn("e", e).where("e >= 1")
    d = F.col("n") - F.col("e")
    return s.groupBy("tissue").agg(F.sum(d * d / F.col("e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


@query("m9_chi_square", f"{CHI} SELECT tissue, round(sum((n - e) * (n - e) / e), 6) AS chi2, count(*) - 1 AS df FROM s WHERE e >= 1 GROUP BY 1")
def m9(t):
    return chi_square(t).withColumn("chi2", r6("chi2"))


# SQL has no incomplete gamma and beta: both are written as their series.
def gamma_tail_sql(a: str, x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 600), lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1)))) END"


def t_tail_sql(t: str, df: str) -> str:
    def series(p: str, q: str, y: str) -> str:
        return f"list_sum(list_transform(range(0, 600), lambda k: exp(lgamma({p} + {q} + k) - lgamma({q}) - lgamma({p} + k + 1) + ({p} + k) * ln({y}) + {q} * ln(1 - {y}))))"

    y, rest = f"({t} * {t} / ({df} + {t} * {t}))", f"({df} / ({df} + {t} * {t}))"
    return f"CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {t} = 0 THEN 1 WHEN {y} < 0.5 THEN 1 - {series('0.5', f'({df} / 2)', y)} ELSE {series(f'({df} / 2)', '0.5', rest)} END"


@query("m9_chi_square_p", f"{CHI}, x AS (SELECT tissue, sum((n - e) * (n - e) / e) AS chi2, CAST(count(*) - 1 AS DOUBLE) AS df FROM s WHERE e >= 1 GROUP BY 1) SELECT tissue, round(chi2, 6) AS chi2, round({gamma_tail_sql('(df / 2)', '(chi2 / 2)')}, 9) AS p FROM x")
def m9p(t):
    """The p-value of the statistic."""
    c = chi_square(t)
    return c.select("tissue", r6("chi2").alias("chi2"), F.round(ST.chi2_upper(F.col("chi2"), F.col("df").cast("double")), 9).alias("p"))


def two_arms(t):
    """(cell, gene, value, tissue, library) of the cells of two regions, saved: for queries that read them twice."""
    of = cells(t).where("tissue IN ('ASIA', 'EUROPE')").select("cell", "tissue", "library")
    return G.saved(coo(t, of).join(of, "cell"))


def bulk(t, rows=None):
    """logCPM by (segment, gene) in two arms, the nations of two regions as replicates (of
    ``rows`` of ``two_arms``, if they are made)."""
    rep = F.concat_ws("/", "tissue", "library")
    if rows is None:
        sums = M.pseudobulk(coo(t), cells(t).where("tissue IN ('ASIA', 'EUROPE')").withColumn("rep", rep), "rep", 1)
    else:
        sums = rows.groupBy(rep.alias("rep"), "gene").agg(F.sum("value").alias("value"))
    b = M.log_cpm(sums, ["rep"])
    return b.select(F.substring_index("rep", "/", 1).alias("arm"), "rep", "gene", "logcpm")


def welch_parts(t, rows=None):
    b = bulk(t, rows)
    s = b.groupBy("gene", "arm").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("logcpm").alias("m"), F.var_samp("logcpm").alias("v"))
    side = lambda arm, x: s.where(F.col("arm") == arm).select("gene", *(F.col(c).alias(x + c) for c in "nmv"))
    both = side("ASIA", "a").join(side("EUROPE", "b"), "gene").where("an > 1 AND bn > 1")
    tt, df = ST.welch(*(F.col(c) for c in ("an", "am", "av", "bn", "bm", "bv")))
    return both.select("gene", (F.col("am") - F.col("bm")).alias("log2fc"), tt.alias("t"), df.alias("df"))


@query("m10_welch", f"""WITH {CELLS}, {COO}, b AS (SELECT tissue, library, gene, sum(value) AS v FROM coo JOIN cells USING (cell) WHERE tissue IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3), l AS (SELECT *, log2(v / sum(v) OVER (PARTITION BY library) * 1e6 + 1) AS x FROM b),
 s AS (SELECT gene, tissue, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY 1, 2)
 SELECT a.gene, round(a.m - b.m, 6) AS log2fc, round((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / nullif(pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1), 0), 6) AS df FROM s a JOIN s b ON a.gene = b.gene AND a.tissue = 'ASIA' AND b.tissue = 'EUROPE' WHERE a.n > 1 AND b.n > 1""")
def m10(t):
    return welch_parts(t).select("gene", r6("log2fc").alias("log2fc"), r6("t").alias("t"), r6("df").alias("df"))


@query("m10_paired", f"""WITH {CELLS}, {COO}, b AS (SELECT tissue, animal, gene, sum(value) AS v FROM coo JOIN cells USING (cell) WHERE tissue IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3), l AS (SELECT *, log2(v / sum(v) OVER (PARTITION BY tissue, animal) * 1e6 + 1) AS x FROM b),
 n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT animal FROM b GROUP BY 1 HAVING count(DISTINCT tissue) = 2)), d AS (SELECT gene, animal, coalesce(sum(x) FILTER (tissue = 'ASIA'), 0) - coalesce(sum(x) FILTER (tissue = 'EUROPE'), 0) AS d FROM l GROUP BY 1, 2),
 s AS (SELECT gene, sum(d) AS s, sum(d * d) AS ss FROM d GROUP BY 1), v AS (SELECT gene, s / n AS m, n, (ss - s * s / n) / (n - 1) AS v FROM s, n)
 SELECT gene, round(m, 6) AS log2fc, round(m / sqrt(CASE WHEN v > 1e-12 THEN v END / n), 5) AS t, n - 1 AS df FROM v""")
def m10_paired(t):
    """The units of both arms are the same (segments), so their differences are tested."""
    named = cells(t).where("tissue IN ('ASIA', 'EUROPE')").withColumn("rep", F.concat_ws("/", "tissue", "animal"))
    b = M.log_cpm(M.pseudobulk(coo(t), named, "rep", 1), ["rep"])
    rows = b.select(F.substring_index("rep", "/", 1).alias("arm"), F.substring_index("rep", "/", -1).alias("unit"), "gene", "logcpm")
    units = rows.groupBy("unit").agg(F.count_distinct("arm").alias("arms")).where("arms = 2").count()
    got = ST.paired(rows, ["gene"], "unit", "arm", "logcpm", "ASIA", "EUROPE", units)
    return got.select("gene", r6("log2fc").alias("log2fc"), F.round("t", 5).alias("t"), "df")


WELCH = f"""WITH {CELLS}, {COO}, b AS (SELECT tissue, library, gene, sum(value) AS v FROM coo JOIN cells USING (cell) WHERE tissue IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3), l AS (SELECT *, log2(v / sum(v) OVER (PARTITION BY library) * 1e6 + 1) AS x FROM b),
 gs AS (SELECT gene, tissue, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY 1, 2),
 w AS (SELECT a.gene, a.m - b.m AS log2fc, (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) AS t, pow(a.v / a.n + b.v / b.n, 2) / nullif(pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1), 0) AS df FROM gs a JOIN gs b ON a.gene = b.gene AND a.tissue = 'ASIA' AND b.tissue = 'EUROPE' WHERE a.n > 1 AND b.n > 1),
 wp AS (SELECT *, {t_tail_sql('t', 'df')} AS pval FROM w),
 wk AS (SELECT *, row_number() OVER (ORDER BY pval, gene) AS i, count(*) OVER () AS n FROM wp WHERE pval IS NOT NULL),
 welched AS (SELECT wp.gene, wp.log2fc, wp.pval, padj FROM wp LEFT JOIN (SELECT gene, least(1.0, min(pval * n / i) OVER (ORDER BY i DESC)) AS padj FROM wk) k ON k.gene = wp.gene)"""


@query("m10_welch_p", f"{WELCH} SELECT gene, round(log2fc, 6) AS log2fc, round(pval, 9) AS pval, round(padj, 9) AS padj FROM welched")
def m10p(t):
    """With two-sided p and BH."""
    w = welch_parts(t).withColumn("pval", ST.t_two_sided(F.col("t"), F.col("df")))
    return ST.bh_fdr(w, "pval").select("gene", r6("log2fc").alias("log2fc"), F.round("pval", 9).alias("pval"), F.round("padj", 9).alias("padj"))


def arms(t):
    return coo(t).join(cells(t).where("tissue IN ('ASIA', 'EUROPE')").select("cell", F.when(F.col("tissue") == "ASIA", "a").otherwise("b").alias("g")), "cell")


def rank_sums(t, rows=None):
    n = cells(t).agg(F.count_if(F.col("tissue") == "ASIA").alias("na"), F.count_if(F.col("tissue") == "EUROPE").alias("nb"))
    n = n.first()
    each = arms(t) if rows is None else rows.withColumn("g", F.when(F.col("tissue") == "ASIA", "a").otherwise("b"))
    return ST.rank_sum(each, ["gene"], "value", "g", {"a": F.lit(n.na), "b": F.lit(n.nb)})


RANKS = f"""{CELLS}, {COO}, u AS (SELECT cell, tissue FROM cells WHERE tissue IN ('ASIA', 'EUROPE')), g AS (SELECT DISTINCT gene FROM coo JOIN u USING (cell)),
 d AS (SELECT g.gene, u.tissue, coalesce(value, 0) AS v FROM g CROSS JOIN u LEFT JOIN coo ON coo.cell = u.cell AND coo.gene = g.gene),
 r AS (SELECT gene, tissue, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk FROM d),
 s AS (SELECT gene, sum(rk) FILTER (tissue = 'ASIA') AS ra, count(*) FILTER (tissue = 'ASIA') AS na, count(*) FILTER (tissue = 'EUROPE') AS nb, avg(v) FILTER (tissue = 'ASIA') AS ma, avg(v) FILTER (tissue = 'EUROPE') AS mb FROM r GROUP BY 1)"""


@query("m11_rank_sum", f"""WITH {RANKS}
 SELECT gene, round(log2((exp(ma) - 1 + 1e-9) / (exp(mb) - 1 + 1e-9)), 5) AS log2fc, round(ra - na * (na + 1) / 2.0, 6) AS u, round((ra - na * (na + 1) / 2.0 - na * nb / 2.0) / sqrt(na * nb * (na + nb + 1) / 12.0), 6) AS z FROM s""")
def m11(t):
    return rank_sums(t).select("gene", F.round("log2fc", 5).alias("log2fc"), r6("u").alias("u"), r6("z").alias("z"))


@query("m11_rank_sum_p")
def m11p(t):
    """With two-sided p and BH; SQL has no error function."""
    w = rank_sums(t).withColumn("pval", ST.normal_two_sided(F.col("z")))
    return ST.bh_fdr(w, "pval").select("gene", r6("z").alias("z"), F.round("pval", 9).alias("pval"), F.round("padj", 9).alias("padj"))


@query("m12_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS q_p, round(corr(l_quantity, l_discount), 6) AS q_d, round(corr(l_quantity, l_tax), 6) AS q_t, round(corr(l_extendedprice, l_discount), 6) AS p_d FROM lineitem")
def m12(t):
    c = lambda a, b: F.round(F.corr(a, b), 6)
    return t.lineitem.agg(c("l_quantity", "l_extendedprice").alias("q_p"), c("l_quantity", "l_discount").alias("q_d"), c("l_quantity", "l_tax").alias("q_t"), c("l_extendedprice", "l_discount").alias("p_d"))


OVERLAP = "e AS (SELECT DISTINCT c_nationkey AS s, o_orderdate AS i FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT s, count(*) AS n FROM e GROUP BY 1), x AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM e a JOIN e b ON a.i = b.i AND a.s < b.s GROUP BY 1, 2), y AS (SELECT x.*, p.n AS n_a, q.n AS n_b FROM x JOIN n p ON a = p.s JOIN n q ON b = q.s)"


def overlaps(t):
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return G.set_overlaps(e, "c_nationkey", "o_orderdate")


@query("m13_jaccard_edges", f"WITH {OVERLAP} SELECT a, b, shared, round(shared / (n_a + n_b - shared), 6) AS jaccard FROM y WHERE shared / (n_a + n_b - shared) >= 0.02")
def m13(t):
    return overlaps(t).where("jaccard >= 0.02").select("a", "b", "shared", r6("jaccard").alias("jaccard"))


@query("m14_panel_overlap", f"WITH {OVERLAP} SELECT a, b, shared, round(shared / least(n_a, n_b), 6) AS overlap FROM y")
def m14(t):
    return overlaps(t).select("a", "b", "shared", r6("overlap").alias("overlap"))


@query("m15_observed_expected", f"WITH {CELLS}, c AS (SELECT library, count(*) AS n, count(*) FILTER (balance < 0) AS k FROM cells GROUP BY 1) SELECT library, k, round(n * sum(k) OVER () / sum(n) OVER (), 6) AS expected, round(k / nullif(n * sum(k) OVER () / sum(n) OVER (), 0), 6) AS fold FROM c")
def m15(t):
    c = cells(t).groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("balance") < 0).alias("k"))
    s = c.agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"))
    c = c.join(F.broadcast(s)).withColumn("e", F.col("n") * F.col("sk") / F.col("sn"))
    return c.select("library", "k", r6("e").alias("expected"), r6(S.ratio(F.col("k"), F.col("e"))).alias("fold"))


@query("m16_background_ceiling", f"WITH {MOL}, c AS (SELECT max(value) FILTER (library = 'error') + 1 AS ceiling FROM mol) SELECT event_id, CASE WHEN value > ceiling AND mate = 1 THEN 'high' WHEN value > ceiling OR mate = 1 THEN 'possible' ELSE 'none' END AS grade FROM mol, c WHERE library <> 'error'")
def m16(t):
    m = molecules(t)
    ceiling = m.where("library = 'error'").agg((F.max("value") + 1).alias("ceiling"))
    over, first = F.col("value") > F.col("ceiling"), F.col("mate") == 1
    return m.where("library <> 'error'").join(F.broadcast(ceiling)).select("event_id", F.when(over & first, "high").when(over | first, "possible").otherwise("none").alias("grade"))


@query("m17_false_positive_rate", f"WITH {MOL}, c AS (SELECT core, count(*) FILTER (library = 'error') AS neg, count(*) FILTER (library <> 'error') AS inf FROM mol GROUP BY 1) SELECT core, neg, inf, round(neg / nullif(inf, 0), 6) AS fp_rate, CASE WHEN inf > 3 * neg THEN 'signal' WHEN inf > neg THEN 'weak' ELSE 'floor' END AS verdict FROM c")
def m17(t):
    c = molecules(t).groupBy("core").agg(F.count_if(F.col("library") == "error").alias("neg"), F.count_if(F.col("library") != "error").alias("inf"))
    return c.withColumn("fp_rate", r6(S.ratio(F.col("neg"), F.col("inf")))).withColumn("verdict", F.when(F.col("inf") > 3 * F.col("neg"), "signal").when(F.col("inf") > F.col("neg"), "weak").otherwise("floor"))


@query("m18_expected_yield", f"WITH {READS} SELECT length(seq) AS read_length, count(*) AS reads, greatest(0, length(seq) - 34 + 1) AS starts, round(count(*) * greatest(0, length(seq) - 34 + 1) / (CAST(9000 AS DOUBLE) - length(seq) + 1), 6) AS expected FROM reads GROUP BY 1")
def m18(t):
    """Reads by length, and how many of each are expected to hold a window of 34 letters."""
    n = F.col("read_length")
    starts = F.greatest(F.lit(0).cast("long"), n - 33)
    by_length = reads(t).groupBy(F.length("seq").cast("long").alias("read_length")).agg(F.count(F.lit(1)).alias("reads"))
    return by_length.select("read_length", "reads", starts.alias("starts"), r6(F.col("reads") * starts / (F.lit(9000.0) - n + 1)).alias("expected"))


@query("mx1_filter_matrix", f"WITH {COO}, c AS (SELECT cell FROM coo WHERE value > 0 GROUP BY 1 HAVING count(*) >= 30), k AS (SELECT * FROM coo WHERE cell IN (SELECT cell FROM c)), g AS (SELECT gene FROM k WHERE value > 0 GROUP BY 1 HAVING count(*) >= 20) SELECT cell, gene, value FROM k WHERE gene IN (SELECT gene FROM g)")
def mx1(t):
    return M.filter_matrix(coo(t), 30, 20).select("cell", "gene", "value")


@query("mx2_variable_genes", f"""WITH {COO}, n AS (SELECT count(*) AS n FROM customer), s AS (SELECT gene, sum(value) / any_value(n) AS mean, (sum(value * value) - any_value(n) * pow(sum(value) / any_value(n), 2)) / (any_value(n) - 1) AS var FROM coo, n GROUP BY 1),
 d AS (SELECT gene, mean, ln(1 + mean) AS x, ln(var / mean) AS disp FROM s WHERE mean > 0 AND var > 0), b AS (SELECT *, CAST(least(19, floor((x - min(x) OVER ()) * 20 / nullif(max(x) OVER () - min(x) OVER (), 0))) AS INTEGER) AS bin FROM d),
 z AS (SELECT gene, mean, bin, (disp - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(disp) OVER w END) / nullif(CASE WHEN count(*) OVER w = 1 THEN abs(disp) ELSE stddev_samp(disp) OVER w END, 0) AS nd FROM b WINDOW w AS (PARTITION BY bin))
 SELECT gene, round(mean, 6) AS mean, bin, round(nd, 5) AS norm_disp FROM z WHERE gene NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') ORDER BY nd DESC NULLS LAST, gene LIMIT 50""")
def mx2(t):
    n = t.customer.agg(F.count(F.lit(1)).alias("n"))
    got = M.variable_genes(M.gene_moments(coo(t), n).where("var > 0"), 50, excluded=part_gene(t, "p_type = 'PROMO'"))
    return got.select("gene", r6("mean").alias("mean"), "bin", F.round("norm_disp", 5).alias("norm_disp"))


@query("mx3_score_panel", f"""WITH {COO}, n AS (SELECT count(*) AS n FROM customer), m AS (SELECT p_partkey AS gene, coalesce(s, 0) / n AS mean FROM part LEFT JOIN (SELECT gene, sum(value) AS s FROM coo GROUP BY 1) ON gene = p_partkey, n), b AS (SELECT gene, ntile(25) OVER (ORDER BY mean, gene) AS bin FROM m),
 p AS (SELECT gene, bin FROM b WHERE gene IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')), c AS (SELECT gene FROM b WHERE gene NOT IN (SELECT gene FROM p) AND bin IN (SELECT bin FROM p) QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(gene AS VARCHAR)), gene) <= 50),
 a AS (SELECT cell, sum(value) / (SELECT count(*) FROM p) AS v FROM coo WHERE gene IN (SELECT gene FROM p) GROUP BY 1), d AS (SELECT cell, sum(value) / (SELECT count(*) FROM c) AS v FROM coo WHERE gene IN (SELECT gene FROM c) GROUP BY 1)
 SELECT c_custkey AS cell, round(coalesce(a.v, 0) - coalesce(d.v, 0), 6) AS score FROM customer LEFT JOIN a ON a.cell = c_custkey LEFT JOIN d ON d.cell = c_custkey""")
def mx3(t):
    cs, genes = t.customer.select(F.col("c_custkey").alias("cell")), part_gene(t)
    return M.score_panel(coo(t), cs, genes, part_gene(t, "p_brand = 'Brand#2'")).select("cell", r6("score").alias("score"))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("batch"))


@query("mx4_pca")
def mx4(t):
    """Two components, signs fixed by the first row's; rows only."""
    return M.pca(vectors(t), 5).select("id", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


@query("mx5_batched_knn", f"SELECT q_id, id, batch, rank FROM (SELECT a.vec_id AS q_id, b.vec_id AS id, b.label AS batch, CAST(row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY {DIST}, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 3")
def mx5(t):
    v = vectors(t)
    return M.knn(v.where("id % 20 = 0"), v, 3, "batch").select("q_id", "id", "batch", "rank")


@query("mx7_label_propagation")
def mx7(t):
    """Clusters of nations by shared days; iterative, so rows only."""
    nodes = t.nation.select(F.col("n_nationkey").alias("node"))
    return G.propagate_labels(nodes, overlaps(t).where("jaccard >= 0.02").select("a", "b", F.round("jaccard", 6).alias("weight")))


@query("mx8_scale_clip", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(greatest(-10, least(10, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER ())), 6) AS z FROM lineitem")
def mx8(t):
    s = t.lineitem.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"))
    z = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("l_extendedprice") - F.col("m")) / F.col("sd")))
    return t.lineitem.join(F.broadcast(s)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6(z).alias("z"))


@query("mx9_doublet_score")
def mx9(t):
    """Share of hash-paired synthetic doublets among each cell's neighbours; rows only."""
    return RC.doublet_scores(vectors(t), k=10)


@query("mx10_chain_qc", f"""WITH {CONTIGS}, c AS (SELECT user_id, day, count(*) FILTER (chain = 'TRA') AS a, count(*) FILTER (chain = 'TRB') AS b, count(*) FILTER (chain = 'TRG') AS g, count(*) FILTER (chain = 'TRD') AS d FROM contigs WHERE productive GROUP BY 1, 2)
 SELECT user_id, day, CASE WHEN a + b > 0 AND g + d > 0 THEN 'ambiguous' WHEN a > 0 AND b > 0 THEN 'TRA+TRB' WHEN a > 0 THEN 'TRA' WHEN b > 0 THEN 'TRB' WHEN g > 0 AND d > 0 THEN 'TRG+TRD' WHEN g > 0 THEN 'TRG' WHEN d > 0 THEN 'TRD' ELSE 'none' END AS receptor_subtype,
 CASE WHEN greatest(a, b, g, d) > 2 THEN 'multichain' WHEN greatest(a, b, g, d) > 1 THEN 'extra' WHEN a + b + g + d = 1 THEN 'orphan' WHEN (a = 1 AND b = 1 AND g + d = 0) OR (g = 1 AND d = 1 AND a + b = 0) THEN 'single pair' ELSE 'mixed' END AS chain_pairing FROM c""")
def mx10(t):
    return RC.chain_qc(contigs(t), ["user_id", "day"])


@query("mx11_components", "WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey - s_nationkey % 3 - 1 AS b FROM supplier WHERE s_acctbal > 2000 AND s_suppkey - s_nationkey % 3 - 1 > 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a) SELECT n AS node, min(m) AS component FROM r GROUP BY 1")
def mx11(t):
    edges = t.supplier.where("s_acctbal > 2000").selectExpr("s_suppkey AS a", "s_suppkey - s_nationkey % 3 - 1 AS b").where("b > 0")
    return G.components(t.supplier.select(F.col("s_suppkey").alias("node")), edges)


@query("mx13_purity_gate", f"""WITH {CELLS}, c AS (SELECT library, animal, count(*) AS n FROM cells GROUP BY 1, 2), p AS (SELECT library, max(n) / sum(n) AS purity FROM c GROUP BY 1), a AS (SELECT median(purity) AS med FROM p), b AS (SELECT median(abs(purity - med)) AS mad, any_value(med) AS med FROM p, a), z AS (SELECT stddev_samp(purity) AS sd FROM p)
 SELECT library, round(purity, 6) AS purity, purity < med - 2 * CASE WHEN mad > 0 THEN mad ELSE sd END AS contaminated FROM p, b, z""")
def mx13(t):
    p = R.dominant(cells(t), ["library"], "animal").select("library", F.col("share").alias("purity"))
    return ST.mad_outlier(p, "purity", 2).select("library", r6("purity").alias("purity"), (F.col("purity") < F.col("med") - 2 * F.col("width")).alias("contaminated"))
