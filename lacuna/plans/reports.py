"""The fuller branches of the composite queries: calls, design tests, lists, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import audit as A
from lacuna.operators import relational as R
from lacuna.operators import stats as ST
from lacuna.operators import subtypes as SU
from lacuna.operators.graph import scratch
from lacuna.plans.aggregates import QC, qc
from lacuna.plans.bindings import ALN, CELLS, COO, alignments, cells, coo
from lacuna.plans.registry import ORACLE, query
from lacuna.plans.statistics_queries import RANKS, WELCH, r6, rank_sums
from lacuna.sources import sinks

FAMILIES = {"plain": ["STANDARD", "ECONOMY"]}
MARGIN, SKEW, FLAGGED = 0.0002, 0.0005, 18.0

TYPED_MEANS = """sizes AS (SELECT p_type AS type, count(*) AS size FROM part GROUP BY 1), per AS (SELECT library, count(*) AS n_cells FROM cells GROUP BY 1),
 scores AS (SELECT library, cell, p_type AS type, sum(value) / any_value(size) AS v FROM coo JOIN part ON gene = p_partkey JOIN sizes ON p_type = type JOIN cells USING (cell) GROUP BY 1, 2, 3),
 means AS (SELECT library, type, sum(v) / any_value(n_cells) AS v FROM scores JOIN per USING (library) GROUP BY 1, 2)"""


def scores(t):
    """(library, cell, type, v): a panel's value in a cell by its genes."""
    sizes = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("size"))
    parts = t.part.join(R.small(sizes), "p_type").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("type"), "size")
    return coo(t).join(parts, "gene").join(cells(t), "cell").groupBy("library", "cell", "type").agg((F.sum("value") / F.first("size")).alias("v"))


def type_means(t):
    per = cells(t).groupBy("library").agg(F.count(F.lit(1)).alias("n_cells"))
    return scores(t).groupBy("library", "type").agg(F.sum("v").alias("v")).join(per, "library").select("library", "type", (F.col("v") / F.col("n_cells")).alias("v"))


@query("q5b_subtype_calls", f"""WITH {CELLS}, {QC}, {TYPED_MEANS},
 fam AS (SELECT library, CASE WHEN type IN ('STANDARD', 'ECONOMY') THEN 'plain' ELSE type END AS family, avg(v) AS v FROM means GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY v DESC, family) AS k FROM fam), rng AS (SELECT family, max(v) - min(v) AS top_range FROM fam GROUP BY 1),
 top AS (SELECT library, max(family) FILTER (k = 1) AS top, max(family) FILTER (k = 2) AS runner_up, max(v) FILTER (k = 1) - max(v) FILTER (k = 2) AS margin, max(v) FILTER (k = 1) AS v FROM k GROUP BY 1),
 skew AS (SELECT library, coalesce(sum(v) FILTER (type = 'STANDARD'), 0) - coalesce(sum(v) FILTER (type = 'ECONOMY'), 0) AS skew FROM means GROUP BY 1),
 ballot AS (SELECT library, type AS vote FROM scores QUALIFY row_number() OVER (PARTITION BY library, cell ORDER BY v DESC, type) = 1),
 won AS (SELECT library, vote, count(*) / sum(count(*)) OVER (PARTITION BY library) AS dominant_frac FROM ballot GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY library ORDER BY count(*) DESC, vote) = 1),
 mito AS (SELECT library, median(pct_flagged) AS flagged FROM m JOIN cells USING (cell) GROUP BY 1)
 SELECT top.library, top, runner_up, round(margin, 6) AS margin, round(top_range, 6) AS top_range, round(skew, 6) AS skew, vote, round(dominant_frac, 6) AS dominant_frac,
  CASE WHEN flagged > {FLAGGED} THEN 'QC: flagged' WHEN NOT (v > 0 AND coalesce(margin, 1e300) >= {MARGIN}) THEN 'Unresolved'
       WHEN top = 'plain' AND skew >= {SKEW} THEN 'plain standard' WHEN top = 'plain' AND skew <= -{SKEW} THEN 'plain economy' ELSE top END AS subtype
 FROM top JOIN rng ON top = family JOIN skew ON top.library = skew.library LEFT JOIN won ON top.library = won.library LEFT JOIN mito ON top.library = mito.library""")
def q5b(t):
    """Families of panels, the margin gate, a split on a measured skew, votes beside, and
    quality labels over all."""
    means = type_means(t)
    calls = SU.call(SU.family_means(means, "library", "type", "v", FAMILIES), "library", MARGIN)
    calls = SU.split(calls, means, "library", "type", "v", "plain", ("STANDARD", "plain standard"), ("ECONOMY", "plain economy"), SKEW)
    calls = calls.join(SU.votes(scores(t), "library", "cell", "type", "v"), "library", "left")
    flags = qc(t).join(cells(t), "cell").groupBy("library").agg(F.median("pct_flagged").alias("flagged"))
    calls = SU.overridden(calls, flags, "library", [(F.col("flagged") > FLAGGED, "QC: flagged")])
    return calls.select("library", "top", "runner_up", *(r6(c).alias(c) for c in ("margin", "top_range", "skew")), "vote", r6("dominant_frac").alias("dominant_frac"), "subtype")


@query("q11b_report", f"""WITH {CELLS}, c AS (SELECT count(*) AS n FROM cells), g AS (SELECT tissue, animal, count(*) AS n FROM cells GROUP BY 1, 2), d AS (SELECT animal FROM g WHERE n >= 3 GROUP BY 1 HAVING count(*) > 1)
 SELECT 'census: levels' AS section, 'library' AS item, count(DISTINCT library) AS n FROM cells UNION ALL SELECT 'census: levels', 'tissue', count(DISTINCT tissue) FROM cells UNION ALL SELECT 'census: levels', 'animal', count(DISTINCT animal) FROM cells
 UNION ALL SELECT 'census: missing', 'library', count(*) - count(library) FROM cells UNION ALL SELECT 'census: missing', 'tissue', count(*) - count(tissue) FROM cells UNION ALL SELECT 'census: missing', 'animal', count(*) - count(animal) FROM cells
 UNION ALL SELECT 'counts: library', library, count(*) FROM cells GROUP BY 2 UNION ALL SELECT 'counts: tissue', tissue, count(*) FROM cells GROUP BY 2 UNION ALL SELECT 'counts: animal', animal, count(*) FROM cells GROUP BY 2
 UNION ALL SELECT 'composition', concat(tissue, ' | ', animal), n FROM g
 UNION ALL SELECT 'integrity', 'duplicate keys', count(*) - count(DISTINCT cell) FROM cells
 UNION ALL SELECT 'verdict: both tissues in one animal', CASE WHEN count(*) > 0 THEN 'yes' ELSE 'no' END, count(*) FROM d""")
def q11b(t):
    """The report in long form: census, counts, composition, integrity, verdicts."""
    c = cells(t)
    names = ["library", "tissue", "animal"]
    census = A.census(c.select(*names))
    part = lambda section, df, item, n: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"))
    g = c.groupBy("tissue", "animal").agg(F.count(F.lit(1)).alias("n"))
    paired = g.where("n >= 3").groupBy("animal").agg(F.count(F.lit(1)).alias("tissues")).where("tissues > 1").agg(F.count(F.lit(1)).alias("n"))
    keys = c.agg((F.count(F.lit(1)) - F.count_distinct("cell")).alias("n"))
    parts = [
        part("census: levels", census, F.col("name"), F.col("levels")), part("census: missing", census, F.col("name"), F.col("missing")),
        *(part(f"counts: {x}", c.groupBy(x).count(), F.col(x), F.col("count")) for x in names),
        part("composition", g, F.concat_ws(" | ", "tissue", "animal"), F.col("n")), part("integrity", keys, F.lit("duplicate keys"), F.col("n")),
        part("verdict: both tissues in one animal", paired, F.when(F.col("n") > 0, "yes").otherwise("no"), F.col("n")),
    ]
    return reduce(DataFrame.union, parts)


ARM_SQL = "CASE WHEN animal IN ('BUILDING', 'MACHINERY') THEN 'b' ELSE 'a' END"


def arm():
    return F.when(F.col("animal").isin("BUILDING", "MACHINERY"), "b").otherwise("a")


@query("q13b_within_batch", f"WITH {CELLS} SELECT library, count(*) FILTER ({ARM_SQL} = 'a') AS n_a, count(*) FILTER ({ARM_SQL} = 'b') AS n_b, count(*) FILTER ({ARM_SQL} = 'a') >= 25 AND count(*) FILTER ({ARM_SQL} = 'b') >= 25 AS both FROM cells GROUP BY 1")
def q13b(t):
    """Libraries that hold both arms, where a comparison is free of the batch."""
    return A.within_batch(cells(t), arm(), "library", 25)


@query("q13c_shared_levels", f"WITH {CELLS}, c AS (SELECT {ARM_SQL} AS arm, animal, tissue, count(*) AS n FROM cells GROUP BY 1, 2, 3) SELECT tissue, count(*) FILTER (arm = 'a' AND n >= 60) AS in_a, count(*) FILTER (arm = 'b' AND n >= 60) AS in_b, count(*) FILTER (arm = 'a' AND n >= 60) > 0 AND count(*) FILTER (arm = 'b' AND n >= 60) > 0 AS shared FROM c GROUP BY 1")
def q13c(t):
    return A.shared_levels(cells(t), arm(), "animal", "tissue", 60)


# Two-sided normal p as a series for the lower tail; SQL has no error function.
TESTED = f"""WITH {RANKS}, zs AS (SELECT gene, log2((exp(ma) - 1 + 1e-9) / (exp(mb) - 1 + 1e-9)) AS log2fc, abs((ra - na * (na + 1) / 2.0 - na * nb / 2.0) / sqrt(na * nb * (na + nb + 1) / 12.0)) AS z FROM s),
 ps AS (SELECT gene, log2fc, CASE WHEN z > 8 THEN 0 WHEN z = 0 THEN 1 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(z) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END AS pval FROM zs),
 ks AS (SELECT *, row_number() OVER (ORDER BY pval, gene) AS i, count(*) OVER () AS n FROM ps), tested AS (SELECT gene, log2fc, pval, least(1.0, min(pval * n / i) OVER (ORDER BY i DESC)) AS padj FROM ks)"""
# Values of few units, so rank sums far from significance: the gates are wide.
ALPHAS, FOLDS, ALPHA, FOLD, READY = [0.05, 0.5, 0.8], [0.0, 0.5, 1.0], 0.5, 0.5, 10


def tested(t):
    w = rank_sums(t).withColumn("pval", ST.normal_two_sided(F.col("z")))
    return ST.bh_fdr(w, "pval").select("gene", "log2fc", "pval", "padj")


# The same series gives the p-values of the rank sums themselves.
ORACLE["m11_rank_sum_p"] = f"""{TESTED}, signed AS (SELECT gene, (ra - na * (na + 1) / 2.0 - na * nb / 2.0) / sqrt(na * nb * (na + nb + 1) / 12.0) AS z FROM s)
 SELECT gene, round(signed.z, 6) AS z, round(pval, 9) AS pval, round(padj, 9) AS padj FROM tested JOIN signed USING (gene)"""


LAYERS = f"{WELCH}, {TESTED.removeprefix(f'WITH {CELLS}, {COO}, ')}"
ORACLE["q15_contrast_run"] = f"""{LAYERS}, layered AS (SELECT gene, 'pseudobulk' AS layer, pval, padj FROM welched UNION ALL SELECT gene, 'cell', pval, padj FROM tested)
 SELECT gene, layer, round(pval, 9) AS pval, round(padj, 9) AS padj, padj < 0.05 AS significant FROM layered"""


@query("q15b_gate_lists", f"""{TESTED}, gated AS (SELECT 'raw' AS gate, * FROM tested WHERE pval < {ALPHA} UNION ALL SELECT 'fdr', * FROM tested WHERE padj < {ALPHA})
 SELECT gate, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction, gene, round(log2fc, 5) AS log2fc, round(pval, 9) AS pval, round(padj, 9) AS padj, count(*) OVER (PARTITION BY gate, log2fc > 0) >= {READY} AS ready
 FROM gated WHERE abs(log2fc) >= {FOLD}""")
def q15b(t):
    """The contrast's lists by gate and direction at the primary thresholds."""
    g = ST.gate_lists(tested(t), "gene", ALPHA, FOLD, READY)
    return g.select("gate", "direction", "gene", F.round("log2fc", 5).alias("log2fc"), F.round("pval", 9).alias("pval"), F.round("padj", 9).alias("padj"), "ready")


@query("q15c_threshold_grid", f"""{TESTED} SELECT CAST(a AS DOUBLE) AS alpha, CAST(f AS DOUBLE) AS least_fold, count(*) FILTER (pval < a AND abs(log2fc) >= f) AS raw, count(*) FILTER (padj < a AND abs(log2fc) >= f) AS fdr, count(pval) AS "of"
 FROM tested, (VALUES (0.05), (0.5), (0.8)) x(a), (VALUES (0.0), (0.5), (1.0)) y(f) GROUP BY 1, 2""")
def q15c(t):
    return ST.threshold_grid(tested(t), ALPHAS, FOLDS)


ELITE = TESTED.replace("u AS (SELECT cell, tissue FROM cells WHERE tissue IN ('ASIA', 'EUROPE'))", "u AS (SELECT cell, CASE WHEN tissue = 'AFRICA' THEN 'ASIA' ELSE 'EUROPE' END AS tissue FROM cells)")


@query("q28b_elite_rank_sums", f"""{ELITE}, n AS (SELECT tissue, count(*) AS n FROM cells GROUP BY 1), e AS (SELECT gene, count(*) FILTER (tissue = 'AFRICA') AS ca, count(*) FILTER (tissue <> 'AFRICA') AS cb FROM coo JOIN cells USING (cell) GROUP BY 1),
 m AS (SELECT k.gene, n.tissue, coalesce(sum(value), 0) / any_value(n.n) AS v FROM (SELECT DISTINCT gene FROM coo) k CROSS JOIN n LEFT JOIN (SELECT gene, tissue, value FROM coo JOIN cells USING (cell)) x ON x.gene = k.gene AND x.tissue = n.tissue GROUP BY 1, 2),
 c AS (SELECT a.gene, count(*) FILTER (b.v < a.v) AS below, count(*) FILTER (b.v > a.v) AS above FROM m a JOIN m b ON a.gene = b.gene AND a.tissue = 'AFRICA' AND b.tissue <> 'AFRICA' GROUP BY 1)
 SELECT gene, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction, round(log2fc, 5) AS log2fc, round(pval, 7) AS pval, round(ca / (SELECT n FROM n WHERE tissue = 'AFRICA'), 6) AS pct_elite, round(cb / (SELECT sum(n) FROM n WHERE tissue <> 'AFRICA'), 6) AS pct_other, CASE WHEN log2fc > 0 THEN below ELSE above END AS consistency
 FROM tested JOIN e USING (gene) JOIN c USING (gene) WHERE abs(log2fc) >= {FOLD} AND CASE WHEN log2fc > 0 THEN ca / (SELECT n FROM n WHERE tissue = 'AFRICA') ELSE cb / (SELECT sum(n) FROM n WHERE tissue <> 'AFRICA') END >= 0.01""")
def q28b(t):
    """One region against all others by rank sums, fold and share, and in how many of the
    others the sign holds (adjusted p of 1 at most: every gene is let through it)."""
    found = ST.elite_panel(coo(t), cells(t), "tissue", "AFRICA", 1.1, FOLD, 0.01)
    return found.select("gene", "direction", F.round("log2fc", 5).alias("log2fc"), F.round("pval", 7).alias("pval"), F.round("pct_elite", 6).alias("pct_elite"), F.round("pct_other", 6).alias("pct_other"), "consistency")


@query("q30b_ratio_gate", f"""WITH {ALN}, v AS (SELECT count(*) FILTER (l_linenumber <= 3 AND library % 2 = 0) AS a0, count(*) FILTER (l_linenumber <= 3 AND library % 2 = 1) AS b0, count(*) FILTER (l_linenumber > 3 AND library % 2 = 0) AS a1, count(*) FILTER (l_linenumber > 3 AND library % 2 = 1) AS b1, count(*) FILTER (flag & 16 <> 0) AS minus, count(*) AS n FROM aln)
 SELECT 'separation' AS gate, CASE WHEN b1 = 0 OR a1 / b1 >= a0 / b0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v UNION ALL SELECT 'strand', CASE WHEN minus / n > 0.8 THEN 'FAIL' ELSE 'PASS' END FROM v UNION ALL SELECT 'floor', CASE WHEN a1 >= 100 THEN 'PASS' ELSE 'FAIL' END FROM v""")
def q30b(t):
    """Signal against control in both versions, the strand of the reads, and a floor."""
    old, signal = F.col("l_linenumber") <= 3, F.col("library") % 2 == 0
    counts = {"a0": old & signal, "b0": old & ~signal, "a1": ~old & signal, "b1": ~old & ~signal, "minus": ~S.lacks_bits(F.col("flag"), S.REVERSE)}
    v = alignments(t).agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    better = F.col("b1").eqNullSafe(0) | F.coalesce(ratio("a1", "b1") >= ratio("a0", "b0"), F.lit(False))
    row = lambda name, ok: F.struct(F.lit(name).alias("gate"), F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))
    return v.select(F.inline(F.array(row("separation", better), row("strand", ~(F.coalesce(ratio("minus", "n"), F.lit(0.0)) > 0.8)), row("floor", F.col("a1") >= 100))))


@query("q31b_stored_recipe", "SELECT * FROM (VALUES ('min_genes', '200', '300'), ('panel', NULL, '\"A\"'), ('seed', '7', NULL)) v(key, stored, wanted)")
def q31b(t):
    """A checkpoint written with its recipe, and what has drifted from the recipe wanted."""
    path = scratch(t.spark, "checkpoint")
    sinks.write_checkpoint(t.region, path, {"min_genes": 200, "target": 1e4, "seed": 7})
    return sinks.recipe_drift(t.spark, path, {"min_genes": 300, "target": 1e4, "panel": "A"})


@query("sk6_figure_table", f"WITH {CELLS}, {COO}, {TYPED_MEANS}, f AS (SELECT library, type, count(DISTINCT cell) AS k FROM scores WHERE v > 0 GROUP BY 1, 2) SELECT library, type, round(means.v, 6) AS mean, round(coalesce(k, 0) / n_cells, 6) AS fraction, round((means.v - avg(means.v) OVER w) / (stddev_samp(means.v) OVER w + 1e-9), 5) AS z FROM means JOIN per USING (library) LEFT JOIN f USING (library, type) WINDOW w AS (PARTITION BY type)")
def sk6(t):
    """The table of a dot plot: per cluster and panel mean, share of cells and z."""
    per = cells(t).groupBy("library").agg(F.count(F.lit(1)).alias("n_cells"))
    s = scores(t).groupBy("library", "type").agg(F.sum("v").alias("v"), F.count_if(F.col("v") > 0).alias("k")).join(per, "library")
    means = s.select("library", "type", (F.col("v") / F.col("n_cells")).alias("mean"), F.col("k"), "n_cells")
    z = ST.zscore(means, "mean", ["type"])
    return z.select("library", "type", r6("mean").alias("mean"), r6(F.col("k") / F.col("n_cells")).alias("fraction"), F.round("z", 5).alias("z"))


ALIASES = {"red widget": ["Red Widget", "small ring"], "Missing": ["Nada"]}


@query("su9b_panel_resolution", """WITH known AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 25 AND p_name <> 'red widget'), g AS (SELECT DISTINCT p_brand AS panel, p_name AS gene FROM part UNION ALL SELECT 'Extra', 'Missing'),
 s AS (SELECT panel, gene, CASE WHEN gene IN (SELECT p_name FROM known) THEN 'exact' WHEN gene = 'red widget' AND 'small ring' IN (SELECT p_name FROM known) THEN 'alias' ELSE 'missing' END AS status FROM g), n AS (SELECT gene, count(*) AS panels FROM g GROUP BY 1)
 SELECT panel, count(*) AS genes, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'alias') AS alias, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (panels > 1) AS shared FROM s JOIN n USING (gene) GROUP BY 1""")
def su9b(t):
    """Panels' genes resolved by name, then by the aliases in their order, and how many
    stand in more than one panel."""
    spark = t.spark
    known = t.part.where("p_size <= 25 AND p_name <> 'red widget'").select(F.col("p_name").alias("found")).distinct()
    genes = t.part.select(F.col("p_brand").alias("panel"), F.col("p_name").alias("gene")).distinct().union(spark.createDataFrame([("Extra", "Missing")], "panel string, gene string"))
    aliases = F.broadcast(spark.createDataFrame(list(ALIASES.items()), "gene string, aliases array<string>"))
    tried = genes.select("gene").distinct().join(aliases, "gene", "left").select("gene", F.posexplode(F.concat(F.array("gene"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("turn", "found"))
    hits = tried.join(known, "found").groupBy("gene").agg(F.min("turn").alias("turn"))
    panels = genes.groupBy("gene").agg(F.count(F.lit(1)).alias("panels"))
    rows = genes.join(panels, "gene").join(hits, "gene", "left")
    turn = F.col("turn")
    return rows.groupBy("panel").agg(F.count(F.lit(1)).alias("genes"), F.count_if(turn == 0).alias("exact"), F.count_if(turn > 0).alias("alias"), F.count_if(turn.isNull()).alias("missing"), F.count_if(F.col("panels") > 1).alias("shared"))
