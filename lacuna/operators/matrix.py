"""Sparse matrices as (cell, gene, value) rows; what is absent is zero.

Denominators come from the unit tables, never from the stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import neighbours
from lacuna.operators.ranges import ntile
from lacuna.operators.stats import per_group


def qc_metrics(coo: DataFrame, flags: DataFrame | None = None, top: int = 20) -> DataFrame:
    """Per cell: total, features seen, log1p of both, share of the top features, and of
    the features that ``flags`` (gene, flag) marks."""
    ranked = coo.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("value"), "gene")))
    if flags is not None:
        ranked = ranked.join(flags, "gene", "left")
    total = F.sum("value")
    marked = [] if flags is None else [(100.0 * F.sum(F.when(F.col("flag"), F.col("value")).otherwise(0.0)) / total).alias("pct_flagged")]
    out = ranked.groupBy("cell").agg(total.alias("total"), F.count_if(F.col("value") > 0).alias("n_features"), (100.0 * F.sum(F.when(F.col("_n") <= top, F.col("value")).otherwise(0.0)) / total).alias("pct_top"), *marked)
    return out.withColumn("log1p_total", F.log1p("total")).withColumn("log1p_n_features", F.log1p("n_features"))


def normalise(coo: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds ``norm`` = value / total * target and ``lognorm`` = log1p of it."""
    norm = F.col("value") / F.sum("value").over(Window.partitionBy("cell")) * target
    return coo.withColumn("norm", norm).withColumn("lognorm", F.log1p("norm"))


def filter_matrix(coo: DataFrame, min_genes: int, min_cells: int) -> DataFrame:
    """Cells with enough features, then features in enough of those cells."""
    cells = coo.where("value > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_genes).select("cell")
    kept = coo.join(cells, "cell", "left_semi")
    genes = kept.where("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells).select("gene")
    return kept.join(genes, "gene", "left_semi")


def gene_moments(coo: DataFrame, n_cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean and sample variance per gene with zeros counted; ``n_cells`` has ``n``."""
    sums = coo.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.count_if(F.col(value) > 0).alias("nnz"))
    joined = sums.join(F.broadcast(n_cells))
    mean = F.col("s") / F.col("n")
    return joined.select("gene", "n", "nnz", mean.alias("mean"), ((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("var"))


def variable_genes(moments: DataFrame, top: int, bins: int = 20, excluded: DataFrame | None = None) -> DataFrame:
    """Dispersion in equal-width bins of log1p mean, standardised within the bin.

    A bin of one gene has its own dispersion as spread.  Genes in ``excluded`` are kept
    out of the selection only.
    """
    m = moments.where("mean > 0").withColumn("x", F.log1p("mean")).withColumn("disp", F.log(F.col("var") / F.col("mean")))
    m = m.where("disp IS NOT NULL")
    edges = m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    m = m.join(F.broadcast(edges)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))).cast("int"))
    w = Window.partitionBy("bin")
    centre = F.when(F.count(F.lit(1)).over(w) == 1, F.lit(0.0)).otherwise(F.avg("disp").over(w))
    wide = F.when(F.count(F.lit(1)).over(w) == 1, F.abs("disp")).otherwise(F.stddev_samp("disp").over(w))
    m = m.withColumn("norm_disp", F.try_divide(F.col("disp") - centre, F.nullif(wide, F.lit(0.0))))
    pick = m if excluded is None else m.join(excluded, "gene", "left_anti")
    return pick.orderBy(F.desc_nulls_last("norm_disp"), "gene").limit(top).select("gene", "mean", "bin", "norm_disp")


def panel_sum(coo: DataFrame, cells: DataFrame, panel: DataFrame, out: str = "score") -> DataFrame:
    """Per cell the sum over a panel's genes, zero where it has none."""
    sums = coo.join(panel, "gene", "left_semi").groupBy("cell").agg(F.sum("value").alias(out))
    return cells.join(sums, "cell", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def score_panel(coo: DataFrame, cells: DataFrame, genes: DataFrame, panel: DataFrame, value: str = "value", bins: int = 25, controls: int = 50) -> DataFrame:
    """Mean over a panel less the mean over control genes of the same expression bins.

    Controls are the genes outside the panel with the lowest hash in each bin that a
    panel gene falls in: the same at every run.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    means = genes.join(coo.groupBy("gene").agg(F.sum(value).alias("s")), "gene", "left").join(F.broadcast(n)).select("gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    binned = ntile(means, bins, "mean", ["gene"], "bin")
    in_panel = binned.join(panel.select("gene").distinct(), "gene", "left_semi")
    spare = binned.join(panel, "gene", "left_anti").join(in_panel.select("bin").distinct(), "bin", "left_semi")
    spare = spare.withColumn("_n", F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.col("gene").cast("string")), "gene"))).where(F.col("_n") <= controls)

    def mean_of(which):
        size = which.agg(F.count(F.lit(1)).alias("k"))
        sums = coo.join(which.select("gene"), "gene", "left_semi").groupBy("cell").agg(F.sum(value).alias("s"))
        return sums.join(F.broadcast(size)).select("cell", F.try_divide(F.col("s"), F.col("k")).alias("m"))

    a, b = mean_of(in_panel).withColumnRenamed("m", "_a"), mean_of(spare).withColumnRenamed("m", "_b")
    return cells.join(a, "cell", "left").join(b, "cell", "left").select("cell", (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("score"))


def pseudobulk(coo: DataFrame, cells: DataFrame, replicate: str, min_cells: int) -> DataFrame:
    """Summed counts per (replicate, gene) for replicates with enough cells."""
    enough = cells.groupBy(replicate).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cells).select(replicate)
    return coo.join(cells.join(enough, replicate, "left_semi").select("cell", replicate), "cell").groupBy(replicate, "gene").agg(F.sum("value").alias("value"))


def log_cpm(bulk: DataFrame, by: list[str]) -> DataFrame:
    every = per_group(bulk, by, F.sum("value").alias("_total"))
    return every.withColumn("logcpm", F.log2(F.coalesce(F.try_divide(F.col("value"), F.nullif("_total", F.lit(0.0))), F.lit(0.0)) * 1e6 + 1)).drop("_total")


def fraction_expressing(coo: DataFrame, cells: DataFrame, by: str, single: bool = False) -> DataFrame:
    """Share of a group's cells in which a gene is above zero; zeros count.

    ``single`` tells that ``coo`` has no cell and gene twice: rows are then counted, where
    distinct cells would be held once more in memory.
    """
    sizes = cells.groupBy(by).agg(F.count(F.lit(1)).alias("n_cells"))
    units = cells.select("cell", by)
    seen = coo.where("value > 0").join(units.distinct() if single else units, "cell").groupBy(by, "gene")
    seen = seen.agg((F.count(F.lit(1)) if single else F.count_distinct("cell")).alias("n_expressing"))
    return seen.join(sizes, by).withColumn("fraction", F.col("n_expressing") / F.col("n_cells"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, batch: str | None = None) -> DataFrame:
    """The k nearest rows (squared distance, ties by id) in each batch, itself excluded:
    exact, through an index of all rows that leaves most pairs unread."""
    found, _ = neighbours.search(queries, neighbours.build(vectors, batch), k)
    return found.select("q_id", "id", *([F.col("batch").alias(batch)] if batch else []), "rank", "dist2")


def pca(vectors: DataFrame, k: int, column: str = "v") -> DataFrame:
    """The first k principal components of array vectors, as an array column ``pc``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fitted = vectors.withColumn("_f", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_f", outputCol="_pc").fit(fitted)
    return model.transform(fitted).withColumn("pc", vector_to_array("_pc")).drop("_f", "_pc")
