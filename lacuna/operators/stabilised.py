"""Variable genes by variance-stabilised counts: a smooth trend, then clipped variance.

The trend of log variance over log mean is a local quadratic fit.  It is fitted from sums
by narrow bins of log mean (at most ``BINS`` rows reach the driver, however many genes
there are): the weight of a gene is that of its bin's middle, and the fit is made at the
middles and read off between them on straight lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.graph import saved

BINS = 1024
#: Share of the genes that a local fit rests on.
SPAN = 0.3


def local_quadratic(at: np.ndarray, middles: np.ndarray, sums: np.ndarray, span: float) -> np.ndarray:
    """The local fit at each of ``at``, from sums of 1, u, u2, u3, u4, y, uy, u2y by bin,
    u counted from the bin's middle."""
    n = sums[:, 0]
    want = max(np.ceil(span * n.sum()), min(n.sum(), 3))
    out = np.empty(len(at))
    for k, x0 in enumerate(at):
        d = middles - x0
        away = np.abs(d)
        order = np.argsort(away, kind="stable")
        held = np.cumsum(n[order])
        reach = away[order[np.searchsorted(held, want)]]
        w = np.where(away < reach, (1 - (away / reach) ** 3) ** 3, 0.0) if reach > 0 else (away == 0).astype(float)
        s0, s1, s2, s3, s4, y0, y1, y2 = sums.T
        m1 = s1 + d * s0
        m2 = s2 + 2 * d * s1 + d**2 * s0
        m3 = s3 + 3 * d * s2 + 3 * d**2 * s1 + d**3 * s0
        m4 = s4 + 4 * d * s3 + 6 * d**2 * s2 + 4 * d**3 * s1 + d**4 * s0
        a0, a1, a2, a3, a4 = ((w * m).sum() for m in (s0, m1, m2, m3, m4))
        b = [(w * y0).sum(), (w * (y1 + d * y0)).sum(), (w * (y2 + 2 * d * y1 + d**2 * y0)).sum()]
        scale = max(reach, 1e-12) ** np.arange(3)
        square = np.array([[a0, a1, a2], [a1, a2, a3], [a2, a3, a4]]) / np.outer(scale, scale)
        out[k] = np.linalg.lstsq(square, np.array(b) / scale, rcond=1e-10)[0][0]
    return out


def trend(moments: DataFrame, span: float = SPAN, bins: int = BINS) -> DataFrame:
    """``moments`` (gene, mean, var) with ``fit``, the smoothed variance; genes without
    mean or variance are left out."""
    xy = saved(moments.where("mean > 0 AND var > 0").withColumns({"x": F.log10("mean"), "y": F.log10("var")}))
    low, high = xy.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return xy.select(*moments.columns, F.lit(None).cast("double").alias("fit"))
    step, half = (high - low) / bins or 1.0, 0.5 if high > low else 0.0
    u = F.col("x") - (F.lit(low) + (F.col("bin") + half) * F.lit(step))
    binned = xy.withColumn("bin", F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(step)), F.lit(bins - 1))).withColumn("u", u)
    parts = [F.lit(1.0), F.col("u"), F.pow("u", F.lit(2)), F.pow("u", F.lit(3)), F.pow("u", F.lit(4)), F.col("y"), F.col("u") * F.col("y"), F.pow("u", F.lit(2)) * F.col("y")]
    sums = np.array([list(r) for r in binned.groupBy("bin").agg(*(F.sum(c) for c in parts)).orderBy("bin").collect()], float)
    middles = low + (sums[:, 0] + half) * step
    nodes = low + (np.arange(bins) + 0.5) * step if high > low else middles
    fits = local_quadratic(nodes, middles, sums[:, 1:], span)
    ends = [(k, float(nodes[k]), float(fits[k]), float(fits[min(k + 1, len(nodes) - 1)])) for k in range(len(nodes))]
    lines = xy.sparkSession.createDataFrame(ends, "node long, x0 double, y0 double, y1 double")
    node = F.greatest(F.lit(0), F.least(F.floor((F.col("x") - F.lit(float(nodes[0]))) / F.lit(step)), F.lit(len(nodes) - 1)))
    read = xy.withColumn("node", node).join(F.broadcast(lines), "node")
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - F.col("x0")) / F.lit(step)))
    return read.select(*moments.columns, F.pow(F.lit(10.0), F.col("y0") + along * (F.col("y1") - F.col("y0"))).alias("fit"))


def stabilised_genes(coo: DataFrame, moments: DataFrame, n_cells: int, top: int, span: float = SPAN, value: str = "value") -> DataFrame:
    """``gene, mean, var, fit, norm_var, rank`` of the ``top`` genes by the variance of
    their counts, scaled by the trend and cut at the square root of the number of cells.

    ``moments`` has ``gene, mean, var`` with zeros counted; zeros of ``coo`` are not made.
    """
    fitted = saved(trend(moments.select("gene", "mean", "var"), span))
    sd = F.sqrt("fit")
    limit = F.col("mean") + sd * F.lit(float(n_cells) ** 0.5)
    cut = coo.join(fitted.select("gene", limit.alias("_limit")), "gene").select("gene", F.least(F.col(value).cast("double"), F.col("_limit")).alias("c"))
    sums = cut.groupBy("gene").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    spread = (F.lit(float(n_cells)) * F.col("mean") * F.col("mean") + F.col("ss") - 2 * F.col("mean") * F.col("s")) / (F.lit(float(n_cells - 1)) * F.col("fit"))
    best = fitted.join(sums, "gene").withColumn("norm_var", spread).orderBy(F.desc("norm_var"), "gene").limit(top)
    ranked = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("norm_var")).alias("less"), F.struct("gene", "mean", "var", "fit", "norm_var").alias("g")))).alias("all"))
    return ranked.select(F.posexplode("all").alias("rank", "r")).select("r.g.*", (F.col("rank") + 1).alias("rank"))
