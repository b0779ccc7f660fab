"""Statistics over columns and groups: robust outliers, multiple testing, contrasts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lacuna.operators.ranges import null_safe


def mad_outlier(df: DataFrame, column: str, n: float, by: list[str] | None = None, out: str = "outlier") -> DataFrame:
    """Adds ``med, mad, width, <out>``: beyond n widths of the median.

    The width is the unscaled median absolute deviation; where that is 0 it is the
    sample standard deviation, and where that is 0 too nothing is flagged.
    """
    by = by or []
    middle = df.groupBy(*by).agg(F.median(column).alias("med"), F.stddev_samp(column).alias("spread"))
    joined = df.join(middle, by) if by else df.join(F.broadcast(middle))
    wide = joined.groupBy(*by).agg(F.median(F.abs(F.col(column) - F.col("med"))).alias("mad"))
    joined = joined.join(wide, by) if by else joined.join(F.broadcast(wide))
    width = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.coalesce("spread", F.lit(0.0)))
    flag = (F.col("width") > 0) & (F.abs(F.col(column) - F.col("med")) > n * F.col("width"))
    return joined.withColumn("width", width).withColumn(out, F.coalesce(flag, F.lit(False))).drop("spread")


def per_group(df: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """``df`` with aggregates of its groups beside each row (null keys are a group).

    Partial sums and a join, where a window would put a whole group into one task.
    """
    sums = df.groupBy(*by).agg(*sums)
    if not by:
        return df.join(F.broadcast(sums))
    return null_safe(df, sums, by)


def p_range(p: Column) -> Column:
    """An increasing whole number: 256 equal parts, the first one by its logarithm."""
    return F.when(p >= 1 / 256, F.floor(p * 256)).otherwise(F.coalesce(F.floor(F.log2(p) * 8), F.lit(-(10**6)))).cast("int")


def bh_fdr(df: DataFrame, p: str, by: list[str] | None = None, ties: list[str] | None = None, out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg over the finite p of each group; null p stays null.

    Equal p have equal results whatever the order of ``ties``, so only distinct p are
    ranked, in ranges of p: each range counts and takes minima by itself, and a table of
    ranges carries them on.
    """
    by = by or []
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    each = df.where(fine).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", p_range(F.col("_p")))
    ranges = each.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    w = Window.partitionBy(*by)
    ranges = ranges.withColumn("_m", F.sum("_in").over(w)).withColumn("_before", F.sum("_in").over(w.orderBy("_range")) - F.col("_in"))
    inside = Window.partitionBy(*by, "_range").orderBy("_p")
    ranked = null_safe(each.withColumn("_k", F.sum("_n").over(inside)), ranges, [*by, "_range"])
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_k")))
    least = ranked.groupBy(*by, "_range").agg(F.min("_q").alias("_least"))
    after = least.select(*by, "_range", F.min("_least").over(w.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    own = F.min("_q").over(Window.partitionBy(*by, "_range").orderBy(F.desc("_p")))
    done = null_safe(ranked.withColumn("_own", own), after, [*by, "_range"])
    done = done.select(*by, "_p", F.least(F.lit(1.0), "_own", "_after").alias(out))
    return null_safe(df.withColumn("_p", F.when(fine, F.col(p))), done, [*by, "_p"], "left").drop("_p")


def bonferroni(df: DataFrame, p: str, by: list[str] | None = None, out: str = "padj") -> DataFrame:
    return per_group(df, by or [], F.count(p).alias("_tests")).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_tests"))).drop("_tests")


def zscore(df: DataFrame, column: str, by: list[str] | None = None, ddof: int = 1, epsilon: float = 1e-9, out: str = "z") -> DataFrame:
    """ddof 1: (x - mean) / (sd + epsilon); ddof 0: null where the sd is 0."""
    spread = F.stddev_samp(column) if ddof else F.stddev_pop(column)
    both = per_group(df, by or [], F.avg(column).alias("_mean"), spread.alias("_sd"))
    centred = F.col(column) - F.col("_mean")
    z = centred / (F.col("_sd") + epsilon) if ddof else F.try_divide(centred, F.nullif("_sd", F.lit(0.0)))
    return both.withColumn(out, z).drop("_mean", "_sd")


def share(value: str, by: list[str]) -> Column:
    """A value's share of its group's sum."""
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by)))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    import math

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or tiny)
        c = (1 + top / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    import math

    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def t_two_sided(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided p of Student's t with (fractional) degrees of freedom."""
    for t, df in parts:
        yield pd.Series([None if pd.isna(x) or pd.isna(n) or n <= 0 else _incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_upper(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, df in parts:
        yield pd.Series([None if pd.isna(v) or pd.isna(n) or n <= 0 else _gamma_tail(n / 2, v / 2) for v, n in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import math

    for z in parts:
        yield pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")


def welch(na: Column, ma: Column, va: Column, nb: Column, mb: Column, vb: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from sizes, means and sample variances."""
    ea, eb = va / na, vb / nb
    t = F.try_divide(ma - mb, F.nullif(F.sqrt(ea + eb), F.lit(0.0)))
    df = F.try_divide((ea + eb) * (ea + eb), ea * ea / (na - 1) + eb * eb / (nb - 1))
    return t, df


def paired(rows: DataFrame, by: list[str], pair: str, arm: str, value: str, a: str, b: str, pairs: int) -> DataFrame:
    """``log2fc, t, df`` of the paired t-test of arm ``a`` against ``b`` per ``by``, over
    ``pairs`` units that both arms have; a unit without a row has the value 0."""
    side = lambda x: F.coalesce(F.sum(F.when(F.col(arm) == x, F.col(value))), F.lit(0.0))
    d = rows.groupBy(*by, pair).agg((side(a) - side(b)).alias("_d"))
    sums = d.groupBy(*by).agg(F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"))
    n = float(pairs)
    var = (F.col("_ss") - F.col("_s") * F.col("_s") / n) / (n - 1)
    t = F.try_divide(F.col("_s") / n, F.sqrt(F.when(var > 1e-12, var) / n))
    return sums.select(*by, (F.col("_s") / n).alias("log2fc"), t.alias("t"), F.lit(n - 1).alias("df"))


def rank_sum(df: DataFrame, by: list[str], value: str, group: str, sizes: dict[str, Column]) -> DataFrame:
    """Wilcoxon rank sums of group 'a' against 'b' per ``by`` over sparse values.

    Rows hold the values above zero; ``sizes`` has how many units each group has, and
    the absent ones are one block of tied zeros, never expanded.  Gives
    ``u, z`` (normal approximation, no tie correction) and ``log2fc``, of the means of
    values that are logarithms of one more than a count.
    """
    na, nb = (sizes[k].cast("double") for k in "ab")  # products of whole numbers would overflow
    per = df.groupBy(*by, value).agg(F.count_if(F.col(group) == "a").alias("ta"), F.count_if(F.col(group) == "b").alias("tb"))
    whole = Window.partitionBy(*by)  # distinct values of one item, not its rows
    below = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.dropna(subset=by).withColumn("under", F.coalesce(F.sum(F.col("ta") + F.col("tb")).over(below), F.lit(0)))
    ranked = ranked.withColumn("xa", F.sum("ta").over(whole)).withColumn("xb", F.sum("tb").over(whole)).withColumn("zeros", na + nb - F.col("xa") - F.col("xb"))
    rank = F.col("zeros") + F.col("under") + (F.col("ta") + F.col("tb") + 1) / 2.0
    sums = ranked.groupBy(*by).agg(F.sum(rank * F.col("ta")).alias("r"), F.first("zeros").alias("zeros"), F.first("xa").alias("xa"), F.sum(F.col(value) * F.col("ta")).alias("sa"), F.sum(F.col(value) * F.col("tb")).alias("sb"))
    total = F.col("r") + (na - F.col("xa")) * (F.col("zeros") + 1) / 2.0
    u = total - na * (na + 1) / 2.0
    return sums.withColumn("u", u).withColumn("z", (F.col("u") - na * nb / 2.0) / F.sqrt(na * nb * (na + nb + 1) / 12.0)).withColumn("log2fc", F.log2((F.expm1(F.col("sa") / na) + 1e-9) / (F.expm1(F.col("sb") / nb) + 1e-9))).select(*by, "u", "z", "log2fc")


def elite_panel(coo: DataFrame, units: DataFrame, unit: str, elite: str, alpha: float, least_fold: float, least_share: float) -> DataFrame:
    """Genes in which one unit stands out from all others: ``gene, direction, log2fc, pval,
    padj, pct_elite, pct_other, consistency, of``.

    Cells of the elite are held against those of all others by rank sums and BH; a gene
    stays if its fold, adjusted p and the share of expressing cells on its higher side all
    pass.  ``consistency`` counts the ``of`` other units whose own mean lies on the other
    side of the elite's: many cells of one unit cannot carry it.
    """
    arm = F.when(F.col(unit) == elite, "a").otherwise("b")
    sizes = units.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.coalesce(F.sum(F.when(F.col(unit) == elite, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col(unit) != elite, F.col("n"))), F.lit(0)).alias("b"), F.count_if(F.col(unit) != elite).alias("of")).first()
    rows = coo.join(units.select("cell", unit), "cell").where("value > 0")
    ranked = rank_sum(rows.withColumn("g", arm), ["gene"], "value", "g", {"a": F.lit(n.a), "b": F.lit(n.b)})
    tested = bh_fdr(ranked.withColumn("pval", normal_two_sided(F.col("z"))), "pval").select("gene", "log2fc", "pval", "padj")
    own = F.col(unit) == elite
    shares = rows.groupBy("gene").agg((F.count_if(own) / F.lit(float(n.a or 1))).alias("pct_elite"), (F.count_if(~own) / F.lit(float(n.b or 1))).alias("pct_other"), (F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0.0)) / F.lit(float(n.a or 1))).alias("mean"))
    means = rows.where(~own).groupBy("gene", unit).agg(F.sum("value").alias("s")).join(sizes, unit).select("gene", (F.col("s") / F.col("n")).alias("m"))
    met = means.join(shares.select("gene", "mean"), "gene").groupBy("gene").agg(F.count_if(F.col("m") < F.col("mean")).alias("below"), F.count_if(F.col("m") > F.col("mean")).alias("above"), F.count(F.lit(1)).alias("seen"))
    up = F.col("log2fc") > 0
    # Units without the gene have mean 0: below a positive mean, never above one.
    absent = F.when(F.col("mean") > 0, F.lit(n.of) - F.coalesce("seen", F.lit(0))).otherwise(0)
    steady = F.when(up, F.coalesce("below", F.lit(0)) + absent).otherwise(F.coalesce("above", F.lit(0)))
    joined = tested.join(shares, "gene").join(met, "gene", "left").where((F.abs("log2fc") >= least_fold) & (F.col("padj") < alpha) & (F.when(up, F.col("pct_elite")).otherwise(F.col("pct_other")) >= least_share))
    return joined.select("gene", F.when(up, "up").otherwise("down").alias("direction"), "log2fc", "pval", "padj", "pct_elite", "pct_other", steady.alias("consistency"), F.lit(n.of).alias("of"))


def gate_lists(tested: DataFrame, item: str, alpha: float, least_fold: float, least_items: int, fold: str = "log2fc") -> DataFrame:
    """``gate, direction, item, fold, pval, padj, ready``: items beyond both thresholds, by
    raw p and by adjusted p, up and down; ``ready`` where the list has ``least_items``."""
    gates = F.array(*(F.struct(F.lit(name).alias("gate"), F.col(c).alias("_p")) for name, c in (("raw", "pval"), ("fdr", "padj"))))
    rows = tested.select(item, fold, "pval", "padj", F.inline(gates)).where((F.col("_p") < alpha) & (F.abs(fold) >= least_fold) & (F.col(fold) != 0))
    rows = rows.withColumn("direction", F.when(F.col(fold) > 0, "up").otherwise("down"))
    sizes = rows.groupBy("gate", "direction").agg((F.count(F.lit(1)) >= least_items).alias("ready"))
    return rows.join(F.broadcast(sizes), ["gate", "direction"]).select("gate", "direction", item, fold, "pval", "padj", "ready")


def threshold_grid(tested: DataFrame, alphas: list[float], folds: list[float], fold: str = "log2fc") -> DataFrame:
    """``alpha, least_fold, raw, fdr, of``: items beyond each pair of thresholds by raw and by
    adjusted p, and the items tested; one pass, a counter for each."""
    cells = [(a, f) for a in alphas for f in folds]
    beyond = lambda p, a, f: F.count_if((F.col(p) < a) & (F.abs(fold) >= f))
    counts = [c for k, (a, f) in enumerate(cells) for c in (beyond("pval", a, f).alias(f"_r{k}"), beyond("padj", a, f).alias(f"_f{k}"))]
    one = tested.agg(F.count("pval").alias("of"), *counts)
    rows = (F.struct(F.lit(a).alias("alpha"), F.lit(f).alias("least_fold"), F.col(f"_r{k}").alias("raw"), F.col(f"_f{k}").alias("fdr")) for k, (a, f) in enumerate(cells))
    return one.select(F.inline(F.array(*rows)), "of")
