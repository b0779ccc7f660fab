"""Integrity and design audits of a unit table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalars import is_placeholder


def census(df: DataFrame) -> DataFrame:
    """Per column: missing, placeholder strings, distinct levels, constant or not.

    One pass over the table whatever the number of columns.
    """
    counts = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        placeholder = F.count_if(v.isNotNull() & is_placeholder(v.cast("string")))
        counts += [F.count_if(v.isNull()).alias(f"{c}|m"), placeholder.alias(f"{c}|p"), F.count_distinct(v).alias(f"{c}|l")]
    one = df.agg(*counts)
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}|m`").alias("missing"), F.col(f"`{c}|p`").alias("placeholder"), F.col(f"`{c}|l`").alias("levels")) for c in df.columns))
    return one.select(F.inline(rows)).withColumn("constant", F.col("levels") <= 1)


def identical_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, identical`` for pairs of columns: equal, or null together, in each row."""
    one = df.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"_{k}"), F.lit(True)).alias("identical")) for k, (a, b) in enumerate(pairs)))))


def twin_columns(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``a, b, all_null``: columns ``b`` equal to an earlier column ``a``, or null together
    with it, in each row; ``a`` is the first of its like.

    One pass sums hashes of row key and value for every column, in no order; columns whose
    sums meet are then compared row by row in a second pass, so equal sums alone name no
    twins.  Numbers of different types are compared as doubles, all else as text.
    """
    columns = [c for c in df.columns if c not in keys] if columns is None else columns

    def plain(c: str) -> Column:
        kind = dict(df.dtypes)[c].split("(")[0]
        v = F.col(f"`{c}`")
        return v.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else v.cast("string")

    def mark(c: str, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *(F.col(f"`{k}`") for k in keys), plain(c).isNull(), F.coalesce(plain(c).cast("string"), F.lit("")))

    sums = [F.sum(mark(c, seed).cast("decimal(38,0)")) for c in columns for seed in (0, 1)]
    one = df.agg(*sums, *(F.count(F.col(f"`{c}`")) for c in columns)).first()
    first: dict[tuple, list[str]] = {}
    for k, c in enumerate(columns):
        first.setdefault((one[2 * k], one[2 * k + 1]), []).append(c)
    pairs = [(a, b) for names in first.values() for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, all_null boolean")
    same = df.agg(*(F.coalesce(F.bool_and(plain(a).eqNullSafe(plain(b))), F.lit(True)) for a, b in pairs)).first()
    filled, found = dict(zip(columns, one[2 * len(columns) :], strict=True)), {}
    for (a, b), equal in zip(pairs, same, strict=True):
        if equal and a not in found:
            found.setdefault(b, a)
    return df.sparkSession.createDataFrame([(a, b, filled[b] == 0) for b, a in found.items()], "a string, b string, all_null boolean")


def twin_verdicts(twins: DataFrame, aliases: list[tuple[str, str, str]], measured: str) -> DataFrame:
    """Groups of twins with ``verdict`` and ``reason``: 'expected alias' where two of their
    names match the two patterns of one of ``aliases`` (pattern, pattern, why), 'BUG' where
    all match ``measured`` (different measurements cannot agree), else 'REVIEW'."""
    groups = twins.groupBy("a").agg(F.concat(F.array("a"), F.array_sort(F.collect_list("b"))).alias("names"), F.bool_and("all_null").alias("all_null"))

    def some(pattern: str) -> Column:
        return F.exists("names", lambda n: n.rlike(pattern))

    bug = F.forall("names", lambda n: n.rlike(measured))
    verdict, reason = F.when(bug, "BUG").otherwise("REVIEW"), F.when(bug, "different measurements agree in every row").otherwise("no known reason to be identical")
    for x, y, why in reversed(aliases):
        hit = some(x) & some(y)
        verdict, reason = F.when(hit, "expected alias").otherwise(verdict), F.when(hit, why).otherwise(reason)
    return groups.select(F.array_join("names", " == ").alias("group"), F.size("names").alias("n_columns"), "all_null", verdict.alias("verdict"), reason.alias("reason"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def share_outliers(shares: DataFrame, group: str, value: str, times: float = 3, least: float = 10, median_above: float = 0.5) -> DataFrame:
    """Rows whose share in percent is over ``times`` their group's median and ``least``,
    where that median is itself above ``median_above``."""
    middle = shares.groupBy(group).agg(F.median(value).alias("med"))
    return shares.join(middle, group).where((F.col(value) > times * F.col("med")) & (F.col(value) > least) & (F.col("med") > median_above))


def confounding(df: DataFrame, arm: str, factors: list[str]) -> DataFrame:
    """Per factor: levels, levels seen in one arm only, and whether all are (perfect)."""
    parts = []
    for f in factors:
        levels = df.groupBy(F.col(f).cast("string").alias("level")).agg(F.count_distinct(arm).alias("arms"))
        parts.append(levels.agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("arms") == 1).alias("one_arm")).select(F.lit(f).alias("factor"), "levels", "one_arm"))
    return reduce(DataFrame.union, parts).withColumn("perfect", F.col("levels") == F.col("one_arm"))


def within_batch(df: DataFrame, arm: Column, batch: str, least: int) -> DataFrame:
    """``batch, n_a, n_b, both``: units of either arm ('a', 'b'; others are left out) in a
    batch, and whether it holds at least ``least`` of both: only such a batch parts the
    arms from the batches."""
    rows = df.select(batch, arm.alias("_arm")).where(F.col("_arm").isin("a", "b") & ~is_placeholder(F.col(batch).cast("string")))
    sizes = rows.groupBy(batch).agg(F.count_if(F.col("_arm") == "a").alias("n_a"), F.count_if(F.col("_arm") == "b").alias("n_b"))
    return sizes.withColumn("both", (F.col("n_a") >= least) & (F.col("n_b") >= least))


def shared_levels(df: DataFrame, arm: Column, unit: str, level: str, least: int) -> DataFrame:
    """``level, in_a, in_b, shared``: units of either arm that have at least ``least`` rows
    at a level, and whether both arms have one there."""
    cells = df.select(arm.alias("_arm"), unit, level).where(F.col("_arm").isin("a", "b")).groupBy("_arm", unit, level).agg(F.count(F.lit(1)).alias("_n"))
    of = lambda x: F.count_if((F.col("_arm") == x) & (F.col("_n") >= least))
    return cells.groupBy(level).agg(of("a").alias("in_a"), of("b").alias("in_b")).withColumn("shared", (F.col("in_a") > 0) & (F.col("in_b") > 0))


def fingerprint(observed: DataFrame, expected: DataFrame, key: str, size: str, tolerance: int) -> DataFrame:
    """``key, observed, expected, ok`` of group sizes against those on record."""
    a, b = observed.select(key, F.col(size).alias("observed")), expected.select(key, F.col(size).alias("expected"))
    ok = F.abs(F.coalesce("observed", F.lit(0)) - F.coalesce("expected", F.lit(0))) <= tolerance
    return a.join(b, key, "full").withColumn("ok", ok)


def replicate_support(df: DataFrame, design: list[str], replicate: str, least: int, thin: int = 2) -> DataFrame:
    """Per cell of a design: replicates with at least ``least`` units; thin if under ``thin``."""
    sizes = df.groupBy(*design, replicate).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*design).agg(F.count_if(F.col("n") >= least).alias("replicates")).withColumn("thin", F.col("replicates") < thin)


def against_rest(df: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """Each unit's value against the mean of the others of its group."""
    w = Window.partitionBy(group)
    rest = F.try_divide(F.sum(value).over(w) - F.col(value), F.count(F.lit(1)).over(w) - 1)
    return df.select(group, unit, value, rest.alias("rest"))
