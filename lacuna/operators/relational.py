"""Frame-to-frame operators: joins, crosstabs, dominant labels, set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows, counted first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with a default for what is missing."""
    joined = df.join(dim, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def ranked_lookup(df: DataFrame, tiers: Sequence[tuple[str, DataFrame, list[str], str]], out: str, source: str, missing: str) -> DataFrame:
    """The value of the first tier that has one, and which tier it was.

    A tier is ``(name, frame, keys, value column)``.
    """
    joined, found = df, []
    for k, (name, dim, keys, value) in enumerate(tiers):
        joined = joined.join(dim.select(*keys, F.col(value).alias(f"_t{k}")), keys, "left")
        found.append((name, f"_t{k}"))
    label = None
    for name, c in found:
        label = F.when(F.col(c).isNotNull(), name) if label is None else label.when(F.col(c).isNotNull(), name)
    return joined.withColumn(out, F.coalesce(*(F.col(c) for _, c in found))).withColumn(source, label.otherwise(missing)).drop(*(c for _, c in found))


def resolve_tags(wanted: DataFrame, names: DataFrame, tag: str = "tag", name: str = "name", separator: str = "_") -> DataFrame:
    """``tag, name, rank`` of every wanted tag: the name that equals it ('exact'), else the
    first in order whose part before the separator does ('stem'), else the first that
    begins with it ('prefix'), else none ('missing').

    Beginnings are cut to the lengths that tags have, so all three are equi-joins.
    """
    tags = wanted.select(F.col(tag).alias("t")).where("t IS NOT NULL").distinct()
    known = names.select(F.col(name).alias("n")).where("n IS NOT NULL").distinct()
    lengths = tags.where("t <> ''").agg(F.collect_set(F.length("t")).alias("ks"))  # one row
    cut = known.join(F.broadcast(lengths)).select("n", F.explode(F.filter("ks", lambda k: k <= F.length("n"))).alias("k"))
    begins = cut.groupBy(F.substring("n", F.lit(1), F.col("k")).alias("t")).agg(F.min("n").alias("prefix"))
    stems = known.groupBy(F.substring_index("n", separator, 1).alias("t")).agg(F.min("n").alias("stem"))
    found = tags.join(known.select(F.col("n").alias("t"), F.col("n").alias("exact")), "t", "left").join(stems, "t", "left").join(begins, "t", "left")
    rank = F.when(F.col("exact").isNotNull(), "exact").when(F.col("stem").isNotNull(), "stem").when(F.col("prefix").isNotNull(), "prefix").otherwise("missing")
    return found.select(F.col("t").alias(tag), F.coalesce("exact", "stem", "prefix").alias(name), rank.alias("rank"))


def best_per_key(df: DataFrame, keys: list[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return numbered.drop("_n") if rank is None else numbered.withColumnRenamed("_n", rank)


def dominant(df: DataFrame, by: list[str], label: str, rank: int = 1) -> DataFrame:
    """``by, label, n, share``: the rank-th most frequent label, ties by label."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return counts.where(F.col("_n") == rank).drop("_n")


def crosstab(df: DataFrame, a: str, b: str, margins: bool = False) -> DataFrame:
    """Counts in long form; with ``margins`` 'TOTAL' rows, columns and corner."""
    if not margins:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cube = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return cube.select(F.when(F.col("_a") == 1, "TOTAL").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "TOTAL").otherwise(F.col(b)).alias(b), "n")


def normalised(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """A crosstab as shares of the ``by`` margin."""
    return crosstab(df, a, b).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def spread(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Per row: largest less smallest value, and the columns they are in (ties by name)."""
    high, low = F.max(F.struct(F.col(value), F.lit(0))).getField(value), F.min(value)
    ordered = df.groupBy(row).agg(
        high.alias("high"), low.alias("low"),
        F.min(F.struct((-F.col(value)).alias("v"), F.col(column).alias("c"))).getField("c").alias("high_in"),
        F.min(F.struct(F.col(value).alias("v"), F.col(column).alias("c"))).getField("c").alias("low_in"),
    )
    return ordered.withColumn("spread", F.col("high") - F.col("low"))


def threshold_sweep(df: DataFrame, value: str, thresholds: Sequence[float], by: list[str] | None = None) -> DataFrame:
    """Rows at or above each threshold: one pass, one counter per threshold."""
    counted = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("of"), *(F.count_if(F.col(value) >= t).alias(f"_t{k}") for k, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{k}").alias("n")) for k, t in enumerate(thresholds)))
    return counted.select(*(by or []), "of", F.inline(rows))


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each key of either side with ``side``: both, a only, b only."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "a only").otherwise("b only")
    return left.join(right, keys, "full").select(*keys, side.alias("side"))


def write_back(whole: DataFrame, part: DataFrame, keys: list[str], columns: Sequence[str], prefix: str = "") -> DataFrame:
    """The part's columns laid over the whole at matching keys; others keep their own."""
    new = part.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = whole.join(new, keys, "left")
    for c in columns:
        target = f"{prefix}{c}"
        own = F.col(target) if target in whole.columns else F.lit(None)
        joined = joined.withColumn(target, F.coalesce(F.col(f"_new_{c}"), own))
    return joined.drop(*(f"_new_{c}" for c in columns))


def set_text(c: Column, default: str = "") -> Column:
    """A group's distinct values as sorted text joined by ';'."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ";"), F.lit("")), F.lit(default))


def private_to(df: DataFrame, element: str, group: str) -> DataFrame:
    """``element, owner``: elements seen in one group only."""
    return df.groupBy(element).agg(F.min(group).alias("owner"), F.max(group).alias("_hi")).where("owner = _hi").drop("_hi")


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``stage, turn, n`` of ordered stages."""
    out = None
    for turn, (name, df) in enumerate(stages):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), F.lit(turn).alias("turn"), "n")
        out = row if out is None else out.union(row)
    return out


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty: for lookups that must not come up empty."""
    if df.isEmpty():
        raise LookupError(f"no rows: {what}")
    return df
