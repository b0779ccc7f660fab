"""Ranks over a whole table, by ranges of rows instead of one window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import saved
from lacuna.operators.relational import small


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null meets null; keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys))
    return left.join(renamed, met, how).drop(*(f"_r_{c}" for c in keys))


def global_rank(df: DataFrame, column: str, ties: list[str], out: str) -> DataFrame:
    """``df`` with the row's place, from 1, in the order of ``column`` and ``ties``.

    Rows are dealt into ranges of both, so that one frequent value of ``column`` is many
    ranges too, and counted within them.
    """
    order = [column, *ties]
    dealt = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits are the number of the range, the others the place in it.
    cut = dealt.withColumn("_range", F.shiftright("_at", 33))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_in"))
    before = sizes.select("_range", (F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return cut.join(small(before), "_range").withColumn(out, F.col("_before") + inside).drop("_range", "_at", "_before")


def ntile(df: DataFrame, n: int, column: str, ties: list[str], out: str) -> DataFrame:
    """``df`` with ``n`` tiles in that order, the first ones a row larger if need be."""
    every = df.agg(F.count(F.lit(1)).alias("_all"))
    ranked = global_rank(df, column, ties, "_rank").join(F.broadcast(every))
    k, least, more = F.col("_rank") - 1, F.expr(f"_all div {n}"), F.col("_all") % n
    edge = more * (least + 1)
    late = F.try_divide(k - edge, least)
    return ranked.withColumn(out, (F.when(k < edge, F.floor(k / (least + 1))).otherwise(more + F.floor(late)) + 1).cast("int")).drop("_all", "_rank")
