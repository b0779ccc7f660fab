"""Subtype calls of clusters from panel means: families, margins, splits, votes, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.relational import best_per_key, dominant

UNRESOLVED = "Unresolved"


def family_means(means: DataFrame, by: str, panel: str, value: str, families: dict[str, list[str]]) -> DataFrame:
    """``by, family, value``: panels of a family give their mean, others are their own."""
    family = F.col(panel)
    for name, members in families.items():
        family = F.when(F.col(panel).isin(members), name).otherwise(family)
    return means.groupBy(by, family.alias("family")).agg(F.avg(value).alias("value"))


def call(families: DataFrame, by: str, least_margin: float) -> DataFrame:
    """``by, top, runner_up, margin, top_range, subtype``: the highest family (ties by
    name), unresolved unless it is above 0 and ``least_margin`` above the next.

    ``top_range`` is how far the winning family's means lie apart over all clusters.
    """
    best = best_per_key(families, [by], [F.desc("value"), F.col("family")], 2, "k")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    margin = pick("value", 1) - pick("value", 2)
    calls = best.groupBy(by).agg(pick("family", 1).alias("top"), pick("family", 2).alias("runner_up"), margin.alias("margin"), pick("value", 1).alias("_v"))
    ranges = families.groupBy(F.col("family").alias("top")).agg((F.max("value") - F.min("value")).alias("top_range"))
    sure = (F.col("_v") > 0) & (F.coalesce("margin", F.lit(float("inf"))) >= least_margin)
    return calls.join(ranges, "top").select(by, "top", "runner_up", "margin", "top_range", F.when(sure, F.col("top")).otherwise(UNRESOLVED).alias("subtype"))


def split(calls: DataFrame, means: DataFrame, by: str, panel: str, value: str, family: str, high: tuple[str, str], low: tuple[str, str], threshold: float) -> DataFrame:
    """``calls`` with ``skew``, the mean of one panel less that of another, and clusters
    of ``family`` renamed where it is at least ``threshold`` to either side.

    ``high`` and ``low`` are ``(panel, label)``.
    """
    of = lambda p: F.coalesce(F.sum(F.when(F.col(panel) == p, F.col(value))), F.lit(0.0))
    skew = means.groupBy(by).agg((of(high[0]) - of(low[0])).alias("skew"))
    hit = F.col("subtype") == family
    label = F.when(hit & (F.col("skew") >= threshold), high[1]).when(hit & (F.col("skew") <= -threshold), low[1]).otherwise(F.col("subtype"))
    return calls.join(skew, by, "left").withColumn("subtype", label)


def votes(scores: DataFrame, by: str, unit: str, panel: str, value: str) -> DataFrame:
    """``by, vote, dominant_frac``: each unit votes for its highest panel (ties by name)."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(panel).alias("p")))["p"]
    cast = scores.groupBy(by, unit).agg(best.alias("vote"))
    return dominant(cast, [by], "vote").select(by, "vote", F.col("share").alias("dominant_frac"))


def overridden(calls: DataFrame, flags: DataFrame, by: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """``calls`` with the first quality rule that a cluster's ``flags`` meet in place of its
    subtype."""
    label = F.col("subtype")
    for rule, name in reversed(rules):
        label = F.when(rule, name).otherwise(label)
    return calls.join(flags, by, "left").withColumn("subtype", label)
