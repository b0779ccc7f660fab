"""What reads are made of: probe groups and controls, layout, and the lists they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import sequences as Q
from lacuna.operators.relational import small


def confident_reads(hits: DataFrame, by: list[str], read: str, anchors: int = 2) -> DataFrame:
    """``by, target, orientation, reads``: reads that hold a whole probe of the group or at
    least ``anchors`` different anchors of it.

    ``hits`` has a row for each place of a probe: ``by``, the read, ``probe``, ``target``,
    ``orientation`` and ``kind`` ('full' or 'anchor').
    """
    group = [*by, "target", "orientation"]
    held = hits.groupBy(*group, read).agg(F.bool_or(F.col("kind") == "full").alias("full"), F.count_distinct(F.when(F.col("kind") == "anchor", F.col("probe"))).alias("n"))
    return held.where(F.col("full") | (F.col("n") >= anchors)).groupBy(*group).agg(F.count(F.lit(1)).alias("reads"))


def offset_summary(hits: DataFrame, by: list[str], probe: str = "probe") -> DataFrame:
    """``by, probe, hits, offsets, mode, at_mode``: the most frequent place of each probe
    (ties: the first) and the share of its hits there."""
    counts = hits.groupBy(*by, probe, "offset").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("offset", "n"), F.struct((-F.col("n")).alias("less"), F.col("offset").alias("offset")))
    found = counts.groupBy(*by, probe).agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("offsets"), best.alias("b"))
    return found.select(*by, probe, "hits", "offsets", F.col("b.offset").alias("mode"), (F.col("b.n") / F.col("hits")).alias("at_mode"))


def control_verdict(hits: Column, at_mode: Column, least: int, share: float) -> Column:
    """'absent', 'fixed' or 'scattered': whether a control stands where it should."""
    return F.when(F.coalesce(hits, F.lit(0)) < least, "absent").when(at_mode >= share, "fixed").otherwise("scattered")


def block_entropy(reads: DataFrame, by: list[str], block: int, read: str = "seq") -> DataFrame:
    """``by, block, entropy, letters``: the mean over the places of a block of the entropy
    in bits of the letters there, and how many letters were seen."""
    places = reads.select(*by, F.posexplode(F.split(read, "")).alias("place", "letter")).where("letter <> ''")
    counts = places.groupBy(*by, "place", "letter").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "place").agg(F.sum("n").alias("of"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.greatest(F.lit(0.0), F.log2("of") - F.col("s") / F.col("of"))
    return totals.withColumn("block", F.expr(f"CAST(place div {block} AS INT)")).groupBy(*by, "block").agg(F.avg(bits).alias("entropy"), F.sum("of").alias("letters"))


def list_orientation(reads: DataFrame, listed: DataFrame, by: list[str], size: int, read: str = "seq") -> DataFrame:
    """``by, reads, forward, reverse, orientation``: how many reads begin with a listed
    word of ``size`` letters as it is, and with its reverse complement; what prevails."""
    words = listed.select("word").distinct()
    turned = words.select(Q.revcomp(F.col("word")).alias("_r")).distinct()
    starts = reads.where(F.length(read) >= size).select(*by, F.substring(read, 1, size).alias("_w"))
    counts = starts.groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(small(words.select(F.col("word").alias("_w"), F.lit(1).alias("_f"))), "_w", "left").join(small(turned.select(F.col("_r").alias("_w"), F.lit(1).alias("_b"))), "_w", "left")
    sums = met.groupBy(*by).agg(F.sum("n").alias("reads"), F.sum(F.col("n") * F.coalesce("_f", F.lit(0))).alias("forward"), F.sum(F.col("n") * F.coalesce("_b", F.lit(0))).alias("reverse"))
    kind = F.when(F.col("forward") > F.col("reverse"), "forward").when(F.col("reverse") > F.col("forward"), "reverse").otherwise("either")
    return sums.withColumn("orientation", kind)


def usual_length(reads: DataFrame, by: list[str], read: str = "seq") -> DataFrame:
    """``by, len``: the most frequent length of reads (ties: the longest)."""
    counts = reads.groupBy(*by, F.length(read).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    turn = Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("len"))
    return counts.withColumn("_n", F.row_number().over(turn)).where("_n = 1").select(*by, F.col("len").cast("long").alias("len"))
