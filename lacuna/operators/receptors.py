"""Receptor chains per unit, and doublet scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import doublets
from lacuna.operators.matrix import knn

# The chains of the two receptor kinds.
PAIRS = (("TRA", "TRB"), ("TRG", "TRD"))


def chain_qc(contigs: DataFrame, cell: list[str]) -> DataFrame:
    """``receptor_subtype`` and ``chain_pairing`` of each unit with a productive chain."""
    n = {c: F.count_if(F.col("chain") == c) for pair in PAIRS for c in pair}
    counts = contigs.where("productive").groupBy(*cell).agg(*(v.alias(c) for c, v in n.items()))
    a, b, g, d = (F.col(c) for pair in PAIRS for c in pair)

    def kind(x, y, names):
        return F.when((x > 0) & (y > 0), "+".join(names)).when(x > 0, names[0]).when(y > 0, names[1])

    subtype = F.when((a + b > 0) & (g + d > 0), "ambiguous").otherwise(F.coalesce(kind(a, b, PAIRS[0]), kind(g, d, PAIRS[1]), F.lit("none")))
    most = F.greatest(a, b, g, d)
    paired = ((a == 1) & (b == 1) & (g + d == 0)) | ((g == 1) & (d == 1) & (a + b == 0))
    pairing = F.when(most > 2, "multichain").when(most > 1, "extra").when(a + b + g + d == 1, "orphan").when(paired, "single pair").otherwise("mixed")
    return counts.select(*cell, subtype.alias("receptor_subtype"), pairing.alias("chain_pairing"))


def doublet_scores(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``id, score``: the share of synthetic doublets among the k nearest neighbours.

    A doublet is the mean of a row and the one that follows it in hash order in its pool
    of the batch, the same at every run.
    """
    made = doublets.pairs(vectors.select(F.col("id").alias("cell"), F.col("batch").alias("library")), ratio=1)
    ends = [made.select("a", "b").join(vectors.select(F.col("id").alias("a"), F.col("v").alias("v")), "a"), vectors.select(F.col("id").alias("b"), F.col("v").alias("w"))]
    made = ends[0].join(ends[1], "b").select((-F.col("a") - 1).alias("id"), F.zip_with("v", "w", lambda a, b: ((a + b) / 2).cast("float")).alias("v"))
    near = knn(vectors, vectors.select("id", "v").union(made), k)
    return near.groupBy(F.col("q_id").alias("id")).agg(F.round(F.count_if(F.col("id") < 0) / F.lit(float(k)), 6).alias("score"))
