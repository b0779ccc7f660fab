"""A purity gate over clusters, clustered anew until no cluster is flagged.

Whole clusters are judged and not single cells: a cluster is a contaminant if its median
score for some lineage lies far above those of the other clusters and its best median
beats that of the anchor.  Flagged clusters are taken out, what is left is clustered
again, and so on; every cell ends with the round and the cluster that it left in, or the
last, and a ledger adds up to all cells.

A clustering is closed if a cluster depends on its own rows alone: what is left after whole
clusters went is clustered as before, so it is made once for all rounds.  Components of
nearest rows are closed, as every row's nearest are in its own cluster and go or stay with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import neighbours
from lacuna.operators.communities import communities
from lacuna.operators.graph import components, saved

NEIGHBOURS, MADS, MARGIN, ROUNDS = 15, 3.0, 0.0, 10


def cluster_purity(members: DataFrame, scores: DataFrame, anchor: str, mads: float = MADS, margin: float = MARGIN) -> DataFrame:
    """Per ``cluster``: ``n_cells, anchor, best`` (medians over its cells of the anchor's
    score and of the best other score), ``lineage`` (largest median), ``outliers`` and
    ``contaminant``.

    ``members`` has ``cell, cluster``, ``scores`` ``cell, lineage, score``.  A lineage is
    an outlier of a cluster whose median is positive and more than ``mads`` deviations
    above the middle of all clusters; without a median deviation the standard one counts.
    """
    rows = members.join(scores, "cell")
    best = rows.where(F.col("lineage") != anchor).groupBy("cluster", "cell").agg(F.max("score").alias("b")).groupBy("cluster").agg(F.median("b").alias("best"))
    medians = saved(rows.groupBy("cluster", "lineage").agg(F.median("score").alias("m")))
    others = medians.where(F.col("lineage") != anchor)
    middle = others.groupBy("lineage").agg(F.median("m").alias("mid"), F.stddev_pop("m").alias("sd"))
    mad = others.join(middle, "lineage").groupBy("lineage", "mid", "sd").agg(F.median(F.abs(F.col("m") - F.col("mid"))).alias("mad"))
    width = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    hit = (F.col("m") > F.col("mid") + mads * width) & (F.col("m") > 0)
    judged = others.join(mad, "lineage").groupBy("cluster").agg(
        F.min_by("lineage", F.struct(-F.col("m"), "lineage")).alias("lineage"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("lineage")))), ";").alias("outliers"),
    )
    own = medians.where(F.col("lineage") == anchor).select("cluster", F.col("m").alias("anchor"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    every = sizes.join(own, "cluster", "left").join(best, "cluster", "left").join(judged, "cluster", "left")
    flagged = (F.col("outliers") != "") & (F.col("best") > F.coalesce("anchor", F.lit(0.0)) + margin)
    return every.select("cluster", "n_cells", "anchor", "best", "lineage", F.coalesce("outliers", F.lit("")).alias("outliers"), F.coalesce(flagged, F.lit(False)).alias("contaminant"))


def neighbour_clusters(vectors: DataFrame, k: int = NEIGHBOURS, resolution: float = 1.0) -> DataFrame:
    """``cell, cluster``: communities of the graph of the ``k`` nearest rows of (id, v)."""
    near, _ = neighbours.search(vectors, neighbours.build(vectors), k)
    edges = near.select(F.least("q_id", "id").alias("a"), F.greatest("q_id", "id").alias("b")).distinct().withColumn("weight", F.lit(1.0))
    return communities(vectors.select(F.col("id").alias("node")), edges, resolution).select(F.col("node").alias("cell"), F.col("community").alias("cluster"))


def chained_clusters(vectors: DataFrame, k: int = 1) -> DataFrame:
    """``cell, cluster``: components of the graph of the ``k`` nearest rows, where a cheap
    clustering will do: a few rounds in place of many.  It is closed."""
    near, _ = neighbours.search(vectors, neighbours.build(vectors), k)
    found = components(vectors.select(F.col("id").alias("node")), near.select(F.col("q_id").alias("a"), F.col("id").alias("b")))
    return found.select(F.col("node").alias("cell"), F.col("component").alias("cluster"))


def purify(vectors: DataFrame, scores: DataFrame, anchor: str, cluster: Callable[[DataFrame], DataFrame] = neighbour_clusters, mads: float = MADS, margin: float = MARGIN, rounds: int = ROUNDS, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells with the ``cluster`` they ended in and the round they were ``removed`` in
    (null: kept), and a ledger: ``round, clusters, flagged, cells, removed, settled``.

    ``vectors`` has ``id, v``.  Rounds end when none is flagged or nothing would be left;
    the last row of the ledger tells whether that was before ``rounds`` were over.
    ``closed`` tells that ``cluster`` is.
    """
    left = saved(vectors.select("id", "v"))
    gone, ledger, members = None, [], None
    for turn in range(1, rounds + 1):
        if members is None or not closed:
            members = saved(cluster(left))
        judged = saved(cluster_purity(members, scores, anchor, mads, margin))
        clusters, flagged, cells, out = judged.agg(F.count(F.lit(1)), F.count_if("contaminant"), F.sum("n_cells"), F.coalesce(F.sum(F.when(F.col("contaminant"), F.col("n_cells"))), F.lit(0))).first()
        clean = not flagged or out == cells
        ledger.append((turn, clusters, flagged, cells or 0, 0 if clean else out, clean))
        if clean:
            break
        bad = judged.where("contaminant").select("cluster")
        part = members.join(bad, "cluster", "left_semi").select("cell", "cluster", F.lit(turn).alias("removed"))
        gone = part if gone is None else gone.union(part)
        members = members.join(bad, "cluster", "left_anti")
        if closed:
            members = saved(members)
        else:
            left = saved(left.join(members.select(F.col("cell").alias("id")), "id", "left_semi"))
    kept = members.select("cell", "cluster", F.lit(None).cast("int").alias("removed"))
    every = kept if gone is None else kept.union(gone)
    return every, vectors.sparkSession.createDataFrame(ledger, "round int, clusters long, flagged long, cells long, removed long, settled boolean")
