"""Communities of a weighted graph by modularity: moves, refinement, contraction.

Nodes move to the neighbouring community that raises modularity most until none can; each
community is then refined, from single nodes, into parts that hang together; parts become
the nodes of a smaller graph, which starts from the communities found; and so on until
nothing joins.  Communities left in several pieces are parted at the end, which never
lowers modularity.

Moves are made side by side, yet each round raises modularity.  A community either takes
nodes in a round or gives some, whichever its best wish asks.  A wish is granted if its
gain is still positive after all better wishes into the same community and out of the same
community: what those add to the one and take from the other is summed in order, while
edges between movers, which could only help, are left out.  The best wish of all is always
granted.  At most ``BUCKETS`` wishes for a community are summed in one round (the best of
each bucket of nodes); the others wish again in the next.

Weights are whole multiples of 1 / ``UNIT``, so sums do not depend on their order and the
same graph gives the same communities at every run and partitioning.  Every round is a few
shuffled joins and sums of edges by node and community, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import components, saved

UNIT = 1 << 20
BUCKETS = 1024
#: Least gain, against all edges of the node: below it a double cannot tell.
LEAST = 1e-12


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, w`` both ways, weights in units; repeated edges add up, loops stay single."""
    w = F.round(F.col("weight") * UNIT).cast("long")
    rows = edges.select("a", "b", w.alias("w")).where("w > 0")
    both = rows.union(rows.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, node: str = "node", label: str = "community") -> DataFrame:
    """One row: ``modularity`` of the labelled nodes, and how many communities there are."""
    both = undirected(edges)
    at = labels.select(F.col(node).alias("a"), F.col(label).alias("c"))
    ends = both.join(at, "a").join(at.select(F.col("a").alias("b"), F.col("c").alias("d")), "b")
    twice = F.col("w") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    parts = ends.groupBy("c").agg(F.sum(twice).alias("k"), F.sum(F.when(F.col("c").eqNullSafe(F.col("d")), twice).otherwise(0)).alias("inside"))
    known = at.select("c").distinct().join(parts, "c", "left").select(F.coalesce("k", F.lit(0)).cast("double").alias("k"), F.coalesce("inside", F.lit(0)).cast("double").alias("inside"))
    sums = known.agg(F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("k").alias("m2"), F.count(F.lit(1)).alias("communities"))
    share = F.try_divide(F.col("i"), F.col("m2")) - F.lit(resolution) * F.try_divide(F.col("kk"), F.col("m2") * F.col("m2"))
    return sums.select("communities", F.coalesce(share, F.lit(0.0)).alias("modularity"))


def _granted(wishes: DataFrame, resolution: float, least: float, turn: int) -> DataFrame:
    """``v, goal`` of the wishes ``v, c, goal, k, g`` that are granted.

    Wishes of equal gain are in the order of a hash that changes with the round: in the
    order of nodes, a chain of equals would grant one wish in a round.
    """
    drawn = F.xxhash64("v", F.lit(turn), F.lit("draw"))
    key = F.struct("g", drawn.alias("_draw"), "v")
    roles = wishes.groupBy(F.col("goal").alias("c")).agg(F.max(key).alias("into")).join(wishes.groupBy("c").agg(F.max(key).alias("out")), "c", "full")
    taking = roles.where("out IS NULL OR into > out").select(F.col("c").alias("goal"))
    asked = wishes.join(taking, "goal", "left_semi").join(taking.select(F.col("goal").alias("c")), "c", "left_anti")
    bucket = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(BUCKETS))

    def best(rows: DataFrame, side: str, more: str) -> DataFrame:
        one = rows.groupBy(side, bucket.alias("_b")).agg(F.max(F.struct("g", drawn.alias("_draw"), "v", "k", "c", "goal", *(["joined"] if "joined" in rows.columns else []))).alias("r")).select("r.*")
        ahead = F.sum("k").over(Window.partitionBy(side).orderBy(F.desc("g"), F.desc("_draw"), F.desc("v")).rowsBetween(Window.unboundedPreceding, -1))
        return one.withColumn(more, F.coalesce(ahead, F.lit(0)))

    held = best(best(asked, "goal", "joined"), "c", "left")
    sure = F.col("g") - F.lit(resolution) * F.col("k") * (F.col("joined") + F.col("left")).cast("double") > F.lit(least) * F.col("k")
    return held.where(sure).select("v", "goal")


def _settle(edges: DataFrame, at: DataFrame, m2: int, resolution: float, alone: bool) -> DataFrame:
    """``v, c, k`` after moves along ``edges`` until no wish is left; ``alone``: only nodes
    that are the whole of their community move."""
    turn = 0
    while True:
        totals = at.groupBy("c").agg(F.sum("k").alias("kc"), F.count(F.lit(1)).alias("n"))
        to = edges.join(at.select(F.col("v").alias("b"), F.col("c").alias("goal")), "b").groupBy(F.col("a").alias("v"), "goal").agg(F.sum("w").alias("w"))
        mine = at.join(totals, "c")
        mine = mine.where("n = 1") if alone else mine
        own = to.select("v", F.col("goal").alias("c"), F.col("w").alias("own"))
        mine = mine.join(own, ["v", "c"], "left").select("v", "c", "k", "kc", F.coalesce("own", F.lit(0)).alias("own"))
        met = to.join(mine, "v").where("goal <> c").join(totals.select(F.col("c").alias("goal"), F.col("kc").alias("kg")), "goal")
        gain = F.lit(float(m2)) * (F.col("w") - F.col("own")) - F.lit(resolution) * F.col("k") * (F.col("kg") - F.col("kc") + F.col("k")).cast("double")
        found = met.withColumn("g", gain).where(F.col("g") > F.lit(LEAST * m2) * F.col("k"))
        wishes = saved(found.groupBy("v", "c", "k").agg(F.min(F.struct((-F.col("g")).alias("less"), F.col("goal").alias("goal"))).alias("w")).select("v", "c", "k", F.col("w.goal").alias("goal"), (-F.col("w.less")).alias("g")))
        if wishes.isEmpty():
            return at
        moves = _granted(wishes, resolution, LEAST * m2, turn)
        at = saved(at.join(moves, "v", "left").select("v", F.coalesce("goal", "c").alias("c"), "k"))
        turn += 1


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, node: str = "node") -> DataFrame:
    """``node, community``: communities hang together and bear the name of their smallest
    node.

    ``edges`` has ``a, b, weight`` in either direction; weights that are null or not
    positive are no edges; ends outside ``nodes`` are left out.
    """
    known = nodes.select(F.col(node).alias("v")).where("v IS NOT NULL").distinct()
    known = saved(known)
    inside = edges.join(known.select(F.col("v").alias("a")), "a", "left_semi").join(known.select(F.col("v").alias("b")), "b", "left_semi")
    whole = saved(undirected(inside))
    degree = whole.groupBy(F.col("a").alias("v")).agg(F.sum(F.col("w") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("k"))
    at = saved(known.join(degree, "v", "left").select("v", F.col("v").alias("c"), F.coalesce("k", F.lit(0)).cast("long").alias("k")))
    m2 = at.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    level, members = whole.where("a <> b"), at.select("v", F.col("v").alias("part"))
    while m2:
        at = _settle(level, at, m2, resolution, alone=False)
        left = at.select("v", "c")
        n, groups = at.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
        if groups == n:
            break
        home = level.join(left.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(left.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        parts = _settle(saved(home.where("ca = cb").select("a", "b", "w")), at.select("v", F.col("v").alias("c"), "k"), m2, resolution, alone=True)
        parts = saved(parts.select("v", F.col("c").alias("s"), "k").join(left, "v"))
        if parts.agg(F.count_distinct("s")).first()[0] == n:
            break
        end = parts.select("v", "s")
        level = level.join(end.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(end.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
        level = saved(level.where("sa <> sb").groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg(F.sum("w").alias("w")))
        members = saved(members.join(end.select(F.col("v").alias("part"), "s"), "part").select("v", F.col("s").alias("part")))
        at = saved(parts.groupBy(F.col("s").alias("v"), "c").agg(F.sum("k").alias("k")))
    labels = saved(members.join(at.select(F.col("v").alias("part"), "c"), "part").select("v", "c"))
    ends = whole.where("a < b").join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    return components(labels, ends.where("ca = cb").select("a", "b"), "v").select(F.col("v").alias(node), F.col("component").alias("community"))
