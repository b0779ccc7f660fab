"""Graphs as edge tables: set similarity, components, label propagation, shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints/lacuna"


_swept: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share; it
    goes when the session ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    own = f"{base.rstrip('/')}/lacuna/core-{spark.sparkContext.applicationId}"
    if own not in _swept:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _swept.add(own)
    return f"{own}/{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_overlaps(members: DataFrame, set_id: str, item: str) -> DataFrame:
    """``a, b, shared, n_a, n_b, jaccard, overlap`` of the sets that share an item.

    Counted by an equi-join on items, so pairs that share nothing are never made.
    """
    rows = members.select(F.col(set_id).alias("s"), F.col(item).alias("i")).distinct()
    rows = rows.join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s")
    left, right = rows.select(F.col("s").alias("a"), "i", F.col("n").alias("n_a")), rows.select(F.col("s").alias("b"), "i", F.col("n").alias("n_b"))
    met = left.join(right, "i").where("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    return met.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).withColumn("overlap", F.col("shared") / F.least("n_a", "n_b"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``node, component``: the smallest node reachable, by min-label rounds that also
    follow each label one step further."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(nodes.select(F.col(node).alias("a"), F.col(node).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a", "left").select("a", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = step.select(F.col("a").alias("label"), F.col("label").alias("jump"))
        moved = saved(step.join(ahead, "label").select("a", "was", F.least("label", "jump").alias("label")))
        if moved.where("label <> was").isEmpty():
            return moved.select(F.col("a").alias(node), F.col("label").alias("component"))
        labels = moved.select("a", "label")


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 100, node: str = "node") -> DataFrame:
    """``node, label, settled``: in each round a node takes the label with the most edge
    weight around it (its own counts once), ties to the smallest label.

    Rounds end when no label changes (``settled``), or when labels are again those of two
    rounds before, as they then alternate for ever, or after ``rounds``.
    """
    both = saved(edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = saved(nodes.select(F.col(node).alias("a"), F.col(node).alias("label"), F.lit(None).cast(nodes.schema[node].dataType).alias("before")))
    settled = False
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("a").alias("b"), "label"), "b").select("a", "label", "weight").union(labels.select("a", "label", F.lit(1.0).alias("weight")))
        summed = votes.groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = summed.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("less"), "label")).getField("label").alias("new"))
        moved = saved(labels.join(best, "a"))
        changed, other = moved.agg(F.count_if(F.col("new") != F.col("label")), F.count_if(~F.col("new").eqNullSafe(F.col("before")))).first()
        labels = moved.select("a", F.col("new").alias("label"), F.col("label").alias("before"))
        settled = not changed
        if settled or not other:
            break
    return labels.select(F.col("a").alias(node), "label", F.lit(settled).alias("settled"))
