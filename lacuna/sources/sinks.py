"""Writers: one-file CSV, stamped Parquet checkpoints, partitioned lists, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import saved


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header in the folder ``path``, a file for each task; the rows written."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).csv(path).count()


class RecipeDrift(ValueError):
    pass


def write_checkpoint(df: DataFrame, path: str, recipe: dict[str, object]) -> None:
    """Parquet with the recipe that made it beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(recipe.items())]
    df.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/recipe")


def recipe_drift(spark: SparkSession, path: str, recipe: dict[str, object]) -> DataFrame:
    """``key, stored, wanted`` where the stored recipe is not the wanted one."""
    stored = spark.read.parquet(f"{path}/recipe").withColumnRenamed("value", "stored")
    wanted = spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in recipe.items()], "key string, wanted string")
    return stored.join(wanted, "key", "full").where(~F.col("stored").eqNullSafe(F.col("wanted")))


def read_checkpoint(spark: SparkSession, path: str, recipe: dict[str, object]) -> DataFrame:
    """The checkpoint, if it was made by this recipe; else an error naming what drifted."""
    if drift := recipe_drift(spark, path, recipe).collect():
        raise RecipeDrift("; ".join(f"{r.key}: stored {r.stored}, wanted {r.wanted}" for r in drift))
    return spark.read.parquet(f"{path}/data")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder per combination of ``by``, rows of a folder written by few tasks."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_headed(df: DataFrame, head: list[str], path: str) -> None:
    """The column ``value`` as lines, each file of the folder beginning with ``head``."""

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    write_lines(df.select("value").mapInArrow(with_head, "value string"), path)


def write_matrix(coo: DataFrame, path: str) -> None:
    """MatrixMarket files of ``i, j, value`` (1-based): each has the head of the whole."""
    coo = saved(coo)  # counted for the head, then written
    rows, columns, n = coo.agg(F.max("i"), F.max("j"), F.count(F.lit(1))).first()
    write_headed(coo.select(F.concat_ws(" ", "i", "j", "value").alias("value")), ["%%MatrixMarket matrix coordinate real general", f"{rows or 0} {columns or 0} {n}"], path)


def write_numbered(df: DataFrame, path: str) -> None:
    """``line, value`` as one file whose lines are numbered from 0, gaps as empty lines:
    names by line number are one file in their format."""
    turn = Window.orderBy("line")
    after, before = F.lead("line").over(turn), F.when(F.isnull(F.lag("line").over(turn)), F.col("line")).otherwise(0)
    gaps = F.concat(F.repeat(F.lit("\n"), before.cast("int")), "value", F.repeat(F.lit("\n"), (F.coalesce(after, F.col("line") + 1) - F.col("line") - 1).cast("int")))
    write_lines(df.select(gaps.alias("value"), "line").orderBy("line").coalesce(1), path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """``turn, value``: the Markdown lines of a table, all rows, a cell's bars escaped."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "turn int, value string")
    cells = (F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns)
    return head.union(df.select(F.lit(2).alias("turn"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")))


def write_markdown(title: str, sections: list[tuple[str, DataFrame]], path: str) -> None:
    """A report of whole tables as lines of text in the folder ``path``, in order.

    Rows are written by the executors and never collected, whatever their number.
    """
    spark, lines = sections[0][1].sparkSession, None
    for k, (head, df) in enumerate(sections):
        top = [(0, f"# {title}"), (1, "")] if k == 0 else []
        rows = spark.createDataFrame([*top, (2, f"## {head}"), (3, "")], "turn int, value string")
        rows = rows.union(markdown_rows(df).withColumn("turn", F.col("turn") + 4)).union(spark.createDataFrame([(9, "")], "turn int, value string"))
        rows = rows.withColumn("section", F.lit(k))
        lines = rows if lines is None else lines.union(rows)
    lines.orderBy("section", "turn", "value").select("value").write.mode("overwrite").text(path)
