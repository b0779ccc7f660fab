"""The stateless read matcher over a stream of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.sequences import between_flanks

COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def reverse_complement(s: str) -> str:
    return s.translate(COMPLEMENT)[::-1]


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").load(folder)


def flanked_cores(lines: DataFrame, left: str, right: str, size: int) -> DataFrame:
    """``seq, core`` of the lines that hold a core between its flanks on either strand.

    One line at a time, so the same on a stream and on a table.
    """
    cheap = F.col("value").contains(left) | F.col("value").contains(reverse_complement(left))
    found = lines.where(cheap).select(F.col("value").alias("seq"), between_flanks(F.col("value"), left, right, size).alias("core"))
    return found.where("core <> ''")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended to Parquet, each file once."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
