"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset (tests, notebooks).
LOCAL_SCRATCH = "/tmp/checkpoints/lacuna"
#: Default and our batch size for rows handed to Python: whole texts are long.
ARROW_ROWS_DEFAULT, ARROW_ROWS = "10000", "256"

#: Words are runs of anything but ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(base)
    return base.rstrip("/")


_swept: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application's, which goes when the session ends."""
    own = f"{scratch_dir(spark)}/lacuna/{spark.sparkContext.applicationId}"
    if own not in _swept:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _swept.add(own)
    return f"{own}/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor without
    running the part before it again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch handed to Python, unless the session sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, ARROW_ROWS_DEFAULT) == ARROW_ROWS_DEFAULT:
        spark.conf.set(key, ARROW_ROWS)


def trimmed(run):
    """``run`` over Arrow batches, after which the worker gives back the memory it has
    freed: idle workers live on beside the stages that follow."""

    def then_trim(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass

    return then_trim


#: Keys that are broadcast as hot: fewer than this, as each has a larger share of the rows
#: than one in as many.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, how: str = "inner", few: int = 0) -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row for a key and in the column
    ``n`` how many rows have that key.

    A lookup of at most ``few`` rows is broadcast.  Else its hot keys alone are, whose
    rows then stay where they are, and the rows of the other keys are shuffled, none of
    them more than 1 / ``HOT_KEYS`` of all.  ``rows`` is read twice, so give a scan or
    what is stashed; ``lookup`` should be stashed too.
    """
    keyed, total = lookup.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    if keyed <= few:
        return rows.join(F.broadcast(lookup), keys, how)
    limit = total // HOT_KEYS
    hot = F.broadcast(lookup.where(F.col(n) > limit))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.where(F.col(n) <= limit), keys, how)
    return rows.join(hot, keys).unionByName(cold)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
