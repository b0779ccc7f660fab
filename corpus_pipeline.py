"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Every stage works on all that the one before it kept and returns the columns of
``documents``, but for the last, which returns the packed pieces.  The mixing stage
writes its rows in mixed order, and packing ranks documents by that order: of the pieces
of one length class those that come first are dealt first.

Defined results
    null texts are empty, and so rejected by the rules; a null ``doc_id`` is kept by the
    near-duplicate stage, and packed; rows that repeat a kept id all stay; a null source
    is the source ''; ties in the mixed order go to the smaller id; texts of any length
    are taken whole; extra columns pass through to the mixing stage, whatever their
    names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from lacuna.llm.runtime import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.apply_policy(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    cut = line_dedup.drop_lines(docs)
    changed = F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select(*(changed if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, sources interleaved to their target weights."""
    return mixing.mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, dealt in the mixed order."""
    return packing.pack(docs, place=packing.written_place(docs))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: The packing plan is a linear program's; SQL has no equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
