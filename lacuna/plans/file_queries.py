"""Queries that write a table as files of a format and read the files back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators.graph import scratch
from lacuna.plans.basic import STATUS
from lacuna.plans.bindings import ALN, READS, alignments, coo, reads
from lacuna.plans.registry import ORACLE, query
from lacuna.sources import fastq_source, sinks
from lacuna.sources import text_formats as T


@query("sc3b_matrix_files", ORACLE["sc3_coordinate_lines"])
def sc3b(t):
    """A matrix, its features and its barcodes as files of lines; numbers are lines."""
    path = scratch(t.spark, "matrix")
    sinks.write_matrix(coo(t).select((F.col("gene") + 1).alias("i"), (F.col("cell") + 1).alias("j"), "value"), f"{path}/matrix")
    sinks.write_numbered(t.customer.select(F.col("c_custkey").alias("line"), F.concat(F.lit("c"), "c_custkey").alias("value")), f"{path}/barcodes")
    sinks.write_numbered(t.part.select(F.col("p_partkey").alias("line"), F.concat(F.lit("g"), "p_partkey", F.lit("\t"), "p_name").alias("value")), f"{path}/features")
    return T.parse_matrix(*(T.lines(t.spark, f"{path}/{name}") for name in ("matrix", "barcodes", "features")))


@query("sc4b_csv_files", ORACLE["sc4_csv_typed"])
def sc4b(t):
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.orders.selectExpr("o_orderkey AS k", f"{STATUS} AS flag", "o_totalprice AS v"), path)
    read = t.spark.read.schema("k long, flag string, v double").option("header", True).option("enforceSchema", False).csv(path)
    return read.select("k", S.as_bool(F.col("flag")).alias("flag"), "v")


@query("sc5b_tsv_files", ORACLE["sc5_headerless_tsv"])
def sc5b(t):
    path = scratch(t.spark, "hits")
    made = t.lineitem.selectExpr("concat_ws('\t', l_orderkey, l_partkey, 99.5, l_linenumber, 0, 0, 1, 2, 3, 4, 0.001, l_extendedprice) AS value")
    sinks.write_lines(made, path)
    return T.parse_delimited(T.lines(t.spark, path), T.HIT_COLUMNS, keep=["qseqid", "sseqid", "length", "bitscore"])


@query("sc6b_sheet_folders", ORACLE["sc6_sheets"])
def sc6b(t):
    """A workbook as a folder of sheets, each a folder of CSV files; a row is named by its
    sheet and its first cell."""
    path = scratch(t.spark, "book")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").alias("k"))
    rows.write.partitionBy("r_name").option("header", True).csv(path)
    return T.sheets(t.spark, path, "n_name string, k long").select(F.concat(F.lit("sheet_"), "sheet", F.lit("_"), "n_name").alias("name"), "k")


@query("sc7b_sam_files", f"WITH {ALN} SELECT concat('r', l_orderkey, '/', l_linenumber) AS qname, flag, pos, mapq, cigar, concat('cb', library) AS CB, CAST(l_linenumber AS INTEGER) AS NM FROM aln WHERE flag & 2304 = 0")
def sc7b(t):
    """Alignments written as SAM, header lines first in every file, and read back."""
    path = scratch(t.spark, "sam")
    made = alignments(t).selectExpr("l_orderkey", "l_linenumber", "concat_ws('\t', concat('r', l_orderkey, '/', l_linenumber), flag, 'c1', pos, mapq, cigar, '*', 0, 0, 'ACGT', 'FFFF', concat('NM:i:', l_linenumber), concat('CB:Z:cb', library)) AS value")
    sinks.write_headed(made.sortWithinPartitions("l_orderkey", "l_linenumber"), ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:100000"], path)
    back = T.parse_sam(T.lines(t.spark, path), drop_flags=0x900)
    return back.select("qname", "flag", "pos", "mapq", "cigar", "CB", "NM")


@query("sc9b_fastq_files", f"WITH {READS} SELECT concat('d', doc_id, '.', read_no, '/1') AS name, seq AS seq_r1, translate(reverse(seq), 'ACGT', 'TGCA') AS seq_r2, length(seq) AS n_qual FROM reads")
def sc9b(t):
    """Mates written as two folders of gzip FASTQ and read back in lockstep."""
    quality = F.repeat(F.lit("F"), F.length("seq"))
    made = reads(t).select("doc_id", "read_no", F.concat(F.lit("d"), "doc_id", F.lit("."), "read_no").alias("name"), F.col("seq").alias("seq_r1"), quality.alias("qual_r1"), Q.revcomp(F.col("seq")).alias("seq_r2"), quality.alias("qual_r2"))
    r1, r2 = fastq_source.write_pairs(made, scratch(t.spark, "fastq"), ["doc_id", "read_no"])
    fastq_source.register(t.spark)
    back = t.spark.read.format("fastq_pairs").option("r1", r1).option("r2", r2).load()
    return back.select("name", "seq_r1", "seq_r2", F.length("qual_r2").cast("long").alias("n_qual"))
