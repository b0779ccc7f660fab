"""What the queries' operators are bound to: frames over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.plans.registry import Tables

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC" * 2


def coo(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """(cell, gene, value): quantities of parts by customer (of the cells ``of`` alone)."""
    orders = t.orders if of is None else t.orders.join(of.select(F.col("cell").alias("o_custkey")), "o_custkey", "left_semi")
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


COO = "coo AS (SELECT o_custkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def sequences(t: Tables) -> DataFrame:
    """(doc_id, seq): every letter of every text as a base."""
    return t.documents.select("doc_id", F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES).alias("seq"))


SEQ = f"seqs AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)"


def reads(t: Tables) -> DataFrame:
    """(doc_id, read_no, seq): the sequences cut into reads of 100 bases."""
    return sequences(t).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit("(.{1,100})"), F.lit(1))).alias("read_no", "seq"))


READS = f"{SEQ}, reads AS (SELECT doc_id, CAST(unnest(range(0, len(r))) AS INTEGER) AS read_no, unnest(r) AS seq FROM (SELECT doc_id, regexp_extract_all(seq, '.{{1,100}}') AS r FROM seqs))"


def alignments(t: Tables) -> DataFrame:
    """Alignment rows: position, flag, a clipped and gapped cigar, library and tags."""
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey AS library", "CAST(l_orderkey % 4096 AS INT) AS flag", "CAST(l_partkey AS INT) AS pos", "CAST(l_suppkey % 61 AS INT) AS mapq",
        "concat(l_linenumber * 2, 'S', CAST(l_quantity AS INT), 'M', l_suppkey % 4 + 1, 'D', 30, 'M', l_linenumber, 'I', 5, 'M', l_suppkey % 3 + 1, 'S') AS cigar",
    )


ALN = """aln AS (SELECT l_orderkey, l_linenumber, l_suppkey AS library, CAST(l_orderkey % 4096 AS INTEGER) AS flag, CAST(l_partkey AS INTEGER) AS pos, CAST(l_suppkey % 61 AS INTEGER) AS mapq,
  CAST(l_linenumber * 2 AS INTEGER) AS lead, CAST(l_quantity AS INTEGER) AS m1, CAST(l_suppkey % 4 + 1 AS INTEGER) AS d, CAST(l_linenumber AS INTEGER) AS ins, CAST(l_suppkey % 3 + 1 AS INTEGER) AS trail,
  concat(l_linenumber * 2, 'S', CAST(l_quantity AS INTEGER), 'M', l_suppkey % 4 + 1, 'D', 30, 'M', l_linenumber, 'I', 5, 'M', l_suppkey % 3 + 1, 'S') AS cigar FROM lineitem)"""


def contigs(t: Tables) -> DataFrame:
    """Receptor rows: the cell is a user and day, the chain an event type."""
    chain = F.create_map(*(F.lit(x) for x in ("click", "TRA", "view", "TRB", "purchase", "TRG", "signup", "TRD", "error", "TRB")))
    return t.events.select(F.col("user_id"), F.to_date("ts").alias("day"), chain[F.col("event_type")].alias("chain"), (F.col("event_type") != "error").alias("productive"), "event_id")


CONTIGS = """contigs AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 'TRA' WHEN 'view' THEN 'TRB' WHEN 'purchase' THEN 'TRG' WHEN 'signup' THEN 'TRD' WHEN 'error' THEN 'TRB' END AS chain,
  event_type <> 'error' AS productive, event_id FROM events)"""


def molecules(t: Tables) -> DataFrame:
    """Molecule rows: library, cell and molecule tags, core, mate."""
    return t.events.selectExpr("event_type AS library", "user_id AS cb", "CAST(to_date(ts) AS STRING) AS ub", "get_json_object(props, '$.k') AS core", "CAST(event_id % 2 + 1 AS INT) AS mate", "event_id", "value")


MOL = "mol AS (SELECT event_type AS library, user_id AS cb, CAST(CAST(ts AS DATE) AS VARCHAR) AS ub, json_extract_string(props, '$.k') AS core, CAST(event_id % 2 + 1 AS INTEGER) AS mate, event_id, value FROM events)"


def cells(t: Tables) -> DataFrame:
    """Unit rows: customer with nation, region, segment."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cell"), F.col("n_name").alias("library"), F.col("r_name").alias("tissue"), F.col("c_mktsegment").alias("animal"), F.col("c_acctbal").alias("balance"))


CELLS = "cells AS (SELECT c_custkey AS cell, n_name AS library, r_name AS tissue, c_mktsegment AS animal, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
