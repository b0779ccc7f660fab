"""Sources, sinks, predicates and joins over the tables (SC, SK, PF, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators import intervals as I
from lacuna.operators import relational as R
from lacuna.operators.graph import saved, scratch
from lacuna.plans.bindings import ALN, CELLS, COO, MOL, READS, SEQ, alignments, cells, coo, molecules, reads, sequences
from lacuna.plans.registry import query
from lacuna.sources import sinks
from lacuna.sources import text_formats as T

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'yes' ELSE 'no' END"


@query("sc1_sparse_matrix", f"WITH {COO} SELECT cell, gene, value FROM coo JOIN part ON gene = p_partkey WHERE p_type <> 'PROMO'")
def sc1(t):
    return coo(t).join(t.part.where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("gene")), "gene", "left_semi").select("cell", "gene", "value")


@query("sc2_pruned_read", "SELECT o_orderkey, o_orderstatus FROM orders")
def sc2(t):
    return t.orders.select("o_orderkey", "o_orderstatus")


@query("sc3_coordinate_lines", f"WITH {COO} SELECT concat('c', cell) AS cell, concat('g', gene) AS gene, value FROM coo")
def sc3(t):
    body = coo(t).selectExpr("'m' AS file", "2 + gene * 10000000 + cell AS line", "concat_ws(' ', gene, cell, value) AS value")
    head = t.spark.createDataFrame([("m", 0, "%%MatrixMarket matrix coordinate"), ("m", 1, "9 9 9")], "file string, line long, value string")
    barcodes = t.customer.selectExpr("c_custkey - 1 AS line", "concat('c', c_custkey) AS value")
    features = t.part.selectExpr("p_partkey - 1 AS line", "concat('g', p_partkey, '\t', p_name) AS value")
    return T.parse_matrix(head.union(body), barcodes, features)


@query("sc4_csv_typed", f"SELECT o_orderkey AS k, lower({STATUS}) IN ('true', '1', 'yes') AS flag, o_totalprice AS v FROM orders")
def sc4(t):
    row = F.from_csv(F.expr(f"concat_ws(',', o_orderkey, {STATUS}, o_totalprice)"), "k long, flag string, v double")
    return t.orders.select(row.alias("r")).select("r.k", S.as_bool(F.col("r.flag")).alias("flag"), "r.v")


@query("sc5_headerless_tsv", "SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, CAST(l_partkey AS VARCHAR) AS sseqid, CAST(l_linenumber AS INTEGER) AS length, l_extendedprice AS bitscore FROM lineitem")
def sc5(t):
    made = t.lineitem.selectExpr("concat_ws('\t', l_orderkey, l_partkey, 99.5, l_linenumber, 0, 0, 1, 2, 3, 4, 0.001, l_extendedprice) AS value")
    return T.parse_delimited(made, T.HIT_COLUMNS, keep=["qseqid", "sseqid", "length", "bitscore"])


@query("sc6_sheets", "SELECT concat('sheet_', r_name, '_', n_name) AS name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc6(t):
    """Sheets as folders: each row carries the name of the sheet that it came from."""
    sheets = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("sheet_"), "r_name").alias("sheet"), "n_name", F.col("n_nationkey").alias("k"))
    return sheets.select(F.concat_ws("_", "sheet", "n_name").alias("name"), "k")


@query("sc7_sam_records", f"WITH {ALN} SELECT concat('r', l_orderkey, '/', l_linenumber) AS qname, flag, pos, mapq, cigar, CAST(CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS mate, flag & 16 <> 0 AS reverse, concat('cb', library) AS CB, CAST(l_linenumber AS INTEGER) AS NM FROM aln WHERE flag & 2304 = 0")
def sc7(t):
    made = alignments(t).selectExpr("concat_ws('\t', concat('r', l_orderkey, '/', l_linenumber), flag, 'c1', pos, mapq, cigar, '*', 0, 0, 'ACGT', 'FFFF', concat('NM:i:', l_linenumber), concat('CB:Z:cb', library)) AS value")
    return T.parse_sam(made, drop_flags=0x900).select("qname", "flag", "pos", "mapq", "cigar", "mate", "reverse", "CB", "NM")


def fasta_lines(t):
    wrapped = sequences(t).where("seq <> ''").selectExpr("concat('doc', doc_id) AS name", "seq")
    return T.write_fasta_lines(wrapped).select(F.regexp_extract("value", r"^>(\S+)", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))


@query("sc8_fasta", f"WITH {SEQ} SELECT concat('doc', doc_id) AS name, seq FROM seqs WHERE seq <> ''")
def sc8(t):
    return T.parse_fasta(fasta_lines(t))


@query("sc9_fastq_pairs", f"WITH {READS} SELECT concat('@d', doc_id, '.', read_no) AS header, seq AS seq_r1, translate(reverse(seq), 'ACGT', 'TGCA') AS seq_r2 FROM reads")
def sc9(t):
    made = reads(t).withColumn("record", F.concat_ws("\n", F.concat(F.lit("@d"), "doc_id", F.lit("."), "read_no"), "seq", F.lit("+"), F.regexp_replace("seq", ".", "F")))
    one = T.parse_fastq(made.select(F.concat("doc_id", F.lit("."), "read_no").alias("file"), F.posexplode(F.split("record", "\n")).alias("line", "value")))
    two = one.select("file", Q.revcomp(F.col("seq")).alias("seq_r2"))
    return one.join(two, "file").select("header", F.col("seq").alias("seq_r1"), "seq_r2")


@query("sc10_gtf_genes", "SELECT p_brand AS contig, p_size AS start0, p_size + 5 AS end0, concat('g', p_partkey) AS gene_id, p_name AS gene_name FROM part")
def sc10(t):
    made = t.part.selectExpr("concat_ws('\t', p_brand, 'src', 'gene', p_size + 1, p_size + 5, '.', '+', '.', concat('gene_id \"g', p_partkey, '\"; gene_name \"', p_name, '\";')) AS value")
    other = t.part.selectExpr("concat_ws('\t', p_brand, 'src', 'exon', 1, 2, '.', '+', '.', 'gene_id \"x\";') AS value")
    return T.parse_gtf_genes(made.union(other)).select("contig", "start0", "end0", "gene_id", "gene_name")


@query("sc11_feature_table", "SELECT 'CDS' AS kind, p_size AS start0, p_size + 9 AS end0, p_name AS name FROM part")
def sc11(t):
    made = t.part.selectExpr("CAST(p_partkey AS STRING) AS file", "posexplode(array('FEATURES', concat('     CDS             ', p_size + 1, '..', p_size + 9), concat('                     /gene=\"', p_name, '\"'))) AS (line, value)")
    return T.parse_genbank_features(made)


@query("sc12_gene_sets", "SELECT p_brand AS set_id, concat('set ', p_brand) AS set_name, CAST(p_partkey AS VARCHAR) AS gene FROM part")
def sc12(t):
    made = t.part.groupBy("p_brand").agg(F.concat_ws("\t", F.collect_list(F.col("p_partkey").cast("string"))).alias("g")).selectExpr("concat_ws('\t', p_brand, concat('set ', p_brand), g) AS value")
    return T.parse_gmt(made)


@query("sc13_key_mapping", "SELECT r_name AS pathway, c_custkey AS gene FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def sc13(t):
    links = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return links.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("r_name").alias("pathway"), F.col("c_custkey").alias("gene"))


@query("sc14_file_inventory")
def sc14(t):
    """Files of the folder by class; a listing, not table rows, so no SQL."""
    files = T.inventory(t.spark, t.folder, [("market", "(orders|lineitem|customer)"), ("text", "(documents|pages)")], newest=100)
    return files.select("class", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@query("sc15_name_parts", "SELECT CAST(o_orderkey AS VARCHAR) AS contrast, lower(o_orderstatus) AS layer, substr(o_orderpriority, 1, 1) AS gate FROM orders")
def sc15(t):
    named = t.orders.selectExpr("concat('C', o_orderkey, '_stem_', lower(o_orderstatus), '_', substr(o_orderpriority, 1, 1), '_up.txt') AS name")
    return T.name_parts(named, "name", r"^C(\d+)_stem_([a-z]+)_(\w)_up", ["contrast", "layer", "gate"]).drop("name")


@query("sc17_hash_sample", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) % 100 < 42")
def sc17(t):
    return T.hash_sample(t.orders.select("o_orderkey"), "o_orderkey", 42)


@query("sk1_csv", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def sk1(t):
    """A table written as CSV, then read back as typed rows."""
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch(t.spark, "csv")
    sinks.write_csv(counts, path)
    return t.spark.read.option("header", True).schema("status string, n long").csv(path)


@query("sk2_checkpoint", "SELECT c_custkey, c_acctbal FROM customer")
def sk2(t):
    return saved(t.customer.select("c_custkey", "c_acctbal"))


@query("sk3_report_rows", "SELECT 'orders' AS section, o_orderstatus AS item, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'segments', c_mktsegment, CAST(count(*) AS VARCHAR) FROM customer GROUP BY 2")
def sk3(t):
    a = t.orders.groupBy("o_orderstatus").count().select(F.lit("orders").alias("section"), F.col("o_orderstatus").alias("item"), F.col("count").cast("string").alias("value"))
    b = t.customer.groupBy("c_mktsegment").count().select(F.lit("segments").alias("section"), F.col("c_mktsegment").alias("item"), F.col("count").cast("string").alias("value"))
    path = scratch(t.spark, "report")
    sinks.write_markdown("Counts", [("orders", a), ("segments", b)], path)
    cells = F.split(F.regexp_extract("value", r"^\| (.*) \|$", 1), r" \| ")
    rows = t.spark.read.text(path).where("value LIKE '| %' AND value NOT LIKE '| section |%'")
    return rows.select(*(cells[k].alias(c) for k, c in enumerate(("section", "item", "value"))))


@query("sk4_partitioned_lists", "SELECT l_returnflag AS direction, l_linestatus AS layer, count(DISTINCT l_partkey) AS genes FROM lineitem GROUP BY 1, 2")
def sk4(t):
    path = scratch(t.spark, "lists")
    lists = t.lineitem.select(F.col("l_returnflag").alias("direction"), F.col("l_linestatus").alias("layer"), F.col("l_partkey").alias("gene")).distinct()
    sinks.write_partitioned(lists, path, ["direction", "layer"])
    return t.spark.read.parquet(path).groupBy("direction", "layer").agg(F.count(F.lit(1)).alias("genes"))


@query("sk5_fasta_lines", f"WITH {SEQ} SELECT concat('>doc', doc_id, chr(10), rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS value FROM seqs")
def sk5(t):
    """Every document, multiples of the width and empty texts too."""
    return T.write_fasta_lines(sequences(t).selectExpr("concat('doc', doc_id) AS name", "coalesce(seq, '') AS seq"))


@query("sk7_write_back", "SELECT c_custkey AS cell, coalesce(CASE WHEN c_acctbal > 5000 THEN concat('rich_', c_mktsegment) END, c_mktsegment) AS label FROM customer")
def sk7(t):
    whole = t.customer.select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("label"))
    part = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("cell"), F.concat(F.lit("rich_"), "c_mktsegment").alias("label"))
    return R.write_back(whole, part, ["cell"], ["label"])


@query("pf1_mask_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
def pf1(t):
    return t.orders.where((F.col("o_totalprice") > 1000) & ((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey")


@query("pf2_optional_predicates", f"WITH {CELLS} SELECT cell FROM cells WHERE tissue = 'ASIA' AND balance > 0")
def pf2(t):
    spec = {"tissue": "ASIA", "library": None, "animal": None}
    return cells(t).where(S.all_of([None if v is None else F.col(k) == v for k, v in spec.items()] + [F.col("balance") > 0])).select("cell")


@query("pf3_exact_symbol", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'symbol' ELSE 'id' END AS matched_by FROM part WHERE p_brand = 'Brand#1' OR CAST(p_partkey AS VARCHAR) = '7'")
def pf3(t):
    """Exact match by symbol, else by id; an empty answer is an error."""
    by = F.when(F.col("p_brand") == "Brand#1", "symbol").when(F.col("p_partkey").cast("string") == "7", "id")
    return R.require_rows(t.part.select("p_partkey", by.alias("matched_by")).where("matched_by IS NOT NULL"), "symbol")


@query("pf4_flag_columns", "SELECT p_partkey, starts_with(p_type, 'PRO') AS mt, regexp_matches(p_type, '(?i)^eco') AS ribo, p_size >= 40 AS hb FROM part")
def pf4(t):
    return t.part.select("p_partkey", F.col("p_type").startswith("PRO").alias("mt"), F.col("p_type").rlike("(?i)^eco").alias("ribo"), (F.col("p_size") >= 40).alias("hb"))


@query("pf5_exclusion_mask", "SELECT count(*) FILTER (p_type = 'PROMO') AS by_flag, count(*) FILTER (regexp_matches(p_brand, '#1$')) AS by_pattern, count(*) FILTER (p_type = 'PROMO' OR regexp_matches(p_brand, '#1$')) AS excluded FROM part")
def pf5(t):
    rules = {"by_flag": F.col("p_type") == "PROMO", "by_pattern": F.col("p_brand").rlike("#1$")}
    return t.part.agg(*(F.count_if(r).alias(n) for n, r in rules.items()), F.count_if(S.any_of(list(rules.values()))).alias("excluded"))


RULES = [("first", "#1[0-9]$"), ("second", "#[12]"), ("third", "#[3-5]")]
RULES_SQL = "CASE WHEN regexp_matches(p_brand, '#1[0-9]$') THEN 'first' WHEN regexp_matches(p_brand, '#[12]') THEN 'second' WHEN regexp_matches(p_brand, '#[3-5]') THEN 'third' ELSE 'other' END"


@query("pf6_first_match", f"SELECT p_partkey, {RULES_SQL} AS class FROM part")
def pf6(t):
    return t.part.select("p_partkey", S.first_match(F.col("p_brand"), RULES, "other").alias("class"))


@query("pf7_classify_distinct", f"SELECT {RULES_SQL} AS class, count(*) AS n FROM part GROUP BY 1")
def pf7(t):
    """Distinct values are classified once and joined back."""
    seen = t.part.select("p_brand").distinct().withColumn("class", S.first_match(F.col("p_brand"), RULES, "other"))
    return t.part.join(seen, "p_brand").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("pf8_nested_labels", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'mid' ELSE 'high' END AS tier FROM customer")
def pf8(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "debt").when(b < 2500, "low").when(b < 7500, "mid").otherwise("high").alias("tier"))


@query("pf9_flag_bits", f"WITH {ALN} SELECT l_orderkey, l_linenumber, flag & 16 <> 0 AS reverse, flag & 4 = 0 AS mapped, flag & 1 <> 0 AS paired FROM aln WHERE flag & 2304 = 0")
def pf9(t):
    f = F.col("flag")
    kept = alignments(t).where(S.lacks_bits(f, S.SECONDARY | S.SUPPLEMENTARY))
    return kept.select("l_orderkey", "l_linenumber", S.has_bits(f, S.REVERSE).alias("reverse"), S.lacks_bits(f, S.UNMAPPED).alias("mapped"), S.has_bits(f, S.PAIRED).alias("paired"))


@query("pf10_strand_split", f"WITH {ALN} SELECT library, count(*) FILTER (flag & 2324 = 0) AS sense, count(*) FILTER (flag & 16 <> 0 AND flag & 2308 = 0) AS antisense, round(100.0 * count(*) FILTER (flag & 16 <> 0 AND flag & 2308 = 0) / nullif(count(*) FILTER (flag & 2308 = 0), 0), 4) AS pct, coalesce(100.0 * count(*) FILTER (flag & 16 <> 0 AND flag & 2308 = 0) / nullif(count(*) FILTER (flag & 2308 = 0), 0) > 80, false) AS alarm FROM aln GROUP BY 1")
def pf10(t):
    f = F.col("flag")
    drop = S.UNMAPPED | S.SECONDARY | S.SUPPLEMENTARY
    sense, anti = F.count_if(S.lacks_bits(f, drop | S.REVERSE)), F.count_if(S.lacks_bits(f, drop) & S.has_bits(f, S.REVERSE))
    out = alignments(t).groupBy("library").agg(sense.alias("sense"), anti.alias("antisense"))
    pct = S.ratio(F.col("antisense"), F.col("sense") + F.col("antisense"), 100.0)
    return out.select("library", "sense", "antisense", F.round(pct, 4).alias("pct"), F.coalesce(pct > 80, F.lit(False)).alias("alarm"))


SCORES = {"flag_a": "l_returnflag = 'A'", "flag_n": "l_returnflag = 'N'", "flag_r": "l_returnflag = 'R'"}


def flag_scores(t):
    return t.lineitem.groupBy("l_suppkey").agg(*(F.sum(F.when(F.expr(e), F.col("l_quantity")).otherwise(0.0)).alias(n) for n, e in SCORES.items()))


FLAGS = "s AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1)"


@query("pf11_argmax_label", f"WITH {FLAGS} SELECT l_suppkey, CASE WHEN greatest(a, n, r) < 100 THEN 'none' WHEN a >= n AND a >= r THEN 'flag_a' WHEN n >= r THEN 'flag_n' ELSE 'flag_r' END AS label FROM s")
def pf11(t):
    return flag_scores(t).select("l_suppkey", S.argmax_label({n: F.col(n) for n in SCORES}, floor=100).alias("label"))


@query("pf12_quarantine", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus IN ('F', 'O')")
def pf12(t):
    held = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(F.col("o_orderstatus").isin("F", "O")).join(held, "o_custkey", "left_anti").select("o_orderkey")


@query("pf13_sequential_relabel", """WITH a AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 5000 THEN 'MACHINERY' ELSE c_mktsegment END AS l1 FROM customer),
 b AS (SELECT *, CASE WHEN l1 = 'FURNITURE' THEN 'MACHINERY' ELSE l1 END AS l2 FROM a) SELECT l2 AS label, count(*) AS n, count(*) FILTER (c_mktsegment <> l1) AS step_1, count(*) FILTER (l1 <> l2) AS step_2 FROM b GROUP BY 1""")
def pf13(t):
    steps = [(F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000), F.lit(False)]
    a = t.customer.withColumn("l1", F.when(steps[0], "MACHINERY").otherwise(F.col("c_mktsegment")))
    b = a.withColumn("l2", F.when(F.col("l1") == "FURNITURE", "MACHINERY").otherwise(F.col("l1")))
    return b.groupBy(F.col("l2").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_mktsegment") != F.col("l1")).alias("step_1"), F.count_if(F.col("l1") != F.col("l2")).alias("step_2"))


@query("pf14_placeholders", "SELECT CASE WHEN c_acctbal < 0 THEN 'Unknown' ELSE c_mktsegment END AS level, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def pf14(t):
    level = F.when(F.col("c_acctbal") < 0, "Unknown").otherwise(F.col("c_mktsegment"))
    return t.customer.select(S.real(level).alias("level")).where("level IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("pf15_attribution", """WITH own AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal >= 5000),
 lib AS (SELECT c_nationkey AS lib, min(c_mktsegment) AS v FROM customer WHERE c_acctbal >= 9500 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 1)
 SELECT c_custkey, coalesce(own.v, lib.v) AS animal, CASE WHEN own.v IS NOT NULL THEN 'cell' WHEN lib.v IS NOT NULL THEN 'library' ELSE 'unattributed' END AS source
 FROM customer LEFT JOIN own ON c_custkey = k LEFT JOIN lib ON c_nationkey = lib.lib""")
def pf15(t):
    own = t.customer.where("c_acctbal >= 5000").select("c_custkey", F.col("c_mktsegment").alias("v"))
    lib = R.private_to(t.customer.where("c_acctbal >= 9500"), "c_nationkey", "c_mktsegment")
    return R.ranked_lookup(t.customer.select("c_custkey", "c_nationkey"), [("cell", own, ["c_custkey"], "v"), ("library", lib, ["c_nationkey"], "owner")], "animal", "source", "unattributed").drop("c_nationkey")


@query("pf16_normalise_names", "SELECT n_nationkey, lower(regexp_replace(replace(n_name, ' ', '_'), '_[0-9]+$', '')) AS slug FROM nation")
def pf16(t):
    return t.nation.select("n_nationkey", F.lower(F.regexp_replace(F.regexp_replace("n_name", " ", "_"), "_[0-9]+$", "")).alias("slug"))


@query("pf17_alias_resolution", "SELECT brand, CASE WHEN brand IN (SELECT p_brand FROM part) THEN brand WHEN upper(brand) = 'BRAND1' THEN 'Brand#1' END AS found, CASE WHEN brand IN (SELECT p_brand FROM part) THEN 'exact' WHEN upper(brand) = 'BRAND1' THEN 'alias' ELSE 'missing' END AS status FROM (VALUES ('Brand#2'), ('BRAND1'), ('Nope')) v(brand)")
def pf17(t):
    wanted = t.spark.createDataFrame([("Brand#2", None), ("BRAND1", ["Brand#999", "Brand#1"]), ("Nope", ["Nada"])], "brand string, aliases array<string>")
    tried = wanted.select("brand", F.posexplode(F.concat(F.array("brand"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("turn", "p_brand"))
    hits = tried.join(t.part.select("p_brand").distinct(), "p_brand").groupBy("brand").agg(F.min(F.struct("turn", "p_brand")).alias("hit"))
    return wanted.join(hits, "brand", "left").select("brand", F.col("hit.p_brand").alias("found"), F.when(F.col("hit").isNull(), "missing").when(F.col("hit.turn") == 0, "exact").otherwise("alias").alias("status"))


@query("pf18_tag_resolution", "SELECT p_name AS tag, split_part(p_name, ' ', 1) AS stem, count(*) OVER (PARTITION BY split_part(p_name, ' ', 1)) AS alike FROM part")
def pf18(t):
    """Exact, then by the part before the separator: here every tag with its stem."""
    stem = F.substring_index("p_name", " ", 1)
    return t.part.select(F.col("p_name").alias("tag"), stem.alias("stem"), F.count(F.lit(1)).over(Window.partitionBy(stem)).alias("alike"))


TAGS = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN {stem} WHEN 2 THEN substr(p_name, 1, 3) ELSE concat('zz', p_name) END"


@query("pf18b_tags_in_three_ranks", f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT {TAGS.format(stem="split_part(p_name, ' ', 1)")} AS tag FROM part),
 c AS (SELECT tag, name, CASE WHEN name = tag THEN 0 WHEN split_part(name, ' ', 1) = tag THEN 1 ELSE 2 END AS r FROM w JOIN n ON name = tag OR split_part(name, ' ', 1) = tag OR starts_with(name, tag)),
 b AS (SELECT tag, name, r FROM c QUALIFY row_number() OVER (PARTITION BY tag ORDER BY r, name) = 1)
 SELECT w.tag, name, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'stem' WHEN 2 THEN 'prefix' ELSE 'missing' END AS rank FROM w LEFT JOIN b ON w.tag = b.tag""")
def pf18b(t):
    """Whole names, stems, beginnings and unknown tags, each resolved among all names."""
    wanted = t.part.selectExpr(TAGS.format(stem="substring_index(p_name, ' ', 1)") + " AS tag")
    return R.resolve_tags(wanted, t.part.select(F.col("p_name").alias("name")), separator=" ")


@query("j1_lookup_default", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j1(t):
    dim = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return R.lookup(t.orders.select("o_orderkey", "o_custkey"), dim, ["o_custkey"], {"segment": "none"}).drop("o_custkey")


@query("j2_reindex_fill", f"WITH {COO}, x AS (SELECT cell, sum(value) AS v FROM coo JOIN part ON gene = p_partkey WHERE p_brand = 'Brand#1' GROUP BY 1) SELECT c_custkey AS cell, coalesce(v, 0.0) AS v FROM customer LEFT JOIN x ON c_custkey = cell")
def j2(t):
    x = coo(t).join(t.part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("gene")), "gene", "left_semi").groupBy("cell").agg(F.sum("value").alias("v"))
    return R.lookup(t.customer.select(F.col("c_custkey").alias("cell")), x, ["cell"], {"v": 0.0})


@query("j3_composite_key", "SELECT concat(o_custkey, '-1-', o_orderstatus) AS key, count(*) AS n FROM orders GROUP BY 1")
def j3(t):
    keyed = t.orders.select(F.concat_ws("-", "o_custkey", F.lit("1"), "o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("bare"), "o_orderstatus")
    back = t.orders.select(F.col("o_custkey").cast("string").alias("bare"), "o_orderstatus").distinct()
    return keyed.join(back, ["bare", "o_orderstatus"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("j4_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j4(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j5_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j5(t):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("j6_merge_complete", "SELECT count(*) AS matched, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unmatched FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j6(t):
    inner = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("matched"))
    return inner.join(j5(t).agg(F.count(F.lit(1)).alias("unmatched")))


@query("j7_outer_concat", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def j7(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@query("j8_all_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j8(t):
    n = t.nation.select("n_nationkey", "n_regionkey")
    return n.alias("x").join(n.alias("y"), F.expr("x.n_nationkey < y.n_nationkey")).selectExpr("x.n_nationkey AS a", "y.n_nationkey AS b", "x.n_regionkey = y.n_regionkey AS same")


def spans(t, prefix=""):
    return t.part.selectExpr("p_brand", f"p_partkey AS {prefix}part", f"p_size AS {prefix}s", f"p_size + 5 AS {prefix}e")


@query("j9_overlap_join", "SELECT a.p_partkey AS part, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_size < b.p_size + 5 AND b.p_size < a.p_size + 5")
def j9(t):
    return I.overlap_join_of_repeats(spans(t), spans(t, "o_").withColumnRenamed("o_part", "other"), ["p_brand"], ("s", "e"), ("o_s", "o_e"), 16).where("part < other").select("part", "other")


@query("j10_narrowest_interval", "SELECT p.k, p.at, s.part FROM (SELECT l_orderkey * 10 + l_linenumber AS k, max(CAST(l_quantity AS INTEGER)) AS at FROM lineitem GROUP BY 1) p JOIN (SELECT p_partkey AS part, p_size AS s, p_size + 1 + p_partkey % 7 AS e FROM part) s ON s.s <= p.at AND p.at < s.e QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY s.e - s.s, s.part) = 1")
def j10(t):
    points = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.max(F.col("l_quantity").cast("int")).alias("at")).withColumn("one", F.lit(1))
    best = t.part.selectExpr("1 AS one", "p_partkey AS part", "p_size AS s", "CAST(p_size + 1 + p_partkey % 7 AS INT) AS e")
    per_point = I.narrowest(points.select("one", "at").distinct(), best, ["one"], "at", ("s", "e"), ["at"], "part", 8).select("at", "part")
    return points.join(per_point, "at").select("k", "at", "part")


@query("j11_proximity", f"WITH {ALN} SELECT l_orderkey, l_linenumber FROM aln WHERE pos BETWEEN 100 - 60 AND 134 + 60")
def j11(t):
    return alignments(t).where(F.col("pos").between(100 - 60, 134 + 60)).select("l_orderkey", "l_linenumber")


@query("j12_orientation", f"WITH {READS}, k AS (SELECT DISTINCT substr(seq, 1, 8) AS key FROM reads WHERE read_no = 0) SELECT CASE WHEN count(*) FILTER (substr(seq, 1, 8) IN (SELECT key FROM k)) >= count(*) FILTER (translate(reverse(substr(seq, 1, 8)), 'ACGT', 'TGCA') IN (SELECT key FROM k)) THEN 'direct' ELSE 'revcomp' END AS better, count(*) FILTER (substr(seq, 1, 8) IN (SELECT key FROM k)) AS direct, count(*) FILTER (translate(reverse(substr(seq, 1, 8)), 'ACGT', 'TGCA') IN (SELECT key FROM k)) AS revcomp FROM reads")
def j12(t):
    key = F.substring("seq", 1, 8)
    listed = reads(t).where("read_no = 0").select(key.alias("key")).distinct().withColumn("in", F.lit(1))
    own = reads(t).select(key.alias("d"), Q.revcomp(key).alias("r"))
    joined = own.join(listed.withColumnsRenamed({"key": "d", "in": "di"}), "d", "left").join(listed.withColumnsRenamed({"key": "r", "in": "ri"}), "r", "left")
    out = joined.agg(F.count("di").alias("direct"), F.count("ri").alias("revcomp"))
    return out.select(F.when(F.col("direct") >= F.col("revcomp"), "direct").otherwise("revcomp").alias("better"), "direct", "revcomp")


def _one_mismatch(t, asked_reads):
    first = reads(t).where("length(seq) >= 10").select("read_no", F.substring("seq", 1, 10).alias("b"))
    listed = first.where("read_no = 0").select(F.col("b").alias("n")).distinct()
    asked = first.where(asked_reads).select("b").distinct().select("b", F.posexplode(Q.one_off(F.col("b"))).alias("turn", "n"))
    best = asked.join(listed, "n").groupBy("b").agg(F.min(F.struct("turn", "n")).alias("hit"))
    return best.select(F.col("b").alias("barcode"), F.col("hit.n").alias("corrected"), (F.col("hit.turn") == 0).alias("exact"))


@query("j13_one_mismatch", f"""WITH {READS}, w AS (SELECT DISTINCT substr(seq, 1, 10) AS b FROM reads WHERE read_no = 0 AND length(seq) >= 10), q AS (SELECT DISTINCT substr(seq, 1, 10) AS b FROM reads WHERE read_no <> 0 AND length(seq) >= 10),
 v AS (SELECT q.b, i, c, substr(q.b, 1, i - 1) || c || substr(q.b, i + 1) AS n FROM q, range(1, 11) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) s(c) WHERE substr(q.b, i, 1) <> c UNION ALL SELECT b, 0, '', b FROM q)
 SELECT v.b AS barcode, w.b AS corrected, i = 0 AS exact FROM v JOIN w ON v.n = w.b QUALIFY row_number() OVER (PARTITION BY v.b ORDER BY i, c) = 1""")
def j13(t):
    """Every read but the listed ones is asked about."""
    return _one_mismatch(t, "read_no <> 0")


@query("j14_catalog_both_strands", f"""WITH {READS}, c AS (SELECT DISTINCT doc_id % 5 AS animal, substr(seq, 13, 10) AS core FROM reads WHERE length(seq) >= 34),
 q AS (SELECT DISTINCT substr(seq, 3, 10) AS core FROM reads WHERE length(seq) >= 12)
 SELECT q.core, string_agg(DISTINCT CAST(c.animal AS VARCHAR), ';' ORDER BY CAST(c.animal AS VARCHAR)) AS animals FROM q JOIN c ON c.core = q.core OR c.core = translate(reverse(q.core), 'ACGT', 'TGCA') GROUP BY 1""")
def j14(t):
    catalog = reads(t).where("length(seq) >= 34").select((F.col("doc_id") % 5).cast("string").alias("animal"), F.substring("seq", 13, 10).alias("key")).distinct()
    asked = reads(t).where("length(seq) >= 12").select(F.substring("seq", 3, 10).alias("core")).distinct()
    either = asked.select("core", F.explode(F.array_distinct(F.array(F.col("core"), Q.revcomp(F.col("core"))))).alias("key"))
    return either.join(catalog, "key").groupBy("core").agg(R.set_text(F.col("animal")).alias("animals"))


@query("j15_pool_diff", "WITH a AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT coalesce(a.g, b.g) AS g, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (a.k IS NULL) AS gained, count(*) FILTER (b.k IS NULL) AS lost FROM a FULL JOIN b ON a.g = b.g AND a.k = b.k GROUP BY 1")
def j15(t):
    pool = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("k"))
    side = R.compare_keys(pool("A"), pool("R"), ["g", "k"])
    return side.groupBy("g").agg(F.count_if(F.col("side") == "both").alias("shared"), F.count_if(F.col("side") == "b only").alias("gained"), F.count_if(F.col("side") == "a only").alias("lost"))


@query("j16_manifest_join", f"WITH {CELLS}, m(id, tissue, animal) AS (VALUES (1, 'ASIA', NULL), (2, 'EUROPE', 'BUILDING'), (3, NULL, 'MACHINERY')) SELECT id, count(*) AS n FROM m JOIN cells c ON (m.tissue IS NULL OR m.tissue = c.tissue) AND (m.animal IS NULL OR m.animal = c.animal) GROUP BY 1")
def j16(t):
    manifest = t.spark.createDataFrame([(1, "ASIA", None), (2, "EUROPE", "BUILDING"), (3, None, "MACHINERY")], "id int, tissue string, animal string")
    c, m = cells(t).alias("c"), R.small(manifest).alias("m")
    return c.join(m, F.expr("(m.tissue IS NULL OR m.tissue = c.tissue) AND (m.animal IS NULL OR m.animal = c.animal)")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
