"""Parsers of line formats: frames with a ``value`` column in, typed rows out.

``lines(spark, path)`` reads files; every parser also takes lines made elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIT_COLUMNS = (
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, "
    "sstart int, send int, evalue double, bitscore double"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line``: text lines with their file and 0-based number in it.

    Files are read in splits: a line is counted within its split, and the splits before
    it in the file are added, so a large file is many tasks.  ``file`` is the whole path.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("file", "_split", (F.sum("_n").over(Window.partitionBy("file").orderBy("_split")) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at"))
    numbered = rows.withColumn("_k", inside).join(ahead, ["file", "_split"])
    return numbered.select("file", (F.col("_ahead") + F.col("_k") - 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


#: Lines of a file that are counted together.
RUN_LINES = 1 << 16


def running(df: DataFrame, flag: Column, out: str) -> DataFrame:
    """``df`` (file, line, ...) with how many lines up to this one of its file have ``flag``:
    counted within runs of lines, the runs before added, so a large file is many tasks."""
    rows = df.withColumn("_f", flag.cast("int")).withColumn("_run", F.expr(f"line div {RUN_LINES}"))
    sizes = rows.groupBy("file", "_run").agg(F.sum("_f").alias("_in"))
    ahead = sizes.select("file", "_run", (F.sum("_in").over(Window.partitionBy("file").orderBy("_run")) - F.col("_in")).alias("_ahead"))
    inside = F.sum("_f").over(Window.partitionBy("file", "_run").orderBy("line"))
    return rows.withColumn("_inside", inside).join(ahead, ["file", "_run"]).withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_f", "_run", "_inside", "_ahead")


def parse_delimited(df: DataFrame, schema: str, sep: str = "\t", keep: list[str] | None = None) -> DataFrame:
    """Typed columns from headerless delimited lines, ``keep`` of them if given."""
    names = [part.strip().split(" ") for part in schema.split(",")]
    cells = F.split("value", f"\\Q{sep}\\E")
    out = df.select(*(F.get(cells, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(names)))
    return out.select(*keep) if keep else out


def parse_sam(df: DataFrame, drop_flags: int = 0) -> DataFrame:
    """Alignment rows with tags CB, UB and NM; headers and flags in ``drop_flags`` go."""
    cells = F.split("value", "\t")
    rows = df.where(~F.col("value").startswith("@")).withColumn("flag", cells[1].cast("int")).where(F.col("flag").bitwiseAND(F.lit(drop_flags)) == 0)

    def tag(name, kind):
        return F.nullif(F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]+)", 1), F.lit(""))

    return rows.select(
        cells[0].alias("qname"), "flag", cells[2].alias("contig"), cells[3].cast("int").alias("pos"), cells[4].cast("int").alias("mapq"), cells[5].alias("cigar"), cells[9].alias("seq"),
        F.when(F.col("flag").bitwiseAND(F.lit(0x80)) != 0, 2).otherwise(1).alias("mate"), (F.col("flag").bitwiseAND(F.lit(0x10)) != 0).alias("reverse"),
        tag("CB", "Z").alias("CB"), tag("UB", "Z").alias("UB"), tag("NM", "i").cast("int").alias("NM"),
    )


def parse_gtf_genes(df: DataFrame) -> DataFrame:
    """Gene rows with 0-based half-open spans."""
    cells = F.split("value", "\t")

    def attribute(name):
        return F.nullif(F.regexp_extract(cells[8], rf'{name} "([^"]*)"', 1), F.lit(""))

    genes = df.where(~F.col("value").startswith("#")).where(cells[2] == "gene")
    return genes.select(cells[0].alias("contig"), (cells[3].cast("int") - 1).alias("start0"), cells[4].cast("int").alias("end0"), cells[6].alias("strand"), attribute("gene_id").alias("gene_id"), F.coalesce(attribute("gene_name"), attribute("gene_id")).alias("gene_name"))


def parse_gmt(df: DataFrame) -> DataFrame:
    """``set_id, set_name, gene`` exploded."""
    cells = F.split("value", "\t")
    # A line is cut once, below the explode: above it, once for each of its genes.
    cut = df.select(cells[0].alias("set_id"), cells[1].alias("set_name"), F.slice(cells, F.lit(3), F.size(cells)).alias("genes"))
    return cut.select("set_id", "set_name", F.explode("genes").alias("gene")).where("gene <> ''")


def parse_matrix(entries: DataFrame, barcodes: DataFrame, features: DataFrame) -> DataFrame:
    """MatrixMarket coordinate lines joined to names by 1-based line number."""
    cells = F.split(F.trim("value"), r"\s+")
    body = entries.where(~F.col("value").startswith("%"))
    body = body.join(body.groupBy("file").agg(F.min("line").alias("line")), ["file", "line"], "left_anti")
    coo = body.select(cells[0].cast("int").alias("i"), cells[1].cast("int").alias("j"), cells[2].cast("double").alias("value"))
    genes = features.select((F.col("line") + 1).alias("i"), F.split("value", "\t")[0].alias("gene"))
    names = barcodes.select((F.col("line") + 1).alias("j"), F.col("value").alias("cell"))
    return coo.where("value <> 0").join(genes, "i").join(names, "j").select("cell", "gene", "value")


def parse_fasta(df: DataFrame) -> DataFrame:
    """``name, seq`` per contig; a sequence may follow its name on the header line."""
    rows = running(df.withColumn("_h", F.col("value").startswith(">")), F.col("_h"), "_k")
    inline = F.regexp_extract("value", r"^>\S+\s+([ACGTNacgtn]{20,})$", 1)
    parts = rows.withColumn("part", F.when(F.col("_h"), inline).otherwise(F.trim("value")))
    head = F.max(F.when(F.col("_h"), F.regexp_extract("value", r"^>(\S+)", 1))).alias("name")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda p: p["part"]), "").alias("seq")
    return parts.where("_k > 0").groupBy("file", "_k").agg(head, joined).select("name", F.upper("seq").alias("seq"))


def write_fasta_lines(contigs: DataFrame, width: int = 60) -> DataFrame:
    """``value`` lines of a FASTA file, one row per contig with its line breaks."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return contigs.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value"))


def parse_fastq(df: DataFrame) -> DataFrame:
    """``file, record_no, header, seq, qual`` from complete four-line records only."""
    rows = df.withColumn("record_no", F.expr("line div 4")).withColumn("_part", F.col("line") % 4)
    parts = [F.max(F.when(F.col("_part") == k, F.col("value"))).alias(n) for k, n in ((0, "header"), (1, "seq"), (3, "qual"))]
    return rows.groupBy("file", "record_no").agg(*parts, F.count(F.lit(1)).alias("_n")).where("_n = 4").drop("_n")


def pair_name(file: Column) -> Column:
    """What two mate files have in common: their path without the R1 or R2 part."""
    return F.regexp_replace(file, r"([._])R?[12](?=[._][^/]*$)", "$1")


def pair_reads(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """``pair, record_no, header, seq_r1, seq_r2``: mates in lockstep, joined by the name
    of their pair of files and the record's number in it."""
    a = r1.select(pair_name(F.col("file")).alias("pair"), "record_no", "header", F.col("seq").alias("seq_r1"))
    return a.join(r2.select(pair_name(F.col("file")).alias("pair"), "record_no", F.col("seq").alias("seq_r2")), ["pair", "record_no"])


def parse_genbank_features(df: DataFrame) -> DataFrame:
    """``kind, start0, end0, name`` of feature lines and their /gene or /product."""
    head = r"^ {5}(\S+) +(?:complement\()?<?(\d+)\.\.>?(\d+)\)?"
    rows = running(df.withColumn("_h", F.col("value").rlike(head)), F.col("_h"), "_k").where("_k > 0")
    name = F.nullif(F.regexp_extract("value", r'/(?:gene|product|note)="([^"]*)"', 1), F.lit(""))
    first = F.when(F.col("_h"), F.struct(F.regexp_extract("value", head, 1).alias("kind"), (F.regexp_extract("value", head, 2).try_cast("int") - 1).alias("start0"), F.regexp_extract("value", head, 3).try_cast("int").alias("end0")))
    got = rows.groupBy("file", "_k").agg(F.max(first).alias("h"), F.min_by(name, F.when(name.isNotNull(), F.col("line"))).alias("name"))
    return got.select("h.kind", "h.start0", "h.end0", "name")


def name_parts(df: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of a pattern over a file name."""
    return df.withColumns({n: F.nullif(F.regexp_extract(column, pattern, k + 1), F.lit("")) for k, n in enumerate(names)})


def inventory(spark: SparkSession, folder: str, classes: list[tuple[str, str]], newest: int = 1) -> DataFrame:
    """``class, path, modified, length``: files by the first pattern they match, the
    newest of each class first."""
    from lacuna.functions.scalars import first_match

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    files = files.withColumn("class", first_match(F.col("path"), classes, "other"))
    w = Window.partitionBy("class").orderBy(F.desc("modified"), "path")
    return files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest).drop("_n")


def sheets(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all CSV files below ``folder``, ``sheet`` being the name of their folder
    (what follows ``=``, if it has one)."""
    read = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)
    return read.select("*", F.regexp_extract("_metadata.file_path", r"/(?:[^/=]*=)?([^/]*)/[^/]*$", 1).alias("_s")).withColumn("sheet", F.url_decode("_s")).drop("_s")


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A repeatable sample of about ``percent`` of the keys."""
    return df.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("int"), F.lit(100)) < percent)
