"""String, sequence and alignment operators over the tables (SP, and the shell's SH)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.functions import sequences as Q
from lacuna.operators import intervals as I
from lacuna.operators import molecules as MO
from lacuna.operators import probes as PR
from lacuna.operators import relational as R
from lacuna.plans.bindings import ALN, MOL, READS, SEQ, alignments, molecules, reads, sequences
from lacuna.plans.registry import query

RC = "translate(reverse(seq), 'ACGT', 'TGCA')"


@query("sp1_revcomp", f"WITH {READS} SELECT doc_id, read_no, {RC} AS rc FROM reads")
def sp1(t):
    return reads(t).select("doc_id", "read_no", Q.revcomp(F.col("seq")).alias("rc"))


@query("sp2_parse_cigar", f"WITH {ALN} SELECT l_orderkey, l_linenumber, 7 AS n_ops, concat(lead, 'S', trail, 'S') AS clips, lead + m1 + d + 30 + ins + 5 + trail AS total FROM aln")
def sp2(t):
    ops = Q.cigar_ops(F.col("cigar"))
    return alignments(t).select("l_orderkey", "l_linenumber", F.size(ops).alias("n_ops"), F.array_join(F.transform(F.filter(ops, lambda o: o["op"] == "S"), lambda o: F.concat(o["n"].cast("string"), o["op"])), "").alias("clips"), F.aggregate(ops, F.lit(0), lambda a, o: a + o["n"]).alias("total"))


@query("sp3_cigar_lengths", f"WITH {ALN} SELECT l_orderkey, l_linenumber, m1 + d + 30 + 5 AS ref_length, lead + m1 + 30 + ins + 5 + trail AS query_length, m1 + 35 AS matched, lead, trail, ins AS insertion, pos - 1 + m1 + d + 35 AS ref_end FROM aln")
def sp3(t):
    c = F.col("cigar")
    return alignments(t).select("l_orderkey", "l_linenumber", Q.ref_length(c).alias("ref_length"), Q.query_length(c).alias("query_length"), Q.matched_length(c).alias("matched"), Q.clip_length(c, "lead").alias("lead"), Q.clip_length(c, "trail").alias("trail"), Q.max_insertion(c).alias("insertion"), (F.col("pos") - 1 + Q.ref_length(c)).alias("ref_end"))


@query("sp4_ref_to_query", f"""WITH {ALN} SELECT l_orderkey, l_linenumber, unnest([pos - 1 - lead, pos - 1, pos - 1 + m1 + d, pos - 1 + m1 + d + 30, pos - 1 + m1 + d + 35]) AS ref, unnest([0, lead, lead + m1, lead + m1 + 30 + ins, lead + m1 + 35 + ins]) AS query,
 unnest([lead, m1, 30, 5, trail]) AS n, unnest(['p', 'A', 'A', 'A', 'p']) AS src FROM aln""")
def sp4(t):
    return alignments(t).select("l_orderkey", "l_linenumber", F.inline(Q.cigar_blocks(F.col("pos"), F.col("cigar"))))


WINDOWS = f"""{READS}, w AS (SELECT doc_id, read_no, seq, CAST(100 + read_no % 7 AS INTEGER) AS pos, CAST(5 + read_no % 4 AS INTEGER) AS lead, length(seq) AS n FROM reads WHERE length(seq) >= 40),
 b AS (SELECT *, x AS ref, CASE WHEN x < pos - 1 - lead THEN NULL WHEN x < pos - 1 THEN x - (pos - 1 - lead) WHEN x < pos - 1 + 20 THEN lead + x - (pos - 1) WHEN x < pos - 1 + 22 THEN NULL WHEN x < pos - 1 + 22 + n - lead - 20 THEN lead + 20 + x - (pos - 1 + 22) END AS q FROM w, range(90, 124) r(x))"""


def windows(t):
    w = reads(t).where("length(seq) >= 40").selectExpr("doc_id", "read_no", "seq", "CAST(100 + read_no % 7 AS INT) AS pos", "CAST(5 + read_no % 4 AS INT) AS lead")
    return w.withColumn("cigar", F.expr("concat(lead, 'S20M2D', length(seq) - lead - 20, 'M')"))


@query("sp5_extract_window", f"WITH {WINDOWS} SELECT doc_id, read_no, string_agg(CASE WHEN q IS NULL THEN '.' ELSE substr(seq, q + 1, 1) END, '' ORDER BY ref) AS window, string_agg(CASE WHEN q IS NULL THEN '.' WHEN ref < pos - 1 THEN 'p' ELSE 'A' END, '' ORDER BY ref) AS provenance, CAST(count(*) FILTER (q IS NOT NULL AND ref >= pos - 1) AS INTEGER) AS n_aligned FROM b GROUP BY 1, 2")
def sp5(t):
    laid = MO.with_cigars(windows(t), blocks=Q.cigar_blocks(F.lit(1), F.col("cigar")))
    return laid.withColumn("w", Q.window_of(F.col("blocks"), F.col("pos"), F.col("seq"), 90, 124)).select("doc_id", "read_no", F.col("w.window"), F.col("w.provenance"), F.col("w.n_aligned"))


@query("sp6_aligned_in", f"WITH {ALN} SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(pos - 1 + m1, 134) - greatest(pos - 1, 100)) + greatest(0, least(pos - 1 + m1 + d + 35, 134) - greatest(pos - 1 + m1 + d, 100)) AS INTEGER) AS n FROM aln")
def sp6(t):
    return alignments(t).select("l_orderkey", "l_linenumber", Q.aligned_in(F.col("pos"), F.col("cigar"), F.lit(100), F.lit(134)).alias("n"))


@query("sp7_spans_window", f"WITH {ALN} SELECT l_orderkey, l_linenumber, (pos - 1 <= 100 AND pos - 1 + m1 >= 120) OR (pos - 1 + m1 + d <= 100 AND pos - 1 + m1 + d + 30 >= 120) AS spans FROM aln")
def sp7(t):
    return alignments(t).select("l_orderkey", "l_linenumber", Q.spans_window(F.col("pos"), F.col("cigar"), F.lit(100), F.lit(120)).alias("spans"))


@query("sp8_registered_core", f"""WITH {READS}, c AS (SELECT doc_id, read_no, m, i, substr(seq, CAST(i + 1 + length(k) + 2 AS BIGINT), 10) AS core FROM reads, (VALUES (0, 'ACGC'), (1, 'GCGT')) v(m, k), range(0, 27) r(i) WHERE i BETWEEN 14 AND 26 AND substr(seq, CAST(i + 1 AS BIGINT), length(k)) = k),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, read_no ORDER BY length(core) < 10, CASE WHEN length(core) < 10 THEN -length(core) ELSE 0 END, m, i) AS k FROM c)
 SELECT doc_id, read_no, core, length(core) = 10 AS complete, CAST(m AS INTEGER) AS marker, CAST(i AS INTEGER) AS offset FROM f WHERE k = 1""")
def sp8(t):
    got = reads(t).withColumn("c", Q.registered_core(F.col("seq"), ["ACGC", "GCGT"], F.lit(20), 6, 2, 10)).where("c IS NOT NULL")
    return got.select("doc_id", "read_no", F.col("c.core"), F.col("c.complete"), F.col("c.marker"), F.col("c.offset"))


@query("sp9_truncation_collapse", f"""WITH {READS}, c AS (SELECT DISTINCT doc_id % 10 AS g, substr(seq, 1, CAST(10 - read_no % 5 AS BIGINT)) AS core FROM reads WHERE length(seq) >= 10)
 SELECT a.g, a.core, coalesce(b.core, a.core) AS canon FROM c a LEFT JOIN c b ON a.g = b.g AND length(b.core) > length(a.core) AND (starts_with(b.core, a.core) OR ends_with(b.core, a.core))
 QUALIFY row_number() OVER (PARTITION BY a.g, a.core ORDER BY length(b.core) DESC NULLS LAST, b.core) = 1""")
def sp9(t):
    cores = reads(t).where("length(seq) >= 10").selectExpr("doc_id % 10 AS g", "substring(seq, 1, 10 - read_no % 5) AS core")
    return MO.collapse_truncated(cores, ["g"])


@query("sp10_flanked_core", f"WITH {READS} SELECT doc_id, read_no, substr(seq, 13, 10) AS fixed, regexp_extract(seq, 'ACG(.{{10}})CGT', 1) AS flanked FROM reads WHERE length(seq) >= 34")
def sp10(t):
    return reads(t).where("length(seq) >= 34").select("doc_id", "read_no", F.substring("seq", 13, 10).alias("fixed"), F.regexp_extract("seq", "ACG(.{10})CGT", 1).alias("flanked"))


def _core_sql(seq: str) -> str:
    after = f"substr({seq}, strpos({seq}, 'ACGC') + 14, 6)"
    fits = " OR ".join(f"(least(length({after}), {len(three)}) >= 4 AND hamming(left({after}, least(length({after}), {len(three)})::INT), left('{three}', least(length({after}), {len(three)})::INT)) <= 1)" for three in ("GCGTAC", "CGTAC"))
    return f"CASE WHEN strpos({seq}, 'ACGC') > 0 AND length(substr({seq}, strpos({seq}, 'ACGC') + 4, 10)) = 10 AND ({fits}) THEN substr({seq}, strpos({seq}, 'ACGC') + 4, 10) END"


@query("sp10b_tolerant_flanks", f"""WITH {READS}, b AS (SELECT doc_id, read_no, seq, translate(reverse(seq), 'ACGT', 'TGCA') AS turned FROM reads), c AS (SELECT doc_id, read_no, {_core_sql("seq")} AS own, {_core_sql("turned")} AS other FROM b)
 SELECT doc_id, read_no, coalesce(own, other) AS core, CASE WHEN own IS NOT NULL THEN 'forward' ELSE 'reverse' END AS strand FROM c WHERE own IS NOT NULL OR other IS NOT NULL""")
def sp10b(t):
    """Cores by an exact flank before and a tolerant one behind, on either strand."""
    own, other = (Q.tolerant_core(s, "ACGC", "GCGTAC", 10, 4, 1) for s in (F.col("seq"), Q.revcomp(F.col("seq"))))
    found = reads(t).select("doc_id", "read_no", own.alias("own"), other.alias("other")).where("own IS NOT NULL OR other IS NOT NULL")
    return found.select("doc_id", "read_no", F.coalesce("own", "other").alias("core"), F.when(F.col("own").isNotNull(), "forward").otherwise("reverse").alias("strand"))


@query("sp11_anchor_either_strand", f"WITH {READS} SELECT doc_id, read_no, coalesce(nullif(regexp_extract(seq, 'ACGC(.{{8}})GC', 1), ''), regexp_extract({RC}, 'ACGC(.{{8}})GC', 1)) AS core FROM reads")
def sp11(t):
    return reads(t).select("doc_id", "read_no", Q.between_flanks(F.col("seq"), "ACGC", "GC", 8).alias("core"))


@query("sp12_find_all", f"WITH {READS} SELECT doc_id, read_no, CAST(i AS INTEGER) AS at FROM reads, range(0, 100) r(i) WHERE substr(seq, CAST(i + 1 AS BIGINT), 3) = 'ACA'")
def sp12(t):
    return reads(t).select("doc_id", "read_no", F.explode(Q.find_all(F.col("seq"), "ACA")).alias("at"))


TSO = "TTACATG"
MISMATCH = " + ".join(f"CAST(substr(seq, CAST(i + {k + 1} AS BIGINT), 1) <> '{b}' AS INTEGER)" for k, b in enumerate(TSO))


@query("sp13_best_offset", f"WITH {READS}, c AS (SELECT doc_id, read_no, CAST(i AS INTEGER) AS \"offset\", {MISMATCH} AS mismatches FROM reads, range(0, 40) r(i) WHERE i + {len(TSO)} <= length(seq)) SELECT doc_id, read_no, mismatches, \"offset\" FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, read_no ORDER BY mismatches, \"offset\") = 1 AND mismatches <= 2")
def sp13(t):
    return PR.best_places(reads(t), TSO, 40, 2)


@query("sp14_hamming", f"WITH {READS} SELECT a.doc_id, a.read_no, CAST(hamming(a.seq, b.seq) AS INTEGER) AS d FROM reads a JOIN reads b ON a.doc_id = b.doc_id AND b.read_no = a.read_no + 1 WHERE length(a.seq) = length(b.seq)")
def sp14(t):
    nxt = F.lead("seq").over(Window.partitionBy("doc_id").orderBy("read_no"))
    return reads(t).withColumn("n", nxt).where("length(n) = length(seq)").select("doc_id", "read_no", Q.hamming(F.col("seq"), F.col("n")).alias("d"))


CORES = "cores AS (SELECT DISTINCT substr(seq, 13, 12) AS core FROM reads WHERE read_no = 0 AND length(seq) >= 24)"


def catalog(t):
    return reads(t).where("read_no = 0 AND length(seq) >= 24").select(F.substring("seq", 13, 12).alias("core")).distinct()


def numbered(t):
    return reads(t).select(F.concat_ws(".", "doc_id", "read_no").alias("read_id"), "seq")


@query("sp15_seeded_mismatch", f"""WITH {READS}, {CORES},
 v AS (SELECT DISTINCT core, concat(substr(core, 1, i), l, substr(core, i + 2)) AS win FROM cores, (SELECT CAST(unnest(range(0, 12)) AS BIGINT) AS i), (VALUES ('A'), ('C'), ('G'), ('T')) x(l)),
 w AS (SELECT concat(doc_id, '.', read_no) AS read_id, i, substr(seq, CAST(i + 1 AS BIGINT), 12) AS win FROM reads, range(0, 89) r(i) WHERE i + 12 <= length(seq))
 SELECT read_id, core, CAST(i AS INTEGER) AS "offset", CAST(CASE WHEN win = core THEN 0 ELSE 1 END AS INTEGER) AS mismatches FROM w JOIN v USING (win)""")
def sp15(t):
    return MO.seed_matches(numbered(t), catalog(t), 12, 1)


@query("sp16_partial_overlap", f"""WITH {READS}, {CORES}, e AS (SELECT core, n, substr(core, CAST(13 - n AS BIGINT)) AS part, 'head' AS e FROM cores, range(9, 12) r(n) UNION ALL SELECT core, n, substr(core, 1, CAST(n AS BIGINT)), 'tail' FROM cores, range(9, 12) r(n)),
 p AS (SELECT concat(doc_id, '.', read_no) AS read_id, n, substr(seq, 1, CAST(n AS BIGINT)) AS part, 'head' AS e FROM reads, range(9, 12) r(n) WHERE length(seq) >= n UNION ALL SELECT concat(doc_id, '.', read_no), n, right(seq, CAST(n AS BIGINT)), 'tail' FROM reads, range(9, 12) r(n) WHERE length(seq) >= n),
 u AS (SELECT read_id, p.n, min(core) AS core FROM p JOIN e ON p.n = e.n AND p.part = e.part AND p.e = e.e GROUP BY 1, 2 HAVING count(DISTINCT core) = 1)
 SELECT read_id, core, CAST(n AS INTEGER) AS bases FROM u QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n DESC, core DESC) = 1""")
def sp16(t):
    return MO.partial_matches(numbered(t), catalog(t), 12, 9)


@query("sp17_tiered_match", f"""WITH {READS}, {CORES}, r AS (SELECT concat(doc_id, '.', read_no) AS read_id, seq FROM reads),
 a AS (SELECT read_id, 0 AS tier, regexp_extract(seq, 'ACG(.{{12}})CG', 1) AS core FROM r), w AS (SELECT read_id, substr(seq, CAST(i + 1 AS BIGINT), 12) AS win FROM r, range(0, 89) x(i) WHERE i + 12 <= length(seq)),
 s AS (SELECT core, k, substr(core, CAST(k * 6 + 1 AS BIGINT), 6) AS seed FROM cores, range(0, 2) x(k)),
 u AS (SELECT a.read_id, tier, a.core FROM a JOIN cores c ON a.core = c.core UNION ALL SELECT read_id, 1, core FROM w JOIN cores ON win = core UNION ALL SELECT read_id, 2, core FROM w JOIN s ON substr(win, CAST(k * 6 + 1 AS BIGINT), 6) = seed WHERE hamming(win, core) <= 1)
 SELECT read_id, core, CAST(tier AS INTEGER) AS tier FROM u QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY tier, core) = 1""")
def sp17(t):
    r, c = numbered(t), catalog(t)
    anchored = r.select("read_id", F.regexp_extract("seq", "ACG(.{12})CG", 1).alias("core")).join(c, "core", "left_semi")
    near = MO.lowest_mismatch(r, c, 12, 1).select("read_id", "core", (F.col("mismatches") + 1).alias("tier"))
    every = anchored.select("read_id", "core", F.lit(0).alias("tier")).union(near)
    return every.groupBy("read_id").agg(F.min(F.struct("tier", "core")).alias("b")).select("read_id", "b.core", "b.tier")


@query("sp18_poly_g_trim", f"WITH {READS} SELECT doc_id, read_no, CASE WHEN strpos(seq, 'GGG') > 0 THEN substr(seq, 1, strpos(seq, 'GGG') - 1) ELSE seq END AS trimmed FROM reads")
def sp18(t):
    return reads(t).select("doc_id", "read_no", Q.trim_run(F.col("seq"), "G", 3).alias("trimmed"))


@query("sp19_flank_hits", f"WITH {READS}, f AS (SELECT doc_id, read_no, regexp_extract(seq, 'ACG(.{{4,10}})CGT', 1) AS fwd, regexp_extract({RC}, 'ACG(.{{4,10}})CGT', 1) AS rev FROM reads) SELECT doc_id, read_no, CASE WHEN length(fwd) >= length(rev) THEN fwd ELSE rev END AS core, CASE WHEN length(fwd) >= length(rev) THEN 'fwd' ELSE 'rev' END AS strand FROM f WHERE greatest(length(fwd), length(rev)) > 0")
def sp19(t):
    pattern = "ACG(.{4,10})CGT"
    f = reads(t).select("doc_id", "read_no", F.regexp_extract("seq", pattern, 1).alias("fwd"), F.regexp_extract(Q.revcomp(F.col("seq")), pattern, 1).alias("rev"))
    best = F.when(F.length("fwd") >= F.length("rev"), F.struct(F.col("fwd").alias("core"), F.lit("fwd").alias("strand"))).otherwise(F.struct(F.col("rev").alias("core"), F.lit("rev").alias("strand")))
    return f.where("greatest(length(fwd), length(rev)) > 0").select("doc_id", "read_no", best.alias("b")).select("doc_id", "read_no", "b.*")


H = " + ".join(f"CASE WHEN c{b} > 0 THEN c{b} / n * log2(c{b} / n) ELSE 0 END" for b in "ACGT")


@query("sp20_entropy", f"WITH {READS}, c AS (SELECT doc_id, read_no, CAST(length(seq) AS DOUBLE) AS n, {', '.join(f'''length(seq) - length(replace(seq, '{b}', '')) AS c{b}''' for b in 'ACGT')} FROM reads) SELECT doc_id, read_no, round(-({H}), 6) + 0.0 AS h FROM c")
def sp20(t):
    return reads(t).select("doc_id", "read_no", (F.round(Q.entropy(F.col("seq")), 6) + 0.0).alias("h"))


@query("sp21_alphabet_and_runs", f"WITH {SEQ} SELECT doc_id, regexp_matches(seq, '^[ACGTN]+$') AS clean, CAST(len(regexp_extract_all(seq, 'TTT+')) AS INTEGER) AS t_runs, CAST(strpos(seq, 'ACGTA') AS INTEGER) AS first_at FROM seqs")
def sp21(t):
    return sequences(t).select("doc_id", F.col("seq").rlike("^[ACGTN]+$").alias("clean"), F.regexp_count("seq", F.lit("TTT+")).alias("t_runs"), F.instr("seq", "ACGTA").alias("first_at"))


@query("sp22_base_diff", f"WITH {READS} SELECT a.doc_id, a.read_no, CAST(i - 1 AS INTEGER) AS at, substr(a.seq, i, 1) AS a, substr(b.seq, i, 1) AS b FROM reads a JOIN reads b ON a.doc_id = b.doc_id AND b.read_no = a.read_no + 1, range(1, 101) r(i) WHERE length(a.seq) = length(b.seq) AND i <= length(a.seq) AND substr(a.seq, i, 1) <> substr(b.seq, i, 1)")
def sp22(t):
    """Every read against the next of its document."""
    nxt = F.lead("seq").over(Window.partitionBy("doc_id").orderBy("read_no"))
    both = reads(t).withColumn("n", nxt).where("length(n) = length(seq)")
    pairs = both.select("doc_id", "read_no", F.posexplode(F.arrays_zip(Q.letters(F.col("seq")).alias("a"), Q.letters(F.col("n")).alias("b"))).alias("at", "p"))
    return pairs.where("p.a <> p.b").select("doc_id", "read_no", "at", "p.a", "p.b")


@query("sp23_tags", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(regexp_extract(props, '\"k\": *\"?([^\",}]+)', 1), '') AS raw FROM events")
def sp23(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.regexp_extract("props", '"k": *"?([^",}]+)', 1).alias("raw"))


@query("sp24_barcode_parse", "SELECT c_custkey, regexp_extract(c_name, '([0-9]{6,})', 1) AS code, split_part(c_name, '#', 1) AS stem FROM customer")
def sp24(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", "([0-9]{6,})", 1).alias("code"), F.substring_index("c_name", "#", 1).alias("stem"))


@query("sp25_title_tokens", r"WITH w AS (SELECT unnest(string_split_regex(p_name, '\s+')) AS token FROM part) SELECT token, count(*) AS n FROM w GROUP BY 1")
def sp25(t):
    return t.part.select(F.explode(F.split("p_name", r"\s+")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("sp26_insert_window", f"WITH {READS} SELECT doc_id, read_no, substr(seq, 1, 10) || 'NNNN' || substr(seq, 15) AS edited, true AS round_trip FROM reads WHERE length(seq) >= 20")
def sp26(t):
    edited = F.overlay("seq", F.lit("NNNN"), 11)
    back = F.overlay(edited, F.substring("seq", 11, 4), 11)
    return reads(t).where("length(seq) >= 20").select("doc_id", "read_no", edited.alias("edited"), (back == F.col("seq")).alias("round_trip"))


@query("sp27_geometry_flags", f"WITH {ALN} SELECT l_orderkey, l_linenumber, abs(pos - 1 - 134) <= 2 AS starts_at_edge, abs(pos - 1 + m1 + d + 35 - 100) <= 2 AS ends_at_edge, lead >= 6 OR trail >= 3 AS clipped FROM aln")
def sp27(t):
    start, end = F.col("pos") - 1, F.col("pos") - 1 + Q.ref_length(F.col("cigar"))
    return alignments(t).select("l_orderkey", "l_linenumber", (F.abs(start - 134) <= 2).alias("starts_at_edge"), (F.abs(end - 100) <= 2).alias("ends_at_edge"), ((Q.clip_length(F.col("cigar"), "lead") >= 6) | (Q.clip_length(F.col("cigar"), "trail") >= 3)).alias("clipped"))


ALN_SPANS = "sp AS (SELECT library, pos - 1 AS s, pos - 1 + m1 + d + 35 AS e FROM aln), ev AS (SELECT library, s AS loc, 1 AS step FROM sp UNION ALL SELECT library, e, -1 FROM sp), st AS (SELECT library, loc, sum(step) AS step FROM ev GROUP BY 1, 2), rn AS (SELECT library, loc AS lo, lead(loc) OVER w AS hi, sum(step) OVER w AS depth FROM st WINDOW w AS (PARTITION BY library ORDER BY loc))"


def depth_runs(t):
    laid = MO.with_cigars(alignments(t).select("library", "pos", "cigar"), n=Q.ref_length(F.col("cigar")))
    spans = laid.select("library", (F.col("pos") - 1).alias("s"), (F.col("pos") - 1 + F.col("n")).alias("e"))
    return I.depth(spans, ["library"], "s", "e")


@query("sh1_depth_summary", f"WITH {ALN}, {ALN_SPANS} SELECT library, CAST(sum((hi - lo) * depth) AS BIGINT) AS bases, CAST(sum(CASE WHEN depth > 0 THEN hi - lo ELSE 0 END) AS BIGINT) AS covered, CAST(max(depth) AS BIGINT) AS max_depth, round(sum((hi - lo) * depth) / 20000.0, 6) AS mean_depth, round(sum(CASE WHEN depth > 0 THEN hi - lo ELSE 0 END) / 20000.0, 6) AS breadth FROM rn WHERE hi IS NOT NULL GROUP BY 1")
def sh1(t):
    c = I.coverage(depth_runs(t), ["library"], 20000)
    return c.select("library", "bases", "covered", "max_depth", F.round("mean_depth", 6).alias("mean_depth"), F.round("breadth", 6).alias("breadth"))


@query("sh2_feature_depth", f"WITH {ALN}, {ALN_SPANS}, f AS (SELECT x AS feature, x * 50 AS fs, x * 50 + 30 AS fe FROM range(0, 4) r(x)) SELECT feature, library, round(sum((least(hi, fe) - greatest(lo, fs)) * depth) / 30.0, 6) AS mean_depth, CAST(sum(CASE WHEN depth > 0 THEN least(hi, fe) - greatest(lo, fs) ELSE 0 END) AS BIGINT) AS covered FROM rn JOIN f ON lo < fe AND fs < hi WHERE hi IS NOT NULL GROUP BY 1, 2")
def sh2(t):
    features = t.spark.range(4).selectExpr("id AS feature", "1 AS one", "id * 50 AS fs", "id * 50 + 30 AS fe")
    met = I.overlap_join(depth_runs(t).withColumn("one", F.lit(1)), features, ["one"], ("lo", "hi"), ("fs", "fe"), 64)
    w = F.least("hi", "fe") - F.greatest("lo", "fs")
    return met.groupBy("feature", "library").agg(F.round(F.sum(w * F.col("depth")) / 30.0, 6).alias("mean_depth"), F.sum(F.when(F.col("depth") > 0, w).otherwise(0)).alias("covered"))


@query("sh3_mapq_histogram", f"WITH {ALN} SELECT mapq, count(*) AS n, round(avg(m1), 6) AS mean, median(m1) AS med, min(m1) AS lo, max(m1) AS hi FROM aln GROUP BY 1")
def sh3(t):
    laid = MO.with_cigars(alignments(t).select("mapq", "cigar"), m1=Q.matched_length(F.col("cigar")) - 35)
    return laid.groupBy("mapq").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m1"), 6).alias("mean"), F.median("m1").alias("med"), F.min("m1").alias("lo"), F.max("m1").alias("hi"))


@query("sh4_n50", "WITH l AS (SELECT source, doc_id, length(text) AS n FROM documents), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS run, sum(n) OVER (PARTITION BY source) AS tot FROM l) SELECT source, count(*) AS contigs, CAST(max(tot) AS BIGINT) AS total, max(n) AS longest, min(n) AS shortest, max(n) FILTER (run >= tot / 2.0) AS n50 FROM r GROUP BY 1")
def sh4(t):
    """Lengths repeat: they are counted first, and the counts summed from the longest."""
    w = Window.partitionBy("source")
    counts = t.documents.groupBy("source", F.length("text").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    letters = F.col("c") * F.col("n")
    r = counts.withColumn("run", F.sum(letters).over(w.orderBy(F.desc("n")))).withColumn("tot", F.sum(letters).over(w))
    return r.groupBy("source").agg(F.sum("c").alias("contigs"), F.max("tot").alias("total"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.max(F.when(F.col("run") >= F.col("tot") / 2.0, F.col("n"))).alias("n50"))


@query("sh5_weighted_identity", f"WITH {ALN} SELECT library, CAST(sum(m1 + 35) AS BIGINT) AS aligned, CAST(sum(d) AS BIGINT) AS gaps, CAST(sum(l_linenumber) AS BIGINT) AS mismatches, round(100.0 * (sum(m1 + 35) - sum(l_linenumber) - sum(d)) / sum(m1 + 35), 6) AS identity FROM aln GROUP BY 1")
def sh5(t):
    m, gap = Q.matched_length(F.col("cigar")), Q.ref_length(F.col("cigar")) - Q.matched_length(F.col("cigar"))
    s = alignments(t).groupBy("library").agg(F.sum(m).alias("aligned"), F.sum(gap).alias("gaps"), F.sum("l_linenumber").alias("mismatches"))
    return s.withColumn("identity", F.round(S.ratio(F.col("aligned") - F.col("mismatches") - F.col("gaps"), F.col("aligned"), 100.0), 6))


@query("sh6_length_curation", "SELECT source, count(*) AS raw, count(*) FILTER (length(text) >= 1000) AS kept FROM documents GROUP BY 1")
def sh6(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.length("text") >= 1000).alias("kept"))


@query("sh7_length_distribution", "SELECT lang, median(length(text)) AS med, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) >= 8000) AS long, count(*) FILTER (length(text) < 1000) AS short FROM documents GROUP BY 1")
def sh7(t):
    n = F.length("text")
    return t.documents.groupBy("lang").agg(F.median(n).alias("med"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n >= 8000).alias("long"), F.count_if(n < 1000).alias("short"))


@query("sh8_multi_pattern_scan", f"WITH {READS}, p(probe) AS (VALUES ('ACGTAC'), ('GGTTA'), ('CATTC')) SELECT probe, count(*) AS hits, min(doc_id * 100000 + read_no) AS first FROM reads, p WHERE contains(seq, probe) GROUP BY 1")
def sh8(t):
    probes = ["ACGTAC", "GGTTA", "CATTC"]
    hits = F.filter(F.array(*(F.when(F.col("seq").contains(p), F.lit(p)) for p in probes)), lambda x: x.isNotNull())
    return reads(t).where(F.col("seq").rlike("|".join(probes))).select((F.col("doc_id") * 100000 + F.col("read_no")).alias("k"), F.explode(hits).alias("probe")).groupBy("probe").agg(F.count(F.lit(1)).alias("hits"), F.min("k").alias("first"))


@query("sh8b_probe_table", f"""WITH {READS}, {CORES},
 p AS (SELECT core AS probe, core AS text, '+' AS strand FROM cores UNION ALL SELECT core, translate(reverse(core), 'ACGT', 'TGCA'), '-' FROM cores WHERE translate(reverse(core), 'ACGT', 'TGCA') <> core),
 w AS (SELECT doc_id * 100000 + read_no AS k, substr(seq, CAST(i + 1 AS BIGINT), 12) AS text FROM reads, range(0, 89) r(i) WHERE i + 12 <= length(seq))
 SELECT probe, strand, count(*) AS hits, min(k) AS first FROM w JOIN p USING (text) GROUP BY 1, 2""")
def sh8b(t):
    """Every core of the table as a probe, on both strands, in one pass over the reads."""
    rows = reads(t).select((F.col("doc_id") * 100000 + F.col("read_no")).alias("k"), "seq")
    found = PR.find_all(rows, catalog(t).withColumnRenamed("core", "probe"), key="k")
    return found.groupBy("probe", "strand").agg(F.count(F.lit(1)).alias("hits"), F.min("k").alias("first"))


@query("sh9_alignment_summary", f"WITH {ALN} SELECT library, count(*) FILTER (flag & 2308 = 0) AS aligned, count(*) FILTER (flag & 4 = 0) - count(*) FILTER (flag & 2308 = 0) AS secondary, count(*) FILTER (flag & 2308 = 0 AND mapq >= 30) AS confident, count(*) FILTER ((pos - 1 <= 100 AND pos - 1 + m1 >= 120) OR (pos - 1 + m1 + d <= 100 AND pos - 1 + m1 + d + 30 >= 120)) AS spanning FROM aln GROUP BY 1")
def sh9(t):
    f = F.col("flag")
    primary = S.lacks_bits(f, S.UNMAPPED | S.SECONDARY | S.SUPPLEMENTARY)
    spanning = Q.spans_window(F.col("pos"), F.col("cigar"), F.lit(100), F.lit(120))
    return alignments(t).groupBy("library").agg(F.count_if(primary).alias("aligned"), (F.count_if(S.lacks_bits(f, S.UNMAPPED)) - F.count_if(primary)).alias("secondary"), F.count_if(primary & (F.col("mapq") >= 30)).alias("confident"), F.count_if(spanning).alias("spanning"))


@query("sh10_pass_rate", f"WITH {MOL} SELECT library, count(*) FILTER (starts_with(core, '1')) AS yes, count(*) AS n, round(100.0 * count(*) FILTER (starts_with(core, '1')) / count(*), 6) AS pct, 100.0 * count(*) FILTER (starts_with(core, '1')) / count(*) >= 20 AS ok FROM mol GROUP BY 1")
def sh10(t):
    c = molecules(t).groupBy("library").agg(F.count_if(F.col("core").startswith("1")).alias("yes"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(S.ratio(F.col("yes"), F.col("n"), 100.0), 6)).withColumn("ok", S.ratio(F.col("yes"), F.col("n"), 100.0) >= 20)


@query("sh11_extract_by_id", "SELECT count(*) AS got, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity >= 45) AS requested FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def sh11(t):
    ids = t.lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return t.part.join(ids, "p_partkey", "left_semi").agg(F.count(F.lit(1)).alias("got")).join(ids.agg(F.count(F.lit(1)).alias("requested")))


@query("sh12_primer_validation", "WITH h AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_quantity) AS k FROM lineitem) SELECT l_orderkey, count(*) AS hits, bool_or(l_quantity = 50) AS perfect, bool_and(l_quantity >= 5) AS all_pass FROM h WHERE k <= 5 GROUP BY 1")
def sh12(t):
    top = R.best_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_quantity")], 5)
    return top.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("hits"), F.bool_or(F.col("l_quantity") == 50).alias("perfect"), F.bool_and(F.col("l_quantity") >= 5).alias("all_pass"))


@query("sh13_vocabulary_counts", "SELECT word, count(*) FILTER (contains(p_name, word)) AS n FROM part, (VALUES ('red'), ('part'), ('1'), ('zz')) v(word) GROUP BY 1")
def sh13(t):
    words = ["red", "part", "1", "zz"]
    one = t.part.agg(*(F.count_if(F.col("p_name").contains(w)).alias(f"_{k}") for k, w in enumerate(words)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"_{k}").alias("n")) for k, w in enumerate(words)))))


@query("sh14_field_lint", "SELECT o_orderpriority AS value, count(*) AS rows FROM orders WHERE contains(o_orderpriority, ' ') OR contains(o_orderpriority, '-') GROUP BY 1")
def sh14(t):
    return t.orders.where(F.col("o_orderpriority").contains(" ") | F.col("o_orderpriority").contains("-")).groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("rows"))


@query("sh15_paired_files", "WITH f AS (SELECT l_suppkey AS file, count(*) AS lines, l_suppkey // 2 AS pair FROM lineitem GROUP BY 1) SELECT pair, min(lines // 4) AS lo, max(lines // 4) AS hi, CAST(sum(lines % 4) AS BIGINT) AS remainder, max(lines // 4) = min(lines // 4) AS ok FROM f GROUP BY 1")
def sh15(t):
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("file")).agg(F.count(F.lit(1)).alias("lines")).withColumn("pair", F.expr("file div 2"))
    records = F.expr("lines div 4")
    return f.groupBy("pair").agg(F.min(records).alias("lo"), F.max(records).alias("hi"), F.sum(F.col("lines") % 4).alias("remainder"), (F.max(records) == F.min(records)).alias("ok"))


@query("sh16_combined_reference", f"WITH {SEQ} SELECT count(*) AS contigs, (SELECT count(*) FROM seqs) AS kept, true AS intact FROM (SELECT doc_id, seq FROM seqs UNION ALL SELECT -1 - s_suppkey, 'ACGT' FROM supplier)")
def sh16(t):
    own = sequences(t)
    whole = own.union(t.supplier.selectExpr("-1 - s_suppkey AS doc_id", "'ACGT' AS seq"))
    same = whole.join(own.withColumnRenamed("seq", "was"), "doc_id", "left")
    return same.agg(F.count(F.lit(1)).alias("contigs"), F.count("was").alias("kept"), F.bool_and(F.col("was").isNull() | (F.col("was") == F.col("seq"))).alias("intact"))
