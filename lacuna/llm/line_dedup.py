"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines
above ``percent`` are boilerplate and dropped from every page of that host.  A line on
one page alone repeats nowhere and stays, however small its host (``least_pages`` is 2).

Counts are taken over all pages with partial sums before the shuffle, keyed by host
and a 128-bit digest of the line, so neither a hot host nor a hot line meets in one
task.  A host has at most (lines per page) / ratio boilerplate lines, so they travel
as one bounded row per host; those rows are broadcast while they are few.  Beyond, the
rows of hot hosts are broadcast and only pages of the other hosts are shuffled.

Defined results
    a null host is the host ''; null texts stay null and count as pages; lines without
    a word are neither counted nor dropped; a line twice on a page counts once; rows
    that repeat are pages of their own; line breaks are "\\n"; other columns pass
    through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.quality_rules import BLANK_CHARS
from lacuna.llm.runtime import let, spread_join, stash, table

RATIO_PERCENT, LEAST_PAGES = 5, 2
#: Boilerplate lines broadcast to all tasks (32 bytes each); beyond it a join.
BROADCAST_LINES = 250_000


def _filled(line: Column) -> Column:
    return F.translate(line, BLANK_CHARS, "") != ""


def _digest(line: Column) -> Column:
    return F.md5(line)


def boilerplate(docs: DataFrame, percent: int, least_pages: int, host: str, text: str) -> DataFrame:
    """``(host, line, of)``: digests of the lines that exceed the ratio, and the host's pages."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    lines = pages.select("host", F.explode(F.array_distinct(F.filter(F.split("text", "\n"), _filled))).alias("line"))
    often = lines.groupBy("host", _digest(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("on")).where(f"on >= {least_pages}")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return stash(often.join(totals, "host").where(f"100 * on > {percent} * of"), "boilerplate")


def drop_lines(docs: DataFrame, percent: int = RATIO_PERCENT, least_pages: int = LEAST_PAGES, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text`` and a struct ``line_dedup`` of
    ``n_lines`` (lines with a word, before) and ``n_removed``; a column of ``docs`` that
    is called so gives way."""
    common = boilerplate(docs, percent, least_pages, host, text)
    by_host = stash(common.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_gone"), F.max("of").alias("_of")), "by_host")
    few = common.count() <= BROADCAST_LINES
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.col(f"`{text}`").alias("_text"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("_host"))
    joined = rows.join(F.broadcast(by_host), "_host", "left") if few else spread_join(rows, by_host, ["_host"], "_of", "left")
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<string>"))

    def cut(lines):
        def without(hit):
            kept = F.when(F.size(hit) == 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(hit, _digest(x)) | ~_filled(x)))
            return let(kept, lambda k: F.struct(
                F.size(F.filter(lines, _filled)).cast("long").alias("n_lines"), (F.size(lines) - F.size(k)).cast("long").alias("n_removed"), F.array_join(k, "\n").alias("text"),
            ))

        # The page's own boilerplate, by a hash set: a page has few lines, a host may have many.
        return let(F.when(F.size(gone) > 0, F.array_intersect(F.transform(lines, _digest), gone)).otherwise(gone), without)

    joined = joined.withColumn("_cut", let(F.split(F.coalesce("_text", F.lit("")), "\n"), cut))
    new_text = F.when(F.col("_text").isNotNull(), F.col("_cut.text")).alias(text)
    columns = (new_text if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "line_dedup")
    return joined.select(*columns, F.struct("_cut.n_lines", "_cut.n_removed").alias("line_dedup"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_dedup.*", "text")


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
f AS (SELECT rid, host, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM d),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
b AS (SELECT f.host, line FROM f JOIN t ON f.host = t.host GROUP BY f.host, line, pages HAVING count(*) >= {LEAST_PAGES} AND 100 * count(*) > {RATIO_PERCENT} * pages),
h AS (SELECT host, list(line) AS gone FROM b GROUP BY 1),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, CAST([] AS VARCHAR[])), x)) AS kept FROM d LEFT JOIN h ON d.host = h.host)
SELECT doc_id, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k
"""
