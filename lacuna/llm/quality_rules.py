"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once over the whole text; a row of the ledger stores the
measurements and one failure bit per rule.  Policies are versioned masks applied to
the ledger afterwards, and ablations are bitwise aggregates over it, so neither
reads the texts again.

Defined results
    null text counts as the empty text; an empty table gives an empty ledger; rows
    that repeat are measured one by one; extra columns are kept where the caller
    asks for them (``keep``), and never clash because measurements are packed into
    the single struct column ``ledger`` until they are selected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import BLANKS, let, table

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Window of the repetition measure, in words.
GRAM = 3
#: Low bits of a sort key that hold the position of a window (texts up to 2^28 words).
POSITION_BITS = 28

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: rule -> failure predicate over the measurements; a rule's bit is its place here.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbol_rate": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "short_words": lambda m: m["word_chars"] < 3 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 10 * m["n_words"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: version -> rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbol_rate", "repeated_lines", "short_words", "long_words"),
}
CURRENT = "v1"


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window whose words occur as a window twice or more.

    Windows are compared in O(n log n) within the row: a sort of 64-bit keys (hash
    above, position below) leaves equal hashes side by side; only those windows are
    then compared by their words, so a hash collision changes nothing.
    """
    low = (1 << POSITION_BITS) - 1

    def key(i):
        return F.shiftleft(F.xxhash64(*(F.get(words, i + k) for k in range(GRAM))), POSITION_BITS).bitwiseOR(i.cast("long"))

    def beside(keys, value):
        def same(x, i):
            return F.coalesce(value(x) == value(F.get(keys, i - 1)), F.lit(False)) | F.coalesce(value(x) == value(F.get(keys, i + 1)), F.lit(False))

        return F.filter(keys, same)

    def gram(i):
        return F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(GRAM))).alias("g"), i.alias("i"))

    def covered(hits):
        spread = F.flatten(F.transform(hits, lambda h: F.array(*(h["i"] + k for k in range(GRAM)))))
        return F.size(F.array_distinct(spread)).cast("long")

    def repeated(keys):
        likely = F.transform(beside(keys, lambda k: F.shiftrightunsigned(k, POSITION_BITS)), lambda k: gram(k.bitwiseAND(F.lit(low)).cast("int")))
        return let(F.sort_array(likely), lambda grams: covered(beside(grams, lambda g: g["g"])))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), key))
    return F.when(F.size(words) < GRAM + 1, F.lit(0).cast("long")).otherwise(let(keys, repeated))


def measurements(text: Column) -> Column:
    """Struct of ``MEASURES`` for a text column."""
    text = F.coalesce(text, F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANK_CHARS, "") != "")

    def per_words(words):
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    def per_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(F.filter(F.split(text, BLANKS), lambda w: w != ""), per_words).alias("w"),
        let(filled, per_lines).alias("l"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``ledger``: every measurement and the failure bits."""
    measured = docs.select(*(F.col(f"`{c}`") for c in keep), measurements(F.col(text)).alias("_m"))
    m = {
        "n_words": F.col("_m.w.n_words"), "n_repeat_words": F.col("_m.w.n_repeat_words"), "n_lines": F.col("_m.l.n_lines"),
        "n_dup_lines": F.col("_m.l.n_dup_lines"), "word_chars": F.col("_m.word_chars"), "n_symbols": F.col("_m.n_symbols"),
    }
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule(m), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()))
    return measured.select(*(F.col(f"`{c}`") for c in keep), F.struct(*(m[k].alias(k) for k in MEASURES), bits.cast("long").alias("fail_bits")).alias("ledger"))


def passes(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with the columns of ``docs``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    # The filter would be pushed into the ledger, every measurement copied for each rule
    # that reads it; it does not pass an explode.
    judged = ledger(rows, "text", ("row",)).select("row", F.explode(F.array("ledger.fail_bits")).alias("bits"))
    return judged.where(passes(F.col("bits"), policy)).select("row.*")


def ablation(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of ``policy``: rows that fail it, rows that fail nothing else of
    the policy (kept again if the rule is dropped), and rows seen.

    One pass of partial sums over the bits, then one row per rule.
    """
    bits, mask = F.col("ledger.fail_bits"), mask_of(policy)
    sums = [F.count(F.lit(1)).alias("n")]
    for name in POLICIES[policy]:
        sums += [F.count_if(bits.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"{name}_f"), F.count_if(bits.bitwiseAND(F.lit(mask)) == BIT[name]).alias(f"{name}_o")]
    rows = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"{k}_f").alias("failed"), F.col(f"{k}_o").alias("failed_alone"), F.col("n").alias("rows")) for k in POLICIES[policy]))
    return ledger_rows.agg(*sums).select(F.inline(rows))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents")).select("doc_id", "ledger.*")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~passes(F.col("fail_bits"), "base")).alias("base_failed"), passes(F.col("fail_bits")).alias("kept"),
    )


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM d) GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
         + (CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
