"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a page are multiplied: the likelihood of its text under
hashed character trigrams, the language its markup declares, the suffix of its
address, and a prior of its host.  The last three are counted from the pages
themselves by grouped aggregation of the text posteriors: how often each declared
value and each suffix goes with a language, and a prior smoothed down the hierarchy
all pages - suffix - registered domain - host.  A page's own share is taken out of
every count before it is used on that page.

The languages are those of all labelled documents.  The trigram tables are fitted on
so many documents of each, first in the order of a hash of their ids, whole whatever
their length; everything counted from pages covers all of them, and whole texts are
scored.

Defined results
    null or empty pages have flat text evidence and are decided by the rest; a missing
    declaration, host or suffix is a value of its own ('') ; ties go to the language
    first in order; rows that repeat count each; a null id passes through; without any
    labelled document the result has null languages; more than ``MOST_LANGUAGES`` of them
    are an error; texts of any length are read whole; columns besides those named are not
    read; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, spread_join, stash, table

SLOTS = 1 << 16
#: Labelled documents fitted of each language at most.
LANGUAGE_ROWS = 500
#: Languages of a model: it holds half a megabyte for each in every task.
MOST_LANGUAGES = 400
#: Range of the hash by which they are taken.
HASHES = (1 << 31) - 1
#: A text counts as so many independent trigrams at most.
EVIDENCE = 60.0
#: Weight, in pages, of the level above in each smoothed count.
SMOOTHING = 5.0
#: Rows of a grouped table broadcast to the join; beyond it the join is shuffled.
BROADCAST_GROUPS = 100_000
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
LEVELS = ("host", "domain", "suffix")


def visible_text(html: str | None) -> str:
    return unescape(_TAGS.sub(" ", html)) if html else ""


def trigram_counts(text: str) -> np.ndarray:
    """Hashed counts of the character trigrams of the lower-cased text."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(chars) < 3:
        return np.zeros(0, np.int64)
    h = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1]) * np.uint64(0x85EBCA77) + chars[2:]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64) % SLOTS


class TextModel:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    @classmethod
    def fit(cls, languages: list[str], seen: pa.Table) -> TextModel:
        """``seen``: columns lang, slot, n, a row for each trigram slot of a language."""
        languages = sorted(languages)
        counts = np.full((len(languages), SLOTS), 0.5)
        if languages and seen.num_rows:
            lang = pc.index_in(seen.column("lang"), value_set=pa.array(languages, pa.string())).to_numpy()
            counts[lang, seen.column("slot").to_numpy()] += seen.column("n").to_numpy()
        return cls(languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if languages else counts)

    def posterior(self, text: str) -> np.ndarray:
        """Chances of the languages from the text alone, all equal before it."""
        at = trigram_counts(text)
        if not len(at):
            return np.full(len(self.languages), 1 / max(1, len(self.languages)))
        score = self.logs[:, at].mean(axis=1) * min(len(at), EVIDENCE)
        p = np.exp(score - score.max())
        return p / p.sum()


def _slots_seen(batches):
    for batch in batches:
        langs, slots, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = np.unique(trigram_counts(text), return_counts=True)
            langs += [lang] * len(at)
            slots += at.tolist()
            counts += n.tolist()
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(slots, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "slot", "n"])


def sample(docs: DataFrame, id_column: str, text: str, lang: str) -> tuple[list[str], DataFrame]:
    """All languages of labelled documents, and ``(lang, text)`` of up to
    ``LANGUAGE_ROWS`` documents of each.

    The hash alone leaves a few times as many rows as are ranked, and always those that
    come first, so no task ranks all rows of a common language.
    """
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    some = named.select(F.col(id_column).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    some = some.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(HASHES)))
    found = some.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("h").alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: clean the column, or raise MOST_LANGUAGES with the tasks' memory")
    upto = [(r.lang, max(r.least, 4 * LANGUAGE_ROWS * HASHES // r.rows)) for r in found]
    limits = docs.sparkSession.createDataFrame(upto, "lang string, upto long")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    taken = some.join(F.broadcast(limits), "lang").where("h <= upto").withColumn("turn", first).where(F.col("turn") <= LANGUAGE_ROWS)
    return [r.lang for r in found], taken.select("lang", "text")


def fit_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> TextModel:
    languages, taken = sample(docs, id_column, text, lang)
    seen = taken.mapInArrow(_slots_seen, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # At most SLOTS rows a language, as columns and not as Row objects.
    return TextModel.fit(languages, seen.toArrow())


def _text_evidence(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            rows = [model.posterior(visible_text(html)).tolist() for html in batch.column(3).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "text_p"])

    return run


def declared_language(html: Column) -> Column:
    """The primary tag of ``<html lang=...>``, lower case, or ''."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    sums = F.array(*(F.sum(F.col("text_p")[k]) for k in range(n)))
    return rows.groupBy(*keys).agg(sums.alias(name), F.count(F.lit(1)).alias("_pages"))


def _joined(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Groups are broadcast while they are few, else hot ones only."""
    counts = stash(counts, "counts")
    if counts.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(counts), keys).drop("_pages")
    return stash(spread_join(stash(rows, "rows"), counts, keys, "_pages").drop("_pages"), "joined")


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Posteriors from ``(page_id, host, declared, text_p)``."""
    n = len(languages)
    parts = F.split("host", r"\.")
    rows = evidence.withColumn("suffix", F.when(F.instr("host", ".") > 0, F.element_at(parts, -1)).otherwise(F.lit("")))
    rows = rows.withColumn("domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host")))
    everything = _sums(rows, [], n, "all_n").drop("_pages")
    full = rows
    for key in (*LEVELS, "declared"):
        full = _joined(full, _sums(rows, [key], n, f"{key}_n"), [key])
    full = full.join(F.broadcast(everything))

    def without_own(name):
        return F.zip_with(name, "text_p", lambda c, p: F.greatest(c - p, F.lit(0.0)))

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

    full = full.withColumn("all_c", without_own("all_n"))
    prior = F.transform("all_c", lambda c: (c + 1.0) / (total(F.col("all_c")) + float(n)))
    full = full.withColumn("prior", prior)
    for level in reversed(LEVELS):
        full = full.withColumn("c", without_own(f"{level}_n"))
        full = full.withColumn("prior", F.zip_with("c", "prior", lambda c, p: (c + SMOOTHING * p) / (total(F.col("c")) + SMOOTHING)))
    # The chance of this value given a language, against the chance of any value: the
    # suffix's own pull is in the prior's hierarchy, the declaration's is here.
    full = full.withColumn("c", without_own("declared_n")).withColumn("base", F.transform("all_c", lambda c: (c + 1.0) / (total(F.col("all_c")) + float(n))))
    full = full.withColumn("said", F.zip_with(F.zip_with("c", "base", lambda c, b: (c + SMOOTHING * b) / (total(F.col("c")) + SMOOTHING)), "base", lambda p, b: p / b))
    product = F.zip_with(F.zip_with("prior", "said", lambda a, b: a * b), "text_p", lambda a, b: a * b)
    full = full.withColumn("product", product)
    full = full.withColumn("posterior", F.transform("product", lambda x: x / total(F.col("product"))))

    def best(array):
        names = F.array(*(F.lit(x) for x in languages))
        return names[F.array_position(array, F.array_max(array)).cast("int") - 1]

    return full.select("page_id", "host", "declared", best(F.col("text_p")).alias("text_lang"), best(F.col("prior")).alias("prior_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"))


def identify(pages: DataFrame, docs: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, declared, text_lang, prior_lang, lang, confidence`` per page."""
    spark = pages.sparkSession
    small_batches(spark)
    model = fit_text(docs)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), declared_language(F.col(html)).alias("declared"), F.col(html).cast("string").alias("html"))
    if not model.languages:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "declared", none.alias("text_lang"), none.alias("prior_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    sent = spark.sparkContext.broadcast(model)
    evidence = stash(rows.mapInArrow(_text_evidence(sent), "page_id long, host string, declared string, text_p array<double>"), "evidence")
    return fuse(evidence, model.languages)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
