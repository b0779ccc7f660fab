"""Spelling variants: words one edit apart, found by their rarest bigrams.

Words are counted over all documents in one pass.  Bigrams are ordered by the number of
words that have them, rarest first (ties by code points; the order is one of bigrams, not
of bigrams and places, as an edit shifts the places behind it).  One edit breaks at most
two bigrams of a word, so of the three rarest of each of two near words, taken in that
order and from left to right, at least one pair is the same unbroken bigram.  Only these
three are joined.

The place of a shared bigram is part of the key.  As the bigram is unbroken, the edit is
either right of it, and both words agree from their starts to its end, or left of it, and
they agree from it to their ends: its place from that side is then the same.  Half of what
is left is the same, too: the edit is in one half of the rest and the other half is whole.
A key is therefore the bigram's side, all letters on that side, the length of the rest
and one half of the rest, hashed; what meets on a key is verified letter by letter.

Defined results
    null texts have no words; a null ``doc_id`` is written as the empty string where the
    hash wants one; rows that repeat are counted one by one; a run of any length is one
    word; an empty table gives an empty result; columns besides the two named are not
    read; words of equal counts are ordered by code points.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, stash, table, trimmed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run in so many, by hash, loses a code point.
DAMAGE = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Rarest bigrams that are joined: one more than an edit breaks.
PREFIX = 3
#: A form has at least so many times the occurrences of the word.
RATIO = 2
#: Distinct words that a task counts before it hands them on.
TALLY_WORDS = 100_000
#: Words whose keys a task makes at a time.
KEY_WORDS = 2_000


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """The damaged lower-case runs of one text, with how often each occurs."""
    lowered: Counter = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        lowered[run.lower() if run.isascii() else run.translate(LOWER)] += n
    out: Counter = Counter()
    name = "" if doc_id is None else str(doc_id)
    for run, n in lowered.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DAMAGE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            for word, n in runs_of(doc_id.as_py(), text.as_py()).items():
                if len(word) >= MIN_LENGTH:
                    seen[word] += n
            if len(seen) > TALLY_WORDS:
                yield out(seen)
                seen = Counter()
    yield out(seen)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words of all documents that are long and frequent enough."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(trimmed(_tally), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def bigram_order(lexicon: DataFrame) -> dict[str, int]:
    """The rank of each bigram, rarest first.

    There are as many as pairs of letters of the alphabet, however large the corpus: 90
    letters for ``RUN``, so at most 8,100 rows reach the driver.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda p: F.col("word").substr(p, F.lit(2)))
    counted = lexicon.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r.gram: k for k, r in enumerate(counted.orderBy("n", "gram").collect())}


def rarest(word: str, order: dict[str, int], size: int = PREFIX) -> list[int]:
    """Places of the ``size`` rarest bigrams, the leftmost first among equal ones."""
    return [p for _, p in heapq.nsmallest(size, ((order[word[p : p + 2]], p) for p in range(len(word) - 1)))]


def keys_of(word: str, order: dict[str, int]) -> tuple[set[int], set[int]]:
    """The keys of ``word`` beside a word as long or longer, and beside a shorter one."""
    own, longer = set(), set()
    for p in rarest(word, order):
        for side, same, rest in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p])):
            for shorter, keys in ((len(rest), own), (len(rest) - 1, longer)):
                if shorter < 0:
                    continue
                half = shorter // 2
                head, tail = rest[:half], rest[len(rest) - half :]
                for part, kept in (("a", head), ("z", tail)) if half else (("a", ""),):
                    keys.add(xxhash.xxh64_intdigest(f"{side}{shorter}{part}{same}|{kept}".encode()) - (1 << 63))
    return own, longer


def near_words(lexicon: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words one edit apart, once, in no order of a and b."""
    order = bigram_order(lexicon)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, KEY_WORDS):
                batch = whole.slice(at, KEY_WORDS)
                keys, place, longer = [], [], []
                for k, word in enumerate(batch.column(0).to_pylist()):
                    own, more = keys_of(word, order)
                    keys += [*own, *more]
                    place += [k] * (len(own) + len(more))
                    longer += [False] * len(own) + [True] * len(more)
                rows = batch.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), *rows.columns], ["key", "longer", "word", "n"])

    keyed = stash(lexicon.select("word", "n").mapInArrow(trimmed(key_rows), "key long, longer boolean, word string, n long"), "keys")
    a = keyed.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, "key").where("(longer AND length(b) = length(a) + 1) OR (NOT longer AND length(a) = length(b) AND a < b)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: chains followed to their ends.

    A form is more frequent than its word, so chains have no loops; each round doubles
    the steps, so there are as many rounds as the logarithm of the longest chain.
    """
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of ``docs``."""
    lexicon = stash(words(docs, doc_id, text), "words")
    pairs = near_words(lexicon)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    around = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = lexicon.join(around, "word", "left")
    taken = -F.col("best.less") >= RATIO * F.col("n")
    found = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(found: DataFrame) -> DataFrame:
    """Rows of ``variants`` with the size and the occurrences of the group of their root,
    summed before they are joined back."""
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("group_words"), F.sum("n").alias("group_n"))
    return found.join(sizes, "root")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
