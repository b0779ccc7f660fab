"""Substring dedup by level-wise doubling.

Levels double up to the window's length (13, 25, 50 words for 50).  At the first one
each window of the full length stands for itself by one of its runs of that many words,
picked so that equal windows pick equal runs (the least code); runs are counted over
all documents.  Only windows whose run repeats in another document are extended to the
next level, where they pick a run of twice the length, and are counted again, until the
full length is reached or no candidate survives.  ``repeated_levels`` carries on
doubling beyond it until no candidate survives.

A document whose words all equal those of a smaller id is settled at once: each of
its windows also starts there, and the smaller one stands for it in what follows.
Runs and windows that very many documents share are joined apart (``spread_join``).

Defined results
    null, blank or short texts lose nothing; a null ``doc_id`` is compared with
    nothing; rows that repeat a ``doc_id`` are judged one by one against smaller ids
    only; ties have no part in the definition; extra columns are ignored; an empty
    table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, spread_join, stash, table
from lacuna.llm.wordhash import codes_of, window_codes, words_of

#: Ids broadcast to filter a scan; beyond it the same join is shuffled.
BROADCAST_IDS = 250_000
#: Texts of several documents broadcast to all rows (some 100 bytes each).
BROADCAST_FIRSTS = 100_000
#: Words of the first level's runs, at least.
LEAST_RUN = 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def levels(length: int) -> list[int]:
    """Lengths from ``LEAST_RUN`` up (or one half at least), each twice the one before
    less one at most, the last of them ``length``."""
    out = [length]
    while (half := (out[0] + 1) // 2) >= (2 if len(out) == 1 else LEAST_RUN) and half < out[0]:
        out.insert(0, half)
    return out


def _selected(codes: np.ndarray, length: int, run: int) -> np.ndarray:
    """For each window of ``length`` words the least code of its runs of ``run`` words."""
    runs = window_codes(codes, run)
    span = length - run + 1
    if len(runs) < span:
        return np.zeros(0, np.uint64)
    # Running minimum over ``span`` values: from both ends of blocks of that size.
    n = len(runs)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = runs
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - span + 1], left[span - 1 : n])


def _survey(length: int, run_words: int):
    """Rows (doc_id, key, n_words, sha of all words, runs picked at the first level)."""

    def run(batches):
        for batch in batches:
            n, shas, marks = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                marks.append(np.unique(_selected(codes_of(words), length, run_words)).view(np.int64) if len(words) >= length else [])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "key", "n_words", "sha", "marks"])

    return run


def _candidates(codes: np.ndarray, length: int, run_words: int, marks) -> np.ndarray:
    """Windows whose run at this level is one of ``marks``."""
    return np.isin(_selected(codes, length, run_words), np.array(marks, np.int64).view(np.uint64))


def _extended(length: int, run_words: int, longer: int):
    """Rows (doc_id, runs of ``longer`` words) of the windows that are candidates."""

    def run(batches):
        for batch in batches:
            marks = []
            for text, had in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                codes = codes_of(words_of(text))
                marks.append(np.unique(_selected(codes, length, longer)[_candidates(codes, length, run_words, had)]).view(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "marks"])

    return run


def _windows(length: int, run_words: int):
    """Rows (a, b, doc_id, key, start) of the windows that are candidates."""

    def run(batches):
        for batch in batches:
            for doc_id, key, text, marks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                codes = codes_of(words_of(text))
                starts = np.flatnonzero(_candidates(codes, length, run_words, marks))
                k = len(starts)
                pair = [pa.array(window_codes(codes, length, which)[starts].view(np.int64)) for which in (0, 1)]
                yield pa.record_batch([*pair, pa.array(np.full(k, doc_id, np.int64)), pa.array(np.full(k, key, np.int64)), pa.array(starts.astype(np.int32))], names=["a", "b", "doc_id", "key", "start"])

    return run


def _windows_at(length: int):
    """The same rows for the windows at given starts."""

    def run(batches):
        for batch in batches:
            for doc_id, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes = codes_of(words_of(text))
                starts = np.sort(np.array(starts, np.int32))
                starts = starts[starts <= len(codes) - length]
                pair = [pa.array(window_codes(codes, length, which)[starts].view(np.int64)) for which in (0, 1)]
                k = len(starts)
                yield pa.record_batch([*pair, pa.array(np.full(k, doc_id, np.int64)), pa.array(np.zeros(k, np.int64)), pa.array(starts)], names=["a", "b", "doc_id", "key", "start"])

    return run


def _cut(length: int):
    """Rows (doc_id, key, n_removed, kept_sha256, kept text) after the removals."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, key, text, starts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.array(starts) + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, gone in zip(words, covered, strict=True) if not gone)
                out.append((doc_id, key, int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "key", "n_removed", "kept_sha256", "kept"])

    return run


def _repeated_marks(rows: DataFrame) -> DataFrame:
    """``(doc_id, marks)``: of the picked runs those that another document has too."""
    each = rows.select("doc_id", F.explode("marks").alias("mark"))
    counted = each.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = stash(counted.where("lo < hi").select("mark", "n"), "shared")
    return stash(spread_join(each, shared, ["mark"], "n").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "marks")


def substring_dedup(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per input row ``doc_id, n_words, n_removed, kept_sha256, kept``; ``kept`` holds
    the words left (joined by a blank) where something was removed, else null."""
    if length < 2:
        raise ValueError("a window has two words at least")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    runs = levels(length)
    rows = stash(docs.mapInArrow(_survey(length, runs[0]), "doc_id long, key long, n_words long, sha string, marks array<long>"), "survey")

    firsts = stash(rows.where(f"n_words >= {length}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("first IS NOT NULL"), "firsts")
    judged = rows.select("doc_id", "sha", "marks").join(firsts.select("sha", F.col("first").alias("doc_id")), ["sha", "doc_id"], "left_semi").select("doc_id", "marks")
    marks = _repeated_marks(stash(judged, "judged"))

    ids = marks.select("doc_id")
    few = marks.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "key"])
    texts = stash(some.join(marks, "doc_id").select("doc_id", "key", "text", "marks"), "texts")
    for had, run in zip(runs, runs[1:-1], strict=False):
        if marks.isEmpty():
            break
        marks = _repeated_marks(stash(texts.mapInArrow(_extended(length, had, run), "doc_id long, marks array<long>"), "extended"))
        texts = stash(texts.drop("marks").join(marks, "doc_id"), "texts")

    last = runs[-2] if len(runs) > 1 else runs[-1]
    windows = stash(texts.mapInArrow(_windows(length, last), "a long, b long, doc_id long, key long, start int"), "windows")
    counted = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = stash(counted.where("lo < hi").select("a", "b", "lo", "n"), "shared")
    gone = spread_join(windows, shared, ["a", "b"], "n").where("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"))
    cut = texts.join(gone, ["doc_id", "key"]).select("doc_id", "key", "text", "starts").mapInArrow(_cut(length), "doc_id long, key long, n_removed long, kept_sha256 string, kept string")
    own = spread_join(rows.select("doc_id", "key", "n_words", "sha"), firsts, ["sha"], "n", "left", BROADCAST_FIRSTS)
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return own.join(cut, ["doc_id", "key"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def repeated_levels(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, length, start)`` of each window that another document has too, for
    ``length``, twice that, and so on until no candidate survives.

    A window of twice the length is a candidate if both of its halves were repeated.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id IS NOT NULL")
    half = levels(length)[-2:][0]
    surveyed = stash(docs.withColumn("key", F.lit(0).cast("long")).mapInArrow(_survey(length, half), "doc_id long, key long, n_words long, sha string, marks array<long>"), "survey")
    marks = _repeated_marks(surveyed.select("doc_id", "marks"))
    texts = stash(docs.join(marks, "doc_id").select("doc_id", F.lit(0).cast("long").alias("key"), "text", "marks"), "texts")
    windows = texts.mapInArrow(_windows(length, half), "a long, b long, doc_id long, key long, start int")
    found = []
    while True:
        shared = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b")
        level = stash(windows.join(shared, ["a", "b"], "left_semi").select("doc_id", F.lit(length).alias("length"), "start").distinct(), "level")
        if level.isEmpty():
            break
        found.append(level)
        ahead = level.select("doc_id", (F.col("start") - length).alias("start"))
        both = level.select("doc_id", "start").join(ahead, ["doc_id", "start"], "left_semi").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
        length *= 2
        windows = texts.join(both, "doc_id").select("doc_id", "text", "starts").mapInArrow(_windows_at(length), "a long, b long, doc_id long, key long, start int")
    out = found[0] if found else level
    for level in found[1:]:
        out = out.union(level)
    return out


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
