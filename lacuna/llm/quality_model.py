"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features: each word and the
character n-grams of ``<word>``, hashed to ``SLOTS`` rows, each pair of adjacent words,
hashed to as many rows of their own, and, for a pair of equal words, one row that all
such pairs share, so that the stutter of an unseen word is known; a softmax over the two
classes follows.  Vectors and output weights are fitted by stochastic gradient descent in numpy on the
driver, on a bounded sample of labelled rows; every document is then scored whole on
the executors.

The softmax of a mean is linear in the features, so scoring needs one number per slot
(the difference of the two classes), which is all that is broadcast.

Defined results
    null or blank texts are scored by the class prior; without a label to learn from
    every score is the prior 0.5; rows that repeat are scored each, and learned from
    each while the sample has room; conflicting labels are both seen; labels other than
    0 and 1 are left out; texts of any length are scored whole; equal texts have equal
    scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, table
from lacuna.llm.wordhash import codes_of, mix, words_of

#: Rows for words and their n-grams, and as many after them for pairs of words.
SLOTS, DIMS = 1 << 17, 16
#: The row of a word after itself, the last one.
AGAIN = 2 * SLOTS
SHORTEST, LONGEST = 3, 4
#: The sample that is fitted: rows, and characters of a row's text at most.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 30_000
EPOCHS, RATE, SEED = 5, 0.5, 7
#: Distinct words after which a worker forgets what it knows of them and begins anew.
MEMO_WORDS = 300_000
CUT = 0.7


def features(word: bytes) -> list[int]:
    """Slots of a word and of its character n-grams (bytes of UTF-8)."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w, 1) % SLOTS]
    for n in range(SHORTEST, LONGEST + 1):
        out += [zlib.crc32(w[i : i + n]) % SLOTS for i in range(len(w) - n + 1)]
    return out


def pair_slots(codes: np.ndarray) -> np.ndarray:
    """Slots of the pairs of adjacent words, from the words' 64-bit codes."""
    both = mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])
    return (both % np.uint64(SLOTS)).astype(np.int64) + SLOTS


def _bag(words: list[bytes], memo: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``(slots, shares)`` of a document's features."""
    counts: Counter[int] = Counter()
    for word, times in Counter(words).items():
        slots = memo.get(word)
        if slots is None:
            slots = memo[word] = features(word)
        for s in slots:
            counts[s] += times
    pairs, times = np.unique(pair_slots(codes_of(words)), return_counts=True)
    if again := sum(map(bytes.__eq__, words, words[1:])):
        pairs, times = np.append(pairs, AGAIN), np.append(times, again)
    slots = np.concatenate([np.fromiter(counts.keys(), np.int64, len(counts)), pairs])
    weights = np.concatenate([np.fromiter(counts.values(), float, len(counts)), times])
    return slots, weights / max(1.0, weights.sum())


class Model:
    """Slot vectors ``vectors``, output weights ``output`` (2 x DIMS) and ``bias``."""

    def __init__(self, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-1 / DIMS, 1 / DIMS, (AGAIN + 1, DIMS))
        self.output, self.bias = np.zeros((2, DIMS)), np.zeros(2)

    def chances(self, slots: np.ndarray, share: np.ndarray) -> np.ndarray:
        logits = self.output @ (share @ self.vectors[slots]) + self.bias
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def gradients(self, slots: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log loss of one document: by its slots' vectors, the output, the bias."""
        error = self.chances(slots, share)
        error[label] -= 1
        return np.outer(share, error @ self.output), np.outer(error, share @ self.vectors[slots]), error

    def fit(self, texts: list[str | None], labels: list[int]) -> Model:
        memo: dict[bytes, list[int]] = {}
        bags = [_bag(words_of(t), memo) for t in texts]
        counts = np.bincount(np.array(labels, int), minlength=2)[:2]
        if counts.sum():
            self.bias = np.log((counts + 1) / (counts.sum() + 2))
        if not counts.all():
            return self
        weigh = counts.sum() / (2 * counts)  # both classes pull alike; the bias holds the prior
        steps, turn = EPOCHS * len(bags), 0
        for _ in range(EPOCHS):
            for k in self.rng.permutation(len(bags)):
                slots, share = bags[k]
                rate = RATE * (1 - turn / steps) * weigh[labels[k]]
                turn += 1
                if not len(slots):
                    continue
                by_vectors, by_output, by_bias = self.gradients(slots, share, labels[k])
                self.output -= rate * by_output
                self.bias -= 0.01 * rate * by_bias
                self.vectors[slots] -= rate * len(slots) ** 0.5 * by_vectors
        return self

    def slots(self) -> tuple[np.ndarray, float]:
        """The difference of the classes for each slot, and of their biases."""
        return self.vectors @ (self.output[1] - self.output[0]), float(self.bias[1] - self.bias[0])


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> Model:
    """A model of ``labels`` outside the held-out part, over at most ``SAMPLE_ROWS``
    rows, those first in the order of a hash of their ids."""
    seen = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    some = seen.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label")).orderBy(F.md5(F.col("id").cast("string")), "id", "label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    # An id may repeat in the documents: the sample is bounded again after the join.
    met = texts.join(F.broadcast(some), "id").orderBy(F.md5(F.col("id").cast("string")), "id", "label", "text").limit(SAMPLE_ROWS)
    rows = sorted((r.id, r.label, r.text or "") for r in met.collect())
    return Model().fit([r[2] for r in rows], [r[1] for r in rows])


class _Known(dict):
    """The place of each word in arrays of its features' sum and number and its code."""

    def __init__(self, slot: np.ndarray):
        super().__init__()
        self.slot = slot
        self.sums, self.sizes, self.codes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at, own = len(self), features(word)
        if at == len(self.sums):
            self.sums, self.sizes, self.codes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.codes))
        self[word] = at
        self.sums[at], self.sizes[at], self.codes[at] = self.slot[own].sum(), len(own), codes_of([word])[0]
        return at

    def logit(self, words: list[bytes]) -> float:
        """The mean over the features of a document, 0 if it has none."""
        if not words:
            return 0.0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        again = int((at[1:] == at[:-1]).sum())
        total = self.sums[at].sum() + self.slot[pair_slots(self.codes[at])].sum() + again * self.slot[AGAIN]
        return float(total / (self.sizes[at].sum() + len(words) - 1 + again))


def _scores(sent):
    def run(batches):
        slot, bias = sent.value
        known = _Known(slot)
        for batch in batches:
            if len(known) > MEMO_WORDS:
                known = _Known(slot)
            logits = np.array([bias + known.logit(words_of(text)) for text in batch.column(1).to_pylist()], float)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text; ``score`` is the chance of label 1."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.slots())
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_scores(sent), "doc_id long, score double")


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
