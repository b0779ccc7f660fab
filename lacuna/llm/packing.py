"""Packing tokenized documents by cutting-stock column generation.

Each document is cut into full sequences and one rest.  The pieces' lengths form a
histogram, of exact lengths while they are at most ``CLASSES``, else of as many classes,
narrow where pieces are many; a linear program over patterns (classes that fit one
sequence together) covers it, its columns priced by knapsack dynamic programming; the
patterns are rounded, what that leaves is packed longest first, and each class's ranked
pieces are dealt to the patterns' places.

Only the histogram (a count for each length up to the capacity) and the plan made from
it (at most a few places per class and pattern) are on the driver, whatever the corpus.
Cuts depend on a document's own length alone, so texts are read and tokenized once.

Defined results
    a null text is empty and gives one piece of one token (the end token); texts of
    any length give full pieces and a rest; rows that repeat are packed each; ties in
    rank are broken by the hash of the id and then the id; an empty table gives an
    empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, stash, table, trimmed

CAPACITY, END = 4096, 2
CLASSES = 768
#: A linear program this close to its optimum is good enough.
GAP, MOST_PIVOTS = 0.0005, 6000
#: Weight of the best prices so far when new patterns are priced, and rounds of pricing
#: that may pass without a gain of ``GAP``.
STEADY, STALLED = 0.7, 40
#: Least pivot and residual against the largest entry, and pivots between two inversions.
PIVOT, TOLERANCE, FRESH = 1e-7, 1e-8, 40
#: How far demands are moved apart; times that a basis may turn out to be singular.
SPREAD, MOST_LOSSES = 1e-5, 50
#: A rounded-up pattern may leave this share of a sequence empty before it is topped up.
FILLED = 0.05
#: Columns taken from one knapsack.
PRICED = 40
#: Distinct words whose ids a worker remembers; others are encoded again.
MEMO_WORDS = 400_000
#: New words that are encoded in one call, a marker between them.
JOINED_WORDS = 512
#: Bytes of text that are tokenized together.
TEXT_BYTES = 4 << 20
#: Pieces of a class that one task ranks, on average, by hash buckets.
BUCKET_ROWS = 1 << 16
#: Rows in turn that are ranked together where a place is given: 2^20.
PLACE_BITS = 20


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_tokenizers: dict[str, WordTokenizer] = {}


def _run_together(a: str, b: str) -> bool:
    """Whether ``a`` ends as ``b`` begins, short of being ``b`` itself."""
    return any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b)))


class WordTokenizer:
    """Ids of whole texts, a word at a time.

    The vocabulary's splitter never joins text across white space and drops it, so a
    text's ids are those of its words in turn; a batch's distinct words are looked up
    once each, and each new word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder, self.memo = Tokenizer.from_file(path), {}
        normalizer = self.encoder.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        added = self.encoder.get_added_tokens_decoder()
        plain = [(k, t.content) for k, t in added.items() if not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        # A marker that no added token can run into, so every one that is put in is found.
        self.marker = next(((k, m) for k, m in plain if not any(_run_together(m, t.content) or _run_together(t.content, m) for t in added.values())), None)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        alone = lambda some: [array("I", e.ids).tobytes() for e in self.encoder.encode_batch_fast(some, add_special_tokens=False)]
        if self.marker is None:
            return alone(words)
        (mark, text), out = self.marker, []
        runs = [words[k : k + JOINED_WORDS] for k in range(0, len(words), JOINED_WORDS)]
        for run, e in zip(runs, self.encoder.encode_batch_fast([text.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
            if len(stops) != len(run):  # a word has the marker in it
                out += alone(run)
                continue
            data, begin = ids.tobytes(), 0
            for stop in stops:
                out.append(data[4 * begin : 4 * stop])
                begin = stop + 1
        return out

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the 32-bit ids of all texts in turn, and where each text's
        begin, and the last one's end."""
        texts = texts.fill_null("")
        if self.lowers:  # so ASCII texts may be lowered before, which leaves fewer words
            texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct, memo = coded.dictionary.to_pylist(), self.memo
        known = list(map(memo.get, distinct))
        missing = [k for k, ids in enumerate(known) if ids is None]
        new = [distinct[k] for k in missing]
        for k, w, ids in zip(missing, new, self._encode_words(new), strict=True):
            known[k] = ids
            if len(memo) < MEMO_WORDS:  # the words that come first: most of them are frequent
                memo[w] = ids
        at, sizes = coded.indices.to_numpy(), np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(known), "<u4")[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], n)]
        return ids, ends[words.offsets.to_numpy()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, ends = self.ids_of(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _joined(batches):
    """The batches, several at a time up to ``TEXT_BYTES``: words are then looked up less often."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _pieces(path: str, capacity: int, end: int):
    """Rows (doc_id, row order, start, length, ids_crc32, doc_tokens)."""
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in _joined(batches):
            ids, ends = tokenizer.ids_of(batch.column(2))
            data, rows = memoryview(ids).cast("B") if len(ids) else b"", []
            for k, (begin, stop) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                n = stop - begin + 1
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(data[4 * (begin + start) : 4 * min(begin + start + length, stop)])
                    rows.append((k, start, length, zlib.crc32(tail, crc) if start + length == n else crc, n))
            found = np.array(rows, np.int64).reshape(-1, 5)
            at = pa.array(found[:, 0])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(found[:, c]) for c in range(1, 5))], names=["doc_id", "place", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def length_classes(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(class of each length, length of each class)``, lengths from 1, classes from 0.

    ``counts[l-1]`` pieces have length l.  With at most ``most`` lengths each is a class
    of its own and nothing is rounded; else neighbours share one, whose length is the
    longest that occurs in it, and the classes are narrow where pieces are many.
    """
    seen = np.flatnonzero(counts)
    if len(seen) <= most:
        of_seen = np.arange(len(seen))
    else:
        # What rounding wastes is least where a class's width goes with 1 / sqrt(pieces).
        weight = np.cumsum(np.sqrt(counts[seen]))
        of_seen = np.unique(np.minimum((weight * (most / weight[-1])).astype(np.int64), most - 1), return_inverse=True)[1]
    sizes = np.zeros(of_seen[-1] + 1 if len(seen) else 0, np.int64)
    np.maximum.at(sizes, of_seen, seen + 1)
    classes = np.full(len(counts), -1, np.int64)
    classes[seen] = of_seen
    return classes, sizes


def _best_patterns(values: np.ndarray, sizes: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over ``sizes`` worth ``values``: what the best pattern is
    worth, and up to ``most`` patterns, the best ones that begin with different sizes."""
    m = len(values)
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            worth = best[c - sizes[:k]] + values[:k]
            at = int(worth.argmax())
            if worth[at] > best[c]:
                best[c], last[c] = worth[at], at
    begun = np.where(values > 0, values + best[capacity - sizes], 0)
    out = []
    for s in np.argsort(-begun, kind="stable")[:most]:
        if begun[s] <= 1:
            break
        pattern, c = np.zeros(m, np.int64), capacity - sizes[s]
        pattern[s] = 1
        while c > 0:
            if last[c] >= 0:
                pattern[last[c]] += 1
                c -= sizes[last[c]]
            else:
                c -= 1
        out.append(pattern)
    return float(best[capacity]), np.array(out, np.int64).reshape(-1, m)


class _Basis:
    """A basis of patterns with its inverse.

    The inverse is updated at a pivot and made afresh from the whole-number columns
    after every ``FRESH`` pivots, or as soon as it no longer solves for the demand; a
    basis that then turns out to be singular is put back to the last good one.
    """

    def __init__(self, columns: np.ndarray, demand: np.ndarray):
        self.columns, self.demand, self.since = columns.astype(float), demand, 0  # whole numbers, exact
        self.scale = max(1.0, float(demand.max()))
        self.good = self.columns.copy()
        self.inverse = np.linalg.inv(self.columns)

    def solution(self) -> np.ndarray:
        return self.inverse @ self.demand

    def _residual(self) -> float:
        return float(np.abs(self.columns @ self.solution() - self.demand).max()) / self.scale

    def refresh(self) -> bool:
        """True if the inverse is sound; False if the last good basis was put back."""
        self.since = 0
        try:
            self.inverse = np.linalg.inv(self.columns)
            sound = bool(np.isfinite(self.inverse).all()) and self._residual() < TOLERANCE
        except np.linalg.LinAlgError:
            sound = False
        if sound:
            self.good = self.columns.copy()
        else:
            self.columns = self.good.copy()
            self.inverse = np.linalg.inv(self.columns)
        return sound

    def enter(self, column: np.ndarray) -> bool:
        """Pivot on ``column``; False if the last good basis had to be put back."""
        move, x = self.inverse @ column, self.solution()
        up = np.flatnonzero(move > PIVOT * max(1.0, float(np.abs(move).max())))
        if not len(up):
            return self.refresh()
        # Of the rows that leave within the tolerance, the one with the largest pivot.
        slack = TOLERANCE * self.scale
        step = ((np.maximum(x[up], 0) + slack) / move[up]).min()
        tied = up[np.maximum(x[up], 0) / move[up] <= step]
        leave = int(tied[move[tied].argmax()])
        row = self.inverse[leave] / move[leave]
        self.inverse -= np.outer(move, row)
        self.inverse[leave] = row
        self.columns[:, leave] = column
        self.since += 1
        return self.refresh() if self.since >= FRESH or self._residual() > TOLERANCE else True


def _linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(patterns, times, bound)`` of the relaxation: one column per pattern.

    It starts from one-size patterns; ``pool`` holds the first columns to enter, then
    the knapsack prices new ones.  The bound is the worth of any non-negative prices,
    scaled so that no pattern is worth more than one, so it holds whatever was rounded.
    """
    per = np.maximum(capacity // sizes, 1)
    # Demands that are slightly apart from each other: pivots that move nothing are rare.
    apart = demand * (1 + SPREAD * np.random.default_rng(len(sizes)).random(len(sizes)))
    basis = _Basis(np.diag(per), apart)
    steady, stalled, reached = sizes / capacity, 0, float("inf")
    bound, losses, pivots = float(demand @ steady) * (1 - 1e-9), 0, 0
    while pivots < MOST_PIVOTS and losses < MOST_LOSSES:
        duals = basis.inverse.sum(axis=0)
        worth = pool @ duals
        at = int(worth.argmax()) if len(worth) else 0
        if not len(worth) or worth[at] <= 1 + GAP:
            if basis.since and not basis.refresh():
                losses += 1
            duals, total = np.maximum(basis.inverse.sum(axis=0), 0), float(basis.solution().sum())
            stalled = 0 if total < reached * (1 - GAP) else stalled + 1
            reached = total if not stalled else reached
            for weight in (STEADY, 0.0):  # between the best prices so far and the basis's own
                prices = weight * steady + (1 - weight) * duals
                most, found = _best_patterns(prices, sizes, capacity, PRICED)
                pool = found.astype(float)
                lower = float(demand @ prices) / most * (1 - 1e-9)
                if lower > bound:
                    bound, steady = lower, prices / most
                if len(pool) and (pool @ duals).max() > 1 + GAP:
                    break
            if stalled >= STALLED or not len(pool) or (pool @ duals).max() <= 1 + GAP or total <= max(bound * (1 + GAP), np.ceil(bound)):
                break
            continue
        if not basis.enter(pool[at]):
            losses += 1
            pool = np.delete(pool, at, axis=0)
        pivots += 1
    basis.refresh()
    basis.demand = demand
    return basis.columns.astype(np.int64), np.maximum(basis.solution(), 0), bound


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, np.ndarray]], float]:
    """``(patterns, bound)`` for ``demand[k] > 0`` pieces of length ``sizes[k]``, ascending.

    patterns: ``(times, pieces of each size)`` that hold the demand exactly; bound: a
    lower bound on the number of sequences.  The relaxation's patterns are taken their
    whole times, then once each in the order of what is left of their times while they
    are filled; what that leaves is packed longest first.
    """
    m = len(sizes)
    if not m:
        return [], 0.0
    plain = _longest_first(sizes, demand, capacity)
    columns, x, bound = _linear_program(sizes, demand.astype(float), capacity, np.array([column for _, column in plain], float))
    left = demand.astype(np.int64).copy()
    patterns = []
    for k in np.argsort(-x, kind="stable"):
        column = columns[:, k]
        used = column > 0
        times = min(int(x[k] + 1e-9), int((left[used] // column[used]).min()))
        if times > 0:
            patterns.append((times, column.copy()))
            left -= times * column
    parts = x - np.floor(x + 1e-9)
    for k in np.argsort(-parts, kind="stable"):
        if parts[k] <= 1e-6 or not left.any():
            break
        column = np.minimum(columns[:, k], left)
        if column.any() and capacity - int(column @ sizes) <= FILLED * capacity:
            column = _topped_up(column, left, sizes, capacity)
            patterns.append((1, column))
            left -= column
    return patterns + _longest_first(sizes, left, capacity), bound


def _topped_up(column: np.ndarray, left: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """``column`` with the longest pieces left that fit beside it, one after another."""
    column, room = column.copy(), capacity - int(column @ sizes)
    while room >= sizes[0]:
        k = int(np.searchsorted(sizes, room, side="right"))
        fits = np.flatnonzero(left[:k] > column[:k])
        if not len(fits):
            break
        s = int(fits[-1])
        n = min(int(left[s] - column[s]), room // int(sizes[s]))
        column[s] += n
        room -= n * int(sizes[s])
    return column


def _longest_first(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Fill one sequence after another, the longest piece that fits first."""
    left, out = left.astype(np.int64).copy(), []
    while left.any():
        column = _topped_up(np.zeros_like(left), left, sizes, capacity)
        used = column > 0
        times = int((left[used] // column[used]).min())
        out.append((times, column))
        left -= times * column
    return out


def _plan(spark, patterns: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``(class, rank_from, rank_to, each, first, turn)``: pieces of a class with ranks
    in a range go ``each`` to a sequence, from sequence ``first`` on."""
    rows, first, given = [], 0, {}
    for times, column in patterns:
        for turn, s in enumerate(np.flatnonzero(column)[::-1]):
            each = int(column[s])
            at = given.get(s, 0)
            given[s] = at + each * times
            rows.append((int(s), at, given[s], each, first, turn))
        first += times
    return spark.createDataFrame(rows, "class int, rank_from long, rank_to long, each int, first long, turn int")


def _listed(values: np.ndarray) -> Column:
    """A literal array."""
    return F.expr(f"array({','.join(map(str, values.tolist()))})")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text", place: Column | None = None) -> DataFrame:
    """Per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, padded_to``.

    ``place``, if given, ranks the documents (a long); else a hash of the id does.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = F.xxhash64(F.col(id_column)) if place is None else place
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), order.cast("long").alias("place"), F.col(text_column).cast("string").alias("text"))
    kinds = "doc_id long, place long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stash(rows.mapInArrow(trimmed(_pieces(path or tokenizer_file(), capacity, end)), kinds), "pieces")

    counts = np.zeros(capacity, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"] - 1] = r.n
    classes, sizes = length_classes(counts, CLASSES)
    demand = np.bincount(classes[classes >= 0], counts[classes >= 0], len(sizes)).astype(np.int64)
    patterns, _ = cutting_stock(sizes, demand, capacity)

    class_of = _listed(classes)[(F.col("length") - 1).cast("int")]
    classed = pieces.withColumn("class", class_of)
    if place is None:
        spread = _listed(-(-demand // BUCKET_ROWS))[F.col("class")]
        bucketed = classed.withColumn("bucket", F.pmod(F.xxhash64("place", "start", "ids_crc32"), spread))
    else:
        bucketed = classed.withColumn("bucket", F.shiftright("place", PLACE_BITS))
    rows = bucketed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = rows.select("class", "bucket", "n", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("ahead"))
    # Ranges of the plan meet buckets, not pieces: a piece then looks among its bucket's few.
    met = ahead.join(F.broadcast(_plan(spark, patterns)), "class").where("rank_from < ahead + n AND rank_to > ahead")
    ranges = F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "each", "first", "turn"))).alias("ranges")
    met = met.groupBy("class", "bucket", "ahead").agg(ranges)
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("place", "doc_id", "start"))
    ranked = bucketed.withColumn("inside", inside).join(met, ["class", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside") - 1)
    dealt = ranked.withColumn("range", F.filter("ranges", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"]))[0])
    dealt = dealt.withColumn("sequence_id", F.expr("range.first + (rank - range.rank_from) div range.each")).withColumn("spot", F.struct("range.turn", "rank"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("spot")) - F.col("length")
    out = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", before.alias("offset"), F.sum("length").over(Window.partitionBy("sequence_id")).alias("sequence_tokens"))
    exact = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return out.withColumn("padded_to", F.when(exact, F.col("sequence_tokens")).otherwise(F.lit(capacity)))


def written_place(docs: DataFrame) -> Column | None:
    """The rank of a row in the Parquet files that ``docs`` was read from, or None."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part, 33) + F.col("_metadata.row_index")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
