"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into ``SLABS`` slabs; a slab's scores of a query are one score
list, spread over the tasks.  (1) Each task scores every row on one slab, in turn, and
gathers the best of each list; those few are scored whole, and the k-th best of all
tasks is a safe cutoff, for no true answer scores less.  (2) The cutoff is broadcast.
A true answer reaches its uniform share, cutoff / slabs, in some list, so rows are
scored slab after slab, and a row is collected where it reaches the share; what it
lacks is bounded by the lengths of query and row in the slabs not yet scored, and a row
that cannot reach the cutoff any more is let go.  (3) Only the slabs that the collected
rows lack are scored, exactly, and merged.

``top_k`` can report how many products of components were made.  Queries go in blocks
of ``QUERIES`` vectors, the only thing broadcast; each block is held against all
rows, which are read where they lie and never shuffled.

Defined results
    vectors that are null or hold a null or a non-finite component take no part, nor
    do null ids; missing components count as zero; scores beyond a long are clipped to
    it (and blocks whose scores may pass 2^53 are scored whole, in exact integers); rows with the query's own id are its own; of rows that repeat a query's id the
    vector first in order asks; other rows that repeat count each; ties go to the
    smaller id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.runtime import stash, table

SLABS = 16
#: Query vectors broadcast at once, and those of them scored at once in a task.
QUERIES, QUERIES_AT_ONCE = 16_384, 1024
#: Rows scored at once in a task: with QUERIES_AT_ONCE this bounds its memory.
ROWS = 2048
#: While more than this share of the pairs runs on, a slab is scored for all of them at once.
DENSE = 0.3
LEAST = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def sound(vector: Column) -> Column:
    """True for vectors of finite components only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class _Lists:
    """Rows against queries by slabs: exact score lists and bounds of what they lack."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        self.queries, self.rows, self.made = queries, rows, 0
        width = rows.shape[1]
        self.slabs = np.array_split(np.arange(width), min(SLABS, max(1, width)))
        self.large = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, width) >= 2**53
        # A slab's score is at most the product of the two lengths in it; lengths are taken
        # a little longer than they are, so that rounding never lets a row go.
        self.of_queries, self.of_rows = (np.stack([_lengths(v[:, at]) for at in self.slabs], axis=1) for v in (queries, rows))
        self.q, self.r = queries.astype(float), rows.astype(float)

    def scores(self, slab: int, which: slice) -> np.ndarray:
        """The list of a slab for the rows ``which``, all queries: whole numbers below
        2^53, so exact in doubles, unless ``large``."""
        at = self.slabs[slab]
        self.made += len(self.queries) * len(range(*which.indices(len(self.rows)))) * len(at)
        return self.q[:, at] @ self.r[which][:, at].T

    def of_pairs(self, slab: int, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The list of a slab for given pairs of query and row."""
        at = self.slabs[slab]
        self.made += len(q) * len(at)
        return np.einsum("ij,ij->i", self.q[:, at][q], self.r[:, at][r])

    def whole(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        self.made += len(q) * self.rows.shape[1]
        if self.large:
            return np.array([min(max(int(np.dot(self.queries[i].astype(object), self.rows[j].astype(object))), LEAST + 1), -LEAST - 1) for i, j in zip(q, r, strict=True)], np.int64)
        return np.einsum("ij,ij->i", self.queries[q], self.rows[r])


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)


def _blocks(batches, queries):
    """``(part of the queries, ids of rows, lists)`` for blocks of rows and queries."""
    ids_q, rows_q = queries

    def made(ids, rows):
        width = max([rows_q.shape[1], *map(len, rows)])
        ids, matrix = np.array(ids, np.int64), _matrix(rows, width)
        for at in range(0, len(ids_q), QUERIES_AT_ONCE):
            part = slice(at, min(at + QUERIES_AT_ONCE, len(ids_q)))
            wide = np.zeros((part.stop - at, width), np.int64)
            wide[:, : rows_q.shape[1]] = rows_q[part]
            yield part, ids, _Lists(wide, matrix)

    ids, rows = [], []
    for batch in batches:
        for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            rows.append(r)
            if len(ids) >= ROWS:
                yield from made(ids, rows)
                ids, rows = [], []
    if ids:
        yield from made(ids, rows)


class _Best:
    """Each query's best rows so far in a task."""

    def __init__(self, queries, k: int):
        self.ids_q, self.k = queries[0], k
        self.ids = np.zeros((len(self.ids_q), k), np.int64)
        self.scores = np.full((len(self.ids_q), k), LEAST, np.int64)

    def add(self, part: slice, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows ``ids`` with ``scores`` for the queries ``q`` of a part, its own left out."""
        fine = (ids != self.ids_q[part][q]) & (scores > LEAST)
        q, ids, scores = q[fine], ids[fine], scores[fine]
        if not len(q):
            return
        order = np.lexsort((ids, ~scores, q))  # ~x falls where x rises, for every long
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        new_ids = np.zeros((part.stop - part.start, self.k), np.int64)
        new_scores = np.full(new_ids.shape, LEAST, np.int64)
        new_ids[q[first], place[first]], new_scores[q[first], place[first]] = ids[first], scores[first]
        ids, scores = np.concatenate([self.ids[part], new_ids], axis=1), np.concatenate([self.scores[part], new_scores], axis=1)
        order = np.lexsort((ids, ~scores, scores == LEAST), axis=1)[:, : self.k]
        self.ids[part], self.scores[part] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def batch(self, made: int):
        """The rows found, and one with the number of products made."""
        at, col = np.nonzero(self.scores != LEAST)
        columns = ([*self.ids_q[at].tolist(), None], [*self.ids[at, col].tolist(), None], [*self.scores[at, col].tolist(), made])
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _local_lists(queries, k: int):
    """Phase 1: the best k of the task among the leaders of its score lists."""

    def run(batches):
        got, made = queries.value, 0
        best = _Best(got, k)
        for part, ids, lists in _blocks(batches, got):
            for slab in range(len(lists.slabs)):
                which = slice(slab, None, len(lists.slabs))
                have = len(ids[which])
                if not have:
                    continue
                take = min(k + 1, have)
                leaders = np.argpartition(-lists.scores(slab, which), take - 1, axis=1)[:, :take]
                q, r = np.repeat(np.arange(len(leaders)), take), slab + leaders.ravel() * len(lists.slabs)
                best.add(part, q, ids[r], lists.whole(q, r))
            made += lists.made
        yield best.batch(made)

    return run


def _collected(lists: _Lists, cut: np.ndarray):
    """Phases 2 and 3: ``(q, r, scores)`` of every pair whose score reaches its cutoff."""
    n, every = len(lists.slabs), slice(None)
    cut = np.maximum(cut, -(2**53)).astype(float)  # no score is below
    share = np.ceil(cut / n)
    left = lists.of_queries @ lists.of_rows.T
    running = left + 1 >= cut[:, None]
    so_far, entered = np.zeros(running.shape), np.zeros(running.shape, bool)
    slab = 0
    while slab < n and running.mean() >= DENSE:
        score = lists.scores(slab, every)
        so_far += score
        entered |= score >= share[:, None]
        slab += 1
        left = lists.of_queries[:, slab:] @ lists.of_rows[:, slab:].T
        running &= so_far + left + 1 >= cut[:, None]
    q, r = np.nonzero(running)
    score, entry, rest = so_far[q, r], entered[q, r], left[q, r]
    for k in range(slab, n):
        more = lists.of_pairs(k, q, r)
        score, entry, rest = score + more, entry | (more >= share[q]), rest - lists.of_queries[q, k] * lists.of_rows[r, k]
        on = score + np.maximum(rest, 0) + 1 >= cut[q]
        q, r, score, entry, rest = q[on], r[on], score[on], entry[on], rest[on]
    fine = entry & (score >= cut[q])
    return q[fine], r[fine], score[fine].astype(np.int64)


def _above(queries, cutoffs, k: int):
    """The task's best k among the pairs that reach their query's cutoff."""

    def run(batches):
        got, made = queries.value, 0
        best = _Best(got, k)
        for part, ids, lists in _blocks(batches, got):
            if lists.large:
                q, r = (x.ravel() for x in np.indices((len(lists.queries), len(ids))))
                scores = lists.whole(q, r)
            else:
                # The best found in the task so far may be a higher cutoff than all tasks' first.
                own = best.scores[part][:, -1]
                q, r, scores = _collected(lists, np.maximum(cutoffs.value[part], own))
            best.add(part, q, ids[r], scores)
            made += lists.made
        yield best.batch(made)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", products: list[int] | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of ``vectors`` for each query.

    ``products``, if given, receives the products of components made in each scan."""
    spark = vectors.sparkSession
    kinds = "query_id long, vec_id long, score long"

    def prepared(df):
        some = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).where(F.col("vec_id").isNotNull() & sound(F.col("v")))
        return some.select("vec_id", scaled(F.col("v")).alias("v"))

    rows = prepared(vectors)
    asked = prepared(queries).groupBy("vec_id").agg(F.min("v").alias("v")).toLocalIterator()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    while block := list(islice(asked, QUERIES)):
        ids = np.array([r.vec_id for r in block], np.int64)
        sent = spark.sparkContext.broadcast((ids, _matrix([r.v for r in block], max(len(r.v) for r in block))))
        gathered = stash(rows.mapInArrow(_local_lists(sent, k), kinds), "gathered")
        kth = gathered.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(f"n = {k}")
        safe = {r.query_id: r.least for r in kth.collect()}
        cutoffs = spark.sparkContext.broadcast(np.array([safe.get(int(i), LEAST + 1) for i in ids], np.int64))
        found = stash(rows.mapInArrow(_above(sent, cutoffs, k), kinds), "found")
        if products is not None:
            products += [df.where("vec_id IS NULL").agg(F.sum("score")).first()[0] or 0 for df in (gathered, found)]
        ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
        out = out.union(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
