"""Mixing sources to target weights by Pfair scheduling [native].

The documents of a source, in a fixed shuffled order, are cut into blocks.  Block b
of a source of weight w = n/q is released at floor(b/w) and due at ceil((b+1)/w); of
the released, the earliest deadline goes first.  Until a source runs out, no source is
a whole block ahead of or behind its share at any slot.

Weights are whole numbers n over their sum q, exact, so the schedule repeats every q
slots: one cycle is computed by a fold in SQL, and the slot of any block follows by
arithmetic.  By default a source weighs the whole root of its documents, so a cycle has
at most sqrt(sources x documents) slots; weights that are given are taken as the exact
fractions that they print as, brought to a common denominator.  Such a cycle can be longer
than any table (13/35 prints 17 digits): the fold then ends with the last block that
exists, and where sources far outlast the others (``FOLD_SLOTS``) not before the first of
them (of weights that are given) has run out; what is left of them later goes at its release, within its window, two
of them perhaps to one slot.  The fold is one task of slots x different weights steps.

Nothing is sorted or ranked in one place: ranks within a source are counted by hash
buckets, as many as the source's documents need, and positions by ranges of slots.

Defined results
    a null source is the source ''; a null id sorts first; rows that repeat each keep
    a place of their own; sources without a listed weight get ``other``; a weight that
    is not above 0 counts as a millionth; empty tables give empty results; texts play
    no part.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.runtime import let, stash, table

BLOCK = 8
#: Rows of a source that share a hash bucket, on average at most.
BUCKET_ROWS = 1 << 14
#: Rows in turn whose positions are counted together, on average.
RANGE_ROWS = 1 << 15
#: Slots of a cycle broadcast to the join (some 40 bytes each); beyond it a shuffled join.
BROADCAST_SLOTS = 500_000
#: Cycles up to here are folded whole; of longer ones as few slots as will do.
FOLD_SLOTS = 1_000_000
#: Products of blocks and q are whole numbers of 64 bits up to here, else decimals.
LONG_CYCLE = 1 << 31


def target_weights(docs: DataFrame, weights: dict[str, float] | None, other: float, source: str) -> list[tuple[str, int, int]]:
    """``(src, total, n)``: documents and whole-number weight of each source, in order."""
    counted = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("src")).agg(F.count(F.lit(1)).alias("total"))
    totals = sorted(((r.src, r.total) for r in counted.collect()), key=lambda x: x[0].encode())
    if weights is None:
        return [(src, total, math.isqrt(total)) for src, total in totals]
    given = ((src, float(weights.get(src, other))) for src, _ in totals)
    raw = [Fraction(repr(w)) if w > 0 and math.isfinite(w) else Fraction(1, 10**6) for _, w in given]
    whole = math.lcm(*(r.denominator for r in raw))
    ints = [int(r * whole) for r in raw]
    common = math.gcd(*ints) or 1
    return [(src, total, n // common) for (src, total), n in zip(totals, ints, strict=True)]


def fold_slots(parts: list[tuple[str, int, int]], block: int, whole: bool = False) -> int:
    """Slots to be folded of the cycle: all, or to the deadline of the last block, or, where
    that is far off and unless the ``whole`` is asked for, to that of the first source to end."""
    q = sum(n for *_, n in parts)
    ends = [-(-(-(-total // block) * q) // n) for _, total, n in parts if n] or [0]
    if whole or q <= FOLD_SLOTS or max(ends) <= FOLD_SLOTS:
        return min(q, max(ends)) if whole or q > FOLD_SLOTS else q
    return min(q, min(ends))


def cycle(spark, ns: list[int], slots_wanted: int | None = None) -> DataFrame:
    """One hyperperiod of sources of whole-number weights ``ns``, or its first
    ``slots_wanted`` slots: ``(k, j, at)``, block j of source k takes slot ``at``.

    A fold over the slots keeps the blocks done at each weight and appends who goes
    next; runs of slots are collected apart, so that appending stays short.
    """
    q = sum(ns)
    if not q:
        return spark.createDataFrame([], "k int, j long, at long")
    wanted = q if slots_wanted is None else slots_wanted
    run = math.isqrt(wanted) + 1
    kind = "BIGINT" if q < LONG_CYCLE else "DECIMAL(38,0)"
    q_of = F.expr(f"CAST({q} AS {kind})")
    # Sources of equal weight have equal windows, so they take turns in order: the fold
    # keeps one count for each weight, however many sources bear it.
    alike: dict[int, list[int]] = {}
    for k, n in enumerate(ns):
        if n:
            alike.setdefault(n, []).append(k)
    weights = ",".join(f"CAST({n} AS {kind})" for n in alike)
    members = ",".join(f"array({','.join(map(str, m))})" for m in alike.values())
    one = spark.range(1).select(F.expr(f"array({weights})").alias("ns"), F.expr(f"array({members})").alias("ms"))

    def goes(done, t):
        def due(n, i):
            of = F.get("ms", i)
            block = F.call_function("div", F.get(done, i), F.size(of).cast("long"))
            free = F.call_function("div", block * q_of, n).cast("long")
            by = F.call_function("div", (block + 1) * q_of + n - 1, n).cast("long")
            return F.when(free <= t, F.struct(by.alias("due"), F.get(of, (F.get(done, i) % F.size(of)).cast("int")).alias("k"), i.alias("i"), block.alias("j")))

        return F.array_min(F.transform("ns", due))  # nulls are skipped

    def slot(state, t):
        return let(goes(state["done"], t), lambda next: F.struct(
            F.transform(state["done"], lambda a, i: F.when(i == next["i"], a + 1).otherwise(a)).alias("done"),
            F.concat(state["took"], F.array(F.struct(t.alias("at"), next["k"].alias("k"), next["j"].alias("j")))).alias("took"),
        ))

    nothing = F.array().cast("array<struct<at:bigint,k:int,j:bigint>>")

    def slots(state, r):
        inside = F.aggregate(F.sequence(r * run, F.least((r + 1) * run, F.lit(wanted)) - 1), F.struct(state["done"].alias("done"), nothing.alias("took")), slot)
        return let(inside, lambda x: F.struct(x["done"].alias("done"), F.concat(state["took"], F.array(x["took"])).alias("took")))

    start = F.struct(F.transform("ns", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<array<struct<at:bigint,k:int,j:bigint>>>").alias("took"))
    runs = F.aggregate(F.sequence(F.lit(0), F.lit((wanted - 1) // run)).cast("array<long>"), start, slots, lambda s: s["took"])
    return one.select(F.explode(runs).alias("run")).select(F.inline("run")).select("k", "j", "at")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, block: int = BLOCK, id_column: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with a struct column ``mix``: ``source, block, release, deadline, slot,
    position``.  ``position`` is the row's place in the mixed order, from 0.  A column
    of ``docs`` that is called ``mix`` gives way."""
    placed = _placed(docs, weights, other, block, id_column, source)
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "mix"), "mix")


def _slotted(docs: DataFrame, weights: dict[str, float] | None, other: float, block: int, id_column: str, source: str) -> DataFrame:
    """``(row, _src, _rank, _block, _n, _q, _slot)``: whole rows and their slots."""
    spark = docs.sparkSession
    parts = target_weights(docs, weights, other, source)
    q = sum(n for _, _, n in parts)
    listed = [(src, k, n, max(0, math.ceil(math.log(total / BUCKET_ROWS, 16)) if total > BUCKET_ROWS else 0)) for k, (src, total, n) in enumerate(parts)]
    sources = F.broadcast(spark.createDataFrame(listed, "_src string, _k int, _n long, _digits int"))

    id_of, source_of = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_of.alias("_id"), source_of.alias("_src"), F.md5(F.coalesce(id_of.cast("string"), F.lit(""))).alias("_hash"))
    rows = rows.join(sources, "_src").withColumn("_bucket", F.substring("_hash", F.lit(1), F.col("_digits")))
    sizes = rows.groupBy("_k", "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    ahead = sizes.select("_k", "_bucket", (F.sum("_in").over(Window.partitionBy("_k").orderBy("_bucket")) - F.col("_in")).alias("_ahead"))

    inside = F.row_number().over(Window.partitionBy("_k", "_bucket").orderBy("_hash", "_id"))
    ranked = rows.withColumn("_inside", inside).join(ahead, ["_k", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_inside") - 1).withColumn("_block", F.expr(f"_rank div {block}")).withColumn("_j", F.expr("_block % _n"))
    # Cycles of default weights are short beside the table, and always folded whole.
    wanted = fold_slots(parts, block, whole=weights is None)
    slots = stash(cycle(spark, [n for _, _, n in parts], wanted).select(F.col("k").alias("_k"), F.col("j").alias("_j"), F.col("at").alias("_at")), "cycle")
    placed = ranked.join(F.broadcast(slots) if wanted <= BROADCAST_SLOTS else slots, ["_k", "_j"], "left" if wanted < q else "inner")
    q_of = f"CAST({q} AS {'BIGINT' if q < LONG_CYCLE else 'DECIMAL(38,0)'})"
    slot = F.expr(f"coalesce((_block div _n) * {q_of} + _at, _block * {q_of} div _n)").cast("long")
    return placed.select("row", "_src", "_rank", "_block", "_n", F.expr(q_of).alias("_q"), slot.alias("_slot"))


def _placed(docs: DataFrame, weights: dict[str, float] | None, other: float, block: int, id_column: str, source: str) -> DataFrame:
    """``(row, mix)``: whole rows and their places."""
    placed = _slotted(docs, weights, other, block, id_column, source)
    # A slot holds one block at most, so ranges of slots are ranges of rows of bounded size.
    placed = placed.withColumn("_range", F.expr(f"_slot div {max(1, RANGE_ROWS // block)}"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_in"))
    before = sizes.select("_range", (F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_slot", "_rank"))
    ranked = placed.withColumn("_inside", inside).join(before, "_range")
    info = F.struct(
        F.col("_src").alias("source"), F.col("_block").alias("block"), F.expr("_block * _q div _n").cast("long").alias("release"), F.expr("((_block + 1) * _q + _n - 1) div _n").cast("long").alias("deadline"),
        F.col("_slot").alias("slot"), (F.col("_before") + F.col("_inside") - 1).alias("position"),
    )
    return ranked.select("row", info.alias("mix"))


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in mixed order, with the columns of ``docs``: written out,
    the files in turn hold the interleaved blocks."""
    return _slotted(docs, weights, 1.0, BLOCK, "doc_id", "source").orderBy("_slot", "_rank").select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _placed(docs, None, 1.0, BLOCK, "doc_id", "source").select("row.doc_id", "mix.*")


OP1_SQL = f"""
WITH RECURSIVE t AS (SELECT coalesce(source, '') AS src, count(*) AS total FROM documents GROUP BY 1),
p AS (SELECT src, total, CAST(floor(sqrt(total)) AS BIGINT) AS n FROM t),
one AS (SELECT list(n ORDER BY src) AS ns, list(src ORDER BY src) AS srcs, CAST(sum(n) AS BIGINT) AS q FROM p),
s(t, k, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(ns, lambda x: CAST(0 AS BIGINT)) FROM one
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END)
  FROM (SELECT t, done, q, list_min(list_filter(list_transform(ns, lambda n, i: CASE WHEN done[i] * q // n <= t + 1
          THEN ((done[i] + 1) * q + n - 1) // n * 100000 + i ELSE NULL END), lambda x: x IS NOT NULL)) % 100000 AS pick
        FROM s, one WHERE t + 1 < q)),
c AS (SELECT srcs[k] AS src, t AS at, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j FROM s, one WHERE t >= 0),
r AS (SELECT doc_id, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rnk FROM documents),
b AS (SELECT r.*, rnk // {BLOCK} AS block, p.n, one.q FROM r JOIN p USING (src), one),
x AS (SELECT b.*, block // n * q + c.at AS slot FROM b JOIN c ON b.src = c.src AND b.block % b.n = c.j)
SELECT doc_id, src AS source, CAST(block AS BIGINT) AS block, CAST(block * q // n AS BIGINT) AS release, CAST(((block + 1) * q + n - 1) // n AS BIGINT) AS deadline,
       CAST(slot AS BIGINT) AS slot, CAST(row_number() OVER (ORDER BY slot, rnk) - 1 AS BIGINT) AS position FROM x
"""
