"""Conversations repaired: the cheapest edits that make roles alternate.

A conversation is edited so that the first letters of its roles read ``(s?(ua)+)?``.
Keeping a turn costs 0, giving it the role user or assistant 2, inserting an empty turn
of one of them 2, deleting 3; blank and repeated turns must be deleted, and a truncated
one that stays costs 1 more.  Four states of the grammar are enough (start, after s, after
u, after a), and as a new role or turn is always the one that the grammar wants, the
letters of the edits determine the result.

A backward pass gives the least cost from each turn and state to the end.  A forward walk
then takes, of the edits that lie on a cheapest way, the least in ASCII (D, I, K, R).

Work is shared out by rows and not by conversation: rows without their texts (hashes
stand for them), equal ones counted first, are sorted into ranges.  A range cuts what it
holds of a conversation into pieces of at most ``PIECE`` rows.  A piece that is no whole
conversation gives, for each state before and after it, the least cost and the least
edits.  The pieces of a conversation, a few numbers each, are then passed backward for
costs and forward for states.  Texts are moved once, to be hashed in order:
that is one stream for a conversation, as SHA-256 is a chain, and is held row by row.

Defined results
    a null ``conv_id`` is a conversation of its own; null roles and texts are one space,
    and so is a null ``conv_id`` or ``turn`` where the damage is drawn; turns are taken by
    number, nulls first, equal numbers by role and then hash of the text; rows that
    repeat another are duplicates; a role whose first letter is none of s, u and a is
    never kept as it is; texts of any length are taken whole; an empty table gives an
    empty result; columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.runtime import small_batches, stash, table, trimmed

#: Rows of a conversation that are weighed in one piece.
PIECE = 4096
RENAME, INSERT, DELETE, CUT_OFF = 2, 2, 3, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: state -> what the grammar wants next of user and assistant, and the state after it.
WANTS = ("user", "user", "assistant", "user")
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: (state, first letter) -> state.
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL = {"su", "ua", "au"}
#: Least cost from each state when no turn is left: a missing user and assistant are added.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
DAMAGE = 20
KEY = ("conv_id", "turn", "role", "digest")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with a twentieth each dropped, emptied, robbed of its sentence ends, said
    twice and given to the user, drawn by the CRC of conversation and turn."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    draw = F.crc32(name.cast("binary")) % DAMAGE
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("_d")).where("_d <> 0")
    harmed = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    said = drawn.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), harmed.alias("text"), times.alias("_t"))
    return said.select("conv_id", "turn", "role", "text", F.explode("_t").alias("_t")).drop("_t")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")


def turns_of(rows: DataFrame) -> DataFrame:
    """One row for all equal turns: ``KEY``, ``times``, ``blank``, ``cut`` and ``again``
    (an earlier turn of the conversation has the same role and text)."""
    text = F.coalesce("text", F.lit(" "))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    facts = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), _digest(text),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    equal = stash(facts.groupBy(*KEY, "blank", "cut").agg(F.count(F.lit(1)).alias("times")), "turns")
    first = equal.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).getField("turn").alias("turn"))
    first = first.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.lit(1).alias("_first"))
    # Keys are unique on both sides: a text said in every turn is no hot key.
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    return equal.join(first, same, "left").select(*KEY, "times", "blank", "cut", F.isnull("_first").alias("again"))


def costs_before(turns: list[tuple[str, bool, bool]], after: tuple) -> list:
    """Least cost to the end from before each turn ``(letter, must go, cut off)``, by state.

    ``after`` has the costs behind the last turn.  Insertions are weighed before a turn,
    not behind the last, so edits of successive pieces simply follow one another.
    """
    costs = [after]
    for letter, gone, cut in reversed(turns):
        ahead = costs[-1]
        c = [DELETE + ahead[s] for s in STATES]
        if not gone:
            stays = CUT_OFF if cut else 0
            for s in STATES:
                kept = STEPS.get((s, letter))
                c[s] = min(c[s], stays + RENAME + ahead[NEXT[s]], FAR if kept is None else stays + ahead[kept])
        u, a = c[AFTER_U], c[AFTER_A]
        c[AFTER_U], c[AFTER_A] = min(u, INSERT + a), min(a, INSERT + u)
        c[START], c[AFTER_S] = min(c[START], INSERT + c[AFTER_U]), min(c[AFTER_S], INSERT + c[AFTER_U])
        costs.append(c)
    costs.reverse()
    return costs


def walk(turns: list[tuple[str, bool, bool]], costs: list, state: int) -> tuple[str, int]:
    """The ASCII-least edits of least cost from ``state``, and the state they end in."""
    edits = []
    for k, (letter, _, cut) in enumerate(turns):
        while True:
            left, ahead = costs[k][state], costs[k + 1]
            if left == DELETE + ahead[state]:
                edits.append("D")
                break
            if left == INSERT + costs[k][NEXT[state]]:
                edits.append("I")
                state = NEXT[state]
                continue
            kept = STEPS.get((state, letter))
            if kept is not None and left == (CUT_OFF if cut else 0) + ahead[kept]:
                edits.append("K")
                state = kept
            else:
                edits.append("R")
                state = NEXT[state]
            break
    return "".join(edits), state


def ending(state: int) -> str:
    """Insertions behind the last turn."""
    return "I" * (AT_END[state] // INSERT)


def _spread(edits: str, times: list[int]) -> str:
    """``edits`` of distinct turns, each followed by the deletions of its repeats."""
    if max(times, default=1) == 1:
        return edits
    out, left = [], iter(times)
    for e in edits:
        out.append(e)
        if e != "I":
            out.append("D" * (next(left) - 1))
    return "".join(out)


PIECE_FIELDS = (
    "part int, no int, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "costs array<long>, ranks array<int>, edits array<string>"
)


def _weighed(letters: list[str], gone: list[bool], cut: list[bool], times: list[int], whole: bool) -> tuple[list, list, list]:
    """Costs, ranks and edits of a piece: for a whole conversation of its one way, else
    for each state before and after it, ranks being those of the edits in ASCII order."""
    turns = list(zip(letters, gone, cut, strict=True))
    more = DELETE * (sum(times) - len(times))
    if whole:
        costs = costs_before(turns, AT_END)
        edits, end = walk(turns, costs, START)
        return [more + costs[0][START]], [0], [_spread(edits, times) + ending(end)]
    costs, edits = [FAR] * 16, [None] * 16
    for end in STATES:
        found = costs_before(turns, tuple(0 if s == end else FAR for s in STATES))
        for start in STATES:
            if found[0][start] < FAR:
                costs[4 * start + end] = more + found[0][start]
                edits[4 * start + end] = walk(turns, found, start)[0]
    ranks = [sorted(e for e in edits[k - k % 4 : k - k % 4 + 4] if e is not None).index(edits[k]) if edits[k] is not None else 4 for k in range(16)]
    return costs, ranks, [e if e is None else _spread(e, times) for e in edits]


def _pieces(size: int):
    """Sorted rows of ``turns_of`` to pieces; nothing is kept but the piece at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, key, held, begun_here, out, schema = TaskContext.get().partitionId(), 0, None, [], False, [], None

        def piece(whole: bool) -> tuple:
            letters = [r[2][:1] for r in held]
            blank, again, cut, times = ([r[k] for r in held] for k in (4, 5, 6, 7))
            gone = [b or a for b, a in zip(blank, again, strict=True)]
            faults = (
                sum(t for b, t in zip(blank, times, strict=True) if b),
                sum(t if a else t - 1 for b, a, t in zip(blank, again, times, strict=True) if not b),
                sum(c and not g for c, g in zip(cut, gone, strict=True)),
            )
            illegal = sum(times) - len(times) + sum(x + y not in LEGAL for x, y in zip(letters, letters[1:], strict=False))
            return (*held[0][:4], part, no, whole, *faults, illegal, letters[0], letters[-1], *_weighed(letters, gone, cut, times, whole))

        for batch in batches:
            if schema is None:
                schema = _piece_schema(batch.schema)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != key:
                    out.append(piece(begun_here))
                    no, held, begun_here = no + 1, [], True
                elif len(held) == size:
                    out.append(piece(False))
                    no, held, begun_here = no + 1, [], False
                key = row[0]
                held.append(row)
            yield _batch(out, schema)
            out = []
        if held:
            yield _batch([piece(False)], schema)

    return run


def _piece_schema(rows: pa.Schema) -> pa.Schema:
    numbers, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    own = [("part", pa.int32()), ("no", pa.int32()), ("whole", pa.bool_()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal"))]
    own += [("first", pa.string()), ("last", pa.string()), ("costs", numbers), ("ranks", pa.list_(pa.int32())), ("edits", texts)]
    return pa.schema([*(rows.field(k) for k in range(len(KEY))), *(pa.field(*f) for f in own)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """Which of its ways each piece of one conversation takes: costs are passed backward
    over the pieces, states forward."""
    rows = pieces.sort_values(["part", "no"]).reset_index(drop=True)
    after = list(AT_END)
    behind = []
    for costs in reversed(rows["costs"].tolist()):
        behind.append(after)
        after = [min(int(costs[4 * s + t]) + after[t] for t in STATES) for s in STATES]
    behind.reverse()
    state, ways, illegal, last = START, [], [], None
    for costs, ranks, ahead, first, end in zip(rows["costs"], rows["ranks"], behind, rows["first"], rows["last"], strict=True):
        to = min(STATES, key=lambda t: (int(costs[4 * state + t]) + ahead[t], ranks[4 * state + t]))  # noqa: B023
        ways.append(4 * state + to)
        illegal.append(int(last is not None and last + first not in LEGAL))
        state, last = to, end
    ends = [""] * (len(rows) - 1) + [ending(state)]
    return pd.DataFrame({"part": rows["part"], "no": rows["no"], "way": ways, "joint": illegal, "ending": ends})


def plan(rows: DataFrame, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """``turns_of(rows)``, and the edits of ``rows`` by pieces: the key of the first turn,
    ``part, no`` (their order), faults, ``cost`` and ``edits``."""
    turns = turns_of(rows)
    order = turns.select(*KEY, "blank", "again", "cut", "times").repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    pieces = stash(order.mapInArrow(_pieces(size), f"conv_id {kind[0]}, turn {kind[1]}, role string, digest binary, {PIECE_FIELDS}"), "pieces")
    parted = pieces.where("not whole")
    ways = parted.select("conv_id", "part", "no", "first", "last", "costs", "ranks").groupBy("conv_id").applyInPandas(_chain, "part int, no int, way int, joint long, ending string")
    faults = ("blank", "duplicate", "truncated")
    rest = parted.join(ways, ["part", "no"]).select(
        *KEY, "part", "no", *faults, (F.col("illegal") + F.col("joint")).alias("illegal"),
        (F.get("costs", F.col("way")) + INSERT * F.length("ending")).alias("cost"), F.concat(F.get("edits", F.col("way")), "ending").alias("edits"),
    )
    alone = pieces.where("whole").select(*KEY, "part", "no", *faults, "illegal", F.get("costs", F.lit(0)).alias("cost"), F.get("edits", F.lit(0)).alias("edits"))
    return turns, stash(alone.union(rest), "edits")


def findings(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per conversation: ``gaps``, the faults, ``illegal``, ``cost`` and ``audit``."""
    faults = ("blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "edits"))), lambda p: p["edits"]), "")
    found = pieces.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in faults), audit.alias("audit"))
    span = F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.count_distinct("turn")
    gaps = turns.groupBy(F.col("conv_id").alias("_c")).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


class _Repair:
    """Edits applied to the turns of one conversation as they come; ``put`` takes each
    turn of the result."""

    def __init__(self, put):
        self.put, self.state, self.edits, self.at = put, START, "", 0

    def insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.put(WANTS[self.state], "")
            self.state, self.at = NEXT[self.state], self.at + 1

    def begin(self, edits: str) -> None:
        self.insert()
        self.edits, self.at = edits, 0

    def take(self, role: str, text: str) -> None:
        self.insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.put(role, text)
            self.state = STEPS[self.state, role[:1]]
        elif edit == "R":
            self.put(WANTS[self.state], text)
            self.state = NEXT[self.state]


def _in_order(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Texts in the order of their turns, the edits of a piece before its first turn."""
    text = F.coalesce("text", F.lit(" "))
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), _digest(text), F.lit(1).alias("kind"), text.alias("text"))
    both = said.union(pieces.select(*KEY, F.lit(0).alias("kind"), F.col("edits").alias("text")))
    small_batches(rows.sparkSession)
    return both.repartition("conv_id").sortWithinPartitions(*KEY, "kind").select("conv_id", "role", "kind", "text")


def _repairs(start, finish):
    """Streams the rows of ``_in_order``: ``start()`` gives a taker of turns for each
    conversation, ``finish(conv_id, taker)`` the rows of its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        key, repair, taker, none = None, None, None, True
        for batch in batches:
            out = []
            for conv, role, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if none or conv != key:
                    if not none:
                        repair.insert()
                        out += finish(key, taker)
                    key, taker, none = conv, start(), False
                    repair = _Repair(taker)
                if kind:
                    repair.take(role, text)
                else:
                    repair.begin(text)
            yield batch.schema.field(0).type, out + ([] if none else finish(key, taker, False))
        if not none:
            repair.insert()
            yield batch.schema.field(0).type, finish(key, taker)

    return run


class _Hash:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def __call__(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True


class _Keep:
    def __init__(self):
        self.turns, self.done = [], 0

    def __call__(self, role: str, text: str) -> None:
        self.turns.append((role, text))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(conv, taker: _Hash, over: bool = True) -> list[tuple]:
        return [(conv, taker.sha.hexdigest())] if over else []

    for kind, rows in _repairs(_Hash, finish)(batches):
        yield _batch(rows, pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(conv, taker: _Keep, over: bool = True) -> list[tuple]:
        out = [(conv, taker.done + k, *turn) for k, turn in enumerate(taker.turns)]
        taker.done, taker.turns = taker.done + len(taker.turns), []
        return out

    for kind, rows in _repairs(_Keep, finish)(batches):
        yield _batch(rows, pa.schema([("conv_id", kind), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def repaired_turns(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the repaired conversations, turns from 0."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, pieces).mapInArrow(trimmed(_texts), f"conv_id {kind}, turn long, role string, text string")


def repaired_hashes(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` of the repaired turns, newlines between."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, pieces).mapInArrow(trimmed(_hashes), f"conv_id {kind}, repaired_sha256 string")


def review(rows: DataFrame, every: DataFrame, size: int = PIECE) -> DataFrame:
    """A row for each ``conv_id`` of ``every``: findings on ``rows`` and the result's hash."""
    turns, pieces = plan(rows, size)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = findings(turns, pieces)
    hashes = repaired_hashes(rows, pieces).select(F.col("conv_id").alias("_h"), "repaired_sha256")
    found = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h"))).select(F.col("conv_id").alias("_k"), *counts, "audit", "repaired_sha256")
    return every.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_k")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return review(damaged(rows), rows)
