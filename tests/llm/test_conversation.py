"""Conversation repair against a search over whole edit strings."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from lacuna.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(name.encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def plain_one(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    want = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(k, state, inserted=0):
        """(cost, edits, result) from turn k on, in the state of the last letter."""
        ways = []
        if k == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            c, e, r = best(k, want[state], inserted + 1)
            ways.append((c + 2, "I" + e, (({"u": "user", "a": "assistant"}[want[state]], ""), *r)))
        if k < len(rows):
            _, _, role, text = rows[k]
            c, e, r = best(k + 1, state)
            ways.append((c + 3, "D" + e, r))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                if role[:1] == want[state] or (state, role[:1]) == ("", "s"):
                    c, e, r = best(k + 1, role[:1])
                    ways.append((c + more, "K" + e, ((role, text), *r)))
                c, e, r = best(k + 1, want[state])
                ways.append((c + more + 2, "R" + e, (({"u": "user", "a": "assistant"}[want[state]], text), *r)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, result = best(0, "")
    turns = [r[1] for r in rows if r[1] is not None]
    letters = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest(),
    ), result


def plain(rows, damage=True):
    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in harm(rows) if damage else rows:
        kept[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain_one(turns)[0] for conv, turns in kept.items()}


def table_of(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


def made(rng, convs, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "übung"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", None, "End. \t", "more words. and", "é.", "Yes."]
    rows = []
    for conv in range(convs):
        n = rng.randrange(1, longest)
        for k in range(n):
            turn = None if rng.random() < 0.05 else k + rng.choice((0, 0, 0, 0, 2, -1))
            rows.append((conv if conv else None, turn, rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 3, conversation.PIECE])
def test_against_search(spark, size):
    rows = made(random.Random(size), 120, 14)
    df = spark.createDataFrame(rows, SCHEMA)
    got = table_of(conversation.review(conversation.damaged(df), df, size))
    assert got == plain(rows)


@pytest.mark.parametrize("size", [7, 64])
def test_one_conversation_holds_all(spark, size):
    rng = random.Random(5)
    rows = [(1, k // 3, rng.choice(("user", "assistant", "system")), rng.choice(("a.", "b", "")) + str(rng.randrange(90)) + ".") for k in range(300)]
    rows += [(2, 0, "user", "x."), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = table_of(conversation.review(df, df, size))
    assert got == plain(rows, damage=False)


def test_equal_turns_and_edges(spark):
    rows = [(1, 4, "user", "same.")] * 200 + [(2, None, "user", "Hm."), (2, None, "assistant", "x" * 300_000 + "."), (3, 1, None, None), (4, 1, "assistant", "a."), (5, 0, "system", "s.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = table_of(conversation.review(df, df))
    assert got == plain(rows, damage=False)
    assert got[1][6] == "K" + "D" * 199 + "I"
    assert got[2][0] == 0 and got[3][1] == 1
    assert table_of(conversation.review(df.limit(0), df.limit(0))) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    lost = spark.createDataFrame([(9, gone, "user", "x.")], SCHEMA)
    assert table_of(conversation.review(conversation.damaged(lost), lost)) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    named = spark.createDataFrame([("c", 0, "user", "x.", 5, "k"), ("c", 1, "assistant", "y.", 5, "k")], "conv_id string, turn int, role string, text string, cost int, audit string")
    assert table_of(conversation.review(named, named))["c"][5:7] == (0, "KK")


def test_repaired_turns(spark):
    rows = made(random.Random(2), 40, 10)
    df = conversation.damaged(spark.createDataFrame(rows, SCHEMA))
    out = {}
    for r in sorted(conversation.repaired_turns(df, conversation.plan(df, 4)[1]).collect(), key=lambda r: (r.conv_id or 0, r.turn)):
        assert r.turn == len(out.setdefault(r.conv_id, []))
        out[r.conv_id].append((r.role, r.text))
    kept = {}
    for r in harm(rows):
        kept.setdefault(r[0], []).append(r)
    want = {conv: list(plain_one(turns)[1]) for conv, turns in kept.items()}
    assert out == {conv: turns for conv, turns in want.items() if turns}


def test_query_on_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert table_of(conversation.op12_conversation_repair(spark, data)) == plain(rows)
