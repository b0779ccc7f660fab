"""Mixing to weights that are not thousandths, and of more sources than thousandths."""

from collections import Counter
from fractions import Fraction

import pytest
from llm_helpers import make

from lacuna.llm import mixing

CASES = {
    "fine": ({"a": 7779, "b": 2202, "c": 19}, {"a": 7779, "b": 2202, "c": 19}),
    "many": ({"hot": 200} | {f"s{k}": 1 for k in range(1001)}, {"hot": 600} | {f"s{k}": 3 for k in range(1001)}),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("broadcast", [mixing.BLOCK * 10**5, -1])
def test_lag_under_one_block(spark, monkeypatch, case, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", broadcast)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 64)
    weights, sizes = CASES[case]
    rows = [(k, "t", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(make(spark, rows), {s: w / 10000 for s, w in weights.items()}, block=1).select("doc_id", "mix.*").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted({r.slot for r in got})
    total = sum(weights.values())
    for r in got:
        w = weights[r.source]
        assert (r.release, r.deadline) == (r.block * total // w, -(-(r.block + 1) * total // w))
        assert r.release <= r.slot < r.deadline
    done, slots = Counter(), {r.slot: r.source for r in got}
    ends = {s: n * Fraction(total, weights[s]) for s, n in sizes.items()}
    for t in range(int(min(ends.values()))):
        done[slots[t]] += 1
        if t % 97 == 0 or len(weights) < 9:
            assert all(abs(done[s] * total - (t + 1) * w) < total for s, w in weights.items())


def test_short_last_blocks(spark):
    sizes = {"a": 1237, "b": 41, "c": 9, "": 3}
    rows = [(k, "t", s or None) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(make(spark, rows), {"a": 0.71234, "b": 0.2, "c": 0.0007}, other=0.0, block=4).select("mix.*").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    order = [(r.source, r.block) for r in sorted(got, key=lambda r: r.position)]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) + 1 == len(set(order))


def test_default_weights_are_whole_roots(spark):
    rows = [(k, "t", s) for k, s in enumerate("a" * 99 + "b" * 10 + "c")]
    parts = mixing.target_weights(make(spark, rows), None, 1.0, "source")
    assert parts == [("a", 99, 9), ("b", 10, 3), ("c", 1, 1)]


def test_sevenths_and_five_thousand_sources(spark):
    sevenths = mixing.target_weights(make(spark, [(k, "t", s) for k, s in enumerate("abc")]), {"a": 1 / 7, "b": 2 / 7, "c": 4 / 7}, 1.0, "source")
    q = sum(n for *_, n in sevenths)
    for (_, _, n), w in zip(sevenths, (1, 2, 4), strict=True):
        assert abs(Fraction(n, q) - Fraction(w, 7)) < Fraction(1, 10**15)
    ns = [10_000] + [1] * 5_000
    order = [(r["at"], r["k"], r["j"]) for r in mixing.cycle(spark, [2, 1, 4]).collect()]
    assert order == edf([2, 1, 4])
    assert [(r["at"], r["k"], r["j"]) for r in mixing.cycle(spark, [300] + [1] * 150).orderBy("at").collect()] == edf([300] + [1] * 150)
    hot = [k for _, k, _ in edf(ns)]
    done = 0
    for t, k in enumerate(hot):
        done += k == 0
        assert abs(done * 15_000 - (t + 1) * 10_000) < 15_000


def edf(ns):
    """The schedule of one cycle by heaps."""
    import heapq

    q, later, ready, done, out = sum(ns), [(0, k) for k in range(len(ns))], [], [0] * len(ns), []
    for t in range(q):
        while later and later[0][0] <= t:
            k = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * q // ns[k]), k))
        k = heapq.heappop(ready)[1]
        out.append((t, k, done[k]))
        done[k] += 1
        heapq.heappush(later, (done[k] * q // ns[k], k))
    return out


@pytest.mark.parametrize("weights", [{"a": 13 / 35, "b": 22 / 35}, {"a": 2**0.5, "b": 1.0, "c": 1 / 3}, {"a": 1.0, "b": 1e-9, "c": 0.1}])
def test_cycles_longer_than_the_table(spark, weights):
    """Windows are kept by every block, lags until the first source's end."""
    rows = [(k, "t", s) for k, s in enumerate(s for s in sorted(weights) for _ in range(90))]
    parts = mixing.target_weights(make(spark, rows), weights, 1.0, "source")
    q, n_of = sum(n for *_, n in parts), {s: n for s, _, n in parts}
    total = sum(Fraction(repr(w)) for w in weights.values())
    assert q > 1000 and all(Fraction(n_of[s], q) == Fraction(repr(w)) / total for s, w in weights.items())
    got = mixing.mix(make(spark, rows), weights, block=1).select("doc_id", "mix.*").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    for r in got:
        assert (r.release, r.deadline) == (r.block * q // n_of[r.source], -(-(r.block + 1) * q // n_of[r.source]))
        assert r.release <= r.slot < r.deadline
    ends = min(90 * q // n for n in n_of.values())  # where the first block that is none would be free
    done, slots = Counter(), {r.slot: r.source for r in got}
    for t in range(ends):
        done[slots[t]] += 1
        assert all(abs(done[s] * q - (t + 1) * n) < q for s, n in n_of.items())


def test_hundreds_of_sources_of_any_weight(spark):
    """Weights without a common measure; the fold ends with the blocks that exist."""
    rows = [(k, "t", f"s{k % 600}") for k in range(1200)]
    weights = {f"s{k}": (k + 2) ** 0.5 for k in range(600)}
    got = mixing.mix(make(spark, rows), weights, block=1).select("mix.*").collect()
    assert sorted(r.position for r in got) == list(range(1200))
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_twenty_thousand_sources(spark):
    """Few different weights: the fold's steps do not grow with the sources that bear them."""
    rows = [(k, "t", f"s{k % 20_000}") for k in range(26_000)]
    got = mixing.mix(make(spark, rows), block=1).select("mix.*").collect()
    assert sorted(r.position for r in got) == list(range(26_000))
    assert all(r.release <= r.slot < r.deadline for r in got) and len({r.slot for r in got}) == 26_000


def test_default_weights_do_not_depend_on_the_length_of_the_cycle(spark, monkeypatch):
    """Sources that end within the first cycle: the others keep the slots of the whole fold."""
    rows = [(k, "t", s) for k, s in enumerate("a" * 400 + "b" * 24 + "c" * 8)]
    found = []
    for slots in (mixing.FOLD_SLOTS, 3):
        monkeypatch.setattr(mixing, "FOLD_SLOTS", slots)
        found.append(sorted(tuple(r) for r in mixing.mix(make(spark, rows)).select("doc_id", "mix.*").collect()))
    assert found[0] == found[1]
