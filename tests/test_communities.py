"""Communities by modularity against plain Python on small graphs."""

import random
from collections import defaultdict

import pytest

from lacuna.operators import communities as C
from lacuna.operators import graph as G

EDGES = "a long, b long, weight double"


def plain_modularity(edges, label):
    k, inside, m2 = defaultdict(float), 0.0, 2.0 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        inside += 2 * w * (label[a] == label[b])
    return inside / m2 - sum(x * x for x in k.values()) / m2**2


def one_by_one(nodes, edges):
    """Node after node to its best community, contracted until nothing moves."""
    of = {v: v for v in nodes}
    k, near, m2 = defaultdict(float), defaultdict(lambda: defaultdict(float)), 2.0 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[a] += w
        k[b] += w
        near[a][b] += w
        near[b][a] += w
    while True:
        label, total, any_moved, moved = {v: v for v in near}, dict(k), False, True
        while moved:
            moved = False
            for v in sorted(near):
                links = defaultdict(float)
                for u, w in near[v].items():
                    if u != v:
                        links[label[u]] += w
                total[label[v]] -= k[v]
                best = max(sorted(links), key=lambda c: links[c] - k[v] * total[c] / m2, default=label[v])
                if links[best] - k[v] * total[best] / m2 > links[label[v]] - k[v] * total[label[v]] / m2 + 1e-12:
                    label[v], moved, any_moved = best, True, True
                total[label[v]] += k[v]
        of = {v: label.get(c, c) for v, c in of.items()}
        if not any_moved:
            return of
        new_k, new_near = defaultdict(float), defaultdict(lambda: defaultdict(float))
        for v in near:
            new_k[label[v]] += k[v]
            for u, w in near[v].items():
                new_near[label[v]][label[u]] += w
        k, near = new_k, new_near


def connected(edges, label):
    members, near = defaultdict(set), defaultdict(set)
    for v, c in label.items():
        members[c].add(v)
    for a, b, _ in edges:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    for c, vs in members.items():
        seen, todo = {c}, [c]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        if seen != vs or c != min(vs):
            return False
    return True


def found(spark, nodes, edges, resolution=1.0, partitions=4):
    df = spark.createDataFrame(edges, EDGES).repartition(partitions)
    return {r.node: r.community for r in C.communities(spark.createDataFrame([(v,) for v in nodes], "node long"), df, resolution).collect()}


def blocks(rng, sizes, inner, outer):
    of = [k for k, n in enumerate(sizes) for _ in range(n)]
    return [(a, b, rng.choice((1.0, 0.5, 2.0))) for a in range(len(of)) for b in range(a) if rng.random() < (inner if of[a] == of[b] else outer)]


@pytest.mark.parametrize("seed", [2])
def test_at_least_as_good_as_other_ways(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(4, 14) for _ in range(8)]
    edges, nodes = blocks(rng, sizes, 0.5, 0.06), range(sum(sizes) + 2)
    label = found(spark, nodes, edges)
    assert set(label) == set(nodes) and connected(edges, label)
    q = plain_modularity(edges, label)
    assert q >= plain_modularity(edges, one_by_one(nodes, edges)) - 0.01
    frame = spark.createDataFrame(edges, EDGES)
    spread = G.propagate_labels(spark.createDataFrame([(v,) for v in nodes], "node long"), frame)
    assert q >= plain_modularity(edges, {r.node: r.label for r in spread.collect()}) - 1e-9
    measured = C.modularity(frame, spark.createDataFrame(list(label.items()), "node long, community long")).first()
    assert abs(measured.modularity - q) < 1e-6 and measured.communities == len(set(label.values()))
    assert found(spark, nodes, [(b, a, w) for a, b, w in reversed(edges)], partitions=1) == label


def test_ring_of_cliques_and_hub(spark):
    """Cliques stay whole; a star is one community though all its nodes wish at once."""
    edges = [(6 * c + a, 6 * c + b, 1.0) for c in range(12) for a in range(6) for b in range(a)]
    edges += [(6 * c, (6 * c + 6) % 72, 0.1) for c in range(12)]
    edges += [(100, 101 + k, 1.0) for k in range(60)]
    label = found(spark, [*range(72), *range(100, 161), 999], edges)
    assert label == {v: v - v % 6 for v in range(72)} | {v: 100 for v in range(100, 161)} | {999: 999}


def test_edges_of_graphs(spark):
    assert found(spark, [1, 2], []) == {1: 1, 2: 2}
    assert found(spark, [], []) == {}
    odd = [(1, 2, 1.0), (2, 1, 1.0), (1, 1, 3.0), (2, 3, -4.0), (3, 3, 0.0), (2, 77, 5.0), (3, None, 1.0), (3, 2, None)]
    assert found(spark, [1, 2, 3, None], odd) in ({1: 1, 2: 1, 3: 3}, {1: 1, 2: 2, 3: 3})
    fine = found(spark, range(6), [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], resolution=1.0)
    assert fine == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    coarse = found(spark, range(6), [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], resolution=0.05)
    assert set(coarse.values()) == {0}


def test_a_chain_of_equal_wishes_is_not_granted_one_by_one(spark):
    from lacuna.operators import communities as C

    wishes = spark.createDataFrame([(k, k, k - 1, 10, 1e6) for k in range(1, 200)], "v long, c long, goal long, k long, g double")
    moves = {r.v: r.goal for r in C._granted(wishes, 1.0, 1e-12, 0).collect()}
    assert len(moves) > 40 and not set(moves) & set(moves.values())
