"""Spectral coordinates against numpy; tails of distributions against exact sums."""

import random
from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import functions as F

from lacuna.functions import scalars as S
from lacuna.operators import layout as L


def test_eigenvectors_against_numpy(spark):
    rng = random.Random(7)
    n, edges = 30, {}
    for a in range(n):
        for b in range(a):
            if a - b == 1 or rng.random() < (0.4 if (a < 15) == (b < 15) else 0.03):
                edges[b, a] = rng.choice((1.0, 2.0, 0.5))
    a = np.zeros((n, n))
    for (x, y), w in edges.items():
        a[x, y] = a[y, x] = w
    d = a.sum(axis=1)
    values, vectors = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    nodes = spark.createDataFrame([(k,) for k in [*range(n), 99]], "node long")
    rows = [(x, y, w) for (x, y), w in edges.items()] + [(3, 3, 5.0), (1, 500, 1.0), (2, None, 1.0), (4, 9, None), (4, 9, -1.0)]
    xy, info = L.spectral(nodes, spark.createDataFrame(rows, "a long, b long, weight double"), 2, residual=1e-5)
    got = {r.node: np.array(r.xy) for r in xy.collect()}
    about = sorted(info.collect())
    assert (got[99] == 0).all() and len(got) == n + 1
    place = np.array([got[k] for k in range(n)])
    for j in range(2):
        assert about[j].residual <= 1e-5 and abs(about[j].value - values[-2 - j]) < 1e-8
        v = vectors[:, -2 - j] / np.sqrt(d)
        assert np.allclose(np.abs(place[:, j] @ v) / np.linalg.norm(v) / np.linalg.norm(place[:, j]), 1, atol=1e-6)
        assert place[np.abs(place[:, j]).argmax(), j] > 0
    assert (place[:15, 0].mean() > 0) != (place[15:, 0].mean() > 0)


def test_graphs_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    xy, info = L.spectral(nodes, spark.createDataFrame([], "a long, b long, weight double"))
    assert sorted(tuple(r) for r in xy.collect()) == [(1, [0.0, 0.0]), (2, [0.0, 0.0])] and info.count() == 0
    xy, info = L.spectral(nodes, spark.createDataFrame([(1, 2, 1.0)], "a long, b long, weight double"))
    assert xy.count() == 2 and abs(info.first().value + 1) < 1e-9


def test_tails_against_exact_sums(spark):
    rng = random.Random(1)
    cases = [(0, 10, 3, 4), (3, 10, 3, 4), (4, 10, 3, 4), (2, 10, 10, 4), (1, 5, 0, 3), (5, 9, 7, 8), (6, 9, 7, 8), (0, 0, 0, 0)]
    for _ in range(150):
        m = rng.randrange(1, 3000)
        n, q = rng.randrange(m + 1), rng.randrange(m + 1)
        cases.append((rng.randrange(min(n, q) + 2), m, n, q))
    df = spark.createDataFrame(cases, "k long, m long, n long, q long")
    for r in df.withColumn("p", S.hypergeom_tail(F.col("k"), F.col("m"), F.col("n"), F.col("q"))).collect():
        ways = sum(comb(r.n, i) * comb(r.m - r.n, r.q - i) for i in range(max(r.k, r.q + r.n - r.m, 0), min(r.n, r.q) + 1))
        assert abs(r.p - float(Fraction(ways, comb(r.m, r.q)))) < 1e-9
    trials = [(k, n, p) for n in (1, 7, 400, 5000) for p in (1e-6, 0.03, 0.5, 0.97) for k in sorted({0, 1, n // 3, int(n * p), int(n * p) + 1, n, n + 1})]
    for r in spark.createDataFrame(trials, "k long, n long, p double").withColumn("tail", S.binom_tail(F.col("k"), F.col("n"), F.col("p"))).collect():
        p = Fraction(r.p)
        exact = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k, r.n + 1)) if r.n <= 400 else None
        assert exact is None or abs(r.tail - float(exact)) < 1e-9
        assert 0 <= r.tail <= 1
