"""Stabilised variance against a direct local fit, and calls on planted doublets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import doublets as D
from lacuna.operators import stabilised as S
from lacuna.operators.matrix import gene_moments


def direct(x, y, span):
    """The local quadratic fit with every point's own weight."""
    out, k = np.empty(len(x)), int(np.ceil(span * len(x)))
    for i, x0 in enumerate(x):
        d = np.abs(x - x0)
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        a = np.stack([np.ones_like(x), x - x0, (x - x0) ** 2], axis=1) * np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0]
    return out


def counts(spark, x):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "cell long, gene long, value double")


def test_stabilised_genes(spark):
    rng = np.random.default_rng(5)
    n, p = 120, 600
    mean = 10 ** rng.uniform(-0.5, 1.5, p)
    x = rng.poisson(rng.gamma(2.0, mean / 2.0, (n, p)))
    x[:10, 7] += 400
    x[:, 8] = 0
    coo = counts(spark, x)
    moments = gene_moments(coo, spark.range(n).agg(F.count(F.lit(1)).alias("n")))
    got = {r.gene: r for r in S.stabilised_genes(coo, moments, n, p).collect()}
    used = np.flatnonzero((x.mean(axis=0) > 0) & (x.var(axis=0) > 0))
    mu, var = x.mean(axis=0)[used], x.var(axis=0, ddof=1)[used]
    fit = 10 ** direct(np.log10(mu), np.log10(var), S.SPAN)
    clipped = np.minimum(x[:, used], mu + np.sqrt(fit * n))
    norm = (n * mu**2 + (clipped**2).sum(axis=0) - 2 * mu * clipped.sum(axis=0)) / ((n - 1) * fit)
    assert set(got) == set(used.tolist()) and 8 not in got
    assert np.allclose([got[g].fit for g in used.tolist()], fit, rtol=0.01)
    assert np.allclose([got[g].norm_var for g in used.tolist()], norm, rtol=0.01)
    assert min(got.values(), key=lambda r: r["rank"]).gene == 7
    assert sorted(r["rank"] for r in got.values()) == list(range(1, len(used) + 1))


def test_stabilised_edges(spark):
    one = counts(spark, np.array([[1, 2], [3, 2], [0, 2]]))
    moments = gene_moments(one, spark.range(3).agg(F.count(F.lit(1)).alias("n")))
    got = S.stabilised_genes(one, moments, 3, 5).collect()
    assert [r.gene for r in got] == [0] and abs(got[0].fit - got[0]["var"]) < 1e-9
    assert S.stabilised_genes(one.limit(0), moments.limit(0), 3, 5).collect() == []


def test_valley():
    low = np.exp(-((np.arange(256) - 50) ** 2) / 200) + 0.5 * np.exp(-((np.arange(256) - 190) ** 2) / 400)
    assert 80 < D.valley(low * 100) < 150
    assert D.valley(np.exp(-((np.arange(256) - 128) ** 2) / 200)) is None
    assert D.valley(np.zeros(256)) is None


def test_pairs(spark):
    cells = spark.createDataFrame([(k, "one" if k < 300 else "two") for k in range(310)] + [(999, "alone")], "cell long, library string")
    made = D.pairs(cells).collect()
    library = {k: "one" if k < 300 else "two" for k in range(310)}
    assert all(library[r.a] == library[r.b] == r.library and r.a != r.b for r in made)
    assert len({r.id for r in made}) == len(made) > 590
    assert sorted(map(tuple, made)) == sorted(map(tuple, D.pairs(cells.repartition(3)).collect()))


def test_calls_on_planted_doublets(spark):
    rng = np.random.default_rng(11)
    n, p, planted = 300, 90, 24
    kinds = np.full((3, p), 0.4)
    for k in range(3):
        kinds[k, 30 * k : 30 * k + 30] = 6.0
    kind = rng.integers(0, 3, n)
    x = rng.poisson(kinds[kind])
    for i in range(planted):
        x[i] = rng.poisson(kinds[i % 3]) + rng.poisson(kinds[(i + 1) % 3])
    rows = counts(spark, x)
    small = [(5000 + k, 1, 4.0) for k in range(20)]
    coo = rows.union(spark.createDataFrame(small, "cell long, gene long, value double"))
    cells = spark.createDataFrame([(k, "big") for k in range(n)] + [(5000 + k, "small") for k in range(20)] + [(7000, None)], "cell long, library string")
    calls, libraries = D.call(coo, cells, components=5)
    got = {r.cell: r for r in calls.collect()}
    assert len(got) == n + 20
    called = {c for c, r in got.items() if r.predicted}
    assert len(called & set(range(planted))) >= 0.85 * planted
    assert len(called - set(range(planted))) <= 0.05 * n
    assert all(got[5000 + k].score == 0 and not got[5000 + k].predicted for k in range(20))
    about = {r.library: r for r in libraries.collect()}
    assert about["small"].threshold is None and about["small"].simulated == 0
    assert about["big"].detected == pytest.approx(len(called) / n) and 0.4 < about["big"].detectable < 0.9
    none = D.call(coo, cells.where("library = 'small'"))
    assert not any(r.predicted for r in none[0].collect()) and none[1].count() == 1
