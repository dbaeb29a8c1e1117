import math
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, index int, deviation string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA).repartition(3)


def brute(rows, k=8):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[j] for _, v in x) for j in range(d)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for _, v in x]
    m = np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for _, v in x])
    cov = m.T @ m / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, dev, m @ q / np.sqrt(e), e / np.trace(cov)


def vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    return [(int(i), (r.standard_normal(d) * (1 + np.arange(d)) / d).astype(np.float32).tolist()) for i in range(n)]


def test_matches_numpy(spark):
    for n, d, block in ((200, 12, 64), (90, 5, 1024), (300, 9, 7)):
        rows = vectors(n, d)
        rows += rows[:2]  # repeated rows count twice
        bad = [(900, None), (901, [math.nan] * d), (902, [math.inf] + [0.0] * (d - 1)), (903, [None] + [0.0] * (d - 1)), (904, []), (905, [1.0] * (d + 1)), (906, [3e38] * d)]
        got = whitening.whitened_components(frame(spark, rows + bad), block_rows=block).collect()
        count, dev, y, share = brute(rows)
        k = min(8, d)
        assert len(got) == len(rows) * k and {x.n for x in got} == {count}
        assert sorted({(x.vec_id, x.deviation) for x in got}) == sorted({(i, e) for (i, _), e in zip(rows, dev, strict=True)})
        mine = {(x.vec_id, x.component): x.whitened for x in got}
        for c in range(k):
            a = np.array([mine[i, c + 1] for i, _ in rows])
            assert min(np.abs(a - y[:, c]).max(), np.abs(a + y[:, c]).max()) < 1e-8
            assert {round(x.explained / share[c], 9) for x in got if x.component == c + 1} == {1.0}
        assert {x.identity_error < 1e-9 for x in got} == {True}
        y = np.array([[mine[i, c + 1] for c in range(k)] for i, _ in rows])
        assert np.abs(y.T @ y / count - np.eye(k)).max() < 1e-9


def test_large_numbers_stay_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1, 1]) * 2.0 ** r.randint(5, 16) for _ in range(3)]) for i in range(40)]
    got = {x.vec_id: x.deviation for x in whitening.whiten(frame(spark, rows))[0].collect()}
    _, dev, _, _ = brute(rows)
    assert [got[i] for i, _ in rows] == [e if e < 2**63 else None for e in dev] and None in got.values() and any(got.values())


def test_edges(spark):
    run = lambda rows: whitening.whitened_components(frame(spark, rows)).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [0.5, 0.25])]) == []
    assert run([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []  # no spread, no component
    # Spread in one direction is one component; rows without id take part.
    got = run([(1, [0.0, 1.0]), (None, [1.0, 1.0])])
    assert sorted((x.vec_id or 0, x.component, x.n, x.deviation, round(abs(x.whitened), 9), round(x.explained, 9)) for x in got) == [(0, 1, 2, 1024**2, 1.0, 1.0), (1, 1, 2, 1024**2, 1.0, 1.0)]
    # A very long vector.
    r = np.random.default_rng(4)
    got = run([(i, r.standard_normal(600).tolist()) for i in range(12)])
    assert len(got) == 12 * 8 and max(x.identity_error for x in got) < 1e-9


def test_whitened_rows_are_uncorrelated(spark):
    rows, fitted = whitening.whiten(frame(spark, vectors(100, 6)), components=3)
    cov = whitening.covariance(rows, fitted.n)
    assert np.abs(cov - np.eye(3)).max() < 1e-9 and rows.filter(F.size("whitened") != 3).count() == 0
