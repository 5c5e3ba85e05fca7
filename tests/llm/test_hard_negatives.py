import random

import numpy as np
import pytest

from sphaera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50):
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dim = max((len(r[1]) for r in rows), default=0)
    q = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] + [0] * (dim - len(r[1])) for r in rows]
    out = []
    order = lambda s, i: (-s, i is None, i or 0)
    for a, (vid, _, label) in enumerate(rows):
        if vid is None or vid % every:
            continue
        scored = [(sum(x * y for x, y in zip(q[a], q[b])), r[0], r[2], b) for b, r in enumerate(rows)]
        same = sorted((s for s in scored if s[2] == label and s[3] != a), key=lambda s: order(*s[:2]))[:5]
        other = sorted((s for s in scored if s[2] != label), key=lambda s: order(*s[:2]))
        for p in same:
            fit = [s for s in other if 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:3]
            out += [(vid, p[1], i + 1, s[1], p[0], s[0]) for i, s in enumerate(fit)]
    return sorted(map(repr, out))


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(repr(tuple(r)) for r in H.hard_negatives(df, **kw).collect())


def vectors(n, dim, seed=1, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((labels, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centers[label] * (1 - spread) + rng.standard_normal(dim) * spread
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    return out


@pytest.mark.parametrize("dim,spread", [(64, 1.0), (100, 0.75), (3, 0.8)])
def test_equals_brute_force_in_small_tiles(spark, dim, spread):
    rows = vectors(700, dim, spread=spread)
    got = mined(spark, rows, anchors_every=10, tile_rows=150, tile_anchors=20)
    assert got == brute(rows, 10) and len(got) > 50


def test_defined_cases(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], rng.randint(0, 2)) for i in range(300)]  # many ties
    rows += [rows[0], rows[0], rows[50], rows[51]]  # repeated rows, anchors among them
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 1), (350, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (450, [1.0, 1.0, 1.0, 1.0], None),
             (500, [float("nan")] * 4, 2), (550, [float("inf"), 0.0, 0.0, 0.0], 2), (600, [2.0, 1.0], 2), (650, [], 1), (-50, [0.0] * 4, 0),
             (700, [1.0, -2.0, 0.5, 0.25], 9)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [r for r in rows if r[0] == 700]) == []


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    assert mined(spark, []) == []
    rows = vectors(200, 8)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in "row q x l nr na ap rp ints bits align rest nth scores".split()})
    assert sorted(repr(tuple(r)) for r in H.hard_negatives(df).collect()) == brute(rows)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.standard_normal((3000, 64)) / 8).astype(np.int64)
    x[:20] *= 1000
    x[20] = 0
    bits, align, rest = H.codes(x)
    a = H.Anchors(x[:64])
    low, high = a.interval(slice(0, 64), bits, align, rest)
    exact = x[:64] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    # the residual is 0.6 of the vector after one code, 0.6^4 after four
    norm = np.linalg.norm(x[100:].astype(float), axis=1)
    assert 0.09 < np.median(rest[100:] / norm) < 0.17
    lengths = np.linalg.norm(x[30:64].astype(float), axis=1)[:, None] * norm
    assert np.median((high - low)[30:, 100:] / 2 / lengths) < 0.22
