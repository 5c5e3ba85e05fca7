"""Noise-distribution draws equal a plain inverse-CDF search."""

import numpy as np

from sphaera.operators import sampling as P


def test_grid_lookup_equals_cdf_search(spark):
    rng = np.random.default_rng(7)
    cns = sorted([int(c) for c in rng.zipf(1.6, 300) + 4], reverse=True)
    vocab = spark.createDataFrame([(0, "</s>", 50)] + [(i + 1, f"w{i}", c) for i, c in enumerate(cns)],
                                  "idx long, word string, cn long")
    hist = P.noise_histogram(vocab).cache()
    sc = P.corpus_scalars(vocab, hist)
    grid = P.noise_grid(hist, sc)
    us = rng.random(3000)
    draws = spark.createDataFrame([(i, float(u), 0.5) for i, u in enumerate(us)], "i long, u1 double, u2 double")
    got = {r["i"]: r["neg"] for r in P.draw_negatives(draws, grid, sc).collect()}
    w = np.array([50.0] + cns) ** 0.75
    cdf = np.cumsum(w)
    z = cdf[-1]
    for i, u in enumerate(us):
        idx = int(np.searchsorted(cdf, u * z, side="right"))
        if idx == 0:
            idx = 1 + int(np.floor(0.5 * (len(cns))))
        assert got[i] == idx, (i, u, got[i], idx)
