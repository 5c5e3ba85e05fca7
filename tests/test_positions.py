"""Plain positions, whose groups find neighbours and draws themselves, and the
digests of many keys at once."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sphaera.functions.keyed import LOW, PRIME, digest_words
from sphaera.operators import pairs as G
from sphaera.operators import train as T
from sphaera.operators import trainer
from sphaera.operators.trainer import Draws, Noise, _active, _slots, _steps, noise_ids, triples_of, widened

V, DIM, WINDOW = 500, 4, 3
NOISE = Noise(np.array([0, 1]), np.array([1, V - 1]), np.array([1.0, 1.0]), np.array([0.0, 1.0]), float(V), V)
DRAWS = Draws(WINDOW, 1, 0)


def _kept(spark):
    rows = [(d - 3, k // 30, k, 1 + (97 * d + 31 * k) % (V - 1), 1 + (d + k) % WINDOW) for d in range(9) for k in range(7 * d + 1)]
    return spark.createDataFrame(rows, "doc_id long, seg int, kpos long, idx long, radius long")


def _vectors(spark):
    rng = np.random.default_rng(0)
    ids = [(r, i) for r in "uv" for i in range(V)] + [("d", d - 3) for d in range(9)]
    rows = [(r, i, [float(x) for x in v / np.linalg.norm(v)]) for (r, i), v in zip(ids, rng.normal(size=(len(ids), DIM)))]
    return spark.createDataFrame(rows, "role string, id long, vec array<float>")


def test_digests_equal_md5():
    keys = ["", "1:win:0:0:0", "1:wneg:3:-17:123456789012", "x" * 55, "y" * 56, "é" * 40, "z" * 200] * 2000
    want = [np.frombuffer(hashlib.md5(k.encode()).digest(), ">u4") for k in keys[:7]] * 2000
    assert (digest_words(pa.array(keys)) == np.array(want)).all()
    assert (digest_words(pa.array(keys)[3:]) == np.array(want[3:])).all()
    assert digest_words(pa.array([], pa.string())).shape == (0, 4)


def test_plain_positions_hold_the_triples_of_wide_ones(spark):
    kept = _kept(spark)
    wide = G.position_rows(kept, WINDOW, 2, 1, 0).withColumn("alpha", F.lit(0.5)).toPandas().sort_values(["doc_id", "kpos"])
    plain = G.plain_positions(kept).withColumn("alpha", F.lit(0.5))
    want = triples_of(pa.Table.from_pandas(wide, preserve_index=False), 2, NOISE)
    got = triples_of(widened(pa.Table.from_batches(plain.repartition(3).toArrow().to_batches()), DRAWS), 2, NOISE)
    assert want.keys() == got.keys() and len(want["neg"]) > 1000
    assert all((want[c] == got[c]).all() for c in want)


def test_plain_positions_over_block_borders(spark, monkeypatch):
    kept, vectors = _kept(spark), _vectors(spark)
    wide, plain = G.position_rows(kept, WINDOW, 2, 1, 0), G.plain_positions(kept)
    n = kept.count()
    for kinds in ((0, 1), (0,), (1,)):
        want = {(r["role"], r["id"]): np.array(r["delta"]) for r in
                T.position_deltas(wide, vectors, 0.1, 0.5, DIM, 2, NOISE, kinds, tokens=n).collect()}
        monkeypatch.setattr(T, "GROUP_POSITIONS", 64)  # blocks of 8 positions
        got = {(r["role"], r["id"]): np.array(r["delta"]) for r in
               T.position_deltas(plain, vectors, 0.1, 0.5, DIM, 2, NOISE, kinds, tokens=n, draws=DRAWS).collect()}
        monkeypatch.undo()
        assert want.keys() == got.keys()
        assert max(np.abs(want[k] - got[k]).max() for k in want) < 1e-12
    want = T.position_objective(wide, vectors, 0.5, DIM, 2, NOISE, tokens=n).collect()
    monkeypatch.setattr(T, "GROUP_POSITIONS", 64)
    got = T.position_objective(plain, vectors, 0.5, DIM, 2, NOISE, tokens=n, draws=DRAWS).collect()
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a["n_triples"] == b["n_triples"] > 0 and abs(a["mean_loss"] - b["mean_loss"]) < 1e-9


def _long_noise(counts=900):
    n, w = np.arange(counts) % 7 + 1, (counts - np.arange(counts)) ** 0.75
    first, cum = np.cumsum(n) - n, np.cumsum(n * w) - n * w
    return Noise(first, n, w, cum, float((n * w).sum()), int(n.sum()))


def test_buckets_and_draws_of_integers():
    noise, rng = _long_noise(), np.random.default_rng(1)
    t = np.concatenate([rng.random(50_000) * noise.total, noise.cum_before, np.nextafter(noise.cum_before[1:], 0)])
    assert (noise.buckets(t) == np.searchsorted(noise.cum_before, t, "right") - 1).all()
    lanes, off = rng.integers(0, 1 << 32, (300, 4)), rng.integers(-5, 6, 300)
    got = noise_ids(lanes, off, 2, noise)
    for row, o, ids in zip(lanes.tolist(), off.tolist(), got.tolist(), strict=True):
        a, b, c, d = row
        for k, found in enumerate(ids, 1):
            j = 2 * (abs(o) * 2 + k) + (o < 0)
            q1, q2, q3 = ((x + y * j + z * j * j) % PRIME for x, y, z in ((a, b, c), (d, a, b), (c, d, a)))
            x = (q1 * LOW + q2 % LOW) / float(PRIME * LOW) * noise.total
            at = int(np.searchsorted(noise.cum_before, x, "right")) - 1
            want = int(noise.first_idx[at] + min(noise.n_words[at] - 1, np.floor((x - noise.cum_before[at]) / noise.w[at])))
            assert found == (want or 1 + int(q3 / float(PRIME) * (noise.vocab_size - 1)))


def test_summed_steps_equal_the_rule_triple_by_triple():
    rng = np.random.default_rng(2)
    U, A = rng.normal(size=(30, 5)), rng.normal(size=(12, 5))
    ai, pi, ni, al = rng.integers(0, 12, 400), rng.integers(0, 30, 400), rng.integers(0, 30, 400), rng.random(400)
    _, act, f, h, av, diff = _active(A, U, ai, pi, ni, 0.5)
    assert 50 < act.sum() < 350
    ai, pi, ni, al = ai[act], pi[act], ni[act], al[act]
    d_u, d_a, n_u, n_a = np.zeros_like(U), np.zeros_like(A), np.zeros(30, int), np.zeros(12, int)
    for a, p, n, r in zip(ai, pi, ni, al, strict=True):
        x, y = U[p] @ A[a], U[n] @ A[a]
        d_u[p] += r * (1 - x) * (A[a] - x * U[p])
        d_u[n] += r * 2 * y * (y * U[n] - A[a])
        d_a[a] += r * (1 - (x - y)) * (U[p] - (x - y) * A[a] - U[n])
        n_u[p] += 1
        n_u[n] += 1
        n_a[a] += 1
    tu, su, cu, ta, sa, ca = _steps(A, U, av, diff, f, h, al, ai, pi, ni, _slots(U, A))
    assert sorted(tu) == sorted(np.flatnonzero(n_u)) and sorted(ta) == sorted(np.flatnonzero(n_a))
    assert np.allclose(su, d_u[tu]) and np.allclose(sa, d_a[ta]) and (cu == n_u[tu]).all() and (ca == n_a[ta]).all()


def test_a_group_of_many_draws_stops_drawing(monkeypatch):
    calls, plain = [], trainer.noise_ids
    monkeypatch.setattr(trainer, "noise_ids", lambda *x: calls.append(len(x[0])) or plain(*x))
    n = 4000
    t = pa.table({"pkey": pa.array(np.arange(n) % 2, pa.int32()), "doc_id": np.arange(n) // 40, "kpos": np.arange(n) % 40,
                  "idx": 1 + np.arange(n) % 9, "radius": np.full(n, 2)})
    need = pa.Table.from_batches(trainer.working_ids(2, NOISE, draws=DRAWS)(iter(t.to_batches(max_chunksize=200))))
    asked = {(r["wpkey"], r["side"]): r["at"] for r in need.to_pylist()}
    assert asked[0, "u"] == asked[1, "u"] == list(range(V)) and sorted(asked[0, "v"] + asked[1, "v"]) == sorted(2 * list(range(1, 10)))
    assert len(asked[0, "d"]) == len(asked[1, "d"]) == 100 and sum(calls) < 4 * V + 2 * 5 * 200
