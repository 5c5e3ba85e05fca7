"""Vectors and their changes in blocks of neighbouring ids, and the subsample
that draws only where a word can be dropped."""

import numpy as np
from pyspark.sql import functions as F

from sphaera.functions.keyed import uniform
from sphaera.operators import sampling as P
from sphaera.operators import train as T
from sphaera.operators.trainer import Noise

V, DIM = 3000, 4
NOISE = Noise(np.array([0, 1]), np.array([1, V - 1]), np.array([1.0, 1.0]), np.array([0.0, 1.0]), float(V), V)


def _positions(spark):
    row = "doc_id long, kpos long, idx long, off array<long>, center array<long>, wdraw array<long>, ddraw array<long>, alpha double"
    at = lambda d, k: 1 + (97 * d + 31 * k) % (V - 1)
    rows = [
        (10**12 + d, k, at(d, k), [-1] if k else [], [at(d, k - 1)] if k else [], [d, k, 7, 9], [k, d, 3, 5], 0.1)
        for d in range(12) for k in range(40)
    ]
    return spark.createDataFrame(rows, row)


def _vectors(spark):
    rng = np.random.default_rng(0)
    ids = [("u", i) for i in range(V)] + [("v", i) for i in range(V)] + [("d", 10**12 + d) for d in range(12)]
    rows = [(r, i, [float(x) for x in v / np.linalg.norm(v)]) for (r, i), v in zip(ids, rng.normal(size=(len(ids), DIM)))]
    return spark.createDataFrame(rows, "role string, id long, vec array<float>")


def test_a_group_gets_each_vector_once_and_in_blocks(spark):
    pos = _positions(spark).withColumn("pkey", (F.col("doc_id") % 3).cast("int")).repartition(7, "kpos").cache()
    vectors = _vectors(spark)
    ws = T.working_set(pos.coalesce(1), vectors, 3, DIM, 2, NOISE).collect()
    want = {(r["role"], r["id"]): r["vec"] for r in vectors.collect()}
    got = [(r["wpkey"], r["role"], i, list(r["vec"][DIM * k : DIM * k + DIM])) for r in ws for k, i in enumerate(r["id"])]
    assert len(got) == len({g[:3] for g in got})
    assert all(want[g[1], g[2]] == g[3] for g in got)
    assert len(ws) <= 3 * (2 * (V // 1024 + 1) + 1) < len(got)
    assert {(g[0], g[2]) for g in got if g[1] == "d"} == {(r["pkey"], r["doc_id"]) for r in pos.select("pkey", "doc_id").distinct().collect()}


def test_deltas_and_loss_do_not_depend_on_groups_or_slices(spark, monkeypatch):
    pos, vectors = _positions(spark), _vectors(spark)

    def run():
        d = T.position_deltas(pos, vectors, 0.1, 0.5, DIM, 2, NOISE, tokens=480)
        loss = T.position_objective(pos, vectors, 0.5, DIM, 2, NOISE, tokens=480).collect()
        return {(r["role"], r["id"]): np.array(r["delta"]) for r in d.collect()}, {r["kind"]: r for r in loss}

    one, loss = run()
    monkeypatch.setattr(T, "GROUP_POSITIONS", 40)
    monkeypatch.setattr(T, "SLICE", 3)
    many, split = run()
    assert one.keys() == many.keys() and {k[0] for k in one} == {"u", "v", "d"}
    assert max(np.abs(one[k] - many[k]).max() for k in one) < 1e-12
    for kind in ("word", "doc"):
        assert loss[kind]["n_triples"] == split[kind]["n_triples"] > 0
        assert abs(loss[kind]["mean_loss"] - split[kind]["mean_loss"]) < 1e-9
    docs = T.position_deltas(pos, vectors, 0.1, 0.5, DIM, 2, NOISE, kinds=(1,), tokens=480).collect()
    assert {r["role"] for r in docs} == {"u", "d"}


def test_subsample_keeps_what_the_draw_on_every_token_keeps(spark):
    sc = P.CorpusScalars(100_000, 50, 1.0, 1)
    rows = [(d, k, k % 50, None if k % 11 == 0 else 1 + 37 * (k % 50) ** 2) for d in range(20) for k in range(100)]
    enc = spark.createDataFrame(rows, "doc_id long, pos long, idx long, cn long")
    p = P.keep_probability(F.col("cn"), sc.train_words, 1e-3)
    want = enc.filter(uniform(1, "sub", "0", "doc_id", "pos") <= p)
    got = P.subsample(enc, sc, 1e-3, 1, 0)
    assert sorted(got.collect()) == sorted(want.collect())
    assert ">= 1.0" in got._jdf.queryExecution().analyzed().toString()  # sure words need no digest
