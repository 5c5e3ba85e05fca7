"""What the training queries write and shuffle: the texts once, no rows of
tokens, pairs or positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sphaera.operators import corpus as C
from sphaera.operators import pairs as G
from sphaera.operators import train as T
from sphaera.operators import trainer
from test_positions import DIM, DRAWS, NOISE, _kept, _vectors


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Texts of few long words, one of 700,000 bytes and 70,000 tokens."""
    words = [f"word{i:06d}" for i in range(40)]
    rows = [(d, " ".join(words[(d * k * k + k) % 40] for k in range(70_000 if d == 3 else 40 + d)), "en") for d in range(12)]
    rows[5] = (5, None, "en")
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_tokens_are_bounded_by_separators(spark, long_texts):
    docs = spark.read.parquet(f"{long_texts}/documents.parquet")
    size, most = C.text_size(docs)
    assert most == 70_000 == C.most_tokens(docs)
    assert size == sum(len(r["text"] or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, "\ta b\n\nc\r d"), (2, ""), (3, None)], "doc_id long, text string")
    assert C.most_tokens(odd) == 6 >= C.tokenize(odd).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert C.text_size(odd.filter("doc_id = 3")) == (0, 1)


def test_partitions_follow_the_bytes():
    assert C.text_partitions(0, 8) == C.text_partitions(8 * C.PARTITION_BYTES, 8) == 8
    assert C.text_partitions(10**10, 8) == -(-(10**10) // C.PARTITION_BYTES)


@pytest.mark.parametrize("name", ["g1_skipgram_pairs", "g3_word_triples", "t3_margin_forward", "t9_epoch_objective"])
def test_tokens_are_not_written_or_shuffled(spark, long_texts, name):
    plan = queries()[name](spark, long_texts)._jdf.queryExecution().executedPlan().toString()
    assert "token-blocks" not in plan
    shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning(doc_id" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)  # the texts alone
    assert "_l#" not in "".join(x for x in plan.split("\n") if "Sort [" in x or "Window [" in x)


def _close(a, b):
    a, b = ({(r["role"], r["id"]): np.array(r["delta"]) for r in x} for x in (a, b))
    assert a.keys() == b.keys() and max(np.abs(a[k] - b[k]).max() for k in a) < 1e-12


@pytest.mark.parametrize("rows", [1, 16, 1 << 15])
def test_positions_stay_where_they_are(spark, monkeypatch, rows):
    """T4 to T6 and the forward pass in tables of few rows, which end inside
    windows, against groups that ask for vectors."""
    kept, vectors = _kept(spark), _vectors(spark)
    pos, n = G.plain_positions(kept), kept.count()
    stream = trainer.make_stream_fn
    for kinds in ((0, 1), (0,), (1,)):
        args = (pos, vectors, 0.1, 0.5, DIM, 2, NOISE, kinds)
        with monkeypatch.context() as m:
            m.setattr(T, "TABLE_BYTES", 0)
            want = T.position_deltas(*args, tokens=n, draws=DRAWS).collect()
        with monkeypatch.context() as m:
            m.setattr(T, "dealt_groups", None)  # which shuffles and keeps positions
            m.setattr(T, "GROUP_POSITIONS", 80)  # blocks of 10 positions
            m.setattr(trainer, "make_stream_fn", lambda *a, **k: stream(*a, **k, rows=rows))
            _close(T.position_deltas(*args, tokens=n, draws=DRAWS).collect(), want)
    with monkeypatch.context() as m:
        m.setattr(T, "TABLE_BYTES", 0)
        want = T.position_objective(pos, vectors, 0.5, DIM, 2, NOISE, tokens=n, draws=DRAWS).collect()
    monkeypatch.setattr(T, "dealt_groups", None)
    monkeypatch.setattr(trainer, "make_stream_fn", lambda *a, **k: stream(*a, **k, rows=rows))
    got = T.position_objective(pos, vectors, 0.5, DIM, 2, NOISE, tokens=n, draws=DRAWS).collect()
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a["n_triples"] == b["n_triples"] > 0 and a["active_share"] == b["active_share"]
        assert abs(a["mean_loss"] - b["mean_loss"]) < 1e-9


def test_words_and_documents_without_a_vector_are_an_error(spark):
    pos, vectors = G.plain_positions(_kept(spark)), _vectors(spark)
    for without in ("role = 'u' AND id = 31", "role = 'd' AND id = 0"):
        with pytest.raises(Exception, match="miss"):
            T.position_deltas(pos, vectors.filter(f"NOT ({without})"), 0.1, 0.5, DIM, 2, NOISE, tokens=99, draws=DRAWS)


def test_vectors_that_come_twice_count_once(spark):
    pos, vectors = G.plain_positions(_kept(spark)), _vectors(spark)
    want = T.position_deltas(pos, vectors, 0.1, 0.5, DIM, 2, NOISE, tokens=99, draws=DRAWS)
    _close(T.position_deltas(pos, vectors.unionByName(vectors), 0.1, 0.5, DIM, 2, NOISE, tokens=99, draws=DRAWS).collect(), want.collect())


def test_changes_of_blocks_are_merged_as_rows_are(spark):
    """At most ``reach`` long, back to the sphere, untouched vectors as they are."""
    rng = np.random.default_rng(2)
    ids = [0, 1, 1023, 1024, 5000]
    vectors = spark.createDataFrame([(r, i, rng.normal(size=DIM).tolist()) for r in "uvw" for i in ids], "role string, id long, vec array<float>")
    packed = [(s, r, b, [i for i in ids if i >> 10 == b and i != 1], []) for s in (0, 1) for r in "uv" for b in (0, 1)]
    packed = [(s, r, b, i, (rng.normal(size=DIM * len(i)) * (0.05 if r == "u" else 1)).tolist()) for s, r, b, i, _ in packed]
    packed = spark.createDataFrame(packed, "src int, role string, blk long, id array<long>, vec array<double>")
    want = T.apply_deltas(vectors, T.sum_blocks(packed, 2, DIM), reach=0.4).collect()
    got = T.merge_blocks(vectors, packed, 2, DIM, 0.4).collect()
    want, got = ({(x["role"], x["id"]): np.array(x["vec"]) for x in rows} for rows in (want, got))
    assert len(got) == 15 and got.keys() == want.keys()
    assert max(np.abs(got[k] - want[k]).max() for k in want) < 1e-6


@pytest.mark.parametrize("merges", [2])
def test_a_fit_does_not_depend_on_where_words_are_held(spark, monkeypatch, merges):
    """Shards that look words up against shards that ask for their vectors; one
    document lies in many shards."""
    from sphaera.params import Params
    from sphaera.plans.fit import _Fit, fit

    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(words[(d * 7 + k * k + k // 3) % 60] for k in range(900 if d == 4 else 30 + 5 * d))) for d in range(20)]
    docs = spark.createDataFrame([*rows, (20, ""), (21, None)], "doc_id long, text string")
    p = Params(dim=6, iter=2, min_count=1, sample=1e-2, shard_tokens=100, merges=merges)

    def run():
        r = fit(docs, p)
        loss = {(x["epoch"], x["kind"]): (x["mean_loss"], x["n_triples"]) for x in r.objective.collect()}
        return {(x["role"], x["id"]): np.array(x["vec"]) for x in r.vectors().collect()}, loss, r

    with monkeypatch.context() as m:
        m.setattr(T, "TABLE_BYTES", 0)
        want, loss, _ = run()
    monkeypatch.setattr(T, "working_set", None)  # which sends every shard its vectors
    monkeypatch.setattr(_Fit, "dealt", lambda self, rows, step, dealt=_Fit.dealt: (dealt(self, rows, step)[0], 3))
    got, other, r = run()
    assert got.keys() == want.keys() and max(np.abs(got[k] - want[k]).max() for k in want) < 1e-5
    assert loss.keys() == other.keys() and all(loss[k][1] == other[k][1] > 0 and abs(loss[k][0] - other[k][0]) < 1e-6 for k in loss)
    assert r.run.log.read("corpus").groupBy("doc_id", "part").count().agg({"count": "max"}).first()[0] == 1  # rows of parts, not of tokens


@pytest.mark.parametrize("role, anchor, pos", [("v", "ctx", "center"), ("d", "doc_id", "word")])
def test_rare_words_are_looked_up_where_the_triples_are(spark, monkeypatch, role, anchor, pos):
    rows = [(k % 9 - 3, k, (7 * k) % 500, (13 * k + 1) % 500, (29 * k + 2) % 510) for k in range(600)]  # 10 ids have no vector
    triples = spark.createDataFrame(rows, "doc_id long, kpos long, ctx long, center long, neg long").withColumn("word", F.col("center"))
    vectors = _vectors(spark)

    def run():
        d = T.margin_forward(triples, vectors, role, anchor, pos, 0.5, DIM)
        small = d.select("doc_id", "kpos", F.round("f", 6), F.round("h", 6), F.round("loss", 6), "active")
        whole = d.select("kpos", "a_vec", "u_vec", "n_vec").orderBy("kpos").collect()
        return sorted(small.collect()), whole, d._jdf.queryExecution().optimizedPlan().toString(), small

    monkeypatch.setattr(T, "HEAD_ROWS", 20)
    got, vec, plan, small = run()
    rare = plan.split("Union", 1)[1]
    assert "dots" in rare and rare.count("Join") == (3 if role == "v" else 4)  # of frequent words and of documents
    assert "look" not in small._jdf.queryExecution().optimizedPlan().toString()  # unused vectors stay out
    monkeypatch.setattr(T, "TABLE_BYTES", 0)
    want, same, _, _ = run()
    assert got == want and vec == same and 500 < len(got) < 600
