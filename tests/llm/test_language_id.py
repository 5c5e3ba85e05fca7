import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.llm import language_id as lid


@pytest.fixture(scope="module")
def model(small_docs):
    return lid.train(small_docs)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4, 2])
    k = 3
    e, trans, start = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    spot, seq, n_at = lid._steps(lengths)
    tm = np.empty_like(e)
    tm[spot] = e
    post = lid._passes(tm, n_at, trans, start)[spot]
    lo = 0
    pairs = np.zeros((k, k))
    for n in lengths:
        want, total = np.zeros((n, k)), 0.0
        here = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(e[lo + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in zip(path, path[1:]):
                here[a, b] += w
        assert np.allclose(post[lo : lo + n], want / total)
        pairs += here / total
        lo += n
    inner = np.flatnonzero(seq[1:] == seq[:-1])
    assert np.allclose(lid._expected_pairs(tm, spot, post, inner, n_at, trans, start), pairs)


def test_held_out_accuracy(small_docs, model):
    got = lid.identify(small_docs).join(small_docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_only_the_text_counts(small_docs, model):
    a = lid.predict(small_docs, model).collect()
    b = lid.predict(small_docs.withColumns({"lang": F.lit("xx"), "source": F.lit("?")}).repartition(7), model).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in a) == sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in b)


def test_switches_within_a_text(spark, small_docs, model):
    rows = {r.lang: r.text for r in small_docs.orderBy("doc_id").collect() if r.text and len(r.text) > 400}
    de, en = lid.words(rows["de"])[:40], lid.words(rows["en"])[:40]
    df = spark.createDataFrame([(1, " ".join(de + en))], "doc_id long, text string")
    langs = lid.label_words(df, model).first().langs
    assert np.mean([x == "de" for x in langs[:38]]) > 0.9 and np.mean([x == "en" for x in langs[42:]]) > 0.9


def test_edge_rows(edge_docs, clashing_docs, no_docs, model):
    got = lid.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    texts = {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert sorted(map(repr, lid.identify(clashing_docs).collect())) == sorted(map(repr, lid.identify(edge_docs).collect()))
    assert lid.identify(no_docs).count() == 0
    none = lid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}
    kept = lid.keep_identified(clashing_docs, model)
    assert kept.columns == clashing_docs.columns
    assert all(any(c.isalpha() for c in r.text) for r in kept.collect())


def test_words_and_features():
    assert lid.words(None) == [] and lid.words("12 _ ½ --") == []
    assert lid.words("Über-all x2y") == ["über", "all", "x", "y"]
    assert {"<ab", ">bc", "^a", "abc", "c$", "=abc"} <= set(lid.features("abc"))


def test_scores_of_words_are_sums_of_their_features(model):
    words = ["a", "ab", "the", "über", "straßenbahn", "ñandú", "x" * 80, "中文", "queque"] + lid.words("thanedble éauxment enchpf")
    got = lid._Scores(model)(words)
    for w, row in zip(words, got):
        want = sum((model.weight[model.index[f]] for f in lid.features(w) if f in model.index), np.zeros(len(model.langs)))
        assert np.allclose(row, want, atol=1e-4)
    assert len(np.unique(lid._Scores(model).keys)) == len(model.index)
