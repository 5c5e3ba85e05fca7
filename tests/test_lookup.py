"""Word lookups whose frequent words are broadcast and whose others are shuffled."""

from pyspark.sql import functions as F

from sphaera.operators import clustering as K
from sphaera.operators import corpus as C
from sphaera.operators import train as T

WORDS = ["", "the", "of", "Räder", "x" * 300] + [f"w{i}" for i in range(60)]


def _vocab(spark):
    return spark.createDataFrame([(i, w, 1000 - i) for i, w in enumerate(WORDS) if i], "idx long, word string, cn long")


def _tokens(spark):
    rows = [(d, k, None if k == 9 else [*WORDS[1:], "unknown"][(7 * d + k * k) % len(WORDS)]) for d in range(30) for k in range(25)]
    return spark.createDataFrame(rows + rows[:40], "doc_id long, pos int, word string")


def test_lookup_in_parts_equals_a_join(spark, monkeypatch):
    vocab, tokens = _vocab(spark), _tokens(spark)
    want = sorted(map(tuple, tokens.join(vocab, "word").collect()))
    for rows, head in ((2_000_000, 500_000), (10, 500_000), (50, 7), (10, 0), (None, 7)):
        got = C.look_up(tokens, vocab, rows, head)
        assert sorted(map(tuple, got.select("word", "doc_id", "pos", "idx", "cn").collect())) == want
    monkeypatch.setattr(C, "BROADCAST_BYTES", 400)  # the long word halves the head
    head, tail = C.vocabulary_parts(vocab, 2_000_000, 32)
    assert 0 < head.count() < 32 and head.count() + tail.count() == vocab.count()
    plan = C.look_up(tokens, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan


def test_encoding_does_not_depend_on_the_bounds(spark):
    docs = spark.createDataFrame([(d, " \t".join(WORDS[(d * k) % 60 + 1] for k in range(1, 40)) + "\r\n zzz") for d in range(20)], "doc_id long, text string")
    one = C.encode_tokens(C.tokenize(docs), _vocab(spark), longest=10_000)
    parts = C.encode_tokens(C.tokenize(docs), _vocab(spark), broadcast_rows=5, longest=10_000)
    assert sorted(one.collect()) == sorted(parts.collect()) and one.count() > 700


def test_tokens_of_odd_texts(spark):
    texts = ["a\rb \t\n c", "", " ", None, "\r", "\n\nx\xa0y\x0bz ", "a\r\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.tokenize(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["word"])
    assert got == {0: ["ab", "c"], 5: ["x\xa0y\x0bz"], 6: ["a", "b"]}


def test_mean_of_ranked_words_equals_plain_mean(spark, monkeypatch):
    emb = spark.createDataFrame([(i, w, [float(i), 1.0 / (i + 1)]) for i, w in enumerate(WORDS)], "id long, key string, vec array<float>")
    tokens, ids = _tokens(spark), spark.range(32).select(F.col("id").alias("doc_id"))
    want = {r["doc_id"]: r["vec"] for r in K.doc_mean_embedding(tokens, emb.drop("id"), ids).collect()}
    for rows in (500_000, 6, -1):
        monkeypatch.setattr(K, "HEAD_ROWS", rows)
        got = {r["doc_id"]: r["vec"] for r in K.doc_mean_embedding(tokens, emb, ids).collect()}
        assert got.keys() == want.keys() and got[31] is want[31] is None
        assert all(abs(a - b) < 1e-9 for d in range(30) for a, b in zip(got[d], want[d], strict=True))


def test_forward_shuffles_only_triples_of_rare_words(spark, monkeypatch):
    roles = [("u", i) for i in range(40)] + [("v", i) for i in range(40)] + [("d", d) for d in (-2, 5, 5, 9)]  # a document twice
    vectors = spark.createDataFrame([(r, i, [0.1 * i, 1.0 / (abs(i) + 2), float(i % 3)]) for r, i in roles], "role string, id long, vec array<float>")
    rows = [(k, (7 * k) % 41, (k * k) % 40, (11 * k + 3) % 40 if k % 9 else None, (-2, 5, 9, 8)[k % 4]) for k in range(200)]
    triples = spark.createDataFrame(rows, "k long, ctx long, center long, neg long, doc_id long")  # 41, null and 8 have no vector
    for role, anchor in (("v", "ctx"), ("d", "doc_id")):
        plain = triples
        for r, key, name in ((role, anchor, "a_vec"), ("u", "center", "u_vec"), ("u", "neg", "n_vec")):
            plain = plain.join(vectors.filter(F.col("role") == r).select(F.col("id").alias(key), F.col("vec").alias(name)), key)
        want = sorted((r["k"], r["a_vec"], r["u_vec"], r["n_vec"]) for r in plain.collect())
        assert len(want) > 100
        for head in (500_000, 39, 17, -1):
            monkeypatch.setattr(T, "HEAD_ROWS", head)
            got = T.margin_forward(triples, vectors, role, anchor, "center", 0.15, 3)
            assert sorted((r["k"], r["a_vec"], r["u_vec"], r["n_vec"]) for r in got.collect()) == want
            hints = got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
            assert hints == (3 if role == "v" else 2)
