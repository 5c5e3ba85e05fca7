"""Hand-made cases for the reference's corpus and vocabulary quirks."""

from pyspark.sql import functions as F

from sphaera.operators import corpus as C
from sphaera.operators import vocab as V


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def toks(df):
    return [(r["doc_id"], r["pos"], r["word"]) for r in df.orderBy("doc_id", "pos").collect()]


def test_separators_and_carriage_return(spark):
    d = docs(spark, ["a  b\tc\r\nd", "x\ry", "", "   "])
    assert toks(C.tokenize(d)) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 3, "d"), (1, 0, "xy")]


def test_long_tokens_cut_to_98_bytes(spark):
    d = docs(spark, ["a" * 120, "é" * 60, "b" * 98])
    w = {r["doc_id"]: r["word"] for r in C.tokenize(d, max_bytes=98).collect()}
    assert w[0] == "a" * 98
    assert len(w[1].encode("utf-8")) == 98 and w[1] == "é" * 49
    assert w[2] == "b" * 98
    # a cut never falls inside a character, and nothing is cut unasked
    d = docs(spark, ["a" + "é" * 60, "ab" + "中" * 40, "abc" + "🙂" * 30, "x" * 500])
    w = {r["doc_id"]: r["word"] for r in C.tokenize(d, max_bytes=98).collect()}
    assert w == {0: "a" + "é" * 48, 1: "ab" + "中" * 32, 2: "abc" + "🙂" * 23, 3: "x" * 98}
    assert {r["word"] for r in C.tokenize(d).collect()} >= {"x" * 500, "a" + "é" * 60}


def test_literal_eos_splits_documents(spark):
    d = docs(spark, ["p q", "a </s> b", "</s>", "c"])
    out = C.doc_boundaries(d).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["src_id"], r["text"]) for r in out] == [
        (0, 0, "p q"), (1, 1, "a"), (2, 1, "b"), (3, 2, ""), (4, 2, ""), (5, 3, "c")]


def test_eos_counts_every_document_even_empty(spark):
    d = docs(spark, ["a a b", "", "a </s> c"])
    counts = {r["word"]: r["cn"] for r in V.word_count(C.tokenize(d), d).collect()}
    # three rows plus one literal marker
    assert counts["</s>"] == 4 and counts["a"] == 3 and counts["b"] == 1 and counts["c"] == 1


def test_vocab_order_ties_and_min_count(spark):
    d = docs(spark, ["x x x y y y z z z z z w"])
    v = V.build_vocab(C.tokenize(d), d, min_count=2)
    got = [(r["idx"], r["word"], r["cn"]) for r in v.orderBy("idx").collect()]
    # </s> stays although its count (1) is below min_count; ties by word descending
    assert got == [(0, "</s>", 1), (1, "z", 5), (2, "y", 3), (3, "x", 3)]


def test_vocab_cap_threshold(spark):
    counts = spark.createDataFrame(
        [("</s>", 1), ("a", 9), ("b", 5), ("c", 5), ("d", 2), ("e", 1)], "word string, cn long")
    kept = {r["word"] for r in V.vocab_cap(counts, 3).collect()}
    assert kept == {"</s>", "a", "b", "c"}
    kept = {r["word"] for r in V.vocab_cap(counts, 2).collect()}
    assert kept == {"</s>", "a"}


def test_split_simple_keeps_empty_and_tabs(spark):
    d = docs(spark, ["  a\tb  c \n"])
    got = [r["word"] for r in C.split_simple(d).orderBy("pos").collect()]
    assert got == ["a\tb", "", "c"]


def test_encode_renumbers_over_dropped_words(spark):
    d = docs(spark, ["k rare k k rare2 k"])
    t = C.tokenize(d)
    v = V.build_vocab(t, d, min_count=2)
    enc = C.encode_tokens(t, v).orderBy("pos").collect()
    assert [(r["pos"], r["idx"]) for r in enc] == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_segments_of_1000(spark):
    rows = [(0, i, 1, 10) for i in range(2500)]
    kept = spark.createDataFrame(rows, "doc_id long, pos long, idx long, cn long")
    assert C.segment(kept).select("seg").distinct().count() == 1
    seg = C.segment(kept, 1000).groupBy("seg").count().orderBy("seg").collect()
    assert [(r["seg"], r["count"]) for r in seg] == [(0, 1000), (1, 1000), (2, 500)]


def test_offsets_and_doc_at_offset(spark):
    d = docs(spark, ["ab", "", "cde"])
    offs = C.doc_offsets(d)
    got = [(r["doc_id"], r["start_off"], r["end_off"]) for r in offs.orderBy("doc_id").collect()]
    assert got == [(0, 0, 3), (1, 3, 4), (2, 4, 8)]
    pos = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 4), (4, 100), (5, -5)], "pos_id long, pos long")
    hit = {r["pos_id"]: r["doc_id"] for r in C.doc_at_offset(offs, pos, bucket_bytes=2).collect()}
    assert hit == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 0}


def test_skipgram_pairs_match_brute_force(spark):
    import random

    random.seed(3)
    rows = []
    for doc in range(3):
        for kpos in range(40):
            rows.append((doc, kpos // 15, kpos, random.randint(1, 9), random.randint(1, 4)))
    kept = spark.createDataFrame(rows, "doc_id long, seg int, kpos long, idx long, radius long")
    from sphaera.operators.pairs import skipgram_pairs

    got = sorted(tuple(r) for r in skipgram_pairs(kept, 4).select("doc_id", "kpos", "off", "ctx", "center").collect())
    want = []
    for (d, s, p, i, r) in rows:
        for (d2, s2, p2, i2, _) in rows:
            if d2 == d and s2 == s and p2 != p and abs(p2 - p) <= r:
                want.append((d, p, p2 - p, i, i2))
    assert got == sorted(want)
    assert F is not None


def test_skipgram_pairs_cross_block_edges(spark):
    import random

    random.seed(4)
    rows = [(7, 0, k, random.randint(1, 50), random.randint(1, 5)) for k in range(5000)]
    kept = spark.createDataFrame(rows, "doc_id long, seg int, kpos long, idx long, radius long")
    from sphaera.operators.pairs import skipgram_pairs

    for block in (64, 999):
        got = skipgram_pairs(kept, 5, block=block).select("kpos", "off", "ctx", "center").collect()
        want = [
            (k, o, i, rows[k + o][3]) for _, _, k, i, r in rows for o in range(-r, r + 1) if o and 0 <= k + o < len(rows)
        ]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_metrics_keep_the_null_language(spark, tmp_dir):
    from sphaera.plans.catalog import q_s13

    rows = [(0, "en", 5), (1, None, 7), (2, None, 1), (3, "fr", 2)]
    spark.createDataFrame(rows, "doc_id long, lang string, n_chars long").write.parquet(tmp_dir + "/documents.parquet")
    assert sorted(r.value for r in q_s13(spark, tmp_dir).collect()) == [",2,8", "en,1,5", "fr,1,2"]
