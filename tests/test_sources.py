"""Round trips and format edge cases of the sources and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from sphaera.sources import benchmarks_io as B
from sphaera.sources import corpus_io, embedding_io, labels_io, vocab_io
from sphaera.sources.lines import read_numbered_lines


def write(path, name, data: bytes):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as f:
        f.write(data)


def test_corpus_lines_numbered_across_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "corpus")
    write(d, "a.txt", b"first line\n\nthird\r\n")
    write(d, "b.txt", b"fourth\nlast without newline")
    got = [(r["doc_id"], r["text"]) for r in corpus_io.read_corpus(spark, d).orderBy("doc_id").collect()]
    assert got == [(0, "first line"), (1, ""), (2, "third\r"), (3, "fourth"), (4, "last without newline")]


def test_big_file_numbering_is_dense(spark, tmp_dir):
    d = os.path.join(tmp_dir, "big")
    write(d, "x.txt", "".join(f"line {i}\n" for i in range(200000)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_numbered_lines(spark, d)
        bad = df.filter(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count()
        assert df.rdd.getNumPartitions() > 4 and bad == 0 and df.count() == 200000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vocab_round_trip(spark, tmp_dir):
    v = spark.createDataFrame([(0, "</s>", 7), (1, "b", 5), (2, "a", 5)], "idx long, word string, cn long")
    path = os.path.join(tmp_dir, "vocab")
    vocab_io.write_vocab(v, path)
    back = sorted((r["word"], r["cn"]) for r in vocab_io.read_vocab(spark, path).collect())
    assert back == [("</s>", 7), ("a", 5), ("b", 5)]


def test_embedding_text_round_trip_last_wins_and_dim(spark, tmp_dir):
    e = spark.createDataFrame([(0, "x", [0.5, -0.25]), (1, "y", [1.0, 0.0])], "id long, key string, vec array<float>")
    lines = [r["value"] for r in embedding_io.embedding_lines(e, "key", "id", 2).orderBy("line_no").collect()]
    assert lines == ["2 2", "x 0.500000 -0.250000 ", "y 1.000000 0.000000 "]
    d = os.path.join(tmp_dir, "emb")
    write(d, "e.txt", b"3 2\nx 0.5 -0.25 \ny 1 0 \nx 2 3 \n")
    got = {r["key"]: r["vec"] for r in embedding_io.read_word_embeddings(spark, d, 2).collect()}
    assert got == {"x": [2.0, 3.0], "y": [1.0, 0.0]}
    write(d, "e.txt", b"1 2\nx 0.5 -0.25 0.1 \n")
    with pytest.raises(Exception):
        embedding_io.read_word_embeddings(spark, d, 2).collect()


def test_doc_embeddings_by_position(spark, tmp_dir):
    d = os.path.join(tmp_dir, "doc")
    write(d, "d.txt", b"2 2\n7 0.1 0.2 \n3 0.3 0.4 \n")
    got = {r["doc_id"]: r["vec"] for r in embedding_io.read_doc_embeddings(spark, d).collect()}
    assert got == {0: [0.1, 0.2], 1: [0.3, 0.4]}


def test_pretrained_pair_and_dim_check(spark, tmp_dir):
    pre = os.path.join(tmp_dir, "pre")
    write(tmp_dir, "pre_w.txt", b"1 2\nx 0.1 0.2 \n")
    write(tmp_dir, "pre_v.txt", b"1 2\nx 0.3 0.4 \n")
    w, v = embedding_io.read_pretrained(spark, pre, 2)
    assert w.collect()[0]["vec"] == [0.1, 0.2] and v.collect()[0]["vec"] == [0.3, 0.4]
    with pytest.raises(ValueError):
        embedding_io.read_pretrained(spark, pre, 3)


def test_labels(spark, tmp_dir):
    d = os.path.join(tmp_dir, "lab")
    write(d, "label.txt", b" 3 \n1\n2\n")
    got = [(r["doc_id"], r["label"]) for r in labels_io.read_labels(spark, d).orderBy("doc_id").collect()]
    assert got == [(0, 2), (1, 0), (2, 1)]


def test_wordsim_csv(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ws")
    write(d, "combined.csv", b"Word 1,Word 2,Human (mean)\r\nMoney,cash,9.15\r\nbank,money,8.5\r\nmoney,bank,8.0\r\n"
          b"money,cash,9.08\r\n")
    got = sorted(tuple(r) for r in B.read_pairs(spark, d, "wordsim353").select("w1", "w2", "score").collect())
    assert got == [("bank", "money", 8.5), ("money", "bank", 8.0), ("money", "cash", 9.08)]


def test_men_and_simlex(spark, tmp_dir):
    d = os.path.join(tmp_dir, "men")
    write(d, "men.txt", b"sun sunlight 50.000000\nbad line here 3\nCar automobile 40\n")
    got = sorted(tuple(r) for r in B.read_pairs(spark, d, "men").select("w1", "w2", "score").collect())
    assert got == [("car", "automobile", 40.0), ("sun", "sunlight", 50.0)]
    s = os.path.join(tmp_dir, "simlex")
    head = "\t".join(["word1", "word2", "POS", "SimLex999", "c1", "c2", "cq", "a", "s", "sd"])
    row = "\t".join(["Old", "new", "A", "1.58", "2.72", "2.81", "2", "7.25", "1", "0.41"])
    write(s, "simlex.txt", (head + "\n" + row + "\nshort\tline\n").encode())
    got = [tuple(r) for r in B.read_pairs(spark, s, "simlex").select("w1", "w2", "score").collect()]
    assert got == [("old", "new", 1.58)]


def test_append_metrics(spark, tmp_dir):
    path = os.path.join(tmp_dir, "metrics")
    row = spark.createDataFrame([(0.5, 0.25)], "mi double, nmi double")
    labels_io.append_metrics(row, path)
    labels_io.append_metrics(row, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ["0.5,0.25", "0.5,0.25"]
