"""The registered data sources against plain reading and the Spark-only form."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from sphaera.sources import text_source as S
from sphaera.sources.lines import read_numbered_lines


def write(path, name, data: bytes):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "wb") as f:
        f.write(data)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 20])
def test_ranges_own_every_line_once(monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randint(0, 40)))
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for size in (1, 2, 5, 11, 100):
            got = [x for a in range(0, len(data), size) for ls in S.owned_lines(io.BytesIO(data), a, min(a + size, len(data))) for x in ls]
            assert got == want, (data, size)


def test_lines_equal_spark_reading(spark, tmp_dir):
    d = os.path.join(tmp_dir, "t")
    write(d, "a.txt", b"first line\n\nthird\r\n")
    write(d, "b.txt", "vierte Zeile äöü\nlast without newline".encode())
    write(d, "c.txt", b"")
    write(d, "_SUCCESS", b"no line\n")
    want = sorted(tuple(r) for r in read_numbered_lines(spark, d).select("line_no", "value").collect())
    for size in (5, 1 << 20):
        assert sorted(tuple(r) for r in S.read_lines(spark, d, size).collect()) == want


def test_lines_round_trip(spark, tmp_dir):
    d = os.path.join(tmp_dir, "r")
    df = spark.range(5000).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).repartition(7)
    S.write_lines(df, ["id"], d)
    back = S.read_lines(spark, d, 1000)
    assert back.count() == 5000
    assert back.filter(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
    assert not [f for f in os.listdir(d) if f.startswith("_pending")]
    S.write_lines(df.filter("id < 3"), ["id"], d)  # overwrites
    assert sorted(r.value for r in S.read_lines(spark, d).collect()) == ["line 0", "line 1", "line 2"]
    with pytest.raises(Exception, match="line feed"):
        S.write_lines(spark.createDataFrame([(1, "a\nb")], "id long, value string"), ["id"], os.path.join(tmp_dir, "bad"))


def test_vectors_round_trip(spark, tmp_dir):
    d = os.path.join(tmp_dir, "v")
    rows = [(i, f"w{i}é", [i / 7, -i / 3]) for i in range(300)]
    e = spark.createDataFrame(rows, "id long, key string, vec array<double>").repartition(5)
    S.write_vectors(e, "key", "id", 2, d)
    assert S.vector_header(d) == (300, 2) and S.check_rows(spark, d) == 300
    text = b"".join(open(os.path.join(d, f), "rb").read() for f in sorted(os.listdir(d)) if f[0] not in "_.").decode()
    assert text.startswith("300 2\nw0é 0.000000 0.000000 \nw1é 0.142857 -0.333333 \n")
    for size in (100, 1 << 20):
        got = {r.key: r.vec for r in S.read_vectors(spark, d, size).collect()}
        assert got == {k: [round(x, 6) for x in v] for _, k, v in rows}
        byplace = {r.doc_id: r.vec for r in S.read_doc_vectors(spark, d, size).collect()}
        assert byplace == {i: [round(x, 6) for x in v] for i, _, v in rows}


def test_vectors_of_a_plain_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "p")
    write(d, "e.txt", b"3 2\nx 0.5 -0.25 \nb\xffad 1 0 \nx 2 3 \n")
    assert {r.key: r.vec for r in S.read_vectors(spark, d, 4).collect()} == {"x": [2.0, 3.0], "bad": [1.0, 0.0]}
    write(d, "e.txt", b"5 2\nx 0.5 -0.25 \n")
    with pytest.raises(ValueError, match="names 5 rows"):
        S.check_rows(spark, d)
    write(d, "e.txt", b"1 2\nx 0.5 \n")
    with pytest.raises(Exception, match="expected vectors of 2"):
        S.read_vectors(spark, d).collect()
    write(d, "e.txt", b"x 0.5\n")
    with pytest.raises(Exception, match="no header"):
        S.read_vectors(spark, d).collect()


def test_empty_tables(spark, tmp_dir):
    d, e = os.path.join(tmp_dir, "l"), os.path.join(tmp_dir, "v")
    S.write_lines(spark.createDataFrame([], "id long, value string"), ["id"], d)
    S.write_vectors(spark.createDataFrame([], "id long, key string, vec array<double>"), "key", "id", 3, e)
    assert S.read_lines(spark, d).count() == 0
    assert S.vector_header(e) == (0, 3) and S.read_vectors(spark, e).count() == 0 and S.check_rows(spark, e) == 0


def test_a_failed_write_leaves_the_old_rows(spark, tmp_dir):
    d = os.path.join(tmp_dir, "f")
    good = spark.createDataFrame([(0, "x", [1.0])], "id long, key string, vec array<double>")
    S.write_vectors(good, "key", "id", 1, d)
    with pytest.raises(Exception, match="expected vectors of 1"):
        S.write_vectors(good.unionByName(spark.createDataFrame([(1, "y", [1.0, 2.0])], good.schema)), "key", "id", 1, d)
    assert [tuple(r) for r in S.read_vectors(spark, d).collect()] == [("x", [1.0])]
    with pytest.raises(Exception, match="appending"):
        good.select("key", "vec").write.format("sphaera_vectors").option("dim", 1).mode("append").save(d)
    assert S.check_rows(spark, d) == 1
