import random

import pytest

CLASHES = (
    "id t h th key cls u v n row part shard src off size chunk lead round bin family lo hi own keep_id group_size "
    "component_id spans fingerprint fp target taken edge piece start length c_source __dd_id mx_id nd_id base_sha256"
).split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, lang="en"):
    parts = {"en": "the and ing tion of ly er th", "de": "sch ung keit der ver en ge ach", "fr": "eau que ment les oi ère re aux"}[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows():
    rng = random.Random(4)
    long = sentence(rng, 6000)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "a", "A", "one two three four", "one  two\nthree four", "ONE two three four", long, base, base, base + " ",
        " ".join(near), " ".join(near[:-1]), "Ünï çôdé 🙂 ́x ﬁ K ſ", "nul\x00 byte and \x1c odd \x85 space here",
        "<|endoftext|> token = \"abcdefgh12345678\" x", "1234 5678", "ab\x0bcd\x0cef\rgh",
    ]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["s1", "s0", None, "ß"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated rows
    rows += [(None, base, "en", "s1", None), (None, "no identifier", None, None, None), (None, None, None, None, None)]
    rows += [(1000 + i, sentence(rng, 5 + 9 * i, ["en", "de", "fr"][i % 3]), ["en", "de", "fr"][i % 3], "s1", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge_rows():
    return make_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(edge_rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def clashing_docs(spark, edge_docs):
    """The same rows with extra columns named like internal ones."""
    from pyspark.sql import functions as F

    return edge_docs.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
