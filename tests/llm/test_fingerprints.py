import hashlib

import numpy as np

from sphaera.llm import fingerprints as fp
from sphaera.llm.shingles import shingles


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (ident, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        f = [fp.fingerprint(shingles(x)) for x in (t, e, nxt)]
        out[ident] = (len(t), hashlib.sha256(e.encode()).hexdigest(), f[0].hex(), f[1].hex(), fp.likeness(f[0], f[1]), fp.likeness(f[0], f[2]))
    return out


def got(df):
    rows = fp.fingerprint_edits(df).collect()
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows}, len(rows)


def test_neighbours_over_partitions(spark, edge_rows, small_docs):
    rows = list({r[0]: r[:2] for r in edge_rows if r[0] is not None}.values())
    for n in (1, 3, 9):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert got(df) == (brute(rows), len(rows))
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert got(small_docs)[0] == brute(rows)


def test_edge_rows(edge_docs, clashing_docs, no_docs, spark):
    assert fp.fingerprint_edits(edge_docs).count() == edge_docs.count()
    assert sorted(map(repr, fp.fingerprint_edits(clashing_docs).collect())) == sorted(map(repr, fp.fingerprint_edits(edge_docs).collect()))
    assert fp.fingerprint_edits(no_docs).count() == 0
    one, n = got(spark.createDataFrame([(5, "abc def")], "doc_id long, text string"))
    assert n == 1 and one[5][0] == 7 and one[5][5] == 1.0


def test_equal_texts_and_plain_form(edge_docs):
    rows = fp.fingerprint_documents(edge_docs).join(edge_docs.select("doc_id", "text"), "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert by[""] == {""}


def test_likeness_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.6, 0.9):
        err = []
        for n in (40, 300, 3000):
            for _ in range(10):
                a = rng.integers(0, 2**64, n, dtype=np.uint64)
                b = a.copy()
                k = int(n * (1 - share) / (1 + share))
                b[:k] = rng.integers(0, 2**64, k, dtype=np.uint64)
                true = (n - k) / (n + k)
                err.append(fp.likeness(fp.fingerprint(np.unique(a)), fp.fingerprint(np.unique(b))) - true)
        assert abs(np.mean(err)) < 0.05 and np.max(np.abs(err)) < 0.3


def test_size_and_densification():
    assert fp.fingerprint(np.empty(0, np.uint64)) == b""
    assert len(fp.fingerprint(np.array([5], np.uint64))) == fp.BINS * fp.BITS // 8
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", fp.fingerprint(np.array([1], np.uint64))) == 0.0
