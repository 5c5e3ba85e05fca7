import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sphaera.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_equals_brute_force(edge_docs, edge_rows, keep, best):
    got = exact_dedup(edge_docs, keep=keep).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(edge_rows, best)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_clashing_names_and_empty(clashing_docs, edge_docs, no_docs):
    assert sorted(map(repr, exact_dedup(clashing_docs).collect())) == sorted(map(repr, exact_dedup(edge_docs).collect()))
    assert exact_dedup(no_docs).count() == 0
    assert drop_exact_copies(no_docs).count() == 0


def test_rows_that_stay(clashing_docs, edge_rows):
    got = drop_exact_copies(clashing_docs)
    assert got.columns == clashing_docs.columns
    rows = got.collect()
    assert len(rows) == len({r[1] or "" for r in edge_rows})
    want = {(k, t) for t, k in {(h[3], h[1]) for h in brute(edge_rows, min)}}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows} == want


def test_hot_group_is_split_and_normaliser(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot copy")).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    got = exact_dedup(df, normalise=F.lower).filter("text_sha256 = sha2('hot copy', 256)").collect()
    assert len(got) == 1000 and {r.group_size for r in got} == {1000} and {r.keep_id for r in got} == {0}
    assert sum(r.kept for r in got) == 1


def test_bad_option(edge_docs):
    with pytest.raises(ValueError):
        exact_dedup(edge_docs, keep="any")
