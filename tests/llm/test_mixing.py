import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sphaera.llm import mixing


def targets(sizes, share=1.5, most=2.0):
    """sizes: source -> words. The rule, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), [s for s in order if sizes[s]], {s: 0.0 for s in order}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df, rows, **options):
    got = mixing.mix(df, **options).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    want = targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n_words(r[1])) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, round(r.target, 6))].append(r)
    for s, n in sizes.items():
        assert (n, round(want[s], 6)) in by
    for (size, target), part in by.items():
        same = [s for s in sizes if (sizes[s], round(want[s], 6)) == (size, target)]
        assert abs(sum(r.taken for r in part) - sum(want[s] for s in same)) <= len(same)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    return got


@pytest.mark.parametrize("block", [4, 256])
def test_edge_rows(edge_docs, edge_rows, block):
    check(edge_docs, edge_rows, block_words=block)


def test_documents_and_rerun(small_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in small_docs.collect()]
    a = check(small_docs, rows)
    b = mixing.mix(small_docs.repartition(3)).collect()
    assert sorted(a) == sorted(b)


def test_source_targets(spark):
    for sizes in [{"a": 10, "b": 1000, "c": 5}, {"x": 7}, {"a": 0, None: 0}, {"a": 1, "b": 1, "c": 1, "d": 10**9, None: 3}, {}]:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_permutation_is_one(spark):
    for n in [1, 2, 3, 5, 10, 97, 1000]:
        p = spark.range(n).select(mixing._permute(F.col("id"), F.lit(n), F.lit(1), F.lit(2)).alias("p")).collect()
        assert sorted(r.p for r in p) == list(range(n))


def test_mixed_documents_hold_the_words_taken(clashing_docs, edge_docs, edge_rows):
    mixed = mixing.mix_documents(clashing_docs, block_words=8)
    assert mixed.columns == clashing_docs.columns
    rows = mixed.collect()
    taken = sum(r.taken for r in mixing.mix(edge_docs, block_words=8).collect())
    assert sum(n_words(r.text) for r in rows) == taken
    texts = Counter(r[0] for r in edge_rows)
    for r in rows:
        assert r.n_chars == len(r.text)
        own = [x[1] for x in edge_rows if x[0] == r.doc_id and x[1]]
        assert any(set(r.text.split(" ")) - {""} <= set(re.split(" ", x)) | set(r.text.split()) for x in own)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2 * max(texts.values())


def test_blocks_fill_their_slots(edge_docs):
    m = mixing.mixed_blocks(edge_docs, block_words=16, shard_slots=8).collect()
    slots = defaultdict(list)
    for r in m:
        slots[(r.src, r.slot)].append((r.at, r.words, r.shard))
    for parts in slots.values():
        assert len({s for _, _, s in parts}) == 1
        at = 0
        for a, n, _ in sorted(parts):
            assert a == at
            at += n
        assert at <= 16
    assert len({s for p in slots.values() for _, _, s in p}) > 1


def test_empty_and_clashing(no_docs, clashing_docs, edge_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix_documents(no_docs).count() == 0
    assert sorted(map(repr, mixing.mix(clashing_docs).collect())) == sorted(map(repr, mixing.mix(edge_docs).collect()))


def test_mix_holds_the_drawn_shards(edge_docs):
    options = dict(block_words=16, shard_slots=8)
    want, got = Counter(), Counter()
    for r in mixing.mixed_blocks(edge_docs, **options).collect():
        want[(r.doc_id, r.shard)] += r.words
    for r in mixing.mix(edge_docs, **options).collect():
        parts = [tuple(map(int, x.split(":"))) for x in r.shards.split(",") if x]
        assert parts == sorted(parts) and sum(n for _, n in parts) == r.taken
        for shard, n in parts:
            got[(r.doc_id, shard)] += n
    assert got == want and len({s for _, s in got}) > 1


def test_rows_that_differ_in_any_column_stay_apart(spark):
    """Same identifier and text under two sources, and a row three times."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "s0"), (1, text, "s1"), (2, "a b c d", "s0"), (3, "x y z", None)] + [(4, "p q r s t u", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    options = dict(block_words=4, shard_slots=3)
    taken = Counter()
    for r in mixing.mix(df, **options).collect():
        taken[r.doc_id, r.target] += r.taken
    got = Counter()
    targets_ = {s: t for s, t in targets({"s0": 44, "s1": 58, None: 3}).items()}
    for r in mixing.mix_documents(df, **options).collect():
        assert (r.doc_id, r.source) in {(i, s) for i, _, s in rows}
        got[r.doc_id, targets_[r.source]] += n_words(r.text)
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
    assert {s for (i, s) in {(r.doc_id, r.source) for r in mixing.mix_documents(df, **options).collect()} if i == 1} == {"s0", "s1"}
    again = sorted(map(repr, mixing.mix(df.repartition(5), **options).collect()))
    assert again == sorted(map(repr, mixing.mix(df, **options).collect()))


def test_copies_of_one_row_are_spread(spark):
    df = spark.range(30000).selectExpr("null as doc_id", "'a b c' as text", "'s' as source")
    rows = mixing.mix(df.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.count(F.lit(1)), F.sum("taken"), F.max("taken")).first()
    assert tuple(rows) == (30000, 135000, 6)
