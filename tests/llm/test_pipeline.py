from collections import Counter

import pytest

import corpus_pipeline
from sphaera.llm.exact_dedup import exact_dedup
from sphaera.llm.mixing import mix
from sphaera.session import write_cut

from conftest import SF_SMALL
from llm.test_near_dedup import brute
from llm.test_packing import check_placed


@pytest.fixture(scope="module")
def stages(spark, small_docs):
    docs, out = small_docs, [small_docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = write_cut(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append(docs)
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in df.collect()} for df in stages[:2])
    assert after <= before and len(after) > 0.97 * len(before)


def test_exact_copies_go(stages):
    kept = Counter(r.text for r in stages[2].collect())
    first = {}
    for r in stages[1].collect():
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    assert set(kept.values()) == {1}
    assert {(r.doc_id, r.text) for r in stages[2].collect()} == {(i, t) for t, i in first.items()}
    assert exact_dedup(stages[2]).filter("not kept").count() == 0


def test_near_copies_go(stages):
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in stages[2].collect()], 80) if i == c}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mix_takes_effect(stages):
    taken = {r.doc_id: r.taken for r in mix(stages[3]).collect()}
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.split())
    assert sum(got.values()) == sum(taken.values())


def test_packing_is_of_the_mix(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    n = check_placed(stages[5].collect(), rows, 4096)
    assert n <= -(-sum(r.length for r in stages[5].collect()) // 4096) + 1


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF_SMALL).count() == stages[5].count()


def through(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(write_cut(stage(spark, out[-1], SF_SMALL), f"edge-{name}"))
    return out


def test_nulls_repeats_and_clashing_names(spark, edge_docs, clashing_docs):
    """Both tables pass every stage; of equal texts and of every near family
    one row stays, whatever its identifier, and what is kept does not depend
    on extra columns."""
    plain, clash = through(spark, edge_docs), through(spark, clashing_docs)
    for got, first in ((plain, edge_docs), (clash, clashing_docs)):
        assert all(df.columns == first.columns for df in got[1:-1])
        texts = [[r.text for r in df.select("text").collect()] for df in got[:4]]
        assert set(texts[1]) <= set(texts[0]) and None not in texts[1] and "" not in texts[1]
        assert sorted(texts[2]) == sorted(set(texts[1]))
        group = {texts[2][i]: c for i, _, c in brute(list(enumerate(texts[2])), 80)}
        assert sorted(group[t] for t in texts[3]) == sorted(set(group.values()))
        bins = {}
        for r in got[5].collect():
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 4096
        ids = {r.doc_id for r in got[4].select("doc_id").collect()}
        assert {r.doc_id for r in got[5].select("doc_id").collect()} == ids
    for a, b in zip(plain[1:4], clash[1:4]):
        key = lambda df: sorted((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())
        assert key(a) == key(b)


def test_empty_table(spark, no_docs):
    got = through(spark, no_docs)
    assert [df.count() for df in got] == [0] * 6
    assert all(df.columns == no_docs.columns for df in got[:-1])
