"""The streaming count equals the batch count over the same corpus parts."""

import os

from conftest import SF_SMALL
from sphaera.operators import corpus as C
from sphaera.operators import vocab as V
from sphaera.session import load
from sphaera.streaming.vocab_stream import start_vocab_stream


def test_stream_counts_equal_batch(spark, tmp_dir):
    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text")
    src = os.path.join(tmp_dir, "src")
    docs.filter("doc_id < 100").write.parquet(os.path.join(src, "part1"))
    latest = {}

    def sink(df, _bid):
        for r in df.collect():
            latest[r["word"]] = r["cn"]

    q = start_vocab_stream(spark, os.path.join(src, "*"), os.path.join(tmp_dir, "ck"), sink)
    q.awaitTermination()
    docs.filter("doc_id >= 100").write.parquet(os.path.join(src, "part2"))
    q = start_vocab_stream(spark, os.path.join(src, "*"), os.path.join(tmp_dir, "ck"), sink)
    q.awaitTermination()
    want = {r["word"]: r["cn"] for r in V.word_count(C.tokenize(docs), docs).collect()}
    assert latest == want


def test_vocabulary_state_ignores_what_it_has_seen(spark, tmp_dir):
    """Parts replayed, reordered and overlapping give the batch vocabulary."""
    from sphaera.streaming.vocab_state import VocabularyState, start_vocabulary_stream

    docs = load(spark, SF_SMALL, "documents").select("doc_id", "text").filter("doc_id < 120")
    key = lambda v: sorted((r["idx"], r["word"], r["cn"]) for r in v.collect())
    parts = {"a": "doc_id < 60", "b": "doc_id >= 40 AND doc_id < 90", "c": "doc_id % 3 = 0 OR doc_id >= 80"}
    for order in ("abca", "ccab"):
        state = VocabularyState(spark, f"{tmp_dir}/{order}")
        for p in order:
            batch = docs.filter(parts[p])
            fresh = all(e["part"] != p for e in state.log.entries())
            assert state.add(batch.unionByName(batch.limit(5)), p) == fresh
        for least in (1, 3):
            assert key(state.vocab(least)) == key(V.vocab_index(V.min_count_filter(V.word_count(C.tokenize(docs), docs), least)))
    assert len([t for t in state.log.tables() if t.startswith("words")]) == 2

    src = os.path.join(tmp_dir, "src")
    state = VocabularyState(spark, f"{tmp_dir}/stream")
    for i, p in enumerate("ab"):
        docs.filter(parts[p]).write.parquet(os.path.join(src, f"part{i}"))
        start_vocabulary_stream(state, os.path.join(src, "*"), os.path.join(tmp_dir, "ck"), True).awaitTermination()
    half = docs.filter("doc_id < 90")
    assert key(state.vocab()) == key(V.vocab_index(V.word_count(C.tokenize(half), half)))
