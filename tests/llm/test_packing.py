import itertools
import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sphaera.llm import packing, token_output
from sphaera.llm.tokens import default_tokenizer, token_bytes


def direct_ids(texts):
    tok = Tokenizer.from_file(default_tokenizer())
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fewest_bins(sizes, cap):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [cap - sizes[i]])

    go(0, [])
    return best if sizes else 0


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(5)
    tight = 0
    for _ in range(300):
        cap = rng.choice([10, 12, 30, 100])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 9))]
        kinds, n = np.unique(sizes, return_counts=True)
        bound, best = packing.lower_bound(kinds.astype(np.int64), n, cap), fewest_bins(sizes, cap)
        assert bound <= best
        tight += bound == best
    assert tight > 250


def test_bound_by_dual_feasible_functions():
    # three items over a third each: the volume alone would say 2
    assert packing.lower_bound(np.array([51]), np.array([4]), 100) == 4
    assert packing.lower_bound(np.array([34]), np.array([6]), 100) == 3
    assert packing.lower_bound(np.array([], int), np.array([], int), 100) == 0


def plain_best_fit(sizes, cap):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in range(len(rooms)) if rooms[r] >= s]
        if fit:
            j = min(fit, key=lambda r: rooms[r])
            rooms[j] -= s
        else:
            rooms.append(cap - s)
    return sorted(rooms)


def test_both_best_fit_searches_equal_the_plain_one():
    rng = random.Random(6)
    for _ in range(100):
        cap = rng.choice([7, 16, 100])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        want = plain_best_fit(sizes, cap)
        bins = packing.best_fit_decreasing(np.array(sizes, int), cap)
        fill = np.bincount(bins, weights=sizes).astype(int) if sizes else []
        assert sorted(cap - f for f in fill) == want
        tree = token_output.best_fit(sizes, cap)
        assert sorted(cap - sum(sizes[i] for i in b) for b in tree) == want
        assert sorted(itertools.chain(*tree)) == list(range(len(sizes)))


def test_words_give_the_ids_of_the_text(edge_rows, small_docs):
    texts = [r[1] for r in edge_rows] + [r.text for r in small_docs.collect()]
    rng = random.Random(1)
    signs = "abcXYZéÉßÿŸİKÅſœŁ'’.,;:!?\"()[]#$%&*+=/_-<>| \t\n\x1c\x85\u200b\u00a0​123½²\u0301\u0308ﬁ中あ🙂~^`s t re"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["a<|endoftext|>b", "(<|startoftext|>)", "can't we're I'd 's don'T", "x" * 500]
    for got, want in zip(token_bytes(texts, default_tokenizer()), direct_ids(texts)):
        assert got == np.array(want[:-1], "<u4").tobytes()


def test_long_texts_are_cut_at_blanks(monkeypatch, small_docs):
    from sphaera.llm import tokens

    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    texts = [r.text for r in small_docs.limit(20).collect()] + ["x" * 200 + " y " + "z" * 70, "a\n\n b " * 40]
    for got, want in zip(token_bytes(texts, default_tokenizer()), direct_ids(texts)):
        assert got == np.array(want[:-1], "<u4").tobytes()


def check_placed(got, rows, capacity):
    ids = {}
    for r, x in zip(rows, direct_ids([r[1] for r in rows])):
        ids.setdefault(r[0], []).append(x)
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append(r)
    assert set(whole) == set(ids)
    for i, parts in whole.items():
        want = sorted((s // capacity, s, min(capacity, len(x) - s), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes()))
                      for x in ids[i] for s in range(0, len(x), capacity))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_edge_rows(edge_docs, edge_rows, clashing_docs, no_docs):
    for cap, parts in [(4096, 8192), (64, 100)]:
        got = packing.pack_documents(edge_docs, capacity=cap, partition_pieces=parts).collect()
        n = check_placed(got, edge_rows, cap)
        assert n <= 1.01 * -(-sum(r.length for r in got) // cap)
    assert packing.pack_documents(clashing_docs).columns == packing.pack_documents(edge_docs).columns
    assert packing.pack_documents(clashing_docs).count() == packing.pack_documents(edge_docs).count()
    assert packing.pack_documents(no_docs).count() == 0


def test_documents_meet_the_bound(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = packing.pack_documents(small_docs, partition_pieces=100).collect()
    assert check_placed(got, rows, 4096) <= -(-sum(r.length for r in got) // 4096) + 1


def test_partitions_with_gaps_exchange(spark):
    rng = random.Random(2)
    sizes = [rng.randint(20, 70) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    one = int(packing.best_fit_decreasing(np.array(sizes), 100).max()) + 1
    got = packing.pack(df, 100, partition_pieces=100).join(df, "row").toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 100 and len(got) == 2000
    alone = sum(
        int(packing.best_fit_decreasing(np.array(p), 100).max()) + 1 for p in np.array_split(np.array(sizes), 20)
    )
    assert one - 2 <= len(fill) < alone


def test_sequences_hold_the_ids(edge_docs, edge_rows):
    seqs = packing.packed_sequences(edge_docs, capacity=128).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 128 for r in seqs)
    total = sum(len(x) for x in direct_ids([r[1] for r in edge_rows]))
    assert sum(len(r.ids) for r in seqs) == total


def test_token_matrix(edge_docs, edge_rows, clashing_docs, no_docs, tmp_path, spark):
    path = str(tmp_path / "matrix")
    token_output.write_token_matrix(edge_docs, path, sequence=64, shard_docs=16)
    rows = spark.read.parquet(path).collect()
    found = {}
    for r in rows:
        x = np.frombuffer(r.ids, "<u2")
        assert len(x) == 64 and not x[r.cu_seqlens[-1] :].any()
        assert r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1]
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            found.setdefault(d, []).append((p, x[a:b].tolist()))
    want = {}
    for r, x in zip(edge_rows, direct_ids([r[1] for r in edge_rows])):
        want.setdefault(r[0], []).extend((s // 64, x[s : s + 64]) for s in range(0, len(x), 64))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({(r.shard, r.row) for r in rows}) == len(rows) and len({r.shard for r in rows}) > 1
    assert token_output.token_matrix(clashing_docs).count() == token_output.token_matrix(edge_docs).count()
    assert token_output.token_matrix(no_docs).count() == 0


def test_piece_lengths_are_whole(edge_docs):
    p = packing.pieces(edge_docs, capacity=50).groupBy("doc_id").agg(F.max("piece"), F.sum("length")).toPandas()
    assert isinstance(p, pd.DataFrame) and (p["sum(length)"] >= 1).all()


def test_rounds_go_on_while_they_save(spark, monkeypatch):
    """Stand-in partitions: every round saves one bin more, ten in a row."""
    monkeypatch.setattr(packing, "lower_bound", lambda *_: 1)

    def saves_one(capacity, round_):
        def run(key, items):
            out = items[["row", "h", "length"]].copy()
            n = max(1, 12 - round_)
            out["round"], out["part"] = round_, key[0]
            out["bin"] = np.arange(len(out)) % n
            out["offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
            out["loose"], out["room"], out["bound"] = True, True, 1
            return out

        return run

    monkeypatch.setattr(packing, "_pack_part", saves_one)
    df = spark.createDataFrame([(i, 1) for i in range(24)], "row long, length long")
    got = packing.pack(df, 100).collect()
    assert len(got) == 24 and len({r.sequence_id for r in got}) == 1


def test_equal_rows_fill_no_shard(spark):
    df = spark.range(50_000).selectExpr("cast(7 as long) as doc_id", "'one two three' as text")
    n = token_output.token_matrix(df, sequence=64).groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert n[1] == 50_000 and n[0] < 5_500


def test_caches_are_empty_after_a_task(spark):
    from sphaera.llm import shingles, task_memory, tokens

    def used(batches):
        for b in batches:
            tokens.token_bytes(["some words"], tokens.default_tokenizer())
            shingles.shingles("some words")
            assert tokens._encoder.cache_info().currsize == 1 and shingles._hashes
            yield b

    for run in (used, lambda b: (x for x in used(b)).throw(ValueError)):
        task = task_memory.bounded(run, tokens.forget, shingles.forget)
        try:
            assert list(task(iter([1]))) == [1]
        except ValueError:
            pass
        assert tokens._encoder.cache_info().currsize == 0 and not shingles._hashes


def test_known_runs_keep_their_ids_when_slots_are_taken_over():
    from sphaera.llm import tokens


    path = tokens.default_tokenizer()
    tok, enc = Tokenizer.from_file(path), tokens._Encoder(path)
    enc.known = tokens._Known(enc.merges.largest_id, bits=3)  # eight slots
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(1, 25, 60)]
    for _ in range(12):
        texts = [" ".join(rng.choice(words, 20)) for _ in range(3)]
        got = [np.frombuffer(x, "<u4").tolist() for x in enc(texts)]
        assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
