import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.llm import bpe_stream as B
from sphaera.llm.tokens import default_tokenizer, token_bytes


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(default_tokenizer())


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def other(t):
    return t.translate(str.maketrans("ab", "ba"))


LONG = [
    "x" * 20000, "ab" * 9000, "!?" * 9000 + "'s", "'" * 5000 + "s", "x'" * 20000, "привет мир " * 2000, "привет" * 9000, "漢字" * 9000,
    "é" + "é" * 9000, "각" * 9000, thue_morse(50000),
]
ODD = [
    "Ünï çôdé 🙂 ́x ﬁ K ſ", "<|endoftext|> token's don't '''s 'r 're 'rev !'s", "İstanbul ΣΑΣ ΑΣ", "à́b",
    "<|startoftext|><|endoftext|>a", "nul\x00 byte and \x1c odd \x85 space", "",
]


def ids_of(encoder, texts):
    out = [[] for _ in texts]
    for rows, ids, ends in encoder(texts):
        lo = 0
        for i, hi in zip(rows, ends):
            out[i] += ids[lo:hi].tolist()
            lo = hi
    return out


def library(encoder, texts):
    return [e.ids for e in encoder.rules.tok.encode_batch(texts, add_special_tokens=False)]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "b", "'", " ", "s", "re", "l", "!", "1", "é", "Я", "é", "漢", "́", "ß", "<|endoftext|>", "_", "-", "th", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(n)]


@pytest.mark.parametrize("piece,block", [(1 << 16, 4096), (50, 10), (7, 10)])
def test_ids_equal_the_library(encoder, monkeypatch, piece, block):
    monkeypatch.setattr(B, "PIECE", piece)
    monkeypatch.setattr(B, "BLOCK", block)
    texts = ODD + random_texts(100) + [t if piece > 50 else t[:3000] for t in LONG]
    assert ids_of(encoder, texts) == library(encoder, texts)


def test_lookahead_bounds_every_change(encoder):
    """Tokens that end before the lookahead stay whatever follows, and the
    bound is not far from what happens."""
    rules, rng, worst = encoder.rules, random.Random(1), 0
    vocabulary = [n.removesuffix("</w>") for n in rules.names if n.isalpha()]
    for _ in range(1500):
        raw = "".join(rng.choice(vocabulary) for _ in range(150)).encode()[:300]
        cut = rng.randint(200, len(raw))
        ends = []
        for w in (raw[:cut], raw):
            e, at = set(), 0
            for i in rules.merge([rules.inner[b] for b in w]):
                at += rules.width[i]
                e.add(at)
            ends.append(e)
        common = max((x for x in ends[0] & ends[1] if x <= cut), default=0)
        assert {x for x in ends[0] if x <= common} == {x for x in ends[1] if x <= common}
        worst = max(worst, cut - common)
    assert 0 < worst <= rules.lookahead < 400


def test_lookahead_of_small_lists():
    assert B.sufficient_lookahead([("a", "b")]) == 1
    # b|c takes a border, then a|bc the one before it
    assert B.sufficient_lookahead([("b", "c"), ("a", "bc")]) == 2
    # a|b comes first, so a|bc never moves the border that b|c moved
    assert B.sufficient_lookahead([("a", "b"), ("c", "d")]) == 1
    with pytest.raises(ValueError):
        B.sufficient_lookahead([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        B.sufficient_lookahead([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_a_run_holds_a_block_only(encoder):
    run = B.Run(encoder.rules)
    text = thue_morse(300_000).encode()
    ids = []
    for lo in range(0, len(text), 1000):
        ids += run.feed(text[lo : lo + 1000])
        assert len(run.held) <= run.block + 1000
    assert ids + run.close() == library(encoder, [text.decode()])[0]


def test_decoding_in_chunks(encoder):
    d = B.Decoder(encoder.rules)
    for t, ids in zip(ODD, ids_of(encoder, ODD)):
        d.reset()
        got = "".join(d.feed(np.array([i])) for i in ids) + d.feed(np.zeros(0, np.int64), True)
        assert got == encoder.rules.tok.decode(ids, skip_special_tokens=False)


def test_words_round_trip(spark, encoder):
    texts = ["Hello world 12", "añb ünï 🙂", None, "", "one " * 60000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    enc = B.encode_documents(df)
    assert enc.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1
    back = {}
    for r in sorted(B.decode_documents(enc).collect(), key=lambda r: (r.doc_id, r.chunk)):
        back[r.doc_id] = back.get(r.doc_id, "") + r.text
    assert back[0] == "hello world 1 2 " and back[1] == "añb ünï 🙂 " and back[2] == back[3] == ""
    assert back[4] == "one " * 60000


def test_digests_on_odd_tables(spark, encoder, edge_docs, clashing_docs, no_docs, edge_rows):
    tok = encoder.rules.tok

    def want(t):
        e = tok.encode(t or "", add_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(e.ids), sha(" ".join(map(str, e.ids))), sha(tok.decode(e.ids, skip_special_tokens=False))

    key = lambda r: tuple(map(repr, r))
    expected = sorted(((r[0], *want(r[1])) for r in edge_rows), key=key)
    assert sorted(map(tuple, B.token_digests(edge_docs).collect()), key=key) == expected
    assert sorted(map(tuple, B.token_digests(clashing_docs).collect()), key=key) == expected
    assert B.token_digests(no_docs).count() == 0


def test_equal_hashes_are_compared(encoder):
    """Runs whose polynomial hashes modulo 2^64 agree."""
    for n in (512, 1024, 2048, 4096):
        t = thue_morse(n) + " " + other(thue_morse(n))
        assert np.frombuffer(token_bytes([t], default_tokenizer())[0], "<u4").tolist() == library(encoder, [t])[0]
