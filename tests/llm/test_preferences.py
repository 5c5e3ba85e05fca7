from sphaera.llm import preferences as pf

SCHEMA = "pair long, side string, turn long, role string, text string, part string, place string, first string, p string"


def rows(pair, side, turns):
    return [(pair, side, i, r, t, "x", "x", "x", "x") for i, (r, t) in enumerate(turns)]


def render(turns):
    return "".join(f"<|{r or 'user'}|>\n{t or ''}<|end|>\n" for r, t in turns)


PAIRS = {
    1: ([("user", "hi"), ("assistant", "good"), ("user", "more")], [("user", "hi"), ("assistant", "bad")]),
    2: ([("user", "same"), ("assistant", "x")], [("user", "same"), ("assistant", "x")]),
    3: ([("system", None), (None, "q"), ("assistant", "a")], [("system", ""), ("user", "q"), ("assistant", "b"), ("assistant", "c")]),
    4: ([("user", "only chosen")], []),
    5: ([("user", "a"), ("assistant", "x")], [("user", "b"), ("assistant", "x")]),
    6: ([("user", "long " * 5000)] + [("assistant", str(i)) for i in range(300)], [("user", "long " * 5000)] + [("assistant", str(i)) for i in range(299)]),
}


def test_pairs(spark):
    data = [x for p, (a, b) in PAIRS.items() for x in rows(p, "chosen", a) + rows(p, "rejected", b)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.pair: r for r in pf.preference_examples(df).collect()}
    for p, (a, b) in PAIRS.items():
        clean = [[(r or "user", t or "") for r, t in x] for x in (a, b)]
        n = 0
        while n < min(map(len, clean)) and clean[0][n] == clean[1][n]:
            n += 1
        assert got[p].prompt == render(clean[0][:n])
        for text, spans, side in ((got[p].chosen, got[p].chosen_train, clean[0]), (got[p].rejected, got[p].rejected_train, clean[1])):
            assert text == render(side[n:])
            assert [text[s.start : s.end] for s in spans] == [render([x]) for x in side[n:] if x[0] == "assistant"]


def test_ties_nulls_and_empty(spark):
    data = [(None, s, None, "user", t, "", "", "", "") for s in ("chosen", "rejected") for t in ("b", "a", "a")]
    data += [(None, "rejected", 1, "assistant", "z", "", "", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    r = pf.preference_examples(df).collect()
    assert len(r) == 1 and r[0].pair is None
    assert r[0].prompt == render([("user", "a"), ("user", "a"), ("user", "b")])
    assert r[0].chosen == "" and r[0].rejected == render([("assistant", "z")])
    assert pf.preference_turns(df.limit(0)).count() == 0


def test_pairs_from_conversations(spark):
    data = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"),
            (2, 0, "user", "no answer"), (None, 0, "assistant", "x"), (5, None, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.pair: r for r in pf.preference_examples(pf.pairs_from_conversations(df)).collect()}
    assert set(got) == {0, 1}
    assert got[0].prompt == render([("user", "q")])
    assert got[0].chosen == render([("assistant", "a0")]) and got[0].rejected == render([("assistant", "a1")])
    assert got[1].rejected == render([("assistant", "")])


def test_next_conversation_across_gaps(spark):
    data = [(i, j, r, f"{r} {i}") for i in (10, 30, 31, 100, 2000) for j, r in enumerate(("user", "assistant"))]
    data += [(500, 0, "user", "no answer"), (30, None, "user", "no number")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.pair: r.rejected for r in pf.preference_examples(pf.pairs_from_conversations(df)).collect()}
    follows = {10: "assistant 30", 30: "assistant 31", 31: "assistant 100", 100: "", 2000: ""}
    assert got == {i: render([("assistant", t)]) for i, t in follows.items()}
