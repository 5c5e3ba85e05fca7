import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sphaera.llm import private_data as pd_

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@1234567890+-() %é", max_size=60))
def test_base_spans_equal_the_patterns(t):
    assert pd_.base_spans(t) == plain(t)


def test_base_spans_cases(small_docs):
    for t in ["4532015112830366", "4532-0151 1283 0366.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.999", "+1 (234) 555-6789 x", "00000001.1.1.1",
              "x" * 3000 + "@", "1" * 3000, "+1" + " " * 3000]:
        assert pd_.base_spans(t) == plain(t)
    for r in small_docs.collect():
        assert pd_.base_spans(r.text or "") == plain(r.text or "")


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    p = pd_._init(rng)
    x = rng.integers(0, pd_.CLASSES, (7, 4))
    gold = rng.integers(0, pd_.TAGS, (7, 4))
    n_at = np.full(7, 4)

    def value(q):
        e = pd_._emit(q, pd_._run_direction(q, "f", x, n_at), pd_._run_direction(q, "b", x, n_at))
        total = 0.0
        for w in range(4):
            z = e[0, :, w]
            s = e[0, gold[0, w], w]
            for t in range(1, 7):
                z = np.log(np.exp(z[:, None] + q["trans"]).sum(0)) + e[t, :, w]
                s += q["trans"][gold[t - 1, w], gold[t, w]] + e[t, gold[t, w], w]
            total += s - np.log(np.exp(z).sum())
        return total / 4

    hf, tf = pd_._run_direction(p, "f", x, n_at, keep=True)
    hb, tb = pd_._run_direction(p, "b", x, n_at, keep=True)
    _, g_e, g_t = pd_._crf_gradient(pd_._emit(p, hf, hb), p["trans"], gold)
    grad = {"bias": g_e.sum((0, 2)), "trans": g_t}
    for d, hid, tape in (("f", hf, tf), ("b", hb, tb)):
        grad[f"W{d}"] = np.einsum("tkn,thn->kh", g_e, hid)
        pd_._back_direction(p, d, x, tape, np.matmul(p[f"W{d}"].T, g_e), grad)
    for k, v in p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in v.shape)
            old, h = v[i], 1e-5
            v[i] = old + h
            up = value(p)
            v[i] = old - h
            down = value(p)
            v[i] = old
            assert abs((up - down) / (2 * h) - grad[k][i]) < 1e-4, k


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=(5, pd_.TAGS, 3)), rng.normal(size=(pd_.TAGS, pd_.TAGS))
    size = np.array([5, 3, 1])
    tags = pd_._viterbi(e, trans, size)
    for w, n in enumerate(size):
        def score(y):
            return sum(e[t, y[t], w] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product(range(pd_.TAGS), repeat=int(n)), key=score)
        assert tuple(tags[:n, w]) == best


def test_windows_cover_every_character():
    for size in [1, 31, 32, 33, 480, 511, 512, 513, 544, 545, 992, 993, 5000]:
        covered = np.zeros(size, int)
        for s, n in pd_._cut(size):
            assert n <= pd_.WINDOW and s + n <= size
            covered[s : s + n] += 1
        assert covered.min() == 1 and covered.max() <= 2


def whole_text_spans(t, p):
    """Every window scored alone, all averaged, one path over the whole text."""
    x = pd_.classes(t).astype(np.int64)
    total, seen = np.zeros((len(t), pd_.TAGS)), np.zeros((len(t), 1))
    for s, n in pd_._cut(len(t)):
        c = x[s : s + n, None]
        e = pd_._emit(p, pd_._run_direction(p, "f", c, np.ones(n, int)), pd_._run_direction(p, "b", c, np.ones(n, int)))
        total[s : s + n] += e[:, :, 0]
        seen[s : s + n] += 1
    e = total / seen
    score, back = e[0], []
    for row in e[1:]:
        got = score[:, None] + p["trans"]
        back.append(got.argmax(0))
        score = got.max(0) + row
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    tags = tags[::-1]
    out, at = [], 0
    for tag, run in itertools.groupby(tags):
        n = len(list(run))
        if tag and n >= pd_.LEAST:
            out.append((at, tag - 1, at + n))
        at += n
    return out


def test_spans_equal_one_path_over_the_whole_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = pd_.train(rows)
    texts = [r.text for r in rows.filter("text rlike '[0-9]{2}|@'").limit(40).collect()]
    texts += [" ".join(texts[:12])] + [("x" * k + " +49 (30) 1234-5678 and jane.doe@example.org ") * 30 for k in (0, 7, 200, 465)]
    got = pd_.tag_spans(texts, p)
    assert got == [whole_text_spans(t, p) for t in texts]
    assert sum(map(len, got)) > 50


def test_model_finds_held_out_spans_that_the_patterns_miss(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    q = {r.kind: r for r in pd_.quality(rows, pd_.train(rows)).collect()}
    n, found, added, right = (sum(r[c] for r in q.values()) for c in ("n", "found", "added", "right"))
    assert n > 200 and found / n > 0.9 and right / added > 0.75


def test_model_learns_the_labelled_spans(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = pd_.train(rows)
    texts = [r.text for r in rows.filter("text rlike '[0-9]{2}'").collect()]
    wanted = found = 0
    for t, got in zip(texts, pd_.tag_spans(texts, p)):
        base = pd_.base_spans(t)
        wanted += len(base)
        found += sum(any(s < e2 and s2 < e for s2, k2, e2 in got) for s, _, e in base)
    assert wanted > 20 and found / wanted > 0.9
    clean = [r.text for r in rows.filter("not text rlike '[0-9@]'").limit(200).collect()]
    assert sum(map(len, pd_.all_spans(clean, p))) == 0
    # windows that are not decoded hold no span when they are
    far = [t + " plain words" * 200 for t in texts[:10]]
    assert [len(x) for x in pd_.tag_spans(far, p)] == [len(x) for x in pd_.tag_spans(texts[:10], p)]


def test_report_on_edge_rows(edge_docs, clashing_docs, no_docs, edge_rows):
    names = pd_.KINDS
    got = sorted(pd_.private_report(edge_docs).collect(), key=repr)
    want = []
    for r in edge_rows:
        spans = plain(r[1] or "")
        want.append((r[0], *[sum(k == i for _, k, _ in spans) for i in range(4)],
                     hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:6]) for r in got)
    assert sorted(map(repr, pd_.private_report(clashing_docs).collect())) == sorted(map(repr, got))
    assert pd_.private_report(no_docs).count() == 0


def _random_model(rng) -> dict:
    p = {k: v.astype(np.float32) for k, v in pd_._init(rng).items()}
    p["bias"] = rng.normal(0, 0.5, pd_.TAGS).astype(np.float32)
    p["trans"] = rng.normal(0, 1, (pd_.TAGS, pd_.TAGS)).astype(np.float32)
    return p


def test_scores_equal_those_of_the_training_pass():
    rng = np.random.default_rng(5)
    size = np.sort(rng.integers(1, 40, 30))[::-1]
    x = rng.integers(0, pd_.CLASSES, (int(size[0]), len(size)))
    n_at = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    p = _random_model(rng)
    want = pd_._emit(p, pd_._run_direction(p, "f", x, n_at), pd_._run_direction(p, "b", x, n_at))
    got = pd_._scores(p, x, n_at)
    for k, n in enumerate(size):
        assert np.allclose(got[:n, :, k], want[:n, :, k], atol=1e-4)


def test_no_best_path_has_a_span_where_none_may_be():
    rng = np.random.default_rng(6)
    left_out = 0
    for _ in range(20):
        trans = _random_model(rng)["trans"]
        stretches = [rng.normal(0, 2, (int(n), pd_.TAGS)).astype(np.float32) + [3, 0, 0, 0, 0] for n in rng.integers(1, 60, 12)]
        for e, may in zip(stretches, pd_._may_be_in_a_span(stretches, trans)):
            tags = pd_._viterbi(e[:, :, None].astype(np.float32), trans, np.array([len(e)]))[:, 0]
            assert not tags[~may].any()
            left_out += int((~may).sum())
    assert left_out > 100
