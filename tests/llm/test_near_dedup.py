import random
from collections import defaultdict

import numpy as np
import pytest

from sphaera.llm import near_dedup as nd
from sphaera.llm.components import connected_components
from sphaera.llm.shingles import shingles

from llm.conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    """rows of (id, text) -> sorted (id, size, component)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in where[g]:
                both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(((ident, len(sets[i]), least.get(find(i)) if sets[i] else ident) for i, (ident, _) in enumerate(rows)), key=repr)


def family(n, seed=1, words=60):
    """Near copies of one text, many of them around the threshold."""
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def got(df, percent):
    rows = nd.near_dedup(df, percent=percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_edge_rows(edge_docs, edge_rows, percent):
    assert got(edge_docs, percent) == brute([r[:2] for r in edge_rows], percent)


def test_clashing_names_empty_table_and_rows_kept(clashing_docs, edge_rows, no_docs):
    kept = nd.drop_near_copies(clashing_docs)
    assert kept.columns == clashing_docs.columns
    want = {i for i, _, c in brute([r[:2] for r in edge_rows], 80) if i == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert nd.near_dedup(no_docs).count() == 0


def test_one_row_of_every_group_is_kept(spark):
    rng = random.Random(9)
    base, lone, twin, other = (sentence(rng, 100) for _ in range(4))
    near = lambda t: " ".join(t.split()[:-1])
    rows = [
        (None, base, 0), (27, base, 1), (30, near(base), 2), (None, "no identifier", 3), (None, lone, 4), (None, near(lone), 5),
        (None, lone, 6), (5, twin, 7), (5, near(twin), 8), (5, other, 9), (8, "one", 10), (8, "one", 10), (7, "", 11), (7, "", 12), (None, None, 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, th long").repartition(3)
    kept = [tuple(r) for r in nd.drop_near_copies(df).collect()]
    tag = [r[2] for r in kept]
    assert set(kept) <= set(rows)
    for group in [{0, 1, 2}, {3}, {4, 5, 6}, {7, 8}, {9}, {10}]:
        assert sum(x in group for x in tag) == 1, group
    assert 1 in tag and {11, 12, 13} <= set(tag) and len(kept) == 9


def test_documents_table(spark, small_docs):
    assert got(small_docs, 85) == brute([(r.doc_id, r.text) for r in small_docs.collect()], 85)


def test_family_around_the_threshold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 1500)
    rng = random.Random(8)
    texts = family(150) + [sentence(rng, 80) for _ in range(30)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, 85) == brute(rows, 85)


def test_exact_forest_connects_what_is_linked():
    rng = np.random.default_rng(0)
    for trial in range(20):
        sets = [np.unique(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(25)]
        side = rng.random(25) < 0.5 if trial % 2 else None
        ok = lambda i, j: (
            100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j])) and (side is None or side[i] != side[j])
        )
        edges = nd.exact_forest(sets, 60, side)
        assert all(ok(i, j) for i, j in edges)
        groups = {frozenset(g) for g in _groups(25, edges)}
        assert groups == {frozenset(g) for g in _groups(25, [(i, j) for i in range(25) for j in range(i) if ok(i, j)])}


def _groups(n, edges):
    label = list(range(n))
    for i, j in edges:
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    return [[i for i in range(n) if label[i] == x] for x in set(label)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)]  # a chain and a hub
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)] + [(7, 7), (None, 3)]
    want = {}
    nodes = sorted({x for a, b in edges if a is not None and a != b for x in (a, b)})
    for g in _groups(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges if a is not None and a != b]):
        for i in g:
            want[nodes[i]] = nodes[min(g)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in out} == want and len(out) == len(want)


def test_minima_estimate_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.concatenate((a[:3000], np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64)))
    assert abs((nd.minima(np.sort(a)) == nd.minima(np.sort(b))).mean() - 0.6) < 0.15


def test_shingles_are_the_words():
    for t in [None, "", " \t", "One", "one TWO three", "a b c d e", "a b c d e a b c d e", "é ß\x1c x\x0by z w q"]:
        assert len(shingles(t)) == len(shingle_set(t))
    assert (shingles("A b  c d\ne F") == shingles("a B c d e f")).all()
