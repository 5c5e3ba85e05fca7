import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.llm.prefix_trie import PerfectHash, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, role, int(h[:15], 16), int(h[15:30], 16)), (role, text)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), []) if rebuild else []
        made[c] = tuple(base[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in made.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        n = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += n
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k]))
                  for k, m in members.items())


def trie(df, **kw):
    return sorted(map(tuple, prefix_trie(df, **kw).collect()))


def conversations(n=150, seed=1, deepest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, deepest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a b", "one two  three", "x"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"band": 3, "heavy": 5, "shard": 20}, {"heavy": 30, "shard": 7}])
def test_equals_brute_force(spark, sizes):
    rows = conversations()
    assert trie(frame(spark, rows), **sizes) == brute(rows)


def test_copies_long_conversations_and_odd_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(4)]  # all the same
    rows += [(1000, t, "user", "word " * (t % 3)) for t in range(300)] + [(1001, t, "user", "word " * (t % 3)) for t in range(299)]
    rows += [(2001, 0, "user", "x"), (2002, 0, "user", "x"), (2003, 0, "user", "y"), (-5, 1, "a", "b"), (-41, 1, "a", "b")]
    rows += [(None, 1, "user", "nobody"), (3000, None, "user", "late"), (3000, 0, "user", "a"), (3000, 0, "user", "b"), (3000, None, None, None)]
    rows += [(3000, 0, "user", "a")] * 2 + [(3020, 1, "user", "long " * 50000)]
    assert trie(frame(spark, rows), band=50, heavy=60, shard=64) == brute(rows)
    assert trie(frame(spark, rows), rebuild=False) == brute(rows, False)


def test_empty_single_and_clashing(spark):
    assert trie(frame(spark, []).limit(0)) == []
    assert trie(frame(spark, [(None, 1, "a", "b")])) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    assert trie(frame(spark, [(turnless, 0, "a", "b")])) == brute([(turnless, 0, "a", "b")])
    rows = conversations(40)
    names = "conv pos x1 x2 p1 p2 t1 t2 depth band m len anchor words idx h base head ends e1 e2 shard top first c".split()
    assert trie(frame(spark, rows).withColumns({c: F.lit("x") for c in names})) == brute(rows)


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30000):
        keys = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
        table = PerfectHash(keys)
        assert sorted(table(keys).tolist()) == list(range(n))
        assert (table(rng.integers(0, 2**64, (500, 2), dtype=np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash(np.zeros((2, 2), np.uint64))
