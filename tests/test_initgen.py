"""The closed-form initialisation equals a walk of the 64-bit generator."""

from sphaera.functions.initgen import MOD, state_after, state_after_sql


def test_low_bits_generator_matches_full_walk(spark):
    n = 70000
    x, walk = 1, []
    for _ in range(n):
        x = (x * 25214903917 + 11) % (1 << 64)
        walk.append(x & (MOD - 1))
    df = spark.range(n).selectExpr(f"id", f"{state_after_sql('id + 1')} AS s")
    got = {r["id"]: r["s"] for r in df.collect()}
    assert all(got[i] == walk[i] for i in range(n))
    assert state_after(5) == walk[4]


def test_period_is_full():
    from sphaera.functions.initgen import JUMPS

    a, c = JUMPS[-1]
    # 2^15 steps twice = 2^16 steps = identity map on 16 bits
    a2, c2 = (a * a) % MOD, (a * c + c) % MOD
    assert (a2, c2) == (1, 0)
