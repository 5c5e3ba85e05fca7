"""Closed form of the reference's vector initialisation.

The reference walks one 64-bit linear congruential stream
``x <- 25214903917 * x + 11`` from state 1 and uses only ``x & 0xFFFF``. The
low 16 bits form their own generator ``x <- (a * x + c) mod 2^16`` with
``a = 25214903917 mod 2^16``. The state after ``n`` steps is therefore a
composition of affine maps, one per set bit of ``n``; each map is applied as
``x <- (m * x + b * C) mod 2^16`` with ``m = 1 + b * (A - 1)`` for the bit
``b``, so the expression stays linear in size and needs no table, loop or
64-bit overflow (Spark runs with ANSI arithmetic).
"""

from __future__ import annotations

# Fixed values of the reference generator.
LCG_MULTIPLIER = 25214903917
LCG_INCREMENT = 11
LCG_START = 1
LOW_BITS = 16

MOD = 1 << LOW_BITS


def _jump_table() -> list[tuple[int, int]]:
    """(A_k, C_k) with f^(2^k)(x) = A_k * x + C_k mod 2^16, derived by squaring."""
    a, c = LCG_MULTIPLIER % MOD, LCG_INCREMENT % MOD
    out = []
    for _ in range(LOW_BITS):
        out.append((a, c))
        a, c = (a * a) % MOD, (a * c + c) % MOD
    return out


JUMPS = _jump_table()


def state_after_sql(steps_expr: str, dialect: str = "spark") -> str:
    """SQL for the low 16 bits of the state after ``steps_expr`` steps from 1.

    ``steps_expr`` must be a non-negative BIGINT expression; only its value
    mod 2^16 matters (the low-bit generator has full period 2^16).
    """
    div = "div" if dialect == "spark" else "//"
    n = f"(({steps_expr}) % {MOD})"
    x = str(LCG_START)
    for k, (a, c) in enumerate(JUMPS):
        bit = f"((({n}) {div} {1 << k}) % 2)"
        x = f"(((1 + {bit} * {a - 1}) * {x} + {bit} * {c}) % {MOD})"
    return x


def init_value_sql(flat_pos_expr: str, dim: int, dialect: str = "spark") -> str:
    """Unnormalised value of stream element ``flat_pos`` (0-based):
    ``(x / 65536 - 0.5) / dim`` with x the state after ``flat_pos + 1`` steps."""
    x = state_after_sql(f"({flat_pos_expr}) + 1", dialect)
    return f"((CAST({x} AS DOUBLE) / {float(MOD)} - 0.5) / {float(dim)})"


def state_after(n: int) -> int:
    """Python reference for tests: walk the full 64-bit generator."""
    x = LCG_START
    for _ in range(n):
        x = (x * LCG_MULTIPLIER + LCG_INCREMENT) % (1 << 64)
    return x & (MOD - 1)


def state_table():
    """``table[n]`` = low 16 bits after ``n + 1`` steps from 1 (the full
    period), built by the rule above; 65536 entries."""
    import numpy as np

    a, c = LCG_MULTIPLIER % MOD, LCG_INCREMENT % MOD
    out = np.empty(MOD, dtype=np.int64)
    x = LCG_START
    for i in range(MOD):
        x = (a * x + c) % MOD
        out[i] = x
    return out
