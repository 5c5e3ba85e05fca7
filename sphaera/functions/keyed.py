"""Keyed uniform draws.

The reference draws from a per-thread sequential generator, which depends on
scheduling. Here every draw is a pure function of its key
``(seed, op, epoch, doc, position, k...)``: the md5 of the joined key, read
as 32-bit lanes. The same text runs in Spark SQL and in DuckDB, so every
stochastic operator keeps a strict SQL oracle, and a re-run after a lost
executor reproduces the same draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed: int, op: str, keys: list[str], dialect: str) -> str:
    typ = "STRING" if dialect == "spark" else "VARCHAR"
    parts = [f"'{int(seed)}'", f"'{op}'"] + [f"CAST({k} AS {typ})" for k in keys]
    return "concat_ws(':', " + ", ".join(parts) + ")"


def uniform_sql(seed: int, op: str, keys: list[str], lane: int = 0, dialect: str = "spark") -> str:
    """SQL text for u in [0, 1) keyed by ``keys`` (SQL expressions).

    ``lane`` 0..3 picks one of the four 32-bit words of the digest.
    """
    if not 0 <= lane <= 3:
        raise ValueError("lane must be 0..3")
    digest = f"md5({_key(seed, op, keys, dialect)})"
    hexpart = f"substr({digest}, {lane * 8 + 1}, 8)"
    if dialect == "spark":
        return f"(CAST(conv({hexpart}, 16, 10) AS BIGINT) / {TWO_32})"
    if dialect == "duckdb":
        return f"(CAST('0x' || {hexpart} AS BIGINT) / {TWO_32})"
    raise ValueError(dialect)


def uniform(seed: int, op: str, *keys: str, lane: int = 0) -> Column:
    """Column form of :func:`uniform_sql` (keys are column names/expressions)."""
    return F.expr(uniform_sql(seed, op, list(keys), lane, "spark"))


def lanes_sql(seed: int, op: str, keys: list[str], dialect: str = "spark") -> str:
    """SQL for the four 32-bit words of one digest, as an array of BIGINT."""
    digest = f"md5({_key(seed, op, keys, dialect)})"
    parts = [f"substr({digest}, {i * 8 + 1}, 8)" for i in range(4)]
    if dialect == "spark":
        return "array(" + ", ".join(f"CAST(conv({p}, 16, 10) AS BIGINT)" for p in parts) + ")"
    return "[" + ", ".join(f"CAST('0x' || {p} AS BIGINT)" for p in parts) + "]"


_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
DIGEST_ROWS = 1 << 13


def digest_words(keys: pa.Array) -> np.ndarray:
    """The four 32-bit words of :func:`lanes_sql` for keys joined already: md5
    of one block for many keys at once, longer keys one by one."""
    out = np.empty((len(keys), 4), np.int64)
    for s in range(0, len(keys), DIGEST_ROWS):
        part = pa.concat_arrays([keys[s : s + DIGEST_ROWS].cast(pa.binary())])
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        out[s : s + len(part)] = _digests(np.frombuffer(part.buffers()[2] or b"", np.uint8), ends)
    return out


def _digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, size = len(ends) - 1, np.diff(ends)
    long = np.flatnonzero(size > 55)
    short = np.where(size > 55, 0, size)
    blocks = np.zeros((n, 64), np.uint8)
    inside = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
    row = np.repeat(np.arange(n), short)
    blocks.ravel()[row * 64 + inside] = data[ends[row] + inside]
    blocks[np.arange(n), short] = 0x80
    words = blocks.view("<u4").T.copy()
    words[14] = short * 8
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[at]
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    out = np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START)], axis=1).byteswap().astype(np.int64)
    for i in long:
        out[i] = np.frombuffer(hashlib.md5(data[ends[i] : ends[i + 1]].tobytes()).digest(), ">u4")
    return out


# Fixed values of the draws: a prime below 2^32, and the second word's share.
PRIME = 4294967291
LOW = 1 << 20


def draw_pair_sql(negative: int, off: str, k: str, lanes: str = "_l", dialect: str = "spark") -> tuple[str, str]:
    """(u1, u2) SQL of draw ``k`` (1-based) at signed distance ``off`` from one
    digest per position: quadratics of the draw's number in the digest's words,
    modulo a prime, so that a pair costs no digest of its own. ``u1`` has 52
    bits, ``u2`` 32. The same integers come out in Spark, DuckDB and NumPy
    (:func:`sphaera.operators.trainer.noise_ids`)."""
    j = f"(2 * (abs({off}) * {negative} + ({k})) + CASE WHEN {off} < 0 THEN 1 ELSE 0 END)"
    a, b, c, d = (f"element_at({lanes}, {i})" if dialect == "spark" else f"{lanes}[{i}]" for i in range(1, 5))

    def quadratic(x, y, z):
        return f"(({x} + {y} * {j} + {z} * {j} * {j}) % {PRIME})"

    u1 = f"(CAST({quadratic(a, b, c)} * {LOW} + {quadratic(d, a, b)} % {LOW} AS DOUBLE) / {float(PRIME * LOW):.1f})"
    return u1, f"(CAST({quadratic(c, d, a)} AS DOUBLE) / {float(PRIME):.1f})"
