"""Sampling operators P1-P6 with keyed uniforms.

Noise distribution (P3): ids are ordered by count, so all words with one
count form a contiguous id range of equal probability. The distribution is
kept as a histogram with one bucket per distinct count (plus one for id 0):
``(first_idx, n_words, cn, w = cn^0.75, cum_before, cum_next)``. Its size is
bounded by the number of distinct counts (at most about sqrt(2N)), not by the
vocabulary. A draw ``t = u * Z`` finds its bucket by an equi-join on a grid
cell of ``[0, Z)`` and then the id inside the bucket arithmetically.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.functions.keyed import uniform
from sphaera.operators.ordering import small_prefix
from sphaera.params import NOISE_POWER

GRID_CELLS = 1 << 16


@dataclass(frozen=True)
class CorpusScalars:
    """One-row aggregates the sampling formulas need as constants."""

    train_words: int  # N: sum of kept counts, </s> included
    vocab_size: int  # V
    noise_total: float  # Z = sum of cn^0.75 over all ids
    n_buckets: int  # rows of the noise histogram


def keep_probability(cn: Column, train_words: int, sample: float) -> Column:
    """``min(1, (sqrt(cn / (s N)) + 1) * s N / cn)``."""
    sn = F.lit(float(sample) * float(train_words))
    return F.least(F.lit(1.0), (F.sqrt(cn / sn) + F.lit(1.0)) * sn / cn)


def subsample(encoded: DataFrame, scalars: CorpusScalars, sample: float, seed: int, epoch: int) -> DataFrame:
    """Keep a token when ``u(seed, 'sub', epoch, doc_id, pos) <= p_keep``;
    off when ``sample <= 0``. Needs ``cn`` on the rows (carried from C8), so
    no join back to the vocabulary."""
    if sample <= 0:
        return encoded
    u = uniform(seed, "sub", str(epoch), "doc_id", "pos")
    p = keep_probability(F.col("cn"), scalars.train_words, sample)
    return encoded.filter((p >= 1.0) | (u <= p))  # u < 1: most words need no digest


def dynamic_window(df: DataFrame, window: int, seed: int, epoch: int) -> DataFrame:
    """P5: ``radius = window - floor(u * window)`` per kept position."""
    u = uniform(seed, "win", str(epoch), "doc_id", "kpos")
    return df.withColumn("radius", (F.lit(window) - F.floor(u * F.lit(window))).cast("bigint"))


def noise_histogram(vocab: DataFrame) -> DataFrame:
    """Per-count buckets in id order with exclusive mass prefix."""
    b = vocab.withColumn("bkey", F.when(F.col("idx") == 0, F.lit(-1)).otherwise(F.col("cn")))
    hist = b.groupBy("bkey").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n_words"), F.max("cn").alias("cn")
    )
    hist = hist.withColumn("w", F.pow(F.col("cn").cast("double"), F.lit(NOISE_POWER)))
    hist = hist.withColumn("mass", F.col("w") * F.col("n_words"))
    hist = small_prefix(hist, ["first_idx"], "mass", "cum_before", inclusive=False)
    nxt = F.lead("cum_before").over(Window.orderBy("first_idx"))
    return hist.withColumn("cum_next", nxt).drop("bkey")


def corpus_scalars(vocab: DataFrame, hist: DataFrame) -> CorpusScalars:
    """Collect the one-row aggregates (N, V, Z, bucket count)."""
    v = vocab.agg(F.sum("cn").alias("n"), F.count(F.lit(1)).alias("v")).first()
    h = hist.agg(F.sum("mass").alias("z"), F.count(F.lit(1)).alias("h")).first()
    return CorpusScalars(int(v["n"] or 0), int(v["v"]), float(h["z"] or 0.0), int(h["h"]))


NOISE_BYTES = 64 << 20


def noise_table(hist: DataFrame, scalars: CorpusScalars):
    """The histogram as arrays for tasks, 32 bytes a bucket. Its size is
    checked before anything is collected: distinct counts are at most about
    sqrt(2N), which meets the bound at some 2e12 tokens."""
    import numpy as np

    from sphaera.operators.trainer import Noise

    if 32 * scalars.n_buckets > NOISE_BYTES:
        raise ValueError(f"{scalars.n_buckets} distinct counts exceed the noise table's {NOISE_BYTES} bytes; raise min_count")
    names = ("first_idx", "n_words", "w", "cum_before")
    h = hist.select(*names).orderBy("first_idx").toPandas()
    arrays = [h[c].to_numpy(np.float64 if c in ("w", "cum_before") else np.int64) for c in names]
    return Noise(*arrays, scalars.noise_total, scalars.vocab_size)


def noise_grid(hist: DataFrame, scalars: CorpusScalars, cells: int = GRID_CELLS) -> DataFrame:
    """Buckets exploded into the grid cells of ``[0, Z)`` they overlap:
    at most ``cells + buckets`` rows."""
    z = F.lit(scalars.noise_total)
    g = F.lit(cells)
    lo = F.least(F.floor(F.col("cum_before") / z * g), g - 1)
    hi_edge = F.coalesce(F.col("cum_next"), z)
    hi = F.least(F.floor(hi_edge / z * g), g - 1)
    return hist.select(
        F.explode(F.sequence(lo.cast("bigint"), F.greatest(lo, hi).cast("bigint"))).alias("cell"),
        "first_idx",
        "n_words",
        "w",
        "cum_before",
        "cum_next",
    )


def draw_negatives(
    draws: DataFrame,
    grid: DataFrame,
    scalars: CorpusScalars,
    broadcast_rows: int = 2_000_000,
    u_col: str = "u1",
    ufall_col: str = "u2",
    out: str = "neg",
) -> DataFrame:
    """P4 + P6 on rows carrying two uniforms: inverse-CDF id from the noise
    histogram; id 0 is replaced by ``1 + floor(u2 * (V - 1))``."""
    if scalars.vocab_size < 2:
        raise ValueError("negative sampling needs a vocabulary with at least one word besides </s>")
    z = F.lit(scalars.noise_total)
    d = draws.withColumn("_t", F.col(u_col) * z).withColumn(
        "cell", F.least(F.floor(F.col("_t") / z * F.lit(GRID_CELLS)), F.lit(GRID_CELLS - 1)).cast("bigint")
    )
    if scalars.n_buckets + GRID_CELLS <= broadcast_rows:
        grid = F.broadcast(grid)
    j = d.join(grid, "cell").filter(
        (F.col("cum_before") <= F.col("_t")) & (F.col("cum_next").isNull() | (F.col("_t") < F.col("cum_next")))
    )
    inner = F.least(F.col("n_words") - 1, F.floor((F.col("_t") - F.col("cum_before")) / F.col("w")))
    idx = (F.col("first_idx") + inner).cast("bigint")
    fallback = (F.lit(1) + F.floor(F.col(ufall_col) * F.lit(scalars.vocab_size - 1))).cast("bigint")
    return j.withColumn(out, F.when(idx == 0, fallback).otherwise(idx)).drop(
        "_t", "cell", "first_idx", "n_words", "w", "cum_before", "cum_next"
    )


def uniform_negative(u: Column, vocab_size: int) -> Column:
    """A uniform id in ``1 .. V-1``."""
    return (F.lit(1) + F.floor(u * F.lit(vocab_size - 1))).cast("bigint")
