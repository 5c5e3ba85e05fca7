"""Pair and triple generation G1-G4 over kept tokens
``kept(doc_id, seg, kpos, idx, radius)``.

Skip-gram pairs use a bounded ROWS frame over blocks of positions: a block
also holds the ``window`` positions beyond either edge, so no pair is lost, each
position sees at most ``2 * window`` neighbours, no document array is ever
carried whole and a long document is no bigger a group than its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera.functions.keyed import draw_pair_sql, lanes_sql
from sphaera.operators.sampling import CorpusScalars, draw_negatives


BLOCK = 8192


def neighbours(
    kept: DataFrame, window: int, carry: tuple[str, ...] = (), by: tuple[str, ...] = (), block: int = BLOCK
) -> DataFrame:
    """Every kept position with ``near``: the positions and words of its
    segment within ``window``, in order, itself included."""
    b = lambda at: F.floor(at / F.lit(block)).cast("bigint")
    first, last = b(F.greatest(F.col("kpos") - window, F.lit(0))), b(F.col("kpos") + window)
    kept = kept.withColumn("_b", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(*by, "doc_id", "seg", "_b").orderBy("kpos").rowsBetween(-window, window)
    near = F.collect_list(F.struct(F.col("kpos").alias("p"), F.col("idx").alias("i"))).over(frame)
    w = kept.select("doc_id", "seg", "kpos", "idx", "radius", *carry, "_b", near.alias("near"))
    return w.filter(F.col("_b") == b(F.col("kpos"))).drop("_b")  # the block that owns the position


def skipgram_pairs(
    kept: DataFrame, window: int, carry: tuple[str, ...] = (), by: tuple[str, ...] = (), block: int = BLOCK,
    lanes: tuple[int, str, int] | None = None,
) -> DataFrame:
    """G1: for every kept position (context ``ctx`` = its word) each other
    position of the same segment within ``radius``: ``center`` = that word,
    ``off`` = signed distance. ``carry`` columns are passed through. ``lanes``:
    seed, name and epoch of the position's draws, whose digest words are added
    after the sort of positions, before their pairs are laid out."""
    w = neighbours(kept, window, carry, by, block)
    if lanes is not None:
        w, carry = with_lanes(w, *lanes), (*carry, "_l")
    e = w.select("doc_id", "seg", "kpos", F.col("idx").alias("ctx"), "radius", *carry, F.explode("near").alias("n"))
    off = F.col("n.p") - F.col("kpos")
    return e.filter((off != 0) & (F.abs(off) <= F.col("radius"))).select(
        "doc_id", "seg", "kpos", off.cast("bigint").alias("off"), "ctx", F.col("n.i").alias("center"), *carry
    )


def doc_word_pairs(kept: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(document, word) once per kept position."""
    return kept.select("doc_id", "kpos", F.col("idx").alias("word"), *carry)


def with_lanes(kept: DataFrame, seed: int, op: str, epoch: int, out: str = "_l") -> DataFrame:
    """Add the digest words that all draws of a position come from."""
    return kept.withColumn(out, F.expr(lanes_sql(seed, op, [str(epoch), "doc_id", "kpos"])))


def _with_draws(df: DataFrame, negative: int, seed: int, op: str, epoch: int, keys: list[str]) -> DataFrame:
    """Rows times ``k = 1..negative`` with two uniforms each. The digest words
    are computed here unless the rows carry them from their position."""
    d = df if "_l" in df.columns else with_lanes(df, seed, op, epoch)
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(negative).cast("bigint"))))
    u1, u2 = draw_pair_sql(negative, "off" if "off" in keys else "0", "k")
    return d.withColumn("u1", F.expr(u1)).withColumn("u2", F.expr(u2)).drop("_l")


def position_rows(
    kept: DataFrame, window: int, negative: int, seed: int, epoch: int, carry: tuple[str, ...] = (),
    by: tuple[str, ...] = (),
) -> DataFrame:
    """G1 to G4 as one row per kept position: its word ``idx``, the pairs'
    ``off`` and ``center`` as arrays in order of distance, and the digest words
    of the pairs' (``wdraw``) and the document's (``ddraw``) draws.
    :func:`sphaera.operators.trainer.noise_ids` reads the draws of
    :func:`word_triples` and :func:`doc_triples` off them."""
    w = neighbours(kept, window, carry, by).withColumn(
        "_p",
        F.expr(
            "filter(transform(near, n -> struct(cast(n.p - kpos as bigint) as off, n.i as center)), "
            "x -> x.off <> 0 and abs(x.off) <= radius)"
        ),
    )
    w = with_lanes(with_lanes(w, seed, "wneg", epoch, "wdraw"), seed, "dneg", epoch, "ddraw")
    return w.select(
        "doc_id", F.col("kpos").cast("bigint").alias("kpos"), "idx", *carry,
        F.expr("transform(_p, x -> x.off)").alias("off"), F.expr("transform(_p, x -> x.center)").alias("center"),
        "wdraw", "ddraw",
    )


def plain_positions(kept: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """G1 to G4 as one row per kept position without its neighbours and draws:
    the group that holds the position and those within its window fills them in
    (:func:`sphaera.operators.trainer.widened`), as :func:`position_rows` would."""
    return kept.select("doc_id", F.col("kpos").cast("bigint").alias("kpos"), "seg", "idx", "radius", *carry)


def word_triples(
    pairs: DataFrame, grid: DataFrame, scalars: CorpusScalars, negative: int, seed: int, epoch: int,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """Each skip-gram pair with ``negative`` noise centers; a draw equal
    to the context word is dropped, not redrawn."""
    d = _with_draws(pairs, negative, seed, "wneg", epoch, ["doc_id", "kpos", "off"])
    d = draw_negatives(d, grid, scalars, broadcast_rows)
    return d.filter(F.col("neg") != F.col("ctx")).drop("u1", "u2")


def doc_triples(
    dpairs: DataFrame, grid: DataFrame, scalars: CorpusScalars, negative: int, seed: int, epoch: int,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """(document, word) with ``negative`` noise words; a draw equal to
    the word is dropped."""
    d = _with_draws(dpairs, negative, seed, "dneg", epoch, ["doc_id", "kpos"])
    d = draw_negatives(d, grid, scalars, broadcast_rows)
    return d.filter(F.col("neg") != F.col("word")).drop("u1", "u2")
