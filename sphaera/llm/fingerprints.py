"""Document fingerprints by one-permutation MinHash.

The shingles of a document (five lower-cased words) are hashed once; the top
bits of a hash name its bin and each bin keeps its least hash. Empty bins are
filled by optimal densification: an empty bin walks through the bins that a
universal hash of (bin, attempt) names until it meets a filled one. The low
``BITS`` bits of every bin are packed and written as hexadecimal text. Two
fingerprints are compared by their share of equal bins, corrected for the
chance of equal low bits.

Defined cases: a null text is empty; a text without words has the empty
fingerprint, whose likeness is 1 to another empty one and 0 to any other;
equal texts have equal fingerprints; an empty table gives an empty result; only
the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_cut
from .shingles import shingles

BINS = 256
BITS = 4
_BIN_BITS = BINS.bit_length() - 1


def _attempt(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in this attempt."""
    x = (bins.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x += np.array([attempt], np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BIN_BITS)).astype(np.int64)


_LOOKS = [_attempt(np.arange(BINS), a) for a in range(64)]


def fingerprint(s: np.ndarray) -> bytes:
    """Packed low bits of the densified one-permutation minima of a sorted,
    distinct set of 64-bit hashes; empty for an empty set."""
    if not len(s):
        return b""
    where = (s >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    head = np.concatenate(([True], where[1:] != where[:-1]))
    value = np.zeros(BINS, np.uint64)
    value[where[head]] = s[head]  # sorted, so a bin's first hash is its least
    filled = np.zeros(BINS, bool)
    filled[where] = True
    source = np.arange(BINS)
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        look = _LOOKS[attempt][empty] if attempt < len(_LOOKS) else _attempt(empty, attempt)
        ok = filled[look]
        source[empty[ok]] = look[ok]
        empty, attempt = empty[~ok], attempt + 1
    low = value[source] & np.uint64(2**BITS - 1)
    return np.packbits(np.unpackbits(low.astype(np.uint8)[:, None], axis=1)[:, 8 - BITS :].ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = 1 - np.count_nonzero(np.unpackbits(x).reshape(BINS, BITS).any(1)) / BINS
    chance = 2.0**-BITS
    return max(0.0, (same - chance) / (1 - chance))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``id_col`` and ``fingerprint`` (hexadecimal) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [fingerprint(shingles(t.as_py(), k)).hex() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f, pa.string())], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t"))
    return out.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


OWN = "doc_id long, n_chars long, fp binary"
EDIT = "edited_sha256 string, edited_fingerprint binary, near_edited double, near_next double"
EDGE = "text string, part int, edge string"


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or
    all) of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _compared(text: str, fp: bytes, following: str, next_fp: bytes, k: int) -> tuple:
    edited = edit(text, following)
    e = fingerprint(shingles(edited, k))
    return hashlib.sha256(edited.encode()).hexdigest(), e, likeness(fp, e), likeness(fp, next_fp)


def _neighbours(k: int):
    """Rows in descending order of identifier, each compared with the next.
    The first and last row of a partition also leave with their text: what
    follows the last one is in another partition."""
    from pyspark import TaskContext

    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fp", pa.binary()), ("edited_sha256", pa.string()),
              ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
              ("text", pa.string()), ("part", pa.int32()), ("edge", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("t")):
                text = t.as_py() or ""
                fp = fingerprint(shingles(text, k))
                if held is None:
                    rows.append((i, len(text), fp, None, None, None, None, text, part, "head"))
                else:
                    rows.append((held[0], len(held[1]), held[2], *_compared(held[1], held[2], text, fp, k), None, part, None))
                held = i, text, fp
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if held is not None:
            last = (held[0], len(held[1]), held[2], None, None, None, None, held[1], part, "tail")
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, schema)], schema=schema)

    return run


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """Every document's fingerprint, that of its edited text (:func:`edit` with
    the next document in descending order of identifier, after the last the
    first), and their likeness. Rows with one identifier are ordered by text,
    null identifiers come last; a single row is its own next one. Identifiers
    are integers. Texts cross the network once: a range partitioning places
    neighbours side by side, and only a partition's first and last row are
    compared across partitions."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("th"))
    ranged = rows.repartitionByRange(F.col("id").desc_nulls_last(), F.col("th"))
    ranged = ranged.sortWithinPartitions(F.col("id").desc_nulls_last(), F.col("th"), F.col("t")).select("id", "t")
    done = write_cut(ranged.mapInArrow(_neighbours(k), f"{OWN}, {EDIT}, {EDGE}"), "fingerprints")

    # two rows for each partition that has any; only the partitions' numbers are
    # put in order in one task, the texts are joined to them
    edges = done.filter("edge is not null").select("part", "edge", "doc_id", "n_chars", "fp", "text")
    heads = edges.filter("edge = 'head'").select(F.col("part").alias("n_part"), F.col("fp").alias("n_fp"), F.col("text").alias("n_text"))
    tails = edges.filter("edge = 'tail'")
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = tails.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("n_part"))
    nxt = tails.join(turn, "part").join(heads, "n_part")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("text", "fp", "n_text", "n_fp")}
            got = [_compared(t, f, nt, nf, k) for t, f, nt, nf in zip(*c.values())]
            new = list(zip(*got)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_chars"), b.column("fp"), pa.array(new[0], pa.string()),
                 pa.array(new[1], pa.binary()), pa.array(new[2], pa.float64()), pa.array(new[3], pa.float64())],
                names=["doc_id", "n_chars", "fp", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"],
            )

    tails = nxt.select("doc_id", "n_chars", "fp", "text", "n_text", "n_fp").mapInArrow(last, f"{OWN}, {EDIT}")
    out = done.filter("edge is null").select(*tails.columns).unionByName(tails)
    return out.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
