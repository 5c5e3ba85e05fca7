"""Best-fit packing with certified bounds.

Documents become token ids plus an end id; only longer ones are cut into
pieces of the capacity. Pieces are dealt into partitions and each is packed by
best-fit decreasing. Dual-feasible functions give a lower bound on the bins
that the partition's sizes need; a partition that meets its bound is certified
and gives away only its emptiest bin, one with a gap gives away the pieces of
every bin that has room. These pieces are dealt anew and packed again, round
after round, while the corpus holds more bins than its own bound; a round that
saves no bin is discarded, and then all bins with room, of certified partitions
too, are tried in the same way. Only identifiers and
lengths are shuffled. The corpus bound is taken over the histogram of sizes,
which has at most as many rows as the capacity.

Defined cases: a null text is empty (one piece that holds the end id alone);
rows with one identifier are documents of their own; an empty table gives an
empty result; only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_cut
from .task_memory import bounded
from .tokens import default_tokenizer, forget, token_bytes

CAPACITY = 4096
END_ID = 1
PARTITION_PIECES = 8192
BATCH_BYTES = 500_000


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins of ``capacity`` that items of these sizes need at least: the
    largest total weight over dual-feasible functions (the size itself; for
    every threshold t, items over capacity - t count whole, those under t not
    at all; and for k, the rounding-down functions of (k + 1) * size)."""
    if not len(sizes):
        return 0
    x, n = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    order = np.argsort(x)
    x, n = x[order], n[order]
    mass, many = np.concatenate(([0], np.cumsum(x * n))), np.concatenate(([0], np.cumsum(n)))
    t = np.unique(np.concatenate((x[x <= capacity // 2], capacity - x[x > capacity // 2] + 1, [1])))
    t = t[(t >= 1) & (t <= capacity // 2)]
    low, high = np.searchsorted(x, t, "left"), np.searchsorted(x, capacity - t, "right")
    weight = (many[-1] - many[high]) * capacity + mass[high] - mass[low]
    if len(t):
        best = max(best, int(-(-weight.max() // capacity)))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity): a size stays itself when (k + 1) * size is whole
        u = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item. The open bins' room is a bit set, so the
    tightest bin that fits is its lowest bit from the item's size up."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    path = tokenizer or default_tokenizer()
    kind = df.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lo = b.column("t"), 0
            chars = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            while lo < len(text):  # long texts a few at a time
                seen = chars[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(chars, seen + BATCH_BYTES)))
                doc, rows = [], []
                for i, ids in enumerate(token_bytes(text.slice(lo, hi - lo).to_pylist(), path), lo):
                    ids += end
                    n = len(ids) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        cut = ids[4 * s : 4 * (s + capacity)]
                        doc.append(i)
                        rows.append((p, s, len(cut) // 4, zlib.crc32(cut), cut))
                cols = list(zip(*rows))
                out = [b.column("id").take(pa.array(doc))] + [pa.array(c, t) for c, (_, t) in zip(cols, fields)]
                names = ["doc_id"] + [n for n, _ in fields]
                if with_ids:
                    out.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cols[4]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
                lo = hi

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(bounded(run, forget), schema + (", ids array<int>" if with_ids else ""))


def _pack_part(capacity: int, round_: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "h", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size = items["length"].to_numpy()
        bins = best_fit_decreasing(size, capacity)
        filled = np.bincount(bins, weights=size).astype(np.int64)
        kinds, counts = np.unique(size, return_counts=True)
        bound = lower_bound(kinds, counts, capacity)
        loose = filled < capacity
        if len(filled) == bound:  # certified: only the emptiest bin leaves
            loose &= np.arange(len(filled)) == np.argmin(filled)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.concatenate(([0], np.cumsum(filled)[:-1]))
        offset = np.empty(len(size), np.int64)
        offset[order] = before - first[bins[order]]
        out = items[["row", "h", "length"]].copy()
        out["round"], out["part"], out["bin"], out["offset"] = round_, key[0], bins, offset
        out["loose"], out["room"], out["bound"] = loose[bins], (filled < capacity)[bins], bound
        return out

    return run


PACKED = "row long, h long, length long, round int, part long, bin long, offset long, loose boolean, room boolean, bound long"


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pack items (``row`` long, unique; ``length`` long, 1 to capacity) into
    bins: ``row``, ``sequence_id`` and ``offset``."""
    items = items.select("row", F.xxhash64("row").alias("h"), "length")
    hist = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most `capacity` rows
    bound = lower_bound(hist["length"].to_numpy(), hist["n"].to_numpy(), capacity)

    def deal(pool: DataFrame, n: int, round_: int) -> tuple[DataFrame, int]:
        part = F.pmod(F.xxhash64("h", F.lit(round_)), F.lit(max(1, -(-n // partition_pieces))))
        done = pool.withColumn("part", part).groupBy("part").applyInPandas(_pack_part(capacity, round_), PACKED)
        done = write_cut(done, "packed")
        return done, done.filter("offset = 0").count()

    first, bins = deal(items, int(hist["n"].sum()), 0)
    stand, rules = [first], ["loose", "room"]  # in the end every bin with room is tried
    for round_ in count(1):  # ends: a round that stays saves a bin at least
        if bins <= bound:
            break
        out = [s.filter(rules[0]).select("row", "h", "length", "offset") for s in stand]
        pool = reduce(DataFrame.unionByName, out)
        n, old = pool.agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        more, new = deal(pool.drop("offset"), n, round_)
        if new < old:
            stand = [s.filter(~F.col(rules[0])) for s in stand] + [more]
            bins -= old - new
        elif len(rules) == 1:
            break
        else:
            rules = rules[1:]
    out = reduce(DataFrame.unionByName, stand)
    # rounds, partitions and bins are numbered; a sequence is one of each
    seq = F.col("round").cast("long") * F.lit(2**44) + F.col("part") * F.lit(2**20) + F.col("bin")
    return out.select("row", seq.alias("sequence_id"), "offset")


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str | None = None, partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``."""
    cut = pieces(df, id_col, text_col, capacity, end_id, tokenizer)
    # rows are numbered once, in the table that is written here
    cut = write_cut(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("row", "length"), capacity, partition_pieces)
    return cut.join(placed, "row").drop("row").withColumnRenamed("doc_id", id_col)


def packed_sequences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    tokenizer: str | None = None,
) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` (array, at most
    ``capacity``) and ``lengths`` of the pieces in it."""
    cut = write_cut(
        pieces(df, id_col, text_col, capacity, end_id, tokenizer, with_ids=True).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "piece-ids",
    )
    placed = pack(cut.select("row", "length"), capacity).join(cut.select("row", "ids"), "row")
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"),
    )
