"""Token-id output: packed id matrices, cumulative segment lengths and position
resets.

Documents become token ids plus an end id; overlong ones are split into pieces
of the sequence length and lose nothing. Pieces are dealt into shards by a hash
of their row and number, so that neither a long document nor equal rows fill
one; there are as many shards as rows and bytes ask for, and every shard is packed by best-fit decreasing: a segment tree over the room
left counts the open bins, and the tightest bin that fits is found by one
descent. A row of the result is one row of a shard's id matrix, as
little-endian unsigned 16- or 32-bit numbers padded to the sequence length.

Defined cases: a null text is empty (the end id alone); rows with one identifier
are documents of their own; an empty table gives an empty result; only the two
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .task_memory import bounded
from .tokens import default_tokenizer, forget, token_bytes

SEQUENCE = 4096
END_ID = 1
PAD_ID = 0
SHARD_DOCS = 4096
SHARD_BYTES = 8 << 20  # of text, on average; a piece has a sequence at most
BATCH_BYTES = 500_000


class RoomTree:
    """Numbers of open bins by room left, as a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that has a bin, or -1."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the right sibling holds larger rooms
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of every bin, packed by best-fit decreasing."""
    tree, by_room, bins = RoomTree(capacity), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.tightest(sizes[i])
        if room < 0:
            room, b = capacity, len(bins)
            bins.append([])
        else:
            b = by_room[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        by_room.setdefault(room - sizes[i], []).append(b)
        tree.add(room - sizes[i], 1)
    return bins


def _pieces(sequence: int, end_id: int, path: str, width: str):
    schema = [("source_row", pa.int64()), ("doc_id", None), ("piece", pa.int32()), ("ids", pa.binary())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lo = b.column("t"), 0
            size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES)))
                doc, piece, ids = [], [], []
                for i, x in enumerate(token_bytes(text.slice(lo, hi - lo).to_pylist(), path), lo):
                    x = np.frombuffer(x + end, "<u4").astype(width)
                    for p, s in enumerate(range(0, len(x), sequence)):
                        doc.append(i)
                        piece.append(p)
                        ids.append(x[s : s + sequence].tobytes())
                at = pa.array(doc)
                cols = [b.column("source_row").take(at), b.column("id").take(at), pa.array(piece, pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in schema])
                lo = hi

    return run


def _matrix(sequence: int, pad_id: int, width: str):
    item = np.dtype(width).itemsize

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        ids, docs, piece = (t.column(c).combine_chunks() for c in ("ids", "doc_id", "piece"))
        sizes = [n // item for n in pc.binary_length(ids).to_pylist()]
        bins = best_fit(sizes, sequence)
        rows, lengths = [], []
        for b in bins:
            row = b"".join(ids[i].as_py() for i in b)
            n = len(row) // item
            rows.append(row + np.full(sequence - n, pad_id, width).tobytes())
            lengths.append(np.concatenate(([0], np.cumsum([sizes[i] for i in b]))).tolist())
        order = [pa.array(b) for b in bins]
        return pa.table({
            "shard": pa.array([key[0].as_py()] * len(bins), pa.int64()),
            "row": pa.array(range(len(bins)), pa.int32()),
            "ids": pa.array(rows, pa.binary()),
            "cu_seqlens": pa.array(lengths, pa.list_(pa.int32())),
            "position_resets": pa.array([x[:-1] for x in lengths], pa.list_(pa.int32())),
            "doc_ids": pa.array([docs.take(o).to_pylist() for o in order], pa.list_(docs.type)),
            "pieces": pa.array([piece.take(o).to_pylist() for o in order], pa.list_(pa.int32())),
        })

    return run


def token_matrix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID,
    pad_id: int = PAD_ID, tokenizer: str | None = None, width: str = "<u2", shard_docs: int = SHARD_DOCS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per packed sequence: ``shard``, ``row``, ``ids`` (binary, padded
    to ``sequence`` numbers of ``width``), ``cu_seqlens`` (0 and the end of each
    segment), ``position_resets`` (where positions start again at 0),
    ``doc_ids`` and ``pieces`` of the segments."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("source_row"), df[id_col].alias("id"), text.alias("t"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    shards = max(1, -(-size["n"] // shard_docs), -(-size["b"] // shard_bytes))
    pieces = rows.mapInArrow(
        bounded(_pieces(sequence, end_id, tokenizer or default_tokenizer(), width), forget), f"source_row long, doc_id {kind}, piece int, ids binary"
    )
    pieces = pieces.select(F.pmod(F.xxhash64("source_row", "piece"), F.lit(shards)).alias("shard"), "doc_id", "piece", "ids")
    schema = (
        f"shard long, row int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>"
    )
    return pieces.groupBy("shard").applyInArrow(_matrix(sequence, pad_id, width), schema)


def write_token_matrix(df: DataFrame, path: str, **options) -> None:
    """Write :func:`token_matrix` as Parquet, one folder per shard range."""
    token_matrix(df, **options).write.parquet(path)
