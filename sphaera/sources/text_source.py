"""S1-S8, S14 as registered data sources: ``spark.read.format("sphaera_lines")``
and ``spark.read.format("sphaera_vectors")``.

A text folder is read in fixed byte ranges. A range owns the lines that start
in it, so a line's place ``(split, pos)`` is the same in every read, and global
numbers need one count per range but no written copy of the lines. Only ``\\n``
ends a line; a last line without one is kept; files follow each other by name,
those that begin with ``_`` or ``.`` are left out.

``sphaera_lines`` holds ``value`` (bytes). ``sphaera_vectors`` holds a header
``rows dim`` and then a key and ``dim`` numbers in every line; a line of another
length is an error. Bytes of a key that are no UTF-8 go.

Writers give every task a file under a pending folder; the commit moves the
files of the tasks that count to their places and, for vectors, writes the
header, last. What a lost task or an aborted job left is never read. Appending
to a folder that holds rows is an error, since a header counts them.

The files are opened with ``pyarrow.fs`` (local and shared folders, HDFS and
object stores); for a store that only Spark's own readers open, use
:mod:`sphaera.sources.lines`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 1 << 20
SPLIT_BYTES = 64 << 20
HEADER = "head.txt"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def visible_files(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = store.get_file_info(fs.FileSelector(path))
    return sorted((f for f in files if f.type == fs.FileType.File and f.base_name[0] not in "_."), key=lambda f: f.path)


def owned_lines(f, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that start in ``[start, end)``, a list for each block read."""
    begin = max(start - 1, 0)  # a line starts at ``start`` if the byte before ends one
    f.seek(begin)
    skip, tail = start > 0, []
    while block := f.read(CHUNK):
        parts = block.split(b"\n")
        tail.append(parts[0])
        if len(parts) == 1:
            continue
        lines, tail = [b"".join(tail), *parts[1:-1]], [parts[-1]]
        if skip:
            begin += len(lines.pop(0)) + 1
            skip = False
        out = []
        for x in lines:
            if begin >= end:
                break
            out.append(x)
            begin += len(x) + 1
        if out:
            yield out
        if begin >= end:
            return
    last = b"".join(tail)
    if last and not skip and begin < end:
        yield [last]


@dataclass
class Split(InputPartition):
    number: int
    path: str
    start: int
    end: int


class LinesReader(DataSourceReader):
    fields = [("split", pa.int32()), ("pos", pa.int64()), ("value", pa.binary())]

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        store, path = open_folder(self.path)
        spans = [
            (f.path, a, min(a + self.split_bytes, f.size))
            for f in visible_files(store, path) for a in range(0, f.size, self.split_bytes)
        ]
        return [Split(i, *s) for i, s in enumerate(spans)] or [Split(0, "", 0, 0)]

    def lines(self, p: Split) -> Iterator[list[bytes]]:
        if p.path:
            store, _ = open_folder(self.path)
            with store.open_input_file(p.path) as f:
                yield from owned_lines(f, p.start, p.end)

    def columns(self, lines: list[bytes]) -> list[pa.Array]:
        return [pa.array(lines, pa.binary())]

    def read(self, p: Split) -> Iterator[pa.RecordBatch]:
        pos = 0
        for lines in self.lines(p):
            at = np.arange(pos, pos + len(lines))
            pos += len(lines)
            split = pa.array(np.full(len(lines), p.number), pa.int32())
            yield pa.RecordBatch.from_arrays([split, pa.array(at, pa.int64()), *self.columns(lines)], schema=pa.schema(self.fields))


def vector_header(path: str) -> tuple[int, int]:
    """Rows and dimension, as the header names them."""
    store, at = open_folder(path)
    files = visible_files(store, at)
    if files:
        with store.open_input_file(files[0].path) as f:
            head = f.read(200).split(b"\n")[0].split()
        if len(head) == 2 and all(x.isdigit() for x in head):
            return int(head[0]), int(head[1])
    raise ValueError(f"{path}: no header of rows and dimension")


class VectorsReader(LinesReader):
    fields = [("split", pa.int32()), ("pos", pa.int64()), ("key", pa.string()), ("vec", pa.list_(pa.float64()))]

    def partitions(self) -> list[Split]:
        self.dim = vector_header(self.path)[1]
        return super().partitions()

    def lines(self, p: Split) -> Iterator[list[bytes]]:
        head = p.number == 0
        for lines in super().lines(p):
            yield lines[1:] if head else lines
            head = False

    def columns(self, lines: list[bytes]) -> list[pa.Array]:
        dim = vector_header(self.path)[1] if not hasattr(self, "dim") else self.dim
        rows = [x.decode("utf-8", "ignore").strip().split(" ") for x in lines]
        for r in rows:
            if len(r) != dim + 1:
                raise ValueError(f"expected vectors of {dim} numbers, found {len(r) - 1}")
        flat = np.array([x for r in rows for x in r[1:]], dtype=np.float64)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(flat))
        return [pa.array([r[0] for r in rows], pa.string()), vec]


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def encode(self, batch: pa.RecordBatch) -> list[bytes]:
        values = batch.column("value").cast(pa.binary()).to_pylist()
        if any(v is None or b"\n" in v for v in values):
            raise ValueError("a line is null or holds a line feed")
        return values

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, rows = f"part-{task.partitionId():06d}.txt-{task.taskAttemptId()}", 0
        store, path = open_folder(self.path)
        store.create_dir(f"{path}/{self.pending}", recursive=True)
        with store.open_output_stream(f"{path}/{self.pending}/{name}") as f:
            for b in batches:
                lines = self.encode(b)
                rows += len(lines)
                f.write(b"".join(x + b"\n" for x in lines))
        return Written(name, rows)

    def commit(self, messages: list[Written]) -> None:
        store, path = open_folder(self.path)
        store.create_dir(path, recursive=True)
        old = visible_files(store, path)
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds files; appending is not possible")
        for f in sorted(old, key=lambda f: f.base_name != HEADER):  # the header goes first and comes last
            store.delete_file(f.path)
        done = [m for m in messages if m is not None]
        for m in done:
            store.move(f"{path}/{self.pending}/{m.name}", f"{path}/{m.name.rsplit('-', 1)[0]}")
        self.finish(store, path, sum(m.rows for m in done))
        self.abort(messages)

    def finish(self, store: fs.FileSystem, path: str, rows: int) -> None:
        pass

    def abort(self, messages: list[Written]) -> None:
        store, path = open_folder(self.path)
        if store.get_file_info(f"{path}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.pending}")


class VectorsWriter(LinesWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.dim = int(options["dim"])

    def encode(self, batch: pa.RecordBatch) -> list[bytes]:
        out = []
        for key, vec in zip(batch.column("key").cast(pa.string()).to_pylist(), batch.column("vec").to_pylist()):
            if key is None or not key or re.search(r"\s", key):
                raise ValueError(f"no key of a line: {key!r}")
            if vec is None or len(vec) != self.dim:
                raise ValueError(f"expected vectors of {self.dim} numbers, found {vec and len(vec)}")
            out.append((key + " " + "".join("%.6f " % x for x in vec)).encode())
        return out

    def finish(self, store: fs.FileSystem, path: str, rows: int) -> None:
        with store.open_output_stream(f"{path}/{HEADER}") as f:
            f.write(f"{rows} {self.dim}\n".encode())


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sphaera_lines"

    def schema(self) -> str:
        return "split int, pos bigint, value binary"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options), overwrite)


class VectorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sphaera_vectors"

    def schema(self) -> str:
        return "split int, pos bigint, key string, vec array<double>"

    def reader(self, schema) -> VectorsReader:
        return VectorsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VectorsWriter:
        return VectorsWriter(dict(self.options), overwrite)


def register_sources(spark: SparkSession) -> None:
    for source in (LinesSource, VectorsSource):
        spark.dataSource.register(source)


def numbered(rows: DataFrame) -> DataFrame:
    """``line_no`` (from 0) in place of ``split`` and ``pos``."""
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("split", before.alias("first"))  # one row per byte range
    return rows.join(first, "split").withColumn("line_no", F.col("first") + F.col("pos")).drop("split", "pos", "first")


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(line_no, value)`` as :func:`sphaera.sources.lines.read_numbered_lines`."""
    register_sources(spark)
    rows = spark.read.format("sphaera_lines").option("split_bytes", split_bytes).load(path)
    return numbered(rows).select("line_no", F.col("value").cast("string").alias("value"))


def write_lines(lines: DataFrame, order_cols: list[str], path: str) -> None:
    """``value`` in order; the files, by name, are one ordered file."""
    register_sources(lines.sparkSession)
    lines.orderBy(*order_cols).select("value").write.format("sphaera_lines").mode("overwrite").save(path)


def read_vectors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(key, vec)``; a key listed twice keeps its last line."""
    register_sources(spark)
    rows = spark.read.format("sphaera_vectors").option("split_bytes", split_bytes).load(path)
    return rows.groupBy("key").agg(F.max_by("vec", F.struct("split", "pos")).alias("vec"))


def read_doc_vectors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(doc_id, vec)`` by position; the key is ignored."""
    register_sources(spark)
    rows = spark.read.format("sphaera_vectors").option("split_bytes", split_bytes).load(path)
    return numbered(rows.drop("key")).select(F.col("line_no").alias("doc_id"), "vec")


def check_rows(spark: SparkSession, path: str) -> int:
    """The number of rows; an error if the header names another one."""
    register_sources(spark)
    want, got = vector_header(path)[0], spark.read.format("sphaera_vectors").load(path).count()
    if want != got:
        raise ValueError(f"{path}: the header names {want} rows, the body has {got}")
    return got


def write_vectors(emb: DataFrame, key_col: str, order_col: str, dim: int, path: str) -> None:
    """Vectors as text in ``order_col`` order, header first."""
    register_sources(emb.sparkSession)
    rows = emb.orderBy(order_col).select(F.col(key_col).cast("string").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    rows.write.format("sphaera_vectors").option("dim", dim).mode("overwrite").save(path)
