"""MinHash near-deduplication on word shingles.

1. Every document gets the minima of ``BANDS * ROWS`` universal hashes of its
   shingle set. Documents with equal sets form one class, which takes part
   once, however many copies it has.
2. Classes meet in buckets of equal band minima. Inside a bucket, signatures
   (the low byte of every minimum) are compared; of the graph of pairs that may
   reach the threshold a spanning forest is emitted, so a bucket emits fewer
   edges than it has rows. Large buckets are compared block against block.
3. Components of these edges are candidate families. Inside a family the full
   shingle sets are intersected through an inverted index, and a spanning
   forest of the confirmed links is emitted. Families with many shingles are
   compared block against block.
4. Components of the confirmed links, by alternating large-star and small-star,
   are the groups.

What a search by minima can miss: a pair at similarity 0.85 shares no band with
probability (1 - 0.85^4)^32 = 6e-11 (0.8: 5e-8), and falls below the signature
bound, 5.2 standard deviations under its mean, with about 1e-6.

Defined cases: a null text is empty; a document without words has no shingles,
is linked with nothing and is its own component; repeated rows are copies; a
row with a null identifier takes part by its text and gets the least identifier
of its component (null if there is none); an empty table gives an empty result;
only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_cut
from .components import connected_components
from .shingles import forget, shingles
from .task_memory import bounded

BANDS, ROWS = 32, 4
N_HASHES = BANDS * ROWS
BLOCK_CLASSES = 2048
BLOCK_SHINGLES = 1_000_000
SLICE = 4096

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift hashes of a set, 32 bits each."""
    best = np.full(N_HASHES, 2**32 - 1, np.uint64)
    for i in range(0, len(s), SLICE):
        part = _A[:, None] * s[None, i : i + SLICE]
        part += _B[:, None]
        np.minimum(best, part.min(1) >> np.uint64(32), out=best)
    return best


def _band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _features(k: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("mini", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, bands, mini = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(_band_keys(m))
                    mini.append(m.astype(np.uint8).tobytes())
                else:
                    cls.append(None)
                    bands.append(None)
                    mini.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(mini, pa.binary())], schema=schema)

    return run


def _blocks(rows: DataFrame, key: str, member: str, n_blocks: Column) -> DataFrame:
    """Deal the rows of a key into blocks and give every pair of blocks a group
    (key, lo, hi) of its own; one block is the usual case."""
    d = rows.withColumn("nb", n_blocks).withColumn("own", F.pmod(F.xxhash64(member), F.col("nb")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    d = d.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("nb", "other")
    # a number of tasks of its own: the groups are small in bytes and large in work
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole (key, lo, hi) groups of a sorted partition, many to a table."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not len(t):
            continue
        start = _starts(t, key)[-1]
        if start:
            yield t.slice(0, start).combine_chunks()
        rest = t.slice(start)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _starts(t: pa.Table, key: str) -> np.ndarray:
    new = np.zeros(len(t), bool)
    new[0] = True
    for c in (key, "lo", "hi"):
        a = t.column(c).combine_chunks()
        if pa.types.is_binary(a.type):
            new[1:] |= np.asarray(pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)))
        else:
            v = a.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _forest(n: int, row) -> list[tuple[int, int]]:
    """Spanning forest of the graph in which ``row(i)`` marks i's neighbours."""
    edges, left = [], np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            x = queue.pop()
            found = np.flatnonzero(row(x) & left)
            left[found] = False
            edges += [(x, int(y)) for y in found]
            queue += found.tolist()
    return edges


def _signature_forest(least: int):
    """Spanning forest, bucket by bucket, of pairs with ``least`` equal minima."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def group(sig: np.ndarray, own: np.ndarray, cross: bool) -> list[tuple[int, int]]:
        side = own == own[0]

        def row(i: int) -> np.ndarray:
            near = (sig == sig[i]).sum(1, dtype=np.int16) >= least
            return near & (side != side[i]) if cross else near

        return _forest(len(sig), row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "key"):
            starts = np.append(_starts(t, "key"), len(t))
            sizes = np.diff(starts)
            sig = np.frombuffer(b"".join(t.column("mini").to_pylist()), np.uint8).reshape(-1, N_HASHES)
            two = starts[:-1][sizes == 2]
            near = two[(sig[two] == sig[two + 1]).sum(1) >= least]
            u, v = [near], [near + 1]
            own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
            for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
                e = np.array(group(sig[s : s + n], own[s : s + n], lo[s] != hi[s]), np.int64).reshape(-1, 2) + s
                u.append(e[:, 0])
                v.append(e[:, 1])
            cls = t.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [cls.take(pa.array(np.concatenate(u))), cls.take(pa.array(np.concatenate(v)))], schema=schema
            )

    return run


def exact_forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets with 100 * intersection at least
    ``percent`` * union; with ``side``, of pairs on different sides only."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = 100 * both >= percent * (size[0] + size[1] - both) and (side is None or side[0] != side[1])
        return [(0, 1)] if ok else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    first = np.flatnonzero(new)
    run_of = np.empty(len(flat), np.int64)
    run_of[order] = np.cumsum(new) - 1  # the run of each shingle, set after set
    length = np.diff(np.append(first, len(flat)))
    offset = np.concatenate(([0], np.cumsum(size)))

    def row(i: int) -> np.ndarray:
        runs = run_of[offset[i] : offset[i + 1]]
        runs = runs[length[runs] > 1]
        n = length[runs]
        at = np.repeat(first[runs] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        ok = 100 * both >= percent * (size + size[i] - both)
        return ok & (side != side[i]) if side is not None else ok

    return _forest(len(sets), row)


def _confirm(k: int, percent: int):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "family"):
            starts = np.append(_starts(t, "family"), len(t))
            own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
            cls = t.column("cls").to_pylist()
            u, v = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                at = list(dict(zip(cls[s:e], range(s, e))).values())  # a repeated row is one member
                if len(at) < 2:
                    continue
                sets = [shingles(t.column("text")[i].as_py(), k) for i in at]
                side = own[at] == own[at[0]] if lo[s] != hi[s] else None
                for x, y in exact_forest(sets, percent, side):
                    u.append(cls[at[x]])
                    v.append(cls[at[y]])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=schema)

    return run


def _labelled(df: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, th, n, cls, ...) and the classes (cls, min_id, rep, rows)
    with their group ``grp``."""
    text = df[text_col].cast("string")
    docs = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    feats = write_cut(
        docs.mapInArrow(bounded(_features(k), forget), "id long, th long, n long, cls binary, bands array<long>, mini binary"), "minima"
    )
    # the class's row whose text is read again; identifiers before nulls
    rep = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    classes = write_cut(
        feats.filter("cls is not null").groupBy("cls").agg(
            F.min("id").alias("min_id"), F.min(rep).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"),
            F.first("bands").alias("bands"), F.first("mini").alias("mini"),
        ),
        "classes",
    )
    share = percent / 100
    least = int(N_HASHES * share - 5.2 * (N_HASHES * share * (1 - share)) ** 0.5)
    rows = classes.select("cls", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(full, "key").join(classes.select("cls", "mini"), "cls")
    rows = _blocks(rows, "key", "cls", F.ceil(F.col("n") / BLOCK_CLASSES).cast("long")).drop("n")
    near = rows.mapInArrow(_signature_forest(least), "u binary, v binary")
    families = connected_components(near)

    members = families.join(classes, families["node"] == classes["cls"])
    total = members.groupBy(F.col("root").alias("family")).agg(F.sum("n").alias("total"))
    members = members.join(total, members["root"] == total["family"]).select(
        "family", "cls", F.col("rep.id").alias("r_id"), F.col("rep.th").alias("r_th"), "total"
    )
    texts = docs.join(members, docs["id"].eqNullSafe(members["r_id"]) & (docs["th"] == members["r_th"]))
    texts = _blocks(
        texts.select("family", "cls", "text", "total"), "family", "cls", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("long")
    ).drop("total")
    roots = connected_components(texts.mapInArrow(bounded(_confirm(k, percent), forget), "u binary, v binary"))

    group = F.coalesce("root", "cls")
    labelled = classes.select("cls", "min_id", "rep", "rows").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return feats, labelled.select("cls", "min_id", "rep", "rows", group.alias("grp"))


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (the
    least identifier that links reach, its own included) and ``kept``."""
    feats, labelled = _labelled(df, id_col, text_col, percent, k)
    least_id = labelled.groupBy("grp").agg(F.min("min_id").alias("component"))
    labels = labelled.join(least_id, "grp").select(F.col("cls").alias("l_cls"), "component")
    out = feats.select("id", "n", "cls").join(labels, F.col("cls") == F.col("l_cls"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5
) -> DataFrame:
    """The rows of ``df`` that are kept, all columns as they were: one row of
    every group, the first by identifier (nulls last) and hash of the text, and
    every row without words. Rows are told apart by identifier and hash."""
    feats, labelled = _labelled(df, id_col, text_col, percent, k)
    best = labelled.groupBy("grp").agg(F.min(F.struct("rep", "rows")).alias("b")).select(
        F.col("b.rep.id").alias("k_id"), F.col("b.rep.th").alias("k_th"), (F.col("b.rows") > 1).alias("many")
    )
    wordless = feats.filter("n = 0").select("id", "th").distinct()
    text = df[text_col].cast("string")
    rows = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th")
    )

    def kept(keys: DataFrame) -> DataFrame:
        return rows.join(keys, rows["id"].eqNullSafe(keys["k_id"]) & (rows["th"] == keys["k_th"]), "left_semi")

    every = best.filter("not many").drop("many").unionByName(wordless.toDF("k_id", "k_th"))
    # only a class of several rows can hold the chosen identifier and text again
    once = kept(best.filter("many").drop("many")).dropDuplicates(["id", "th"])
    return kept(every).unionByName(once).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
