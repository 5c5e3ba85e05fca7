"""Trie of conversation prefixes in minimal-perfect-hash node tables.

A turn is a 120-bit digest of its role and text, and a prefix the exclusive-or
of one 64-bit number pair per turn, drawn from the turn's digest and its depth.
That is associative, so digests of a conversation's prefixes come from a scan
over blocks of ``BAND`` turns. Equal conversations are folded into one with
their number; its prefixes, grouped by digest, are the nodes. Every group is
checked to hold one last turn, one parent and one depth, so that by induction
equal digests are equal prefixes; two that differ are an error.

Nodes are dealt into shards by subtree. A node is heavy if the conversations
through it hold over ``HEAVY`` more turns of its band; all else hangs below in
subtrees of at most that many nodes, and shards are made up of whole ones. In a
shard each digest gets a slot of a minimal perfect hash, checked against the
digest stored there; counts are scattered into flat arrays and summed along the
parent slots, deepest first. The sums of a shard's tops reach the nodes above by a
partial aggregation: band by band from the deepest, and level by level over the
heavy nodes of a band, which are at most (turns / HEAVY) a level.

Defined cases: rows without ``conv_id`` take no part; null turns come first,
null role or text is empty; turns with one number come by role, then by a
digest of the text; ``c % 20`` has the sign of c; repeated rows are turns of
their own; an empty table gives an empty result; only the four named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_global_index
from ..session import write_cut

BAND = 8192  # turns of a conversation that one band holds
HEAVY = 8192  # turns below a node from which it is not in a shard
SHARD = 65_536  # nodes of a shard, about
ENDS = 4096  # identifiers that travel as one row
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit numbers: keys that are
    alone in their place of a level stay there, the others go on to the next;
    a slot is the rank of the place. A slot stores its key, so that a key that
    is not in the table is found out."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, self.stored = len(keys), [], np.zeros((len(keys), 2), np.uint64)
        rest, base = np.arange(len(keys)), 0
        while len(rest):
            size = 2 * len(rest) + 1
            at = self._place(keys[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slot = base - 1 + np.cumsum(alone)
            self.levels.append((alone, slot))
            stay = alone[at]
            self.stored[slot[at[stay]]] = keys[rest[stay]]
            base += int(stay.sum())
            rest = rest[~stay]
            if len(self.levels) > 60:
                raise ValueError("keys of a perfect hash are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys[:, 0] ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        for x in (keys[:, 1], keys[:, 0]):
            h = (h ^ (h >> np.uint64(31)) ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for a key that is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._place(keys[open_], level, len(alone))
            here = alone[at]
            found, s = open_[here], slot[at[here]]
            same = (self.stored[s] == keys[found]).all(1)
            out[found[same]] = s[same]
            open_ = open_[~here]
        return out


def accumulate(depth, parent, n_convs, words, children, leaves, saved) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children, leaves and saved tokens of nodes, given what comes from
    outside; ``parent`` is a slot or -1."""
    children, leaves, saved = children.copy(), leaves.copy(), saved + (n_convs - 1) * words
    inside = parent >= 0
    np.add.at(children, parent[inside], 1)
    leaves += children == 0
    order = np.argsort(-depth, kind="stable")
    for nodes in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        nodes = nodes[inside[nodes]]
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    return children, leaves, saved


def _shard(nodes: pd.DataFrame) -> pd.DataFrame:
    keys = nodes[["x1", "x2"]].to_numpy(np.int64).view(np.uint64)
    table = PerfectHash(keys)
    slot = table(keys)

    def scattered(name):
        out = np.zeros(table.n, np.int64)
        out[slot] = nodes[name].to_numpy(np.int64)
        return out

    parent = np.full(table.n, -1, np.int64)
    parent[slot] = table(nodes[["p1", "p2"]].to_numpy(np.int64).view(np.uint64))
    depth, conv = scattered("depth"), scattered("conv")
    children, leaves, saved = accumulate(
        depth, parent, *(scattered(c) for c in ("n_convs", "words", "in_children", "in_leaves", "in_saved")))
    out = nodes[["x1", "x2", "p1", "p2", "depth", "conv", "n_convs"]].copy()
    top = parent[slot] < 0
    out["parent_conv"], out["top"] = np.where(top, 0, conv[parent[slot]]), top
    out["children"], out["leaves"], out["saved"] = children[slot], leaves[slot], saved[slot]
    return out


NODE = "x1 long, x2 long, p1 long, p2 long, depth long, conv long, n_convs long"
DONE = f"{NODE}, parent_conv long, top boolean, children long, leaves long, saved long"


def turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns as (conv, pos from 1, digest t1 t2, words of the text)."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = df.select(
        df[conv_col].cast("long").alias("conv"), df[turn_col].alias("turn"), role.alias("role"),
        *[F.conv(F.substring(digest, i, 15), 16, 10).cast("long").alias(n) for i, n in ((1, "t1"), (16, "t2"))],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).filter("conv IS NOT NULL")
    rows = with_global_index(rows, ["conv", F.col("turn").asc_nulls_first(), "role", "t1", "t2"], "idx")
    first = rows.groupBy(F.col("conv").alias("c")).agg(F.min("idx").alias("first"))
    return rows.join(first, rows["conv"] == first["c"]).select(
        "conv", (F.col("idx") - F.col("first") + 1).alias("pos"), "t1", "t2", "words")


def rebuilt(own: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first h turns from the first of their
    group: (conv, depth, t1, t2, words), and all identifiers."""
    size = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = size.select("conv", (F.crc32(F.col("conv").cast("string")) % 4).alias("h"),
                        (F.col("conv") - F.col("conv") % group).alias("base"))
    base = size.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = write_cut(convs.join(base, "base", "left").select(
        "conv", "h", "base", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).alias("head")), "conversations")
    heads = own.filter("pos <= 3").select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "t1", "t2", "words")
    heads = convs.join(heads, "base").filter("depth <= h").select("conv", "depth", "t1", "t2", "words")
    tails = own.join(convs, "conv").filter("pos > h")
    tails = tails.select("conv", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "words")
    return heads.unionByName(tails), convs.select("conv")


def prefixes(rows: DataFrame, band: int) -> DataFrame:
    """Digest (x1, x2) of each prefix and its parent's (p1, p2)."""
    rows = rows.withColumn("band", F.floor((F.col("depth") - 1) / band).cast("int"))
    w = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.bit_xor(f"z{k}").over(w).alias(f"x{k}") for k in (1, 2)])
    if rows.agg(F.max("band")).first()[0]:
        before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy("conv", "band").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
        blocks = blocks.select("conv", "band", *[F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)])
        out = out.join(blocks, ["conv", "band"]).withColumns({f"x{k}": F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2)})
    return out.withColumns({f"p{k}": F.col(f"x{k}").bitwiseXOR(F.col(f"z{k}")) for k in (1, 2)})


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x1, x2, conv): runs of one node as comma-joined identifiers."""
    for b in batches:
        x1, x2, conv = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "x2", "conv"))
        new = np.flatnonzero((np.diff(x1) != 0) | (np.diff(x2) != 0)) + 1
        starts = sorted({0, *new.tolist(), *range(0, len(conv), ENDS)}) if len(conv) else []
        text = conv.astype(str).tolist()
        at = pa.array(starts, pa.int64())
        ids = [",".join(text[a:z]) for a, z in zip(starts, [*starts[1:], len(text)])]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("x1", "x2", "conv")), pa.array(ids, pa.string())],
                                         names=["x1", "x2", "conv", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of identifiers: one SHA-256 a node, a run at a time."""
    key, sha, out = None, None, []

    def taken():
        rows = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["e1", "e2", "ends"])

    for b in batches:
        for x1, x2, ids in zip(*(b.column(c).to_pylist() for c in ("x1", "x2", "ids"))):
            if (x1, x2) == key:
                sha.update(b",")
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (x1, x2), hashlib.sha256()
            sha.update(ids.encode())
        yield taken()
    if key:
        out.append((*key, sha.hexdigest()))
        yield taken()


def ends(last: DataFrame) -> DataFrame:
    """SHA-256 of the identifiers that end in each node (x1, x2, conv)."""
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = last.repartitionByRange(n, "x1", "x2", "conv").sortWithinPartitions("x1", "x2", "conv")
    runs = runs.mapInArrow(_join_ids, "x1 long, x2 long, conv long, ids string")
    runs = runs.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "conv")
    return runs.mapInArrow(_hash_ids, "e1 long, e2 long, ends string")


def _above(done: DataFrame) -> DataFrame:
    """What nodes give to their parents."""
    return done.groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))


def _given(nodes: DataFrame, given: DataFrame | None) -> DataFrame:
    names = ("in_children", "in_leaves", "in_saved")
    if given is None:
        return nodes.withColumns({c: F.lit(0).cast("long") for c in names})
    return nodes.join(given, ["x1", "x2"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    rebuild: bool = True, band: int = BAND, heavy: int = HEAVY, shard: int = SHARD,
) -> DataFrame:
    """One row per distinct prefix: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Without ``rebuild`` conversations are
    taken as they are."""
    own = write_cut(turns(df, conv_col, turn_col, role_col, text_col), "turns")
    if rebuild:
        rows, convs = rebuilt(own)
    else:
        rows, convs = own.withColumnRenamed("pos", "depth"), own.select("conv").distinct()
    z = {f"z{k}": F.xxhash64("t1", "t2", "depth", F.lit(k)) for k in (1, 2)}
    rows = write_cut(rows.withColumns(z), "rebuilt")
    last = rows.groupBy("conv").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.max("depth").alias("len"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    last = write_cut(convs.join(last, "conv", "left").select("conv", zero("x1"), zero("x2"), zero("len")), "ends")
    kinds = last.groupBy("x1", "x2", "len").agg(F.count(F.lit(1)).alias("m"), F.min("conv").alias("conv"))
    kinds = write_cut(kinds.select("conv", "m", "len"), "kinds")

    # prefixes of distinct conversations, with the turns of their band that follow
    pre = prefixes(rows.join(kinds, "conv"), band)
    follow = F.least(F.col("len"), (F.col("band") + 1) * band) - F.col("depth")
    pre = write_cut(pre.select("conv", "m", "depth", "band", "x1", "x2", "p1", "p2", "t1", "t2", "words", follow.alias("follow")), "prefixes")
    big = pre.groupBy(F.col("x1").alias("h1"), F.col("x2").alias("h2")).agg(F.sum("follow").alias("s")).filter(F.col("s") > heavy).drop("s")
    big = write_cut(big, "heavy")
    w = Window.partitionBy("conv", "band")  # at most `band` rows
    is_big = pre.join(big, (pre["x1"] == big["h1"]) & (pre["x2"] == big["h2"]), "left").withColumn("big", F.col("h1").isNotNull())
    top = F.min(F.when(~F.col("big"), F.struct("depth", "x1", "x2"))).over(w)
    pre = is_big.withColumn("anchor", F.when(~F.col("big"), F.xxhash64(top["x1"], top["x2"])))
    same = F.struct("depth", "t1", "t2", "p1", "p2")
    nodes = pre.groupBy("x1", "x2").agg(
        F.min(same).alias("a"), F.max(same).alias("b"), F.sum("m").alias("n_convs"), F.min("conv").alias("conv"),
        F.max("words").alias("words"), F.min("anchor").alias("anchor"), F.min("band").alias("band"))
    one = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("struct<depth:bigint,t1:bigint,t2:bigint,p1:bigint,p2:bigint>"))
    nodes = nodes.select("x1", "x2", one.alias("a"), "n_convs", "conv", "words", "anchor", "band")
    nodes = nodes.select("x1", "x2", "a.p1", "a.p2", F.col("a.depth").cast("long").alias("depth"), "conv", "n_convs", "words", "anchor", "band")
    nodes = write_cut(nodes, "nodes")
    bands = {r["band"]: r for r in nodes.groupBy("band").agg(
        F.count("anchor").alias("light"), F.max(F.when(F.col("anchor").isNull(), F.col("depth"))).alias("deep"),
        F.min(F.when(F.col("anchor").isNull(), F.col("depth"))).alias("high")).collect()}  # one row per `band` turns of depth

    done, given = [], None
    for b in sorted(bands, reverse=True):
        part = nodes.filter(F.col("band") == b)
        shards = max(1, -(-bands[b]["light"] // shard))
        light = _given(part.filter(F.col("anchor").isNotNull()), given)
        light = light.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        light = write_cut(light.groupBy("shard").applyInPandas(_shard, DONE), "shards")
        done.append(light)
        up = _above(light.filter("top"))
        if bands[b]["deep"] is not None:
            heavies = part.filter(F.col("anchor").isNull())
            if given is not None:
                up = up.unionByName(given)
            for d in range(bands[b]["deep"], bands[b]["high"] - 1, -1):
                sums = up.groupBy("x1", "x2").agg(*[F.sum(c).alias(c) for c in ("in_children", "in_leaves", "in_saved")])
                level = _given(heavies.filter(F.col("depth") == d), sums)
                level = level.select(
                    "x1", "x2", "p1", "p2", "depth", "conv", "n_convs", F.lit(0).cast("long").alias("parent_conv"), F.lit(True).alias("top"),
                    F.col("in_children").alias("children"), F.col("in_leaves").alias("leaves"),
                    (F.col("in_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
                level = write_cut(level, "heavy-level")
                done.append(level)
                up = up.unionByName(_above(level))
        given = write_cut(up.groupBy("x1", "x2").agg(*[F.sum(c).alias(c) for c in ("in_children", "in_leaves", "in_saved")]), "given")

    root = last.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "p1", "p2", "depth")], "conv", "n_convs")
    root = _given(root, given).select(
        "x1", "x2", "p1", "p2", "depth", "conv", "n_convs", F.lit(0).cast("long").alias("parent_conv"), F.lit(True).alias("top"),
        F.col("in_children").alias("children"), F.greatest("in_leaves", F.lit(1)).alias("leaves"), F.col("in_saved").alias("saved"))
    done = write_cut(reduce(DataFrame.unionByName, [root, *done]), "trie")
    # parents of tops: the root, heavy nodes and the last nodes of a band
    above = done.join(nodes.filter("anchor IS NULL").select("x1", "x2"), ["x1", "x2"], "left_semi")
    above = above.unionByName(done.filter(F.col("depth") % band == 0)).select(
        F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv").alias("q_conv")).distinct()
    tops = done.filter("top AND depth > 0")
    tops = tops.join(above, (tops["p1"] == above["q1"]) & (tops["p2"] == above["q2"])).withColumn("parent_conv", F.col("q_conv"))
    names = ["x1", "x2", "depth", "conv", "parent_conv", "n_convs", "children", "leaves", "saved"]
    out = done.filter("NOT top").select(*names).unionByName(tops.select(*names)).unionByName(
        done.filter("depth = 0").withColumn("parent_conv", F.lit(None).cast("long")).select(*names))
    e = ends(last.select("x1", "x2", "conv"))
    out = out.join(e, (out["x1"] == e["e1"]) & (out["x2"] == e["e2"]), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
