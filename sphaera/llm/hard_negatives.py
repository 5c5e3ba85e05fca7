"""Hard-negative mining over exact integer inner products.

A vector is rotated at random and replaced by its signs, one bit a component.
With it goes its alignment, the inner product t with the unit code c, so that
v = t c + r with r orthogonal to c. What the bits leave over, r, is coded again
in the same way under a further rotation: each of the ``LEVELS`` one-bit codes
takes the residual down to about 0.6 of its length. For an anchor q,

    <v, q> = sum t_k <c_k, q_k> + <r, q_K>,   |<r, q_K>| <= |r| sqrt(|q|^2 - <c_K, q_K>^2)

(Cauchy-Schwarz on the part of q orthogonal to the last code). <c_k, q_k> is
estimated by popcounts of the code against the bit planes of q_k rounded to
``PLANES`` bits, whose rounding error is known per anchor and goes into the
interval. Intervals are certain, so a row is left out only where its score
cannot matter; what survives is scored in integers.

Anchors meet rows in tiles of bounded size on both sides: for the positives
only rows of their own label, for the negatives all. Each tile keeps the best
few per anchor; these meet in a window per anchor.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; a shorter vector counts as ending in zeros; repeated
rows are rows of their own, as anchors too; a null identifier is no anchor and
comes last among equal scores; scores are 64-bit integers, and a component of
2^26 or more after scaling is an error; an empty table gives an empty result;
only the three named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_cut

LEVELS = 4
PLANES = 6
SCALE = 256
TILE_ROWS = 32_768
TILE_ANCHORS = 4_096
LEAST_ROWS = 2_048  # small tables are cut finer, down to this, to use all tasks
AT_ONCE = 1 << 19  # pairs that are estimated at a time


@lru_cache(maxsize=2)
def rotations(dim: int) -> np.ndarray:
    """Fixed random orthogonal matrices, one a level."""
    rng = np.random.default_rng(dim)
    out = []
    for _ in range(LEVELS):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def padded(dim: int) -> int:
    return max(64, -(-dim // 64) * 64)


def matrix(values, dim: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def codes(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes (level, row, word), alignments (level, row) and the
    length of what remains (row)."""
    dim = ints.shape[1]
    r = ints.astype(np.float64)
    bits, align = [], []
    for turn in rotations(dim):
        r = r @ turn.T
        one = r >= 0
        c = np.where(one, 1.0, -1.0) / np.sqrt(dim)
        t = (r * c).sum(1)
        r = r - t[:, None] * c
        bits.append(np.packbits(one, axis=1, bitorder="little").view("<u8"))
        align.append(t)
    return np.array(bits), np.array(align), np.sqrt((r * r).sum(1))


class Anchors:
    """Anchors rotated and cut into bit planes."""

    def __init__(self, ints: np.ndarray):
        dim = ints.shape[1]
        self.dim, q = dim, ints.astype(np.float64)
        self.norm = np.sqrt((q * q).sum(1))
        self.low, self.step, self.error, self.total, self.planes = [], [], [], [], []
        for turn in rotations(dim):
            q = q @ turn.T
            low = q.min(1)
            step = np.maximum((q.max(1) - low) / (2**PLANES - 1), 1e-300)
            u = np.rint((q - low[:, None]) / step[:, None]).clip(0, 2**PLANES - 1).astype(np.uint8)
            rounded = low[:, None] + step[:, None] * u
            self.low.append(low)
            self.step.append(step)
            self.total.append(rounded.sum(1))
            self.error.append(np.sqrt(((q - rounded) ** 2).sum(1)))
            self.planes.append([np.packbits(u >> p & 1, axis=1, bitorder="little").view("<u8") for p in range(PLANES)])

    def interval(self, a: slice, bits: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of anchors ``a`` with coded rows."""
        middle, width = 0.0, 0.0
        for k in range(LEVELS):
            count = np.zeros((len(self.norm[a]), bits.shape[1]), np.int32)
            for p in range(PLANES):
                for w in range(bits.shape[2]):
                    hit = np.bitwise_count(self.planes[k][p][a][:, w, None] & bits[k][None, :, w])
                    count += hit.astype(np.int32) << p
            ones = np.bitwise_count(bits[k]).sum(1)
            along = (2 * (self.low[k][a][:, None] * ones + self.step[k][a][:, None] * count) - self.total[k][a][:, None]) / np.sqrt(self.dim)
            middle = middle + align[k] * along
            width = width + np.abs(align[k]) * self.error[k][a][:, None]
        sure = np.maximum(np.abs(along) - self.error[-1][a][:, None], 0)
        across = np.sqrt(np.maximum(self.norm[a][:, None] ** 2 - sure**2, 0))
        size = np.sqrt((align**2).sum(0) + rest**2)
        width = width + rest * across + 1e-9 * self.norm[a][:, None] * size + 1e-6
        return middle - width, middle + width


def prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows that take part, as ``row``, ``vec_id``, ``label`` and integers ``q``."""
    x = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("long").alias("label"),
                  F.transform(df[vec_col], lambda v: v.cast("double")).alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    far = F.exists("x", lambda v: F.abs(v) >= 2.0**26 / SCALE)
    q = F.transform("x", lambda v: F.floor(v * SCALE).cast("long"))
    q = F.when(far, F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("array<bigint>")).otherwise(q)
    return x.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", q.alias("q"))


def coded(rows: DataFrame, dim: int) -> DataFrame:
    """The rows with their codes; fixed-size values as bytes."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                ints = matrix(part["q"], dim)
                bits, align, rest = codes(ints)
                yield pd.DataFrame({
                    "row": part["row"], "vec_id": part["vec_id"], "named": part["named"], "label": part["label"],
                    "ints": [v.astype("<i4").tobytes() for v in ints],
                    "bits": [v.tobytes() for v in bits.transpose(1, 0, 2)],
                    "align": [v.tobytes() for v in align.T], "rest": rest})

    # pandas has no null integers: a null identifier is 0 and not ``named``
    rows = rows.select("row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("named"), "label", "q")
    return rows.mapInPandas(run, "row long, vec_id long, named boolean, label long, ints binary, bits binary, align binary, rest double")


def _stack(column: pd.Series, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), *shape)


class _Tile:
    """Both sides of a tile as arrays."""

    def __init__(self, anchors: pd.DataFrame, rows: pd.DataFrame, dim: int):
        words = dim // 64
        self.ints = _stack(rows["ints"], "<i4", dim).astype(np.int64)
        self.bits = np.ascontiguousarray(_stack(rows["bits"], "<u8", LEVELS, words).transpose(1, 0, 2))
        self.align = np.ascontiguousarray(_stack(rows["align"], "<f8", LEVELS).T)
        self.rest = rows["rest"].to_numpy(np.float64)
        self.ids, self.named = rows["vec_id"].to_numpy(np.int64), rows["named"].to_numpy(bool)
        self.label, self.row = rows["label"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
        self.q = _stack(anchors["ints"], "<i4", dim).astype(np.int64)
        self.q_label, self.q_row = anchors["label"].to_numpy(np.int64), anchors["row"].to_numpy(np.int64)
        self.anchors = Anchors(self.q)

    def parts(self):
        """Blocks of anchors and rows with the bounds of their pairs."""
        n, m = len(self.rest), len(self.q)
        wide = min(n, 4096)
        tall = max(1, AT_ONCE // wide)
        for a in range(0, m, tall):
            for r in range(0, n, wide):
                part = slice(r, min(r + wide, n))
                at = slice(a, min(a + tall, m))
                yield at, part, *self.anchors.interval(at, self.bits[:, part], self.align[:, part], self.rest[part])

    def score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            out[s] = np.einsum("ij,ij->i", self.q[i[s]], self.ints[j[s]])
        return out


def _nth_best(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row (-inf: there are fewer)."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, n - 1, axis=1)[:, n - 1]


class _Best:
    """The best few found so far for each key."""

    def __init__(self, n: int, keys: int):
        self.n, self.found = n, [np.zeros(0, np.int64)] * 3
        self.floor = np.full(keys, -np.inf)

    def add(self, tile: _Tile, key: np.ndarray, score: np.ndarray, j: np.ndarray) -> None:
        key, score, j = (np.concatenate(p) for p in zip(self.found, (key, score, j)))
        order = np.lexsort((tile.row[j], tile.ids[j], ~tile.named[j], -score, key))
        key, score, j = key[order], score[order], j[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        keep = nth < self.n
        last = keep & (nth == self.n - 1)
        self.floor[key[last]] = score[last]
        self.found = [key[keep], score[keep], j[keep]]


def _positives(dim: int, n: int):
    names = ["a_row", "p_row", "id", "named", "score"]

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        t = _Tile(anchors, rows, dim)
        best = _Best(n, len(t.q))
        for at, part, low, high in t.parts():
            itself = t.q_row[at][:, None] == t.row[part][None, :]
            low[itself] = high[itself] = -np.inf
            bar = np.maximum(_nth_best(low, n), best.floor[at])
            i, j = np.nonzero((high >= bar[:, None]) & ~itself)
            i, j = i + at.start, j + part.start
            best.add(t, i, t.score(i, j), j)
        i, score, j = best.found
        return pd.DataFrame({"a_row": t.q_row[i], "p_row": t.row[j], "id": t.ids[j], "named": t.named[j], "score": score})

    return run


def _negatives(dim: int, n: int, low_percent: int, high_percent: int):
    names = ["a_row", "nth", "n_row", "id", "named", "score"]

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        t = _Tile(anchors, rows, dim)
        scores = [np.asarray(s, np.int64) for s in anchors["scores"]]
        most = max(len(s) for s in scores)
        p = np.zeros((len(scores), most), np.int64)
        has = np.zeros(p.shape, bool)
        for i, s in enumerate(scores):
            p[i, : len(s)], has[i, : len(s)] = s, True
        best = _Best(n, p.size)
        for at, part, low, high in t.parts():
            other = t.q_label[at][:, None] != t.label[part][None, :]
            for nth in range(most):
                s = p[at, nth][:, None]
                floor, ceiling = low_percent * s / 100, high_percent * s / 100
                may = other & (high >= floor) & (low <= ceiling) & has[at, nth][:, None]
                sure = np.where(may & (low >= floor) & (high <= ceiling), low, -np.inf)
                key = np.arange(at.start, at.stop) * most + nth
                may &= high >= np.maximum(_nth_best(sure, n), best.floor[key])[:, None]
                i, j = np.nonzero(may)
                i, j = i + at.start, j + part.start
                score = t.score(i, j)
                inside = (low_percent * p[i, nth] <= 100 * score) & (100 * score <= high_percent * p[i, nth])
                best.add(t, (i * most + nth)[inside], score[inside], j[inside])
        key, score, j = best.found
        return pd.DataFrame({"a_row": t.q_row[key // most], "nth": key % most + 1, "n_row": t.row[j], "id": t.ids[j], "named": t.named[j], "score": score})

    return run


def _parts(n, size: int):
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def hard_negatives(
    df: DataFrame, anchors_every: int = 50, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50,
    high_percent: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    tile_rows: int = TILE_ROWS, tile_anchors: int = TILE_ANCHORS,
) -> DataFrame:
    """For each row whose identifier is divisible by ``anchors_every`` and each
    of its ``n_positives`` best rows of the same label: the ``n_negatives`` best
    rows of another label that score between the two shares of the positive's
    score. ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``."""
    spark = df.sparkSession
    rows = write_cut(prepared(df, id_col, vec_col, label_col), "vectors")
    size = rows.agg(F.max(F.size("q")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim = padded(size["dim"] or 0)
    data = write_cut(coded(rows, dim), "codes")
    # fresh columns: both sides of a tile come from one table
    anchors = data.filter(F.col("named") & (F.col("vec_id") % anchors_every == 0)).select(*[F.col(c).alias(c) for c in ("row", "vec_id", "label", "ints")])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = max(1, min(tasks, size["n"] // LEAST_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # positives: tiles of one label
    labels = data.groupBy(F.col("label").alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("named") & (F.col("vec_id") % anchors_every == 0), 1)).alias("na"))
    labels = labels.filter("na > 0").select(
        "l", _parts(F.col("n"), min(tile_rows, max(LEAST_ROWS, size["n"] // fine))).alias("nr"), _parts(F.col("na"), tile_anchors).alias("na"))
    own = lambda d: d.join(labels, d["label"] == labels["l"]).drop("l")
    left = own(anchors.select("row", "label", "ints")).withColumn("ap", deal(F.col("na"))).withColumn("rp", spread(F.col("nr"))).drop("nr", "na")
    right = own(data).withColumn("rp", deal(F.col("nr"))).withColumn("ap", spread(F.col("na"))).drop("nr", "na")
    keys = ("label", "ap", "rp")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _positives(dim, n_positives), "a_row long, p_row long, id long, named boolean, score long").withColumn("p_id", F.when(F.col("named"), F.col("id")))
    best = Window.partitionBy("a_row").orderBy(F.col("score").desc(), F.col("p_id").asc_nulls_last(), "p_row")
    positives = write_cut(found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n_positives), "positives")

    # negatives: tiles of all rows
    n_rows = max(-(-size["n"] // tile_rows), fine)
    lists = positives.groupBy(F.col("a_row").alias("row")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", "score"))), lambda p: p["score"]).alias("scores"))  # n_positives at most
    n_anchors = lists.count()
    n_anchors = max(1, -(-n_anchors // tile_anchors))
    left = anchors.select("row", "label", "ints").join(lists, "row").withColumn("ap", deal(F.lit(n_anchors))).withColumn("rp", spread(F.lit(n_rows)))
    right = data.withColumn("rp", deal(F.lit(n_rows))).withColumn("ap", spread(F.lit(n_anchors)))
    found = left.groupBy("ap", "rp").cogroup(right.groupBy("ap", "rp")).applyInPandas(
        _negatives(dim, n_negatives, low_percent, high_percent), "a_row long, nth int, n_row long, id long, named boolean, score long")
    found = found.withColumn("n_id", F.when(F.col("named"), F.col("id")))
    best = Window.partitionBy("a_row", "nth").orderBy(F.col("score").desc(), F.col("n_id").asc_nulls_last(), "n_row")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    names = anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    return found.join(positives.select("a_row", "nth", "p_id", F.col("score").alias("positive_score")), ["a_row", "nth"]).join(names, "a_row").select(
        "anchor_id", F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
