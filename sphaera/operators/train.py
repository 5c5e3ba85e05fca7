"""Training operators in DataFrame form: T1-T7, T9-T11.

``vectors(role, id, vec ARRAY<FLOAT>)`` holds the three tables: ``u``
(center words), ``v`` (context words) and ``d`` (documents). The synchronous
``batch_step`` (T6) is the oracle-checked definition of one update; the
shard-local trainer (T8, ``sphaera.operators.trainer``) runs the same update
rule in sequential mini-batches inside each shard.

Update rule, with anchor a (context word v or document d), positive center u,
negative center u', f = <u, a>, h = <u', a>, active when f - h < margin:

* u  += alpha (1 - f) (a - f u)
* u' += alpha 2h (h u' - a)
* a  += alpha (1 - (f - h)) (u - f a + h a - u')   (pre-update u, u')

each followed by retraction to the sphere.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera.functions import vectors as M
from sphaera.functions.initgen import init_value_sql
from sphaera.params import ALPHA_FLOOR, EOS
from sphaera.session import write_cut


def init_rows(ids: DataFrame, role: str, dim: int, row_offset, pos_col: str = "id", id_col: str = "id") -> DataFrame:
    """T1 for the rows of ``ids``: the row at stream row ``pos_col`` takes
    elements ``(row_offset + pos) * dim + j``; normalised (T11).

    Arrow-batched: the generator's 65536 states are one table built by its
    rule on each worker, so a vector is a vectorised table lookup. The norm
    is summed element by element in order, as the SQL form does.
    ``row_offset`` is an int."""
    fn = _init_udf(dim, int(row_offset))
    return ids.select(F.lit(role).alias("role"), F.col(id_col).cast("bigint").alias("id"),
                      fn(F.col(pos_col).cast("bigint")).alias("vec"))




def _init_udf(dim: int, row_offset: int):
    from sphaera.functions.arrow_udfs import init_vectors_udf

    return init_vectors_udf(dim, row_offset)



def init_vectors(vocab: DataFrame, doc_ids: DataFrame, dim: int, vocab_size: int) -> DataFrame:
    """Context rows first, then center rows, then documents, as one
    stream; every row is independent, so this is a pure projection."""
    ids = vocab.select(F.col("idx").alias("id"))
    v = init_rows(ids, "v", dim, 0)
    u = init_rows(ids, "u", dim, vocab_size)
    d = init_rows(doc_ids.select(F.col("doc_id").alias("id")), "d", dim, 2 * vocab_size)
    return v.unionByName(u).unionByName(d)


def load_pretrained(vocab: DataFrame, pretrained: DataFrame, role: str, dim: int, normalize: bool = False) -> DataFrame:
    """Rows for the vocabulary from ``pretrained(key, vec)``; words
    missing from the file get random unit vectors from a generator restarted
    at 1 for this file, advancing over missing words in id order. Loaded rows
    are kept as read (the reference does not renormalise them) unless
    ``normalize``. A vector of another length is an error."""
    pre = pretrained.select(F.col("key").alias("word"), F.col("vec"))
    checked = pre.withColumn(
        "vec",
        F.when(F.size("vec") == dim, F.col("vec")).otherwise(
            F.raise_error(F.concat(F.lit(f"expected vectors of {dim} numbers, found "), F.size("vec").cast("string")))
        ),
    )
    j = vocab.select("idx", "word").join(checked, "word", "left")
    hit = j.filter(F.col("vec").isNotNull()).select(F.lit(role).alias("role"), F.col("idx").alias("id"),
                                                    M.to_float("vec").alias("vec"))
    if normalize:
        hit = M.l2_normalize(hit, "vec")
    miss = j.filter(F.col("vec").isNull()).select("idx")
    from sphaera.operators.ordering import with_global_index

    miss = with_global_index(miss, ["idx"], "r")
    rnd = init_rows(miss, role, dim, 0, pos_col="r", id_col="idx")
    return hit.unionByName(rnd)


HEAD_ROWS, HEAD_BYTES = 500_000, 48 << 20
#: ``coalesce`` to more partitions than there are moves nothing, but ends a
#: generated method, which grows too long to be compiled well.
SAME_PARTITIONS = 1 << 24


def _gather(triples: DataFrame, vectors: DataFrame, role: str, key: str, name: str, head: int | None = None) -> DataFrame:
    """Triples with the vector of ``key``. With ``head`` the keys are ranks up
    to it, whose vectors are broadcast."""
    vv = vectors.filter(F.col("role") == role)
    if head is not None:
        vv = F.broadcast(vv.filter(F.col("id") <= head))
    return triples.join(vv.select(F.col("id").alias(key), F.col("vec").alias(name)), key)


def _gather_all(triples: DataFrame, vectors: DataFrame, anchor_role: str, anchor: str, pos: str, dim: int | None) -> DataFrame:
    """Triples with their three vectors. Word ids are ranked by count, so the
    vectors of the most frequent words, as many as a broadcast may hold, meet the
    triples where they are. Only triples with a rarer word need others: while tasks may
    hold the vectors of all (:func:`word_tables`) they look them up there, beyond they are
    shuffled for their words. Those of documents are, once for the document. Where words
    are looked up there are ``f`` and ``h`` too."""
    known = vectors.filter(F.col("role").isin("u", "v")).agg(F.max("id").alias("last"), F.max(F.size("vec")).alias("dim")).first()
    head = min(HEAD_ROWS, HEAD_BYTES // (64 + 4 * (dim or known["dim"] or 1)))
    words = [("u", pos, "u_vec"), ("u", "neg", "n_vec")]
    if anchor_role == "v":
        words.insert(0, ("v", anchor, "a_vec"))

    def gathered(t: DataFrame, most: int | None) -> DataFrame:
        if anchor_role != "v":
            t = _gather(t, vectors, anchor_role, anchor, "a_vec")
        if most is not None:
            t = t.coalesce(SAME_PARTITIONS)
        for role, key, name in words:
            t = _gather(t, vectors, role, key, name, most)
        return t if most is None else t.coalesce(SAME_PARTITIONS)

    if (known["last"] or 0) <= head:
        return gathered(triples, head)
    size = dim or known["dim"]
    table, _ = word_tables(vectors, size, _roles((0,) if anchor_role == "v" else (1,)))
    highest = F.greatest(*[F.col(key) for _, key, _ in words])
    frequent, rare = gathered(triples.filter(highest <= head), head), triples.filter(highest > head)
    if table is None:
        return frequent.unionByName(gathered(rare, None))
    return _with_products(frequent, dim).unionByName(_looked_up(rare, vectors, table, anchor_role, anchor, pos, size))


def _with_products(t: DataFrame, dim: int | None) -> DataFrame:
    return t.withColumn("f", M.dot("u_vec", "a_vec", dim)).withColumn("h", M.dot("n_vec", "a_vec", dim))


def _looked_up(triples: DataFrame, vectors: DataFrame, table, anchor_role: str, anchor: str, pos: str, dim: int) -> DataFrame:
    """Triples with ``f``, ``h`` and, where they are used, the vectors, from the
    words' table that tasks hold."""
    from sphaera.functions.arrow_udfs import dots_udf, vectors_udf

    u = vectors_udf(table, "u")
    if anchor_role == "v":
        t, a = triples, F.col(anchor).cast("bigint")
        a_vec = vectors_udf(table, "v")(a)
    else:
        t, a = _gather(triples, vectors, anchor_role, anchor, "a_vec"), F.col("a_vec").cast("array<float>")
        a_vec = F.col("a_vec")
    p, n = F.col(pos).cast("bigint"), F.col("neg").cast("bigint")
    t = t.withColumn("_x", dots_udf(table, dim, anchor_role)(a, p, n)).filter("_x.f IS NOT NULL")
    return t.withColumns({"f": F.col("_x.f"), "h": F.col("_x.h"), "a_vec": a_vec, "u_vec": u(p), "n_vec": u(n)}).drop("_x")


def margin_forward(triples: DataFrame, vectors: DataFrame, anchor_role: str, anchor: str, pos: str,
                   margin: float, dim: int | None = None) -> DataFrame:
    """``f = <u_pos, anchor>``, ``h = <u_neg, anchor>``, hinge loss and
    the strict ``f - h < margin`` activity flag, over :func:`_gather_all`."""
    t = _gather_all(triples, vectors, anchor_role, anchor, pos, dim)
    t = t if "f" in t.columns else _with_products(t, dim)
    m = F.lit(float(margin))
    return t.withColumn("loss", F.greatest(F.lit(0.0), m - (F.col("f") - F.col("h")))).withColumn(
        "active", (F.col("f") - F.col("h")) < m
    )


def triple_deltas(fwd: DataFrame, anchor_role: str, anchor: str, pos: str, alpha, dim: int | None = None) -> DataFrame:
    """T4 (anchor = context word) / T5 (anchor = document): the three
    gradient steps of every active triple as rows ``(role, id, delta)``.
    (Unrolling these for a known ``dim`` overflows the generated-code size
    limit and falls back to slower interpretation, so they stay array
    functions; ``dim`` is accepted for symmetry.)"""
    a = alpha if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    act = fwd.filter("active")
    f, h = F.col("f"), F.col("h")
    du = F.zip_with("a_vec", "u_vec", lambda av, uv: a * (F.lit(1.0) - f) * (av - f * uv))
    dn = F.zip_with("n_vec", "a_vec", lambda nv, av: a * F.lit(2.0) * h * (h * nv - av))
    da = F.transform(
        F.arrays_zip(F.col("u_vec").alias("u"), F.col("a_vec").alias("x"), F.col("n_vec").alias("n")),
        lambda z: a * (F.lit(1.0) - (f - h)) * (z["u"] - f * z["x"] + h * z["x"] - z["n"]),
    )
    rows = F.array(
        F.struct(F.lit("u").alias("role"), F.col(pos).alias("id"), du.alias("delta")),
        F.struct(F.lit("u").alias("role"), F.col("neg").alias("id"), dn.alias("delta")),
        F.struct(F.lit(anchor_role).alias("role"), F.col(anchor).alias("id"), da.alias("delta")),
    )
    return act.select(F.explode(rows).alias("r")).select("r.role", "r.id", "r.delta")


def sum_deltas(deltas: DataFrame, dim: int) -> DataFrame:
    """Elementwise sum per ``(role, id)`` as ``dim`` plain sums: the
    aggregate combines map-side, so the hottest words cost one partial row
    per task; ``n`` counts the summed rows."""
    g = deltas.groupBy("role", "id").agg(*M.element_aggs("delta", dim), F.count(F.lit(1)).alias("n"))
    return g.select("role", "id", M.element_array(dim).alias("delta"), "n")


def apply_deltas(vectors: DataFrame, summed: DataFrame, reach: float | None = None) -> DataFrame:
    """Add summed deltas (with ``reach`` shortened to that length where they
    are longer) and retract to the sphere; untouched rows pass through."""
    if reach is not None:
        size = F.sqrt(F.aggregate("delta", F.lit(0.0), lambda s, x: s + x * x))
        summed = summed.withColumn("_f", F.when(size > reach, F.lit(reach) / size).otherwise(F.lit(1.0)))
        summed = summed.withColumn("delta", F.transform("delta", lambda x: x * F.col("_f")))
    j = vectors.join(summed.select("role", "id", "delta"), ["role", "id"], "left")
    d = F.col("delta")
    new = F.when(F.col("delta").isNull(), F.col("vec")).otherwise(M.add(F.col("vec").cast("array<double>"), d))
    out = j.select("role", "id", new.alias("vec"), F.col("delta").isNotNull().alias("_t"))
    touched = M.l2_normalize(out.filter("_t"), "vec").drop("_t")
    return out.filter(~F.col("_t")).drop("_t").unionByName(touched)


def batch_step(vectors: DataFrame, word_tr: DataFrame, doc_tr: DataFrame, alpha: float, margin: float,
               dim: int) -> DataFrame:
    """One synchronous step: gradients of all triples from one snapshot,
    deltas summed per row, added, retracted."""
    # array-function dots here: unrolled ones in the same stage as the
    # array-function updates exceed the generated-code limit
    wf = margin_forward(word_tr, vectors, "v", "ctx", "center", margin)
    df_ = margin_forward(doc_tr, vectors, "d", "doc_id", "word", margin)
    deltas = triple_deltas(wf, "v", "ctx", "center", alpha).unionByName(
        triple_deltas(df_, "d", "doc_id", "word", alpha)
    )
    return apply_deltas(vectors, sum_deltas(deltas, dim))


def working_set(positions: DataFrame, vectors: DataFrame, groups: int, dim: int, negative: int, noise,
                kinds: tuple[int, ...] = (0, 1), draws=None) -> DataFrame:
    """The vectors that the triples of every group ``pkey`` touch, once each,
    in blocks of neighbouring ids: ``(wpkey, role, id array, vec array)``. A
    group asks a block for places, and the block answers all groups of a slice
    at once, so rows are per block and not per vector."""
    from sphaera.operators.trainer import BLOCK_BITS, NEED_SCHEMA, WS_SCHEMA, make_take_fn, working_ids

    slices = groups // SLICE + 1
    need = positions.mapInArrow(working_ids(negative, noise, kinds, draws), NEED_SCHEMA).withColumn("sl", F.pmod("wpkey", F.lit(slices)))
    side = F.when(F.col("role") == "w", "d").otherwise(F.col("role")).alias("side")
    v = vectors.select(side, F.shiftright("id", BLOCK_BITS).alias("blk"), "role", "id", "vec")
    v = v.withColumn("sl", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    by = ("side", "blk", "sl")
    return need.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(make_take_fn(dim), WS_SCHEMA)


def _sliced(packed: DataFrame, groups: int, dim: int) -> DataFrame:
    """Packed changes ``(src, role, blk, id array, vec array)`` of many groups
    added up in slices."""
    from sphaera.operators.trainer import SUMS_SCHEMA, make_sum_fn

    slices = groups // SLICE + 1
    if slices > 1:
        sl = F.pmod("src", F.lit(slices)).alias("sl")
        packed = packed.select("role", "blk", "id", "vec", sl).groupBy("role", "blk", "sl").applyInArrow(
            make_sum_fn(dim, False), SUMS_SCHEMA)
    return packed.select("role", "blk", "id", "vec")


def sum_blocks(packed: DataFrame, groups: int, dim: int) -> DataFrame:
    """Packed changes added up per id: ``(role, id, delta)``."""
    from sphaera.operators.trainer import ROWS_SCHEMA, make_sum_fn

    return _sliced(packed, groups, dim).groupBy("role", "blk").applyInArrow(make_sum_fn(dim, True), ROWS_SCHEMA)


def merge_blocks(vectors: DataFrame, packed: DataFrame, groups: int, dim: int, reach: float) -> DataFrame:
    """:func:`apply_deltas` of :func:`sum_blocks`, block by block in NumPy."""
    from sphaera.operators.trainer import BLOCK_BITS, make_merge_fn

    v = vectors.select("role", F.shiftright("id", BLOCK_BITS).alias("blk"), "id", "vec").groupBy("role", "blk")
    packed = _sliced(packed, groups, dim).groupBy("role", "blk")
    return v.cogroup(packed).applyInArrow(make_merge_fn(dim, reach), "role string, id long, vec array<float>")


SLICE = 1024
GROUP_POSITIONS = 400_000


TABLE_BYTES = 192 << 20


def word_tables(vectors: DataFrame, dim: int, roles: tuple[str, ...] = ("u", "v")):
    """The words' vectors as a broadcast :class:`~sphaera.operators.trainer.Words`
    for tasks that look ids up in it, or None where they, by the highest id,
    exceed ``TABLE_BYTES``, which is looked up first; and the rows of a role."""
    import numpy as np

    from sphaera.operators.trainer import Words

    words = vectors.filter(F.col("role").isin(*roles) & F.col("id").isNotNull())
    ends = words.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    if ends["last"] is None or ends["first"] < 0 or 4 * dim * len(roles) * (ends["last"] + 1) > TABLE_BYTES:
        return None, 0
    vec, there = {}, {}
    for role in roles:
        rows = words.filter(F.col("role") == role).select("id", F.col("vec").cast("array<float>").alias("vec")).toArrow().combine_chunks()
        ids = rows.column("id").to_numpy()
        vec[role], there[role] = np.zeros((ends["last"] + 1, dim), np.float32), np.zeros(ends["last"] + 1, bool)
        if len(ids):
            vec[role][ids] = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        there[role][ids] = True
        if there[role].all():
            there[role] = None
    return vectors.sparkSession.sparkContext.broadcast(Words(vec, there)), ends["last"] + 1


def task_count(spark, tokens: int | None, words: int) -> int:
    """Tasks that add changes of ``words`` rows up before they are shuffled: one
    for every core, while each has more tokens than there are words."""
    cores = spark.sparkContext.defaultParallelism
    return cores if tokens is None else max(1, min(cores, tokens // max(words, 1)))


def in_blocks(positions: DataFrame, shard_tokens: int, window: int) -> DataFrame:
    """Positions in blocks ``_b`` of at most ``shard_tokens`` of a document, with
    those of the document within the window beyond either edge, marked as not its ``own``."""
    of = lambda at: F.floor(at / F.lit(min(shard_tokens, GROUP_POSITIONS // 8)))
    first, last = of(F.greatest(F.col("kpos") - window, F.lit(0))), of(F.col("kpos") + window)
    positions = positions.withColumn("_b", F.explode(F.sequence(first, last)))
    return positions.withColumn("own", F.col("_b") == of(F.col("kpos")))


def streamed(positions: DataFrame, vectors: DataFrame, kinds: tuple[int, ...], shard_tokens: int, window: int) -> DataFrame:
    """Plain positions in the order of documents' blocks, the ``first`` of each with
    the vector of its document. Where positions lie by document already, as the
    windows over its tokens leave them, none is shuffled."""
    p = in_blocks(positions, shard_tokens, window)
    order = Window.partitionBy("doc_id", "_b").orderBy("kpos")
    p = p.withColumn("first", F.row_number().over(order) == 1)
    cols = [c for c in ("doc_id", "_b", "part", "seg", "kpos", "idx", "radius", "alpha", "own", "first") if c in p.columns]
    if 1 in kinds:
        d = vectors.filter(F.col("role").isin("d", "w")).select(F.col("id").alias("_id"), F.col("vec").cast("array<float>").alias("_vec"))
        p = p.join(d.dropDuplicates(["_id"]).hint("merge"), F.col("doc_id") == F.col("_id"), "left")  # keeps the order
        cols.append(F.when(F.col("first"), F.col("_vec")).alias("vec"))
    return p.select(*cols)


def _roles(kinds: tuple[int, ...]) -> tuple[str, ...]:
    return ("u", "v") if 0 in kinds else ("u",)


def position_deltas(positions: DataFrame, vectors: DataFrame, alpha: float, margin: float, dim: int, negative: int, noise,
                    kinds: tuple[int, ...] = (0, 1), shard_tokens: int = 100_000, tokens: int | None = None, draws=None) -> DataFrame:
    """T4 (kind 0), T5 (kind 1) or both over position rows: every group of
    positions gets the vectors its triples touch, once each, and sums its steps
    per row before they are shuffled: ``(role, id, delta)``. A document's
    positions need not be in one group. ``tokens`` bounds the positions.
    ``draws``: the positions are plain, the groups find their pairs and draws;
    while the words' vectors fit a broadcast, tasks look them up and add changes
    up themselves, and no position is shuffled (:func:`streamed`)."""
    from sphaera.operators.trainer import DELTAS_SCHEMA, make_delta_fn, make_stream_fn

    words, rows = (None, 0) if draws is None else word_tables(vectors, dim, _roles(kinds))
    if words is not None:
        pos = streamed(positions.withColumn("alpha", F.lit(float(alpha))), vectors, kinds, shard_tokens, draws.window)
        n = task_count(pos.sparkSession, tokens, rows)
        out = pos.coalesce(n).mapInArrow(make_stream_fn(words, margin, negative, noise, dim, kinds, draws), DELTAS_SCHEMA)
        summed = write_cut(sum_blocks(out, n, dim), "deltas")
        words.destroy()
        return summed
    if 0 not in kinds and draws is None:  # documents' triples have no neighbours
        none = F.array().cast("array<bigint>")
        positions = positions.withColumn("off", none).withColumn("center", none).withColumn("wdraw", none)
    pos, n = dealt_groups(positions.withColumn("alpha", F.lit(float(alpha))), shard_tokens, tokens, draws)
    ws = working_set(pos, vectors, n, dim, negative, noise, kinds, draws)
    out = pos.groupBy("pkey").cogroup(ws.groupBy("wpkey")).applyInArrow(
        make_delta_fn(margin, negative, noise, dim, kinds, draws=draws), DELTAS_SCHEMA
    )
    summed = write_cut(sum_blocks(out, n, dim), "deltas")
    pos.unpersist()
    return summed


def position_objective(positions: DataFrame, vectors: DataFrame, margin: float, dim: int, negative: int, noise,
                       shard_tokens: int = 100_000, tokens: int | None = None, draws=None) -> DataFrame:
    """T9 as a forward pass over position rows: ``(kind, mean_loss,
    active_share, n_triples)`` of the given vectors, which nothing changes.
    Groups and tasks as in :func:`position_deltas`; each returns its counters."""
    from sphaera.operators.trainer import make_loss_fn, make_stream_fn

    counters = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(6)]
    words, _ = (None, 0) if draws is None else word_tables(vectors, dim)
    if words is not None:
        pos = streamed(positions.withColumn("alpha", F.lit(0.0)), vectors, (0, 1), shard_tokens, draws.window)
        out = pos.mapInArrow(make_stream_fn(words, margin, negative, noise, dim, (0, 1), draws, loss=True), "stats array<double>")
        sums = write_cut(out.groupBy().agg(*counters), "objective")
        words.destroy()
        return loss_table(sums)
    pos, n = dealt_groups(positions.withColumn("alpha", F.lit(0.0)), shard_tokens, tokens, draws)
    ws = working_set(pos, vectors.select("role", "id", "vec"), n, dim, negative, noise, draws=draws)
    out = pos.groupBy("pkey").cogroup(ws.groupBy("wpkey")).applyInArrow(make_loss_fn(margin, negative, noise, dim, draws=draws), "stats array<double>")
    sums = write_cut(out.groupBy().agg(*counters), "objective")
    pos.unpersist()
    return loss_table(sums)


def loss_table(sums: DataFrame, *keys: str) -> DataFrame:
    """Summed counters ``s0`` to ``s5`` as one row per kind of triple."""
    kinds = [
        F.struct(F.lit(kind).alias("kind"), (F.col(f"s{i}") / F.col(f"s{i + 2}")).alias("mean_loss"),
                 (F.col(f"s{i + 1}") / F.col(f"s{i + 2}")).alias("active_share"), F.col(f"s{i + 2}").cast("bigint").alias("n_triples"))
        for i, kind in ((0, "word"), (3, "doc"))
    ]
    return sums.select(*keys, F.explode(F.array(*kinds)).alias("o")).select(*keys, "o.*")


def dealt_groups(positions: DataFrame, shard_tokens: int, tokens: int | None = None, draws=None) -> tuple[DataFrame, int]:
    """Positions with the number ``pkey`` of their group, kept by group, and the
    number of groups. Blocks of at most ``shard_tokens`` positions of a document
    are dealt by their hash; a group has about ``GROUP_POSITIONS`` of ``tokens``
    (counted, if not given), so that it asks for a vector once. A block of plain
    positions (``draws``) also gets those of its document within the window
    beyond either edge, marked as not its ``own``."""
    tokens = positions.count() if tokens is None else tokens
    n = max(tokens // GROUP_POSITIONS, 1)
    if draws is not None:
        positions, block = in_blocks(positions, shard_tokens, draws.window), F.col("_b")
    else:
        block = F.floor(F.col("kpos") / F.lit(min(shard_tokens, GROUP_POSITIONS // 8)))
    dealt = positions.withColumn("pkey", F.pmod(F.xxhash64("doc_id", block), F.lit(n)).cast("int"))
    return dealt.repartition(min(n, 4096), "pkey").persist(StorageLevel.MEMORY_AND_DISK), n


def alpha_expr(alpha0: float, done, iters: int, train_words: int):
    """``alpha0 * max(1 - done / (iter * N + 1), 1e-4)``."""
    done = done if not isinstance(done, (int, float)) else F.lit(done)
    frac = F.lit(1.0) - done / F.lit(float(iters) * float(train_words) + 1.0)
    return F.lit(float(alpha0)) * F.greatest(frac, F.lit(ALPHA_FLOOR))


def doc_progress(encoded: DataFrame, doc_ids: DataFrame, shards: DataFrame) -> DataFrame:
    """Per document: in-vocabulary tokens incl. its ``</s>`` (``n_words``) and
    the same summed over earlier documents of its shard (``before``). Windows
    are partitioned by shard, whose size the shard plan bounds."""
    n = encoded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    d = doc_ids.join(shards, "doc_id").join(n, "doc_id", "left")
    d = d.withColumn("n_words", F.coalesce(F.col("n"), F.lit(0)) + F.lit(1)).drop("n")
    w = Window.partitionBy("shard").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("before", F.coalesce(F.sum("n_words").over(w), F.lit(0)))


def alpha_schedule(progress: DataFrame, alpha0: float, iters: int, train_words: int, parallel: int) -> DataFrame:
    """T7 per (epoch, document): ``done = epoch * N + parallel * before``,
    i.e. ``parallel`` shards advance together as the reference's threads do."""
    ep = progress.sparkSession.range(iters).select(F.col("id").alias("epoch"))
    e = progress.crossJoin(F.broadcast(ep))
    done = F.col("epoch") * F.lit(train_words) + F.lit(parallel) * F.col("before")
    return e.select("epoch", "doc_id", alpha_expr(alpha0, done, iters, train_words).alias("alpha"))


def epoch_objective(word_fwd: DataFrame, doc_fwd: DataFrame) -> DataFrame:
    """Mean hinge loss, share of active triples and count per kind."""
    def agg(df, kind):
        return df.agg(
            F.lit(kind).alias("kind"),
            F.avg("loss").alias("mean_loss"),
            F.avg(F.col("active").cast("double")).alias("active_share"),
            F.count(F.lit(1)).alias("n_triples"),
        )

    return agg(word_fwd, "word").unionByName(agg(doc_fwd, "doc"))


def epoch_quota(encoded: DataFrame, kept: DataFrame, doc_ids: DataFrame, shards: DataFrame) -> DataFrame:
    """Per shard, documents, in-vocabulary tokens incl. ``</s>`` (the
    reference's per-thread quota unit) and tokens kept by subsampling."""
    n = encoded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    k = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    d = doc_ids.join(shards, "doc_id").join(n, "doc_id", "left").join(k, "doc_id", "left")
    return d.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum(F.coalesce(F.col("n"), F.lit(0))) + F.count(F.lit(1))).cast("bigint").alias("n_words"),
        F.sum(F.coalesce(F.col("k"), F.lit(0))).cast("bigint").alias("n_kept"),
    )
