"""Registered operator queries: each a Spark plan over the driver tables and,
where the operator is deterministic, the DuckDB statement it must equal.

Defaults of the registered plans: ``min_count`` 5, ``window`` 5, ``negative``
2, ``sample`` 1e-3, seed 1, epoch 0, ``dim`` 8 for the vector oracles, 16
byte-balanced shards. Every plan reads whole tables; floating results are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera.operators import corpus as C
from sphaera.operators import pairs as G
from sphaera.operators import sampling as P
from sphaera.operators import vocab as V
from sphaera.params import MAX_SEGMENT, MAX_TOKEN_BYTES
from sphaera.plans import sqlparts as S
from sphaera.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIN_COUNT = 5
WINDOW = 5
NEGATIVE = 2
SAMPLE = 1e-3
SEED = 1
EPOCH = 0
DIM = 8
SHARDS = 16


_BUILT: dict[tuple, object] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def query(spark, sf):
            _BUILT.clear()
            return fn(spark, sf)

        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def once(fn):
    """Build a shared input once per query: a vocabulary costs a written table
    each time, so the parts of one plan use the same."""

    @wraps(fn)
    def build(*args):
        key = (fn.__name__, *args)
        if key not in _BUILT:
            _BUILT[key] = fn(*args)
        return _BUILT[key]

    return build


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared Spark


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "text")


def tokens(spark, sf):
    return C.tokenize(docs(spark, sf))


@once
def vocab(spark, sf, min_count=MIN_COUNT):
    return V.build_vocab(tokens(spark, sf), docs(spark, sf), min_count).cache()


@once
def text_size(spark, sf):
    return C.text_size(docs(spark, sf))


def longest(spark, sf):
    return text_size(spark, sf)[1]


@once
def encoded(spark, sf):
    """Documents are dealt by id before they are cut into tokens, so that the
    windows over a document's tokens need no further shuffle."""
    n = C.text_partitions(text_size(spark, sf)[0], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return C.encode_tokens(C.tokenize(docs(spark, sf).repartition(n, "doc_id")), vocab(spark, sf), longest=longest(spark, sf))


@once
def sampling_state(spark, sf):
    v = vocab(spark, sf)
    hist = P.noise_histogram(v).cache()
    sc = P.corpus_scalars(v, hist)
    return v, hist, sc


def kept(spark, sf, sc, max_segment=None):
    k = P.subsample(encoded(spark, sf), sc, SAMPLE, SEED, EPOCH)
    k = C.segment(k, max_segment, longest=longest(spark, sf))
    return P.dynamic_window(k, WINDOW, SEED, EPOCH)


# ------------------------------------------------------------------- corpus

BASE = S.with_(S.tok())


@register("c1_tokenize", BASE + "SELECT doc_id, pos, word FROM tok")
def q_c1(spark, sf):
    return tokens(spark, sf).select("doc_id", F.col("pos").cast("bigint"), "word")


@register(
    "c2_doc_boundaries",
    "SELECT doc_id, (1 + len(list_filter(regexp_split_to_array(replace(text, chr(13), ''), '[ \\t\\n]+'), "
    "lambda x: x = '</s>')))::BIGINT AS n_docs FROM documents",
)
def q_c2(spark, sf):
    d = C.doc_boundaries(load(spark, sf, "documents").select("doc_id", "text"))
    return d.groupBy(F.col("src_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_docs"))


@register(
    "c3_truncate_token",
    S.with_(S.tok("replace(text, ' ', '_')")) + f"SELECT doc_id, pos, {S.cut_token('word')} AS word FROM tok",
)
def q_c3(spark, sf):
    """Whole lines as tokens (blanks become underscores), cut to 98 bytes."""
    d = docs(spark, sf).withColumn("text", F.replace("text", F.lit(" "), F.lit("_")))
    return C.tokenize(d, max_bytes=MAX_TOKEN_BYTES).select("doc_id", F.col("pos").cast("bigint"), "word")


@register(
    "c4_corpus_stats",
    "SELECT (count(*) + sum(m))::BIGINT AS n_docs, (sum(n) - sum(m))::BIGINT AS n_tokens, "
    "(sum(n) + count(*))::BIGINT AS n_words_read, sum(b)::BIGINT AS n_bytes FROM ("
    "SELECT len(a) AS n, len(list_filter(a, lambda x: x = '</s>')) AS m, strlen(text) + 1 AS b FROM ("
    "SELECT text, list_filter(regexp_split_to_array(replace(text, chr(13), ''), '[ \\t\\n]+'), lambda x: x <> '') AS a "
    "FROM documents))",
)
def q_c4(spark, sf):
    return C.corpus_stats(load(spark, sf, "documents"))


OFFSETS_SQL = (
    "offs AS (SELECT doc_id, sum(strlen(text) + 1) OVER (ORDER BY doc_id) - (strlen(text) + 1) AS start_off, "
    "sum(strlen(text) + 1) OVER (ORDER BY doc_id) AS end_off FROM documents)"
)


@register(
    "c5_doc_offsets",
    S.with_(OFFSETS_SQL) + "SELECT doc_id, start_off::BIGINT AS start_off, end_off::BIGINT AS end_off FROM offs",
)
def q_c5(spark, sf):
    return C.doc_offsets(load(spark, sf, "documents"))


@register(
    "c6_doc_at_offset",
    S.with_(
        OFFSETS_SQL,
        "tot AS (SELECT max(end_off) AS total FROM offs)",
        "p AS (SELECT i::BIGINT AS pos_id, (i * (total // 64))::BIGINT AS pos FROM tot, range(64) r(i))",
    )
    + "SELECT pos_id, pos, doc_id FROM (SELECT p.pos_id, p.pos, o.doc_id, row_number() OVER "
    "(PARTITION BY p.pos_id ORDER BY o.end_off) AS rn FROM p JOIN offs o ON o.end_off > p.pos) WHERE rn = 1",
)
def q_c6(spark, sf):
    offs = C.doc_offsets(load(spark, sf, "documents")).cache()
    total = offs.agg(F.max("end_off").alias("t"))
    pos = spark.range(64).crossJoin(total).select(
        F.col("id").alias("pos_id"), (F.col("id") * F.floor(F.col("t") / 64)).cast("bigint").alias("pos")
    )
    return C.doc_at_offset(offs, pos)


@register(
    "c7_balanced_shards",
    S.with_(OFFSETS_SQL, "tot AS (SELECT max(end_off) AS total FROM offs)")
    + f"SELECT doc_id, least({SHARDS - 1}, (start_off * {SHARDS}) // total)::BIGINT AS shard FROM offs, tot",
)
def q_c7(spark, sf):
    s = C.balanced_shards(C.doc_offsets(load(spark, sf, "documents")), SHARDS)
    return s.select("doc_id", F.col("shard").cast("bigint"))


ENC = S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT), S.enc())


@register("c8_encode_tokens", ENC + "SELECT doc_id, pos, idx FROM enc")
def q_c8(spark, sf):
    return encoded(spark, sf).select("doc_id", "pos", "idx")


KEPT = S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT), S.enc(), S.kept(SEED, SAMPLE, EPOCH, WINDOW))


SEGMENTED = S.with_(
    S.tok(), S.counts(), S.vocab(MIN_COUNT), S.enc(), S.kept(SEED, SAMPLE, EPOCH, WINDOW, MAX_SEGMENT)
)


@register("c9_segment_documents", SEGMENTED + "SELECT doc_id, seg, kpos, idx FROM kept")
def q_c9(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    k = kept(spark, sf, sc, MAX_SEGMENT)
    return k.select("doc_id", F.col("seg").cast("bigint"), F.col("kpos").cast("bigint"), "idx")


@register(
    "c10_line_documents",
    "SELECT doc_id, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS text FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
)
def q_c10(spark, sf):
    ld = C.line_documents(load(spark, sf, "documents"))
    return ld.select("doc_id", F.col("line_no").cast("bigint"), "text")


def _strip_sql(col: str) -> str:
    from sphaera.functions.text import PY_STRIP_CLASS

    return f"regexp_replace({col}, '^{PY_STRIP_CLASS}+|{PY_STRIP_CLASS}+$', '', 'g')"


@register(
    "c11_split_simple",
    "SELECT doc_id, unnest(range(len(a)))::BIGINT AS pos, unnest(a) AS word FROM "
    f"(SELECT doc_id, string_split({_strip_sql('text')}, ' ') AS a FROM documents)",
)
def q_c11(spark, sf):
    s = C.split_simple(load(spark, sf, "documents"))
    return s.select("doc_id", F.col("pos").cast("bigint"), "word")


@register("c12_doc_lengths", ENC + "SELECT doc_id, count(*)::BIGINT AS n_tokens FROM enc GROUP BY doc_id")
def q_c12(spark, sf):
    return C.doc_lengths(encoded(spark, sf))


# ------------------------------------------------------------------- vocabulary

CNT = S.with_(S.tok(), S.counts())
VOC = S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT))


@register("v1_word_count", CNT + "SELECT word, cn::BIGINT AS cn FROM counts")
def q_v1(spark, sf):
    return V.word_count(tokens(spark, sf), docs(spark, sf))


@register("v2_min_count_filter", VOC + "SELECT word, cn::BIGINT AS cn FROM kept_words")
def q_v2(spark, sf):
    return V.min_count_filter(V.word_count(tokens(spark, sf), docs(spark, sf)), MIN_COUNT)


@register("v3_vocab_index", VOC + "SELECT idx::BIGINT AS idx, word, cn::BIGINT AS cn FROM vocab")
def q_v3(spark, sf):
    return vocab(spark, sf)


@register("v3_incremental_vocab", ORACLES["v3_vocab_index"])
def q_v3_incremental(spark, sf):
    """The ranked vocabulary after three overlapping parts, one of them
    delivered twice."""
    from sphaera.session import scratch_path
    from sphaera.streaming.vocab_state import VocabularyState

    state = VocabularyState(spark, scratch_path(spark, "vocabulary"))
    for part in (0, 1, 2, 1):
        state.add(docs(spark, sf).filter((F.col("doc_id") % 3 == part) | (F.col("doc_id") % 7 == 0)), f"part-{part}")
    return state.vocab(MIN_COUNT)


@register("v4_train_words", VOC + "SELECT n_train AS train_words, n_vocab AS vocab_size FROM nstat")
def q_v4(spark, sf):
    return V.train_words(vocab(spark, sf))


CAP = 1000


@register(
    "v5_vocab_cap",
    CNT
    + f", h AS (SELECT cn, count(*) AS n FROM counts WHERE word <> '</s>' GROUP BY cn), "
    "ha AS (SELECT cn, coalesce(sum(n) OVER (ORDER BY cn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS above FROM h), "
    f"t AS (SELECT CASE WHEN (SELECT sum(n) FROM h) <= {CAP} THEN 0 ELSE (SELECT min(cn) FROM ha WHERE above <= {CAP}) "
    "END AS t) "
    "SELECT word, cn::BIGINT AS cn FROM counts, t WHERE cn > t.t OR word = '</s>'",
)
def q_v5(spark, sf):
    return V.vocab_cap(V.word_count(tokens(spark, sf), docs(spark, sf)), CAP)


@register(
    "v6_vocab_lookup",
    VOC + "SELECT t.doc_id, t.pos, coalesce(v.idx, -1)::BIGINT AS idx FROM tok t LEFT JOIN vocab v ON t.word = v.word",
)
def q_v6(spark, sf):
    return V.vocab_lookup(tokens(spark, sf), vocab(spark, sf)).select("doc_id", F.col("pos").cast("bigint"), "idx")


IMPORT_MIN = 10


@register(
    "v7_import_vocab",
    VOC.replace(f"cn >= {MIN_COUNT} OR", f"cn >= {IMPORT_MIN} OR")
    + "SELECT idx::BIGINT AS idx, word, cn::BIGINT AS cn, (SELECT n_train FROM nstat) AS train_words FROM vocab",
)
def q_v7(spark, sf):
    # an unsorted (word, cn) list, as read from a vocabulary file, re-filtered
    rows = V.word_count(tokens(spark, sf), docs(spark, sf))
    v = V.import_vocab(rows, IMPORT_MIN)
    return v.crossJoin(V.train_words(v).select("train_words"))


@register(
    "v8_oov_report",
    VOC
    + ", d AS (SELECT word, count(*) AS n FROM tok GROUP BY word), j AS (SELECT d.word, d.n, v.idx FROM d LEFT JOIN vocab v "
    "ON d.word = v.word) SELECT sum(n)::BIGINT AS n_tokens, sum(CASE WHEN idx IS NULL THEN n ELSE 0 END)::BIGINT AS "
    "n_oov_tokens, sum(CASE WHEN idx IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_oov_words, "
    "sum(CASE WHEN idx IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_matched_words FROM j",
)
def q_v8(spark, sf):
    return V.oov_report(tokens(spark, sf), vocab(spark, sf))


# ------------------------------------------------------------------- sampling

HIST = S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT), S.hist())


@register(
    "p1_keep_probability",
    VOC + f"SELECT idx::BIGINT AS idx, word, round({S.keep_p(SAMPLE)}, 6) AS p_keep FROM vocab, nstat WHERE idx > 0",
)
def q_p1(spark, sf):
    v, _, sc = sampling_state(spark, sf)
    p = P.keep_probability(F.col("cn"), sc.train_words, SAMPLE)
    return v.filter("idx > 0").select("idx", "word", r6(p).alias("p_keep"))


@register(
    "p2_subsample",
    ENC.rstrip() + ",\n" + S.kept(SEED, SAMPLE, EPOCH, WINDOW) + "\nSELECT doc_id, pos, idx FROM sub",
)
def q_p2(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    return P.subsample(encoded(spark, sf), sc, SAMPLE, SEED, EPOCH).select("doc_id", "pos", "idx")


@register(
    "p3_noise_distribution",
    HIST + "SELECT first_idx::BIGINT AS first_idx, n_words::BIGINT AS n_words, cn::BIGINT AS cn, "
    "round(w / z, 9) AS p, round(cum_before / z, 6) AS cum_before FROM hist, hz",
)
def q_p3(spark, sf):
    _, hist, sc = sampling_state(spark, sf)
    z = F.lit(sc.noise_total)
    return hist.select(
        "first_idx", "n_words", F.col("cn").cast("bigint"),
        F.round(F.col("w") / z, 9).alias("p"), r6(F.col("cum_before") / z).alias("cum_before"),
    )


def _kept_sql(*extra: str) -> str:
    return S.with_(
        S.tok(), S.counts(), S.vocab(MIN_COUNT), S.enc(), S.kept(SEED, SAMPLE, EPOCH, WINDOW), S.hist(), *extra
    )


def _grid(spark, sf):
    v, hist, sc = sampling_state(spark, sf)
    return P.noise_grid(hist, sc), sc


@register(
    "p4_negative_sample",
    _kept_sql(S.draws("dr", "kept", SEED, "dneg", EPOCH, ["doc_id", "kpos"], NEGATIVE))
    + "SELECT doc_id, kpos, k, neg FROM dr",
)
def q_p4(spark, sf):
    grid, sc = _grid(spark, sf)
    k = kept(spark, sf, sc)
    d = G._with_draws(k.select("doc_id", "kpos"), NEGATIVE, SEED, "dneg", EPOCH, ["doc_id", "kpos"])
    return P.draw_negatives(d, grid, sc).select("doc_id", F.col("kpos").cast("bigint"), "k", "neg")


@register("p5_dynamic_window", KEPT + "SELECT doc_id, kpos, radius FROM kept")
def q_p5(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    return kept(spark, sf, sc).select("doc_id", F.col("kpos").cast("bigint"), "radius")


@register(
    "p6_uniform_negative",
    _kept_sql(S.draws("dr", "kept", SEED, "dneg", EPOCH, ["doc_id", "kpos"], NEGATIVE))
    + "SELECT doc_id, kpos, k, (1 + CAST(floor(u2 * (n_vocab - 1)) AS BIGINT))::BIGINT AS uneg FROM dr_u, nstat",
)
def q_p6(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    k = kept(spark, sf, sc).select("doc_id", "kpos")
    d = G._with_draws(k, NEGATIVE, SEED, "dneg", EPOCH, ["doc_id", "kpos"])
    return d.select("doc_id", F.col("kpos").cast("bigint"), "k", P.uniform_negative(F.col("u2"), sc.vocab_size).alias("uneg"))


# ------------------------------------------------------------------- pairs


def _pairs(spark, sf):
    grid, sc = _grid(spark, sf)
    k = kept(spark, sf, sc)
    # one digest per position serves all draws of its pairs
    return G.skipgram_pairs(k, WINDOW, lanes=(SEED, "wneg", EPOCH)), k, grid, sc


@register("g1_skipgram_pairs", _kept_sql(S.pairs(WINDOW)) + "SELECT doc_id, kpos, off, ctx, center FROM pairs")
def q_g1(spark, sf):
    p, _, _, _ = _pairs(spark, sf)
    return p.select("doc_id", F.col("kpos").cast("bigint"), "off", "ctx", "center")


@register("g2_doc_word_pairs", KEPT + "SELECT doc_id, kpos, idx AS word FROM kept")
def q_g2(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    return G.doc_word_pairs(kept(spark, sf, sc)).select("doc_id", F.col("kpos").cast("bigint"), "word")


@register(
    "g3_word_triples",
    _kept_sql(S.pairs(WINDOW), S.draws("wt", "pairs", SEED, "wneg", EPOCH, ["doc_id", "kpos", "off"], NEGATIVE))
    + "SELECT doc_id, kpos, off, k, ctx, center, neg FROM wt WHERE neg <> ctx",
)
def q_g3(spark, sf):
    p, _, grid, sc = _pairs(spark, sf)
    t = G.word_triples(p, grid, sc, NEGATIVE, SEED, EPOCH)
    return t.select("doc_id", F.col("kpos").cast("bigint"), "off", "k", "ctx", "center", "neg")


@register(
    "g4_doc_triples",
    _kept_sql(S.draws("dt", "kept", SEED, "dneg", EPOCH, ["doc_id", "kpos"], NEGATIVE))
    + "SELECT doc_id, kpos, k, idx AS word, neg FROM dt WHERE neg <> idx",
)
def q_g4(spark, sf):
    grid, sc = _grid(spark, sf)
    k = kept(spark, sf, sc)
    t = G.doc_triples(G.doc_word_pairs(k), grid, sc, NEGATIVE, SEED, EPOCH)
    return t.select("doc_id", F.col("kpos").cast("bigint"), "k", "word", "neg")


# ------------------------------------------------------------------- training

from sphaera.operators import train as T  # noqa: E402
from sphaera.operators.trainer import Draws  # noqa: E402

MARGIN = 0.15
ALPHA = 0.04
ITERS = 10


@once
def _vectors(spark, sf, dim=DIM):
    v, _, sc = sampling_state(spark, sf)
    d = load(spark, sf, "documents").select("doc_id")
    return T.init_vectors(v, d, dim, sc.vocab_size).cache()


def _long(df, col="vec"):
    return df.select("role", "id", F.posexplode(col).alias("j", "x")).select(
        "role", "id", F.col("j").cast("bigint"), r6(F.col("x").cast("double")).alias("x")
    )


VEC = S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT), S.vecs(DIM))


@register(
    "t1_init_vectors",
    VEC + "SELECT role, id, j::BIGINT AS j, round(x::DOUBLE, 6) AS x FROM "
    "(SELECT role, id, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM vecs)",
)
def q_t1(spark, sf):
    return _long(_vectors(spark, sf))


PRE_MIN = 10


@register(
    "t2_load_pretrained",
    S.with_(S.tok(), S.counts(), S.vocab(MIN_COUNT), S.vocab(PRE_MIN, "p"), S.vecs(DIM, "p"))
    + ", pre AS (SELECT v.word AS key, p.vec FROM pvecs p JOIN pvocab v ON p.id = v.idx WHERE p.role = 'u'),\n"
    "hit AS (SELECT v.idx AS id, pre.vec FROM vocab v JOIN pre ON pre.key = v.word),\n"
    "miss AS (SELECT idx AS id, row_number() OVER (ORDER BY idx) - 1 AS r FROM vocab WHERE word NOT IN (SELECT key FROM pre)),\n"
    f"mraw AS (SELECT id, {S.init_vec(f'r * {DIM}', DIM)} AS vec FROM miss),\n"
    "mn AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS n FROM mraw),\n"
    "allv AS (SELECT id, vec FROM hit UNION ALL SELECT id, list_transform(vec, lambda x: CAST(x / n AS FLOAT)) FROM mn)\n"
    "SELECT 'u' AS role, id, j::BIGINT AS j, round(x::DOUBLE, 6) AS x FROM "
    "(SELECT id, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM allv)",
)
def q_t2(spark, sf):
    pv = vocab(spark, sf, PRE_MIN)
    none = spark.createDataFrame([], "doc_id bigint")
    pvecs = T.init_vectors(pv, none, DIM, pv.count()).filter("role = 'u'")
    pre = pvecs.join(pv.select(F.col("idx").alias("id"), F.col("word").alias("key")), "id").select("key", "vec")
    return _long(T.load_pretrained(vocab(spark, sf), pre, "u", DIM))


def _triples(spark, sf):
    p, k, grid, sc = _pairs(spark, sf)
    wt = G.word_triples(p, grid, sc, NEGATIVE, SEED, EPOCH)
    dt = G.doc_triples(G.doc_word_pairs(k), grid, sc, NEGATIVE, SEED, EPOCH)
    return wt, dt


TRI = _kept_sql(
    S.pairs(WINDOW),
    S.draws("wt", "pairs", SEED, "wneg", EPOCH, ["doc_id", "kpos", "off"], NEGATIVE),
    S.draws("dt", "kept", SEED, "dneg", EPOCH, ["doc_id", "kpos"], NEGATIVE),
    "wtr AS (SELECT * FROM wt WHERE neg <> ctx)",
    "dtr AS (SELECT doc_id, kpos, k, idx AS word, neg FROM dt WHERE neg <> idx)",
    S.vecs(DIM),
    S.forward("wf", "wtr", "v", "ctx", "center", MARGIN),
    S.forward("df", "dtr", "d", "doc_id", "word", MARGIN),
)


@register(
    "t3_margin_forward",
    TRI + "SELECT doc_id, kpos, k, round(f, 6) AS f, round(h, 6) AS h, round(loss, 6) AS loss, "
    "CAST(active AS BIGINT) AS active FROM df",
)
def q_t3(spark, sf):
    _, dt = _triples(spark, sf)
    fw = T.margin_forward(dt, _vectors(spark, sf), "d", "doc_id", "word", MARGIN, DIM)
    return fw.select("doc_id", F.col("kpos").cast("bigint"), "k", r6("f").alias("f"), r6("h").alias("h"),
                     r6("loss").alias("loss"), F.col("active").cast("bigint").alias("active"))


def _position_deltas(spark, sf, kinds):
    _, hist, sc = sampling_state(spark, sf)
    pos = G.plain_positions(kept(spark, sf, sc))
    return T.position_deltas(pos, _vectors(spark, sf), ALPHA, MARGIN, DIM, NEGATIVE, P.noise_table(hist, sc), kinds,
                             tokens=sc.train_words, draws=Draws(WINDOW, SEED, EPOCH))


def _delta_long(s):
    return s.select("role", "id", F.posexplode("delta").alias("j", "x")).select(
        "role", "id", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "t4_word_update",
    TRI.rstrip() + ",\n" + S.deltas("wd", "wf", "v", "ctx", "center", ALPHA, DIM) + ",\n" + S.long_sum("ws", "wd")
    + "\nSELECT role, id, j::BIGINT AS j, round(x, 6) AS x FROM ws",
)
def q_t4(spark, sf):
    return _delta_long(_position_deltas(spark, sf, (0,)))


@register(
    "t5_doc_update",
    TRI.rstrip() + ",\n" + S.deltas("dd", "df", "d", "doc_id", "word", ALPHA, DIM) + ",\n" + S.long_sum("ds", "dd")
    + "\nSELECT role, id, j::BIGINT AS j, round(x, 6) AS x FROM ds",
)
def q_t5(spark, sf):
    return _delta_long(_position_deltas(spark, sf, (1,)))


@register(
    "t6_batch_step",
    TRI.rstrip() + ",\n" + S.deltas("wd", "wf", "v", "ctx", "center", ALPHA, DIM) + ",\n"
    + S.deltas("dd", "df", "d", "doc_id", "word", ALPHA, DIM) + ",\n"
    "alld AS (SELECT * FROM wd UNION ALL SELECT * FROM dd),\n" + S.long_sum("sd", "alld") + ",\n"
    "sda AS (SELECT role, id, list(x ORDER BY j) AS delta FROM sd GROUP BY role, id),\n"
    "nw AS (SELECT v.role, v.id, CASE WHEN s.delta IS NULL THEN CAST(v.vec AS DOUBLE[]) ELSE "
    "list_transform(range(len(v.vec)), lambda j: v.vec[j + 1] + s.delta[j + 1]) END AS vec, s.delta IS NOT NULL AS t "
    "FROM vecs v LEFT JOIN sda s ON v.role = s.role AND v.id = s.id),\n"
    "nn AS (SELECT role, id, vec, t, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS n FROM nw),\n"
    "fin AS (SELECT role, id, CASE WHEN t THEN list_transform(vec, lambda x: CAST(x / n AS FLOAT)) "
    "ELSE list_transform(vec, lambda x: CAST(x AS FLOAT)) END AS vec FROM nn)\n"
    "SELECT role, id, j::BIGINT AS j, round(x::DOUBLE, 6) AS x FROM "
    "(SELECT role, id, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM fin)",
)
def q_t6(spark, sf):
    return _long(T.apply_deltas(_vectors(spark, sf), _position_deltas(spark, sf, (0, 1))))


def _shards(spark, sf):
    return C.balanced_shards(C.doc_offsets(load(spark, sf, "documents")), SHARDS)


QUOTA_SQL = S.with_(
    S.tok(), S.counts(), S.vocab(MIN_COUNT), S.enc(), OFFSETS_SQL, "tot AS (SELECT max(end_off) AS total FROM offs)",
    f"sh AS (SELECT doc_id, least({SHARDS - 1}, (start_off * {SHARDS}) // total) AS shard FROM offs, tot)",
    "dn AS (SELECT sh.doc_id, sh.shard, coalesce(e.n, 0) + 1 AS n_words FROM sh LEFT JOIN "
    "(SELECT doc_id, count(*) AS n FROM enc GROUP BY doc_id) e ON sh.doc_id = e.doc_id)",
    "prog AS (SELECT doc_id, shard, n_words, coalesce(sum(n_words) OVER (PARTITION BY shard ORDER BY doc_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dn)",
)


@register(
    "t7_alpha_schedule",
    QUOTA_SQL + f"SELECT e::BIGINT AS epoch, doc_id, round({ALPHA}::DOUBLE * greatest(1.0 - "
    f"(e * n_train + {SHARDS} * before) / ({ITERS}.0 * n_train + 1.0), 1e-4), 9) AS alpha "
    f"FROM prog, nstat, range({ITERS}) r(e)",
)
def q_t7(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    prog = T.doc_progress(encoded(spark, sf), load(spark, sf, "documents").select("doc_id"), _shards(spark, sf))
    a = T.alpha_schedule(prog, ALPHA, ITERS, sc.train_words, SHARDS)
    return a.select("epoch", "doc_id", F.round("alpha", 9).alias("alpha"))


@register(
    "t9_epoch_objective",
    TRI + "SELECT 'word' AS kind, round(avg(loss), 6) AS mean_loss, round(avg(CAST(active AS DOUBLE)), 6) AS "
    "active_share, count(*)::BIGINT AS n_triples FROM wf UNION ALL SELECT 'doc', round(avg(loss), 6), "
    "round(avg(CAST(active AS DOUBLE)), 6), count(*)::BIGINT FROM df",
)
def q_t9(spark, sf):
    wt, dt = _triples(spark, sf)
    vec = _vectors(spark, sf)
    o = T.epoch_objective(T.margin_forward(wt, vec, "v", "ctx", "center", MARGIN, DIM),
                          T.margin_forward(dt, vec, "d", "doc_id", "word", MARGIN, DIM))
    return o.select("kind", r6("mean_loss").alias("mean_loss"), r6("active_share").alias("active_share"), "n_triples")


@register("t9_forward_pass", ORACLES["t9_epoch_objective"])
def q_t9_forward(spark, sf):
    """The same objective as the trainer computes it: a forward pass over
    position rows with the vectors of each group, none of them changed."""
    _, hist, sc = sampling_state(spark, sf)
    pos = G.plain_positions(kept(spark, sf, sc))
    o = T.position_objective(pos, _vectors(spark, sf), MARGIN, DIM, NEGATIVE, P.noise_table(hist, sc), shard_tokens=20_000,
                             tokens=sc.train_words, draws=Draws(WINDOW, SEED, EPOCH))
    return o.select("kind", r6("mean_loss").alias("mean_loss"), r6("active_share").alias("active_share"), "n_triples")


@register(
    "t10_epoch_quota",
    QUOTA_SQL.rstrip() + ",\n" + S.kept(SEED, SAMPLE, EPOCH, WINDOW)
    + "\nSELECT d.shard::BIGINT AS shard, count(*)::BIGINT AS n_docs, sum(d.n_words)::BIGINT AS n_words, "
    "sum(coalesce(k.k, 0))::BIGINT AS n_kept FROM dn d LEFT JOIN (SELECT doc_id, count(*) AS k FROM kept GROUP BY doc_id) k "
    "ON d.doc_id = k.doc_id GROUP BY d.shard",
)
def q_t10(spark, sf):
    _, _, sc = sampling_state(spark, sf)
    q = T.epoch_quota(encoded(spark, sf), kept(spark, sf, sc), load(spark, sf, "documents").select("doc_id"),
                      _shards(spark, sf))
    return q.select(F.col("shard").cast("bigint"), "n_docs", "n_words", "n_kept")


# ------------------------------------------------------------------- vectors

from sphaera.functions import vectors as Mv  # noqa: E402
from sphaera.operators import clustering as K  # noqa: E402
from sphaera.operators import knn as L  # noqa: E402
from sphaera.operators import similarity as E  # noqa: E402

EV = "ev AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings)"


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _next_pairs(spark, sf):
    e = _emb(spark, sf)
    b = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("vec_b"))
    return e.join(b, "id")


def _dsql(a, b):
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


NEXT = S.with_(EV, "np AS (SELECT a.id, a.vec, b.vec AS vec_b FROM ev a JOIN ev b ON b.id = a.id + 1)")


@register("m1_dot", NEXT + f"SELECT id, round({_dsql('vec', 'vec_b')}, 6) AS dot FROM np")
def q_m1(spark, sf):
    return _next_pairs(spark, sf).select("id", r6(Mv.dot("vec", "vec_b")).alias("dot"))


@register("m2_norm", S.with_(EV) + f"SELECT id, round(sqrt({_dsql('vec', 'vec')}), 6) AS norm FROM ev")
def q_m2(spark, sf):
    return _emb(spark, sf).select("id", r6(Mv.norm("vec")).alias("norm"))


@register(
    "m3_cosine",
    NEXT + f"SELECT id, round({_dsql('vec', 'vec_b')} / (sqrt({_dsql('vec', 'vec')}) * sqrt({_dsql('vec_b', 'vec_b')})), 6) "
    "AS cosine FROM np",
)
def q_m3(spark, sf):
    return _next_pairs(spark, sf).select(
        "id", r6(Mv.dot("vec", "vec_b") / (Mv.norm("vec") * Mv.norm("vec_b"))).alias("cosine"))


EUC = "sqrt(list_sum(list_transform(range(len({a})), lambda j: ({a}[j + 1]::DOUBLE - {b}[j + 1]::DOUBLE) * ({a}[j + 1]::DOUBLE - {b}[j + 1]::DOUBLE))))"


@register("m4_euclidean", NEXT + f"SELECT id, round({EUC.format(a='vec', b='vec_b')}, 6) AS euclidean FROM np")
def q_m4(spark, sf):
    return _next_pairs(spark, sf).select("id", r6(Mv.euclidean("vec", "vec_b")).alias("euclidean"))


CEN = (
    "cen AS (SELECT label AS cid, list(x ORDER BY j) AS vec FROM (SELECT label, j, avg(x::DOUBLE) AS x FROM "
    "(SELECT label, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM ev) GROUP BY label, j) GROUP BY label)"
)


@register(
    "m5_mean_vector",
    S.with_(EV, CEN) + "SELECT cid AS label, j::BIGINT AS j, round(x, 6) AS x FROM "
    "(SELECT cid, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM cen)",
)
def q_m5(spark, sf):
    m = K.mean_vectors(_emb(spark, sf).drop("id"), "label")
    return m.select("label", F.posexplode("vec").alias("j", "x")).select(
        "label", F.col("j").cast("bigint"), r6("x").alias("x"))


# ------------------------------------------------------------------- clustering

ASG = (
    "asg AS (SELECT id, cid AS cluster, d AS dist FROM (SELECT e.id, c.cid, "
    + EUC.format(a="e.vec", b="c.vec")
    + " AS d FROM ev e, cen c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)"
)
CT = (
    "ct AS (SELECT e.label AS true_label, a.cluster AS pred_label, count(*) AS n FROM ev e JOIN asg a ON e.id = a.id "
    "GROUP BY ALL),\n"
    "ma AS (SELECT true_label, sum(n) AS a FROM ct GROUP BY true_label),\n"
    "mb AS (SELECT pred_label, sum(n) AS b FROM ct GROUP BY pred_label),\n"
    "tot AS (SELECT sum(n)::DOUBLE AS nn FROM ct),\n"
    "mi AS (SELECT greatest(coalesce(sum((n / nn) * ln((n / nn) / ((a / nn) * (b / nn)))), 0.0), 0.0) AS mi "
    "FROM ct JOIN ma USING (true_label) JOIN mb USING (pred_label), tot),\n"
    "ha AS (SELECT sum(-(a / nn) * ln(a / nn)) AS ha, count(*) AS ka FROM ma, tot),\n"
    "hb AS (SELECT sum(-(b / nn) * ln(b / nn)) AS hb, count(*) AS kb FROM mb, tot),\n"
    "nmi AS (SELECT CASE WHEN ka = 1 AND kb = 1 THEN 1.0 WHEN ka = 1 OR kb = 1 OR mi = 0 THEN 0.0 ELSE mi / ((ha + hb) / 2.0) END AS nmi "
    "FROM mi, ha, hb),\n"
    "pc AS (SELECT (SELECT sum(n * n) FROM ct) AS sn2, (SELECT sum(n) FROM ct) AS nt, (SELECT sum(a * a) FROM ma) AS sa2, "
    "(SELECT sum(b * b) FROM mb) AS sb2),\n"
    "pq AS (SELECT sn2 - nt AS tp, sb2 - sn2 AS fp, sa2 - sn2 AS fn, nt * nt - (sb2 - sn2) - (sa2 - sn2) - sn2 AS tn FROM pc),\n"
    "ari AS (SELECT CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp::DOUBLE * tn::DOUBLE - fn::DOUBLE * fp::DOUBLE) / "
    "((tp + fn)::DOUBLE * (fn + tn)::DOUBLE + (tp + fp)::DOUBLE * (fp + tn)::DOUBLE) END AS ari FROM pq),\n"
    "pur AS (SELECT (SELECT sum(m) FROM (SELECT max(n) AS m FROM ct GROUP BY pred_label))::DOUBLE / "
    "(SELECT sum(n) FROM ct)::DOUBLE AS purity)"
)
KSQL = S.with_(EV, CEN, ASG, CT)


def _assigned(spark, sf):
    e = _emb(spark, sf).cache()
    cen = K.mean_vectors(e.drop("id"), "label").withColumnRenamed("label", "cid")
    return e, K.assign_clusters(e, cen, "euclidean")


def _cont(spark, sf):
    e, a = _assigned(spark, sf)
    return K.contingency(e, a).cache()


@register("k3_assign_clusters", KSQL + "SELECT id, cluster::BIGINT AS cluster, round(dist, 6) AS dist FROM asg")
def q_k3(spark, sf):
    _, a = _assigned(spark, sf)
    return a.select("id", F.col("cluster").cast("bigint"), r6("dist").alias("dist"))


@register(
    "k4_update_centers",
    KSQL + ", upd AS (SELECT a.cluster AS cid, j, avg(x::DOUBLE) AS x FROM (SELECT id, unnest(range(len(vec))) AS j, "
    "unnest(vec) AS x FROM ev) v JOIN asg a ON v.id = a.id GROUP BY a.cluster, j) "
    "SELECT cid::BIGINT AS cid, j::BIGINT AS j, round(x, 6) AS x FROM upd",
)
def q_k4(spark, sf):
    e, a = _assigned(spark, sf)
    c = K.update_centers(e.select("id", "vec"), a)
    return c.select(F.col("cid").cast("bigint"), F.posexplode("vec").alias("j", "x")).select(
        "cid", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "k5_contingency",
    KSQL + "SELECT true_label::BIGINT AS true_label, pred_label::BIGINT AS pred_label, n::BIGINT AS n FROM ct",
)
def q_k5(spark, sf):
    c = _cont(spark, sf)
    return c.select(F.col("true_label").cast("bigint"), F.col("pred_label").cast("bigint"), F.col("n").cast("bigint"))


@register("k6_mutual_info", KSQL + "SELECT round(mi, 6) AS mi FROM mi")
def q_k6(spark, sf):
    return K.mutual_info(_cont(spark, sf)).select(r6("mi").alias("mi"))


@register("k7_normalized_mutual_info", KSQL + "SELECT round(nmi, 6) AS nmi FROM nmi")
def q_k7(spark, sf):
    return K.normalized_mutual_info(_cont(spark, sf)).select(r6("nmi").alias("nmi"))


@register("k8_adjusted_rand", KSQL + "SELECT round(ari, 6) AS ari FROM ari")
def q_k8(spark, sf):
    return K.adjusted_rand(_cont(spark, sf)).select(r6("ari").alias("ari"))


@register("k9_purity", KSQL + "SELECT round(purity, 6) AS purity FROM pur")
def q_k9(spark, sf):
    return K.purity(_cont(spark, sf)).select(r6("purity").alias("purity"))


@register(
    "k10_cluster_report",
    KSQL + "SELECT round(mi, 6) AS mi, round(nmi, 6) AS nmi, round(ari, 6) AS ari, round(purity, 6) AS purity "
    "FROM mi, nmi, ari, pur",
)
def q_k10(spark, sf):
    r = K.cluster_report(_cont(spark, sf))
    return r.select(*[r6(c).alias(c) for c in ("mi", "nmi", "ari", "purity")])


def _dist_sql(metric: str, a: str, b: str) -> str:
    if metric == "euclidean":
        return EUC.format(a=a, b=b)
    return f"1 - {_dsql(a, b)} / (sqrt({_dsql(a, a)}) * sqrt({_dsql(b, b)}))"


KM_K, KM_SAMPLES, KM_FACTOR, KM_ROUNDS = 10, 3, 2.0, 40


def _kmeans_sql(metric: str) -> str:
    """Seeding by oversampling, then Lloyd rounds until long after they have
    converged, unrolled."""
    cost = f"greatest({_dist_sql(metric, 'e.vec', 'c.vec')}, 0.0)"
    cost = cost if metric == "cosine" else f"pow({cost}, 2)"
    ctes = [EV, f"s0 AS MATERIALIZED (SELECT id, vec FROM ev ORDER BY {S.u(SEED, 'kmeans', ['0', 'id'])}, id LIMIT 1)"]
    for r in range(1, KM_SAMPLES + 1):
        ctes.append(f"d{r} AS MATERIALIZED (SELECT e.id, min({cost}) AS cost FROM ev e, s{r - 1} c GROUP BY e.id)")
        ctes.append(
            f"s{r} AS MATERIALIZED (SELECT id, vec FROM s{r - 1} UNION SELECT e.id, e.vec FROM ev e JOIN d{r} d ON d.id = e.id WHERE "
            f"{S.u(SEED, 'kmeans', [str(r), 'e.id'])} < {KM_FACTOR * KM_K} * d.cost / (SELECT sum(cost) FROM d{r}))"
        )
    ctes.append(
        f"w AS MATERIALIZED (SELECT c.id, c.vec, count(n.id) AS w FROM s{KM_SAMPLES} c LEFT JOIN (SELECT e.id, c.id AS near FROM ev e, "
        f"s{KM_SAMPLES} c QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY {_dist_sql(metric, 'e.vec', 'c.vec')}, c.id) = 1) n "
        "ON n.near = c.id GROUP BY c.id, c.vec)"
    )
    ctes.append("p0 AS MATERIALIZED (SELECT 0 AS cid, id, vec FROM w ORDER BY w DESC, id LIMIT 1)")
    for i in range(1, KM_K):
        ctes.append(
            f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL (SELECT {i}, e.id, e.vec FROM w e, p{i - 1} c WHERE e.id NOT IN "
            f"(SELECT id FROM p{i - 1}) GROUP BY e.id, e.vec, e.w ORDER BY e.w * min({cost}) DESC, e.id LIMIT 1))"
        )
    ctes.append(f"c0 AS MATERIALIZED (SELECT cid, CAST(vec AS DOUBLE[]) AS vec FROM p{KM_K - 1})")
    for i in range(KM_ROUNDS + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT id, cid, vec FROM (SELECT e.id, e.vec, c.cid, {_dist_sql(metric, 'e.vec', 'c.vec')} AS d "
            f"FROM ev e, c{i} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)"
        )
        mean = (
            "SELECT cid, list(x ORDER BY j) AS vec FROM (SELECT cid, j, avg(x::DOUBLE) AS x FROM (SELECT cid, "
            f"unnest(range(len(vec))) AS j, unnest(vec) AS x FROM a{i}) GROUP BY cid, j) GROUP BY cid"
        )
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cid, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN ({mean}) m ON m.cid = c.cid)")
    return S.with_(*ctes) + f"SELECT id, cid::BIGINT AS cluster FROM a{KM_ROUNDS}"


def _kmeans(spark, sf, spherical):
    c = K.kmeans(_emb(spark, sf).select("id", "vec"), KM_K, seed=SEED, spherical=spherical)
    return c.select("id", F.col("cluster").cast("bigint"))


@register("k1_kmeans", _kmeans_sql("euclidean"))
def q_k1(spark, sf):
    return _kmeans(spark, sf, False)


@register("k2_spherical_kmeans", _kmeans_sql("cosine"))
def q_k2(spark, sf):
    return _kmeans(spark, sf, True)


def _lloyd_sql(rounds: int, metric: str) -> str:
    """Lloyd rounds from the first ten rows, unrolled."""
    cos = f"1 - {_dsql('e.vec', 'c.vec')} / (sqrt({_dsql('e.vec', 'e.vec')}) * sqrt({_dsql('c.vec', 'c.vec')}))"
    dist = EUC.format(a="e.vec", b="c.vec") if metric == "euclidean" else cos
    ctes = [EV, "c0 AS (SELECT id AS cid, CAST(vec AS DOUBLE[]) AS vec FROM ev WHERE id < 10)"]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS (SELECT id, cid AS cluster, vec, d FROM (SELECT e.id, e.vec, c.cid, {dist} AS d FROM ev e, c{i} c) "
            "QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)"
        )
        mean = (
            f"SELECT cluster AS cid, list(x ORDER BY j) AS vec FROM (SELECT cluster, j, avg(x::DOUBLE) AS x FROM (SELECT "
            f"cluster, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM a{i}) GROUP BY cluster, j) GROUP BY cluster"
        )
        if metric == "cosine":
            mean = f"SELECT cid, list_transform(vec, lambda x: x / sqrt({_dsql('m.vec', 'm.vec')})) AS vec FROM ({mean}) m"
        ctes.append(f"c{i + 1} AS ({mean})")
    return S.with_(*ctes) + f"SELECT id, cluster::BIGINT AS cluster, round(d, 6) AS dist FROM a{rounds}"


LLOYD_ROUNDS = 3


def _lloyd(spark, sf, metric):
    e = _emb(spark, sf).select("id", "vec")
    a = K.lloyd(e, K.first_rows_as_centers(e, 10), LLOYD_ROUNDS, metric)
    return a.select("id", F.col("cluster").cast("bigint"), r6("dist").alias("dist"))


@register("k1_lloyd_rounds", _lloyd_sql(LLOYD_ROUNDS, "euclidean"))
def q_k1_lloyd(spark, sf):
    return _lloyd(spark, sf, "euclidean")


@register("k2_lloyd_rounds", _lloyd_sql(LLOYD_ROUNDS, "cosine"))
def q_k2_lloyd(spark, sf):
    return _lloyd(spark, sf, "cosine")


WEMB = "wemb AS (SELECT v.word AS key, x.vec FROM vecs x JOIN vocab v ON x.id = v.idx WHERE x.role = 'u')"
SPLIT_DOCS = (
    f"sd AS (SELECT doc_id, unnest(string_split({_strip_sql('text')}, ' ')) AS word FROM documents)"
)
DOCMEAN = S.with_(
    S.tok(), S.counts(), S.vocab(MIN_COUNT), S.vecs(DIM), WEMB, SPLIT_DOCS,
    "dm AS (SELECT d.doc_id, j, avg(x::DOUBLE) AS x FROM (SELECT sd.doc_id, unnest(range(len(w.vec))) AS j, "
    "unnest(w.vec) AS x FROM sd JOIN wemb w ON sd.word = w.key) d GROUP BY d.doc_id, j)",
)


def _word_emb(spark, sf, carry=()):
    v = vocab(spark, sf)
    vec = _vectors(spark, sf).filter("role = 'u'")
    return vec.join(v.select(F.col("idx").alias("id"), F.col("word").alias("key")), "id").select("key", "vec", *carry)


def _doc_means(spark, sf):
    docs_ = load(spark, sf, "documents")
    return K.doc_mean_embedding(C.split_simple(docs_), _word_emb(spark, sf, ("id",)), docs_.select("doc_id"))


@register(
    "k11_doc_mean_embedding",
    DOCMEAN + "SELECT d.doc_id, m.j::BIGINT AS j, round(m.x, 6) AS x FROM documents d LEFT JOIN dm m ON d.doc_id = m.doc_id",
)
def q_k11(spark, sf):
    m = _doc_means(spark, sf)
    return m.select("doc_id", F.posexplode_outer("vec").alias("j", "x")).select(
        "doc_id", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "t11_l2_normalize",
    DOCMEAN + ", dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM dm GROUP BY doc_id) "
    "SELECT d.doc_id, m.j::BIGINT AS j, round(CAST(m.x / dn.n AS FLOAT)::DOUBLE, 6) AS x FROM documents d "
    "LEFT JOIN dm m ON d.doc_id = m.doc_id LEFT JOIN dn ON m.doc_id = dn.doc_id",
)
def q_t11(spark, sf):
    m = Mv.l2_normalize(_doc_means(spark, sf), "vec")
    return m.select("doc_id", F.posexplode_outer("vec").alias("j", "x")).select(
        "doc_id", F.col("j").cast("bigint"), r6(F.col("x").cast("double")).alias("x"))


# ------------------------------------------------------------------- similarity

BENCH_SQL = S.with_(
    S.tok(), S.counts(), S.vocab(MIN_COUNT), S.vecs(DIM), WEMB,
    "bt AS (SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT item_id, list_filter("
    "regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0B\\x0C]+'), lambda x: x <> '') AS a FROM benchmark))",
    "bp0 AS (SELECT 'adjacent' AS benchmark, item_id, pos, w AS w1, lead(w, 1) OVER (PARTITION BY item_id ORDER BY pos) "
    "AS w2 FROM bt UNION ALL SELECT 'skip', item_id, pos, w, lead(w, 2) OVER (PARTITION BY item_id ORDER BY pos) FROM bt)",
    "bp AS (SELECT benchmark, w1, w2, max_by(((item_id + pos) % 11)::DOUBLE, (item_id, pos)) AS score FROM bp0 "
    "WHERE w2 IS NOT NULL GROUP BY benchmark, w1, w2)",
    "cov AS (SELECT p.benchmark, count(*)::BIGINT AS n_pairs, sum(CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL "
    "THEN 1 ELSE 0 END)::BIGINT AS n_covered FROM bp p LEFT JOIN wemb a ON p.w1 = a.key LEFT JOIN wemb b ON p.w2 = b.key "
    "GROUP BY p.benchmark)",
    "sim AS (SELECT p.benchmark, p.w1, p.w2, p.score, "
    + _dsql("a.vec", "b.vec") + " / (sqrt(" + _dsql("a.vec", "a.vec") + ") * sqrt(" + _dsql("b.vec", "b.vec") + ")) AS sim "
    "FROM bp p JOIN wemb a ON p.w1 = a.key JOIN wemb b ON p.w2 = b.key)",
    "rk AS (SELECT benchmark, rank() OVER (PARTITION BY benchmark ORDER BY score) + (count(*) OVER (PARTITION BY benchmark, "
    "score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY benchmark ORDER BY sim) + (count(*) OVER (PARTITION BY benchmark, "
    "sim) - 1) / 2.0 AS ry FROM sim)",
    "rho AS (SELECT benchmark, corr(rx, ry) AS spearman FROM rk GROUP BY benchmark)",
)


def _bench_pairs(spark, sf):
    words = F.filter(F.split(F.lower(F.col("text")), "[ \t\n\r\x0B\x0C]+"), lambda x: x != "")
    t = load(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("pos", "word"))
    w = Window.partitionBy("item_id").orderBy("pos")
    p = t.select("item_id", "pos", F.col("word").alias("w1"), F.lead("word", 1).over(w).alias("a"),
                 F.lead("word", 2).over(w).alias("s"))
    p = p.select("item_id", "pos", "w1", F.explode(F.array(
        F.struct(F.lit("adjacent").alias("benchmark"), F.col("a").alias("w2")),
        F.struct(F.lit("skip").alias("benchmark"), F.col("s").alias("w2")))).alias("x")).select(
        "item_id", "pos", "w1", "x.benchmark", "x.w2").filter(F.col("w2").isNotNull())
    score = ((F.col("item_id") + F.col("pos")) % 11).cast("double")
    key = F.struct("item_id", "pos")
    return p.groupBy("benchmark", "w1", "w2").agg(F.max_by(score, key).alias("score"))


@register("e1_pair_coverage", BENCH_SQL + "SELECT benchmark, n_pairs, n_covered FROM cov")
def q_e1(spark, sf):
    return E.pair_coverage(_bench_pairs(spark, sf), _word_emb(spark, sf))


@register("e2_pair_similarity", BENCH_SQL + "SELECT benchmark, w1, w2, score, round(sim, 6) AS sim FROM sim")
def q_e2(spark, sf):
    s = E.pair_similarity(_bench_pairs(spark, sf), _word_emb(spark, sf))
    return s.select("benchmark", "w1", "w2", "score", r6("sim").alias("sim"))


@register("e3_spearman", BENCH_SQL + "SELECT benchmark, round(spearman, 6) AS spearman FROM rho")
def q_e3(spark, sf):
    s = E.pair_similarity(_bench_pairs(spark, sf), _word_emb(spark, sf))
    return E.spearman(s, "benchmark", "score", "sim").select("benchmark", r6("spearman").alias("spearman"))


@register(
    "e4_similarity_report",
    BENCH_SQL + "SELECT c.benchmark, c.n_pairs, c.n_covered, round(r.spearman, 6) AS spearman FROM cov c LEFT JOIN rho r "
    "ON c.benchmark = r.benchmark",
)
def q_e4(spark, sf):
    r = E.similarity_report(_bench_pairs(spark, sf), _word_emb(spark, sf))
    return r.select("benchmark", "n_pairs", "n_covered", r6("spearman").alias("spearman"))


# ------------------------------------------------------------------- classification

TRAIN_SHARE = 0.8
LSQL = S.with_(
    EV,
    "cut AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM embeddings)",
    "tr AS (SELECT * FROM ev WHERE id < (SELECT n FROM cut))",
    "te AS (SELECT * FROM ev WHERE id >= (SELECT n FROM cut))",
    "nb AS (SELECT t.id AS test_id, r.id AS train_id, r.label, " + EUC.format(a="t.vec", b="r.vec")
    + " AS dist FROM te t, tr r QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY dist, r.id) <= 3)",
    "nbr AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rank FROM nb)",
    "vote AS (SELECT test_id, label AS pred FROM (SELECT test_id, label, count(*) AS n FROM nb GROUP BY test_id, label) "
    "QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY n DESC, label) = 1)",
    "conf AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ("
    "SELECT t.label, CAST(t.label = v.pred AS INT) AS tp, 0 AS fp, CAST(t.label <> v.pred AS INT) AS fn FROM te t JOIN vote v "
    "ON t.id = v.test_id UNION ALL SELECT v.pred, 0, CAST(t.label <> v.pred AS INT), 0 FROM te t JOIN vote v ON t.id = v.test_id)"
    " GROUP BY label)",
    "f1m AS (SELECT avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS f1_macro FROM conf)",
    "f1u AS (SELECT CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + "
    "sum(fn)) END AS f1_micro FROM conf)",
)


def _split(spark, sf):
    e = _emb(spark, sf)
    total = e.count()
    import math as _m

    return L.split_positional(e, int(_m.floor(total * TRAIN_SHARE)), total)


def _neighbours(spark, sf):
    tr, te = _split(spark, sf)
    return L.knn(tr, te, 3), te


@register("l1_split_positional", LSQL + "SELECT id, 'train' AS part FROM tr UNION ALL SELECT id, 'test' FROM te")
def q_l1(spark, sf):
    tr, te = _split(spark, sf)
    return tr.select("id", F.lit("train").alias("part")).unionByName(te.select("id", F.lit("test").alias("part")))


@register("l2_knn", LSQL + "SELECT test_id, rank::BIGINT AS rank, train_id, round(dist, 6) AS dist FROM nbr")
def q_l2(spark, sf):
    nb, _ = _neighbours(spark, sf)
    return nb.select("test_id", F.col("rank").cast("bigint"), "train_id", r6("dist").alias("dist"))


@register("l3_majority_vote", LSQL + "SELECT test_id, pred::BIGINT AS pred FROM vote")
def q_l3(spark, sf):
    nb, _ = _neighbours(spark, sf)
    return L.majority_vote(nb).select("test_id", F.col("pred").cast("bigint"))


@register("l4_confusion", LSQL + "SELECT label::BIGINT AS label, tp, fp, fn FROM conf")
def q_l4(spark, sf):
    nb, te = _neighbours(spark, sf)
    c = L.confusion(te, L.majority_vote(nb))
    return c.select(F.col("label").cast("bigint"), "tp", "fp", "fn")


@register("l5_f1_macro", LSQL + "SELECT round(f1_macro, 6) AS f1_macro FROM f1m")
def q_l5(spark, sf):
    nb, te = _neighbours(spark, sf)
    return L.f1_macro(L.confusion(te, L.majority_vote(nb))).select(r6("f1_macro").alias("f1_macro"))


@register("l6_f1_micro", LSQL + "SELECT round(f1_micro, 6) AS f1_micro FROM f1u")
def q_l6(spark, sf):
    nb, te = _neighbours(spark, sf)
    return L.f1_micro(L.confusion(te, L.majority_vote(nb))).select(r6("f1_micro").alias("f1_micro"))


@register(
    "l7_classification_report",
    LSQL + "SELECT round(f1_macro, 6) AS f1_macro, round(f1_micro, 6) AS f1_micro, (SELECT count(*) FROM te) AS n_test "
    "FROM f1m, f1u",
)
def q_l7(spark, sf):
    nb, te = _neighbours(spark, sf)
    r = L.classification_report(te, L.majority_vote(nb))
    return r.select(r6("f1_macro").alias("f1_macro"), r6("f1_micro").alias("f1_micro"), "n_test")


# ------------------------------------------------------------------- fit

from sphaera.params import Params  # noqa: E402

FIT_PARAMS = Params(dim=16, iter=2, window=WINDOW, negative=NEGATIVE, min_count=MIN_COUNT, sample=SAMPLE, seed=SEED)


@register("t8_fit")
def q_t8(spark, sf):
    """Vector norms of all three trained tables (rows = 2V + D); iterative,
    so no SQL oracle."""
    from sphaera.plans.fit import fit

    r = fit(load(spark, sf, "documents"), FIT_PARAMS)
    return r.vectors().select("role", "id", r6(Mv.norm("vec")).alias("norm"))


@register("t9_fit_objective")
def q_t9_fit(spark, sf):
    """Per-epoch hinge loss and active share reported by the trainer."""
    from sphaera.plans.fit import fit

    return fit(load(spark, sf, "documents"), FIT_PARAMS).objective


ONE_EPOCH = Params(dim=DIM, iter=1, window=WINDOW, negative=NEGATIVE, min_count=MIN_COUNT, sample=SAMPLE, seed=SEED,
                   margin=MARGIN, alpha=ALPHA, shard_tokens=20_000, merges=1, batch_size=1_000_000_000)


def _one_epoch_sql(shard_tokens: int, reach: float) -> str:
    """One step of all shards, one batch per shard: T6 inside every shard with
    the schedule's rate, then the shards' changes of a row added up, at most
    ``reach`` long. A document over ``shard_tokens`` is cut into parts, which
    are segments of their own."""
    step, part = f"range({DIM})", f"pos // {shard_tokens}"
    triples = TRI.rstrip()
    for old, new in (
        ("(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS kpos FROM sub",
         f"(row_number() OVER (PARTITION BY doc_id, {part} ORDER BY pos) - 1 + {part} * {shard_tokens})::BIGINT AS kpos FROM sub"),
        ("(0)::BIGINT AS seg", f"({part})::BIGINT AS seg"),
    ):
        if old not in triples:
            raise ValueError(old)
        triples = triples.replace(old, new)
    parts = {
        "pos": f"list_transform({step}, lambda j: alpha * (1.0 - f) * (a_vec[j + 1] - f * u_vec[j + 1]))",
        "neg": f"list_transform({step}, lambda j: alpha * 2.0 * h * (h * n_vec[j + 1] - a_vec[j + 1]))",
        "anchor": f"list_transform({step}, lambda j: alpha * (1.0 - (f - h)) * (u_vec[j + 1] - (f - h) * a_vec[j + 1] - n_vec[j + 1]))",
    }
    cols = "f, h, a_vec, u_vec, n_vec, run, alpha"
    norm = "sqrt(list_sum(list_transform(vec, lambda y: y * y)))"
    return (
        triples + ",\n"
        "pld AS (SELECT d.doc_id, coalesce(e.n, 0) + 1 AS n FROM documents d LEFT JOIN "
        "(SELECT doc_id, count(*) AS n FROM enc GROUP BY doc_id) e ON d.doc_id = e.doc_id),\n"
        f"pl0 AS (SELECT doc_id, p.part, n > {shard_tokens} AS wide, least({shard_tokens}, n - p.part * {shard_tokens}) AS n_words "
        f"FROM pld, unnest(range(0, (n - 1) // {shard_tokens} + 1)) AS p(part)),\n"
        "pl1 AS (SELECT doc_id, part, coalesce(sum(n_words) OVER (ORDER BY doc_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "1 PRECEDING), 0)::BIGINT AS cum FROM pl0),\n"
        f"pl2 AS (SELECT doc_id, part, cum, cum // {shard_tokens} AS run FROM pl1),\n"
        "al AS (SELECT doc_id, part, run, "
        f"{ALPHA}::DOUBLE * greatest(1.0 - ((SELECT count(DISTINCT run) FROM pl2) * (cum - min(cum) OVER (PARTITION BY run)))::DOUBLE "
        "/ (n_train::DOUBLE + 1.0), 1e-4) AS alpha FROM pl2, nstat),\n"
        f"tri AS MATERIALIZED (SELECT 'v' AS arole, ctx AS anchor, center AS pos, neg, {cols} FROM wf JOIN al ON al.doc_id = "
        f"wf.doc_id AND al.part = wf.kpos // {shard_tokens} WHERE active UNION ALL SELECT 'd', df.doc_id, word, neg, {cols} FROM df "
        f"JOIN al ON al.doc_id = df.doc_id AND al.part = df.kpos // {shard_tokens} WHERE active),\n"
        f"st AS (SELECT run, 'u' AS role, pos AS id, {parts['pos']} AS delta FROM tri UNION ALL "
        f"SELECT run, 'u', neg, {parts['neg']} FROM tri UNION ALL SELECT run, arole, anchor, {parts['anchor']} FROM tri),\n"
        "sl AS (SELECT run, role, id, j, sum(x) AS x FROM (SELECT run, role, id, unnest(range(len(delta))) AS j, unnest(delta) AS x "
        "FROM st) GROUP BY ALL),\n"
        "sh AS MATERIALIZED (SELECT run, role, id, list(x ORDER BY j) AS delta FROM sl GROUP BY ALL),\n"
        f"nw AS (SELECT s.role, s.id, v.vec AS old, list_transform({step}, lambda j: v.vec[j + 1] + s.delta[j + 1]) AS vec "
        "FROM sh s JOIN vecs v ON v.role = s.role AND v.id = s.id),\n"
        f"nn AS MATERIALIZED (SELECT role, id, old, list_transform(vec, lambda y: y / {norm}) AS vec FROM nw),\n"
        f"ch AS (SELECT role, id, list_transform({step}, lambda j: CAST(vec[j + 1] - old[j + 1] AS FLOAT)) AS delta FROM nn "
        "WHERE role <> 'd' OR id IN (SELECT doc_id FROM pl0 WHERE wide)),\n"
        "ms AS (SELECT role, id, j, sum(x::DOUBLE) AS x FROM (SELECT role, id, "
        "unnest(range(len(delta))) AS j, unnest(delta) AS x FROM ch) GROUP BY ALL),\n"
        "mn AS (SELECT role, id, list(x ORDER BY j) AS delta, sqrt(sum(x * x)) AS size FROM ms GROUP BY role, id),\n"
        f"ml AS (SELECT role, id, list_transform(delta, lambda y: y * CASE WHEN size > {reach} THEN {reach} / size ELSE 1.0 END) "
        "AS delta FROM mn),\n"
        f"mw AS (SELECT v.role, v.id, list_transform({step}, lambda j: v.vec[j + 1] + m.delta[j + 1]) AS vec FROM ml m "
        "JOIN vecs v ON v.role = m.role AND v.id = m.id),\n"
        f"fin AS (SELECT role, id, list_transform(vec, lambda y: CAST(y / {norm} AS FLOAT)) AS vec FROM mw UNION ALL "
        "SELECT role, id, list_transform(vec, lambda y: CAST(y AS FLOAT)) FROM nn WHERE role = 'd' "
        "AND id NOT IN (SELECT doc_id FROM pl0 WHERE wide) UNION ALL "
        "SELECT role, id, vec FROM vecs WHERE (role, id) NOT IN (SELECT (role, id) FROM sh))\n"
        "SELECT role, id, j::BIGINT AS j, round(x::DOUBLE, 6) AS x FROM "
        "(SELECT role, id, unnest(range(len(vec))) AS j, unnest(vec) AS x FROM fin)"
    )


@register("t8_fit_one_epoch", _one_epoch_sql(ONE_EPOCH.shard_tokens, ONE_EPOCH.reach))
def q_t8_epoch(spark, sf):
    """The production trainer over one epoch of one step and one batch per
    shard: every vector of the three tables."""
    from sphaera.plans.fit import fit

    return _long(fit(load(spark, sf, "documents"), ONE_EPOCH).vectors())


PARTS = ONE_EPOCH.with_(shard_tokens=1_500)


@register("t8_fit_split_documents", _one_epoch_sql(PARTS.shard_tokens, PARTS.reach))
def q_t8_parts(spark, sf):
    """The same with shards that longer documents are split over."""
    from sphaera.plans.fit import fit

    return _long(fit(load(spark, sf, "documents"), PARTS).vectors())


@register("e5_trained_similarity")
def q_e5(spark, sf):
    """The similarity report of trained word vectors, one row per benchmark."""
    from sphaera.plans.fit import fit

    emb = fit(load(spark, sf, "documents"), FIT_PARAMS).word_embeddings("u").select("key", "vec")
    r = E.similarity_report(_bench_pairs(spark, sf), emb)
    return r.select("benchmark", "n_pairs", "n_covered", r6("spearman").alias("spearman"))


@register("k12_trained_clustering")
def q_k12(spark, sf):
    """Both K-means variants on trained document vectors against the
    documents' language, one row per method."""
    from sphaera.plans.fit import fit
    from sphaera.plans.flagship import label_codes

    d = load(spark, sf, "documents")
    vec = fit(d, FIT_PARAMS).docs.select("id", "src_id", "vec")
    codes = label_codes(d, "lang")
    truth = vec.join(d.select(F.col("doc_id").alias("src_id"), "lang").join(codes, "lang"), "src_id").select("id", "label")
    out = None
    for method in ("kmeans", "spherical"):
        pred = K.kmeans(vec.select("id", "vec"), codes.count(), seed=SEED, spherical=method == "spherical")
        r = K.cluster_report(K.contingency(truth, pred).cache())
        r = r.select(F.lit(method).alias("method"), *[r6(c).alias(c) for c in ("mi", "nmi", "ari", "purity")])
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------- sources / sinks

from sphaera.session import scratch_path  # noqa: E402
from sphaera.sources import benchmarks_io as B  # noqa: E402
from sphaera.sources import corpus_io as CI  # noqa: E402
from sphaera.sources import embedding_io as EI  # noqa: E402
from sphaera.sources import labels_io as LI  # noqa: E402
from sphaera.sources import text_source as TS  # noqa: E402
from sphaera.sources import vocab_io as VI  # noqa: E402
from sphaera.sources.lines import write_ordered_lines  # noqa: E402


@register(
    "s1_read_corpus",
    "SELECT (row_number() OVER (ORDER BY doc_id, line_no) - 1)::BIGINT AS doc_id, text FROM ("
    "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
)
def q_s1(spark, sf):
    """Every line of the documents written as a one-document-per-line text
    corpus in the shared scratch folder, then read back and numbered."""
    lines = C.line_documents(load(spark, sf, "documents")).select(
        "doc_id", "line_no", F.col("text").alias("value"))
    path = scratch_path(spark, "corpus-text")
    write_ordered_lines(lines, ["doc_id", "line_no"], path)
    return CI.read_corpus(spark, path)


VOC_LINES = VOC + ", vl AS (SELECT idx, word || ' ' || CAST(cn AS VARCHAR) AS value FROM vocab)"


@register("s3_write_vocab", VOC_LINES + " SELECT idx::BIGINT AS idx, value FROM vl")
def q_s3(spark, sf):
    return VI.vocab_lines(vocab(spark, sf))


@register("s2_read_vocab", VOC + "SELECT idx::BIGINT AS idx, word, cn::BIGINT AS cn FROM vocab")
def q_s2(spark, sf):
    path = scratch_path(spark, "vocab-text")
    VI.write_vocab(vocab(spark, sf), path)
    return V.import_vocab(VI.read_vocab(spark, path), MIN_COUNT)


def _emb_line_sql(role: str, key: str, order: str) -> str:
    return (
        f"SELECT 0::BIGINT AS line_no, CAST(count(*) AS VARCHAR) || ' {DIM}' AS value FROM vecs WHERE role = '{role}' "
        f"UNION ALL SELECT ({order} + 1)::BIGINT, CAST({key} AS VARCHAR) || ' ' || array_to_string(list_transform(x.vec, "
        f"lambda y: printf('%.6f', y::DOUBLE)), ' ') || ' ' FROM vecs x {'JOIN vocab v ON x.id = v.idx' if key == 'v.word' else ''} "
        f"WHERE x.role = '{role}'"
    )


def _emb_lines(spark, sf, role):
    vec = _vectors(spark, sf).filter(F.col("role") == role)
    if role == "d":
        return EI.embedding_lines(vec, "id", "id", DIM)
    keyed = vec.join(vocab(spark, sf).select(F.col("idx").alias("id"), "word"), "id")
    return EI.embedding_lines(keyed, "word", "id", DIM)


@register("s6_write_word_embeddings", VEC + _emb_line_sql("u", "v.word", "x.id"))
def q_s6(spark, sf):
    return _emb_lines(spark, sf, "u")


@register("s7_write_context_embeddings", VEC + _emb_line_sql("v", "v.word", "x.id"))
def q_s7(spark, sf):
    return _emb_lines(spark, sf, "v")


@register("s8_write_doc_embeddings", VEC + _emb_line_sql("d", "x.id", "x.id"))
def q_s8(spark, sf):
    return _emb_lines(spark, sf, "d")


@register(
    "s4_read_word_embeddings",
    VEC + ", wl AS (SELECT v.word AS key, x.vec FROM vecs x JOIN vocab v ON x.id = v.idx WHERE x.role = 'u') "
    "SELECT key, unnest(range(len(vec)))::BIGINT AS j, round(CAST(printf('%.6f', unnest(vec)::DOUBLE) AS DOUBLE), 6) AS x FROM wl",
)
def q_s4(spark, sf):
    path = scratch_path(spark, "word-emb-text")
    write_ordered_lines(_emb_lines(spark, sf, "u"), "line_no", path)
    e = EI.read_word_embeddings(spark, path, DIM)
    return e.select("key", F.posexplode("vec").alias("j", "x")).select("key", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "s5_read_doc_embeddings",
    VEC + "SELECT id AS doc_id, unnest(range(len(vec)))::BIGINT AS j, "
    "round(CAST(printf('%.6f', unnest(vec)::DOUBLE) AS DOUBLE), 6) AS x FROM vecs WHERE role = 'd'",
)
def q_s5(spark, sf):
    path = scratch_path(spark, "doc-emb-text")
    write_ordered_lines(_emb_lines(spark, sf, "d"), "line_no", path)
    e = EI.read_doc_embeddings(spark, path)
    return e.select("doc_id", F.posexplode("vec").alias("j", "x")).select("doc_id", F.col("j").cast("bigint"),
                                                                          r6("x").alias("x"))


@register("s1_source_corpus", ORACLES["s1_read_corpus"])
def q_s1_source(spark, sf):
    """The corpus of ``s1_read_corpus`` through the registered source."""
    lines = C.line_documents(load(spark, sf, "documents")).select("doc_id", "line_no", F.col("text").alias("value"))
    path = scratch_path(spark, "corpus-lines")
    TS.write_lines(lines, ["doc_id", "line_no"], path)
    return TS.read_lines(spark, path).select(F.col("line_no").alias("doc_id"), F.col("value").alias("text"))


@register("s2_source_vocab", ORACLES["s2_read_vocab"])
def q_s2_source(spark, sf):
    path = scratch_path(spark, "vocab-lines")
    TS.write_lines(VI.vocab_lines(vocab(spark, sf)), ["idx"], path)
    return V.import_vocab(VI.parse_vocab_lines(TS.read_lines(spark, path)), MIN_COUNT)


@register("s4_source_word_vectors", ORACLES["s4_read_word_embeddings"])
def q_s4_source(spark, sf):
    path = scratch_path(spark, "word-vectors")
    words = vocab(spark, sf).select(F.col("idx").alias("id"), "word")
    TS.write_vectors(_vectors(spark, sf).filter("role = 'u'").join(words, "id"), "word", "id", DIM, path)
    e = TS.read_vectors(spark, path).select("key", F.posexplode("vec").alias("j", "x"))
    return e.select("key", F.col("j").cast("bigint"), r6("x").alias("x"))


@register("s5_source_doc_vectors", ORACLES["s5_read_doc_embeddings"])
def q_s5_source(spark, sf):
    path = scratch_path(spark, "doc-vectors")
    TS.write_vectors(_vectors(spark, sf).filter("role = 'd'"), "id", "id", DIM, path)
    e = TS.read_doc_vectors(spark, path).select("doc_id", F.posexplode("vec").alias("j", "x"))
    return e.select("doc_id", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "s14_read_pretrained",
    VEC + "SELECT x.role, v.word AS key, unnest(range(len(vec)))::BIGINT AS j, "
    "round(CAST(printf('%.6f', unnest(vec)::DOUBLE) AS DOUBLE), 6) AS x FROM vecs x JOIN vocab v ON x.id = v.idx "
    "WHERE x.role IN ('u', 'v')",
)
def q_s14(spark, sf):
    """Both word tables written as a pretrained pair and read back."""
    prefix = scratch_path(spark, "pretrained")
    for role, suffix in (("u", "_w.txt"), ("v", "_v.txt")):
        write_ordered_lines(_emb_lines(spark, sf, role), "line_no", prefix + suffix)
    u, v = EI.read_pretrained(spark, prefix, DIM)
    e = u.withColumn("role", F.lit("u")).unionByName(v.withColumn("role", F.lit("v")))
    return e.select("role", "key", F.posexplode("vec").alias("j", "x")).select(
        "role", "key", F.col("j").cast("bigint"), r6("x").alias("x"))


@register(
    "s13_append_metrics",
    "SELECT coalesce(CAST(lang AS VARCHAR), '') || ',' || CAST(count(*) AS VARCHAR) || ',' || CAST(sum(n_chars)::BIGINT AS VARCHAR) "
    "AS value FROM documents GROUP BY lang",
)
def q_s13(spark, sf):
    """One metrics line per language, appended run by run and read back."""
    path = scratch_path(spark, "metrics")
    d = load(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("c"))
    d = d.withColumn("lang", F.coalesce("lang", F.lit("")))  # a null language is an empty label
    LI.append_metrics(d.filter("lang <= 'en'"), path)
    LI.append_metrics(d.filter("lang > 'en'"), path)
    return spark.read.text(path)


@register(
    "s9_read_labels",
    "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_id, quality::INT AS label FROM labels",
)
def q_s9(spark, sf):
    """The ``labels`` table written as a 1-based label file (quality + 1 per
    line, in doc order) and read back."""
    lab = load(spark, sf, "labels").select(F.col("doc_id").alias("o"), (F.col("quality") + 1).cast("string").alias("value"))
    path = scratch_path(spark, "labels-text")
    write_ordered_lines(lab, "o", path)
    return LI.read_labels(spark, path)


def _pair_lines(spark, sf, fmt: str):
    """All pairs of both kinds as a file; a pair of both kinds is listed twice
    and its later line, of the skip kind, counts."""
    p = _bench_pairs(spark, sf).withColumn("o", F.when(F.col("benchmark") == "adjacent", 1).otherwise(2))
    s = F.format_string("%.2f", "score")
    if fmt == "csv":
        quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in ("w1", "w2")]
        body = p.select("o", "w1", "w2", F.concat_ws(",", *quoted, s).alias("value"))
        head = "first,second,score"
    elif fmt == "men":
        body = p.select("o", "w1", "w2", F.concat_ws(" ", "w1", "w2", s).alias("value"))
        head = None
    else:
        body = p.select("o", "w1", "w2",
                        F.concat_ws("\t", "w1", "w2", F.lit("N"), s, *[F.lit("1") for _ in range(6)]).alias("value"))
        head = "\t".join(["first", "second", "pos", "score", *[f"x{i}" for i in range(6)]])
    if head is not None:
        body = body.unionByName(spark.createDataFrame([(0, "", "", head)], "o int, w1 string, w2 string, value string"))
    path = scratch_path(spark, f"pairs-{fmt}")
    write_ordered_lines(body, ["o", "w1", "w2"], path)
    return path


PAIRS_SQL = BENCH_SQL + (
    ", ap AS (SELECT w1, w2, round(max_by(score, benchmark), 2) AS score FROM bp GROUP BY w1, w2) "
)


@register("s10_read_pairs_wordsim", PAIRS_SQL + "SELECT w1, w2, score FROM ap")
def q_s10(spark, sf):
    return B.read_pairs(spark, _pair_lines(spark, sf, "csv"), "wordsim353").select("w1", "w2", "score")


@register("s11_read_pairs_men", PAIRS_SQL + "SELECT w1, w2, score FROM ap")
def q_s11(spark, sf):
    return B.read_pairs(spark, _pair_lines(spark, sf, "men"), "men").select("w1", "w2", "score")


@register("s12_read_pairs_simlex", PAIRS_SQL + "SELECT w1, w2, score FROM ap")
def q_s12(spark, sf):
    return B.read_pairs(spark, _pair_lines(spark, sf, "simlex"), "simlex").select("w1", "w2", "score")


# ------------------------------------------------------------------- M6 / M7


@register(
    "m6_string_functions",
    "SELECT item_id, lower(" + _strip_sql("text") + ") AS lowered, len(string_split(" + _strip_sql("text")
    + ", ' '))::BIGINT AS n_fields, TRY_CAST(string_split(" + _strip_sql("text") + ", ' ')[1] AS DOUBLE) AS first_num "
    "FROM benchmark",
)
def q_m6(spark, sf):
    """lower / strip / split / cast as the evaluation parsers use them."""
    from sphaera.functions.text import PY_STRIP_CLASS

    b = load(spark, sf, "benchmark")
    st = F.regexp_replace("text", f"^{PY_STRIP_CLASS}+|{PY_STRIP_CLASS}+$", "")
    parts = F.split(st, " ")
    return b.select("item_id", F.lower(st).alias("lowered"), F.size(parts).cast("bigint").alias("n_fields"),
                    F.try_element_at(parts, F.lit(1)).try_cast("double").alias("first_num"))


@register(
    "m7_math_functions",
    VOC + "SELECT idx::BIGINT AS idx, round(pow(cn::DOUBLE, 0.75), 6) AS pw, round(sqrt(cn::DOUBLE), 6) AS sq, "
    "(cn // 7)::BIGINT AS fl, (cn % 7)::BIGINT AS md, round(ln(cn::DOUBLE), 6) AS lg FROM vocab",
)
def q_m7(spark, sf):
    """pow / sqrt / floor-division / mod / log as the sampling and metric
    formulas use them, over the vocabulary counts."""
    v = vocab(spark, sf)
    c = F.col("cn").cast("double")
    return v.select("idx", r6(F.pow(c, F.lit(0.75))).alias("pw"), r6(F.sqrt(c)).alias("sq"),
                    F.floor(F.col("cn") / 7).cast("bigint").alias("fl"), (F.col("cn") % 7).cast("bigint").alias("md"),
                    r6(F.log(c)).alias("lg"))
