"""DuckDB text of the building blocks, composed into the oracle queries.

Each function returns ``name AS (...)`` CTE text over the driver's views
(``documents``, ``embeddings``, ``labels`` ...). The oracles are the plain,
single-node statement of each operator: global windows, ASOF joins and cross
joins are fine there; the Spark forms avoid them.
"""

from __future__ import annotations

from sphaera.functions.initgen import init_value_sql
from sphaera.functions.keyed import draw_pair_sql, lanes_sql, uniform_sql
from sphaera.params import EOS, MAX_TOKEN_BYTES, NOISE_POWER


def u(seed: int, op: str, keys: list[str], lane: int = 0) -> str:
    return uniform_sql(seed, op, keys, lane, "duckdb")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cut_token(w: str, n: int = MAX_TOKEN_BYTES) -> str:
    """The characters that fit whole into ``n`` bytes."""
    fits = ", ".join(f"try(decode(encode({w})[1:{n - i}]))" for i in range(4))
    return f"CASE WHEN strlen({w}) > {n} THEN coalesce({fits}) ELSE {w} END"


def tok(text: str = "text") -> str:
    arr = f"list_filter(regexp_split_to_array(replace({text}, chr(13), ''), '[ \\t\\n]+'), lambda x: x <> '')"
    return (
        "tok AS (SELECT doc_id, pos, w AS word FROM ("
        f"SELECT doc_id, unnest(range(len(arr))) AS pos, unnest(arr) AS w FROM (SELECT doc_id, {arr} AS arr FROM documents)))"
    )


def counts() -> str:
    return (
        "counts AS (SELECT word, count(*) AS cn FROM "
        f"(SELECT word FROM tok UNION ALL SELECT '{EOS}' AS word FROM documents) GROUP BY word)"
    )


def vocab(min_count: int, p: str = "") -> str:
    return (
        f"{p}kept_words AS (SELECT word, cn FROM counts WHERE cn >= {min_count} OR word = '{EOS}'),\n"
        f"{p}vocab AS (SELECT 0::BIGINT AS idx, word, cn FROM {p}kept_words WHERE word = '{EOS}' UNION ALL "
        f"SELECT row_number() OVER (ORDER BY cn DESC, word DESC) AS idx, word, cn FROM {p}kept_words WHERE word <> '{EOS}'),\n"
        f"{p}nstat AS (SELECT sum(cn)::BIGINT AS n_train, count(*)::BIGINT AS n_vocab FROM {p}vocab)"
    )


def enc() -> str:
    return (
        "enc AS (SELECT t.doc_id, (row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos) - 1)::BIGINT AS pos, "
        "v.idx, v.cn FROM tok t JOIN vocab v ON t.word = v.word WHERE v.idx > 0)"
    )


def keep_p(sample: float) -> str:
    """P1 as an expression over ``cn`` and ``nstat.n_train``."""
    sn = f"({float(sample)} * n_train)"
    return f"least(1.0, (sqrt(cn / {sn}) + 1) * {sn} / cn)"


def kept(seed: int, sample: float, epoch: int, window: int, max_segment: int | None = None) -> str:
    """P2 + C9 + P5: subsampled tokens with kpos, seg and radius."""
    seg = "0" if max_segment is None else f"kpos // {max_segment}"
    uu = u(seed, "sub", [str(epoch), "doc_id", "pos"])
    filt = f"WHERE {uu} <= {keep_p(sample)}" if sample > 0 else ""
    rad = f"{window} - CAST(floor({u(seed, 'win', [str(epoch), 'doc_id', 'kpos'])} * {window}) AS BIGINT)"
    return (
        f"sub AS MATERIALIZED (SELECT enc.* FROM enc, nstat {filt}),\n"
        "kp AS (SELECT doc_id, pos, idx, cn, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS kpos FROM sub),\n"
        f"kept AS MATERIALIZED (SELECT doc_id, pos, idx, cn, kpos, ({seg})::BIGINT AS seg, ({rad})::BIGINT AS radius FROM kp)"
    )


def noise() -> str:
    """Plain per-id CDF (``noise_cdf``) and the per-count histogram."""
    return (
        f"nw AS (SELECT idx, cn, pow(cn::DOUBLE, {NOISE_POWER}) AS w FROM vocab),\n"
        "nz AS (SELECT sum(w) AS z FROM nw),\n"
        "noise_cdf AS (SELECT idx, sum(w) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb, "
        "w FROM nw)"
    )


def init_vec(flat_base: str, dim: int) -> str:
    """T1 unnormalised vector of ``dim`` values starting at stream element
    ``flat_base``."""
    return f"list_transform(range({dim}), lambda j: {init_value_sql(f'({flat_base}) + j', dim, 'duckdb')})"


def hist() -> str:
    """P3 histogram: one bucket per distinct count, id 0 alone, in id order."""
    return (
        "hb AS (SELECT min(idx) AS first_idx, count(*) AS n_words, max(cn) AS cn FROM vocab "
        "GROUP BY CASE WHEN idx = 0 THEN -1 ELSE cn END),\n"
        f"hw AS (SELECT first_idx, n_words, cn, pow(cn::DOUBLE, {NOISE_POWER}) AS w, "
        f"pow(cn::DOUBLE, {NOISE_POWER}) * n_words AS mass FROM hb),\n"
        "hist AS (SELECT *, coalesce(sum(mass) OVER (ORDER BY first_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS cum_before FROM hw),\n"
        "hz AS (SELECT sum(mass) AS z FROM hist)"
    )


def draws(name: str, src: str, seed: int, op: str, epoch: int, keys: list[str], negative: int) -> str:
    """Rows of ``src`` times k = 1..negative with the two keyed uniforms and
    the drawn noise id ``neg`` (P4 with the P6 fallback), via ASOF join."""
    lanes = lanes_sql(seed, op, [str(epoch), "doc_id", "kpos"], "duckdb")
    u1, u2 = draw_pair_sql(negative, "g.off" if "off" in keys else "0", "kk.k", "g._l", "duckdb")
    return (
        f"{name}_g AS (SELECT s.*, {lanes} AS _l FROM {src} s),\n"
        f"{name}_u AS (SELECT g.* EXCLUDE (_l), kk.k::BIGINT AS k, {u1} AS u1, {u2} AS u2 FROM {name}_g g, "
        f"(SELECT unnest(range(1, {negative + 1})) AS k) kk),\n"
        f"{name}_t AS (SELECT x.*, x.u1 * hz.z AS t FROM {name}_u x, hz),\n"
        f"{name} AS (SELECT x.* EXCLUDE (t), CASE WHEN h.first_idx + least(h.n_words - 1, "
        "CAST(floor((x.t - h.cum_before) / h.w) AS BIGINT)) = 0 THEN "
        "1 + CAST(floor(x.u2 * ((SELECT n_vocab FROM nstat) - 1)) AS BIGINT) ELSE h.first_idx + least(h.n_words - 1, "
        f"CAST(floor((x.t - h.cum_before) / h.w) AS BIGINT)) END AS neg FROM {name}_t x ASOF JOIN hist h "
        "ON x.t >= h.cum_before)"
    )


def pairs(window: int) -> str:
    """G1 as an equi-join on the other position, for every signed distance."""
    return (
        "po AS (SELECT k.*, o.off::BIGINT AS off, k.kpos + o.off AS other FROM kept k, "
        f"(SELECT unnest(range(-{window}, {window} + 1)) AS off) o WHERE o.off <> 0 AND abs(o.off) <= k.radius),\n"
        "pairs AS (SELECT a.doc_id, a.seg, a.kpos, a.off, a.idx AS ctx, b.idx AS center "
        "FROM po a JOIN kept b ON a.doc_id = b.doc_id AND a.seg = b.seg AND b.kpos = a.other)"
    )


def vecs(dim: int, p: str = "") -> str:
    """V rows, then u rows, then documents as one stream; normalised and
    stored as FLOAT like the Spark table."""
    return (
        f"{p}ids AS (SELECT 'v' AS role, idx AS id, idx AS rno FROM {p}vocab UNION ALL "
        f"SELECT 'u', idx, (SELECT n_vocab FROM {p}nstat) + idx FROM {p}vocab UNION ALL "
        f"SELECT 'd', doc_id, 2 * (SELECT n_vocab FROM {p}nstat) + doc_id FROM documents),\n"
        f"{p}rawv AS (SELECT role, id, {init_vec(f'rno * {dim}', dim)} AS vec FROM {p}ids),\n"
        f"{p}nv AS (SELECT role, id, vec, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS n FROM {p}rawv),\n"
        f"{p}vecs AS (SELECT role, id, list_transform(vec, lambda x: CAST(x / n AS FLOAT)) AS vec FROM {p}nv)"
    )


def dotp(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def forward(name: str, src: str, anchor_role: str, anchor: str, pos: str, margin: float) -> str:
    """T3 over triples ``src``: anchor/positive/negative vectors, f, h."""
    m = f"{float(margin)}::DOUBLE"
    return (
        f"{name}0 AS (SELECT t.*, a.vec AS a_vec, u.vec AS u_vec, n.vec AS n_vec FROM {src} t "
        f"JOIN vecs a ON a.role = '{anchor_role}' AND a.id = t.{anchor} "
        f"JOIN vecs u ON u.role = 'u' AND u.id = t.{pos} JOIN vecs n ON n.role = 'u' AND n.id = t.neg),\n"
        f"{name}1 AS (SELECT *, {dotp('u_vec', 'a_vec')} AS f, {dotp('n_vec', 'a_vec')} AS h FROM {name}0),\n"
        f"{name} AS (SELECT *, greatest(0.0::DOUBLE, {m} - (f - h)) AS loss, (f - h) < {m} AS active FROM {name}1)"
    )


def deltas(name: str, fwd: str, anchor_role: str, anchor: str, pos: str, alpha: float, dim: int) -> str:
    """T4/T5: per active triple the three gradient steps as rows."""
    a = f"{float(alpha)}::DOUBLE"
    r = f"range({dim})"
    du = f"list_transform({r}, lambda j: {a} * (1.0 - f) * (a_vec[j + 1] - f * u_vec[j + 1]))"
    dn = f"list_transform({r}, lambda j: {a} * 2.0 * h * (h * n_vec[j + 1] - a_vec[j + 1]))"
    da = (
        f"list_transform({r}, lambda j: {a} * (1.0 - (f - h)) * (u_vec[j + 1] - f * a_vec[j + 1] + h * a_vec[j + 1] "
        "- n_vec[j + 1]))"
    )
    return (
        f"{name} AS (SELECT 'u' AS role, {pos} AS id, {du} AS delta FROM {fwd} WHERE active UNION ALL "
        f"SELECT 'u', neg, {dn} FROM {fwd} WHERE active UNION ALL "
        f"SELECT '{anchor_role}', {anchor}, {da} FROM {fwd} WHERE active)"
    )


def long_sum(name: str, src: str) -> str:
    return (
        f"{name} AS (SELECT role, id, j, sum(x) AS x FROM (SELECT role, id, unnest(range(len(delta))) AS j, "
        f"unnest(delta) AS x FROM {src}) GROUP BY role, id, j)"
    )
