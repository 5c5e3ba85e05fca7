"""Secret scan (DataFrame functions only).

Base spans come from three fixed patterns. Further spans come from two
character Markov models, one of random strings and one of ordinary identifiers:
a run of key characters outside all base spans is a secret when the
log-likelihood ratio of the models is high, in total over its distinct pairs
and for each character over all its pairs. Few distinct pairs, over and over,
are repetition and no evidence.
Both models are bigram tables trained from a bounded labelled sample: the
values inside base spans are the random strings, all other runs are ordinary.
A uniform table stands behind the random strings, so that a few hexadecimal
samples do not rule out other alphabets, and a corpus without any labelled
secret still has a model.

Defined cases: a null text is empty; an empty text, and a table without rows,
has no spans; rows with one identifier are scanned one by one; only the named
columns are read, and other columns may have any name.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, in order
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that have 32 characters or more
KINDS = ["assign", "access", "hex", "model"]
BASE = [(ASSIGN, 2, 8), (ACCESS, 0, 16), (HEX, 0, 32)]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
START = "^"
MIN_RUN = 16
TRAIN_ROWS = 8000
PER_CHARACTER = 1.0
IN_TOTAL = 20.0
LEAST_PAIRS = 16  # distinct pairs of a run whose repeated pairs count
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str, group: int, keep) -> Column:
    """The matches of a pattern as (value, start, end), leftmost and without
    overlap, those whose group ``keep`` accepts. The text between matches and
    the matches themselves alternate, so their lengths add up to the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(x["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(keep(x["value"]), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out")
        )

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """Spans (value, start, end) of each base kind."""
    return [_found(text, p, g, lambda v, n=least: F.length(v) >= n) for p, g, least in BASE]


def _with_base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    return rows.withColumns({f"b{i}": c for i, c in enumerate(base_spans(F.col("t")))})


def _outside(rows: DataFrame) -> Column:
    """Whether a span (start, end) touches no base span of its row."""
    return lambda x: ~F.exists(
        F.concat(*[F.col(f"b{i}") for i in range(len(BASE))]), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    )


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> dict[str, float]:
    """Log-likelihood ratio of every pair of characters, from about ``rows``
    rows chosen by a hash of the identifier. The counts that reach the driver
    are bounded by the alphabet."""
    n = df.count()
    cut = 1_000_000
    take = cut if n <= rows else max(1, cut * rows // n)
    sample = df.filter(F.pmod(F.xxhash64(df[id_col], F.lit("secrets")), F.lit(cut)) < take)
    d = _with_base(sample, id_col, text_col)
    rand = F.flatten(F.array(*[F.transform(f"b{i}", lambda b: b["value"]) for i in range(len(BASE))]))
    rest = F.col("t")
    for pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    plain = F.regexp_extract_all(rest, F.lit(RUN % 3), F.lit(0))
    both = F.array(*[F.struct(F.lit(k).alias("rand"), v.alias("v")) for k, v in ((1, rand), (0, plain))])
    texts = d.select(F.explode(both).alias("x"))
    texts = texts.select("x.rand", F.explode("x.v").alias("v"))
    # each character with the one before it, cut once: a long run costs its length
    chars = F.split(F.col("v"), "")
    before = F.concat(F.array(F.lit(START)), F.slice(chars, F.lit(1), F.size(chars) - 1))
    pairs = texts.filter("length(v) > 0").select("rand", F.explode(F.zip_with(before, chars, lambda a, b: F.concat(a, b))).alias("p"))
    counts: dict = defaultdict(lambda: [0.0, 0.0])
    for r in pairs.groupBy("rand", "p").count().collect():
        counts[r["p"]][r["rand"]] = float(r["count"])
    model = {}
    for a in START + ALPHABET:
        total = [sum(counts[a + b][k] for b in ALPHABET) for k in (0, 1)]
        for b in ALPHABET:
            ordinary = (counts[a + b][0] + 0.5) / (total[0] + 0.5 * len(ALPHABET))
            random = (counts[a + b][1] + 1.0) / (total[1] + 1.0 * len(ALPHABET))
            model[a + b] = math.log(random / ordinary)
    return model


def _scores(model: dict[str, float]) -> Column:
    """The model as an array, one number for each pair of characters."""
    table = ",".join(f"{model[a + b]:.6f}" for a in START + ALPHABET for b in ALPHABET)
    return F.split(F.lit(table), ",").cast("array<double>")  # folded to one constant


def _pairs(value: Column) -> Column:
    """The numbers of the pairs of a run of characters of the alphabet."""
    symbols = F.lit(START + ALPHABET)
    place = F.concat(F.array(F.lit(1)), F.transform(F.split(value, ""), lambda c: F.position(c, symbols)))
    return F.zip_with(
        F.slice(place, F.lit(1), F.length(value)), F.slice(place, F.lit(2), F.length(value)),
        lambda a, b: (a - 1) * len(ALPHABET) + b - 2,
    )


def _sum(pairs: Column, scores: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get(scores, i))


def _ratio(value: Column, model: dict[str, float]) -> Column:
    """Log-likelihood ratio of a run of characters of the alphabet; a pair of
    characters counts once, so that repetition is no evidence."""
    return _sum(F.array_distinct(_pairs(value)), _scores(model))


def _secret(value: Column, model: dict[str, float]) -> Column:
    """Whether a run is a secret. The distinct pairs are bounded by the alphabet
    while the bar for each character grows with the run, so a run with enough
    of them is held against that bar with all its pairs."""
    scores, bar = _scores(model), PER_CHARACTER * F.length(value)

    def decide(every: Column, once: Column, total: Column) -> Column:
        return (total >= IN_TOTAL) & ((total >= bar) | ((F.size(once) >= LEAST_PAIRS) & (_sum(every, scores) >= bar)))

    # arrays of one value: each is computed once
    return F.exists(F.array(_pairs(value)), lambda every: F.exists(
        F.array(F.array_distinct(every)),
        lambda once: F.exists(F.array(_sum(once, scores)), lambda total: decide(every, once, total)),
    ))


def find_secrets(
    df: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN
) -> DataFrame:
    """``id`` and ``spans``: all spans (start, kind, end) in code points, end
    exclusive, sorted; ``kind`` counts through ``KINDS``."""
    d = _with_base(df, id_col, text_col)

    secrets = _found(F.col("t"), RUN % min_run, 0, lambda v: _secret(v, model))
    d = d.withColumn(f"b{len(BASE)}", F.filter(secrets, _outside(d)))

    def of_kind(i: int) -> Column:
        return F.transform(
            f"b{i}", lambda b: F.struct(b["start"].alias("start"), F.lit(i).alias("kind"), b["end"].alias("end"))
        )

    return d.select("id", F.sort_array(F.concat(*[of_kind(i) for i in range(len(KINDS))])).alias("spans"))


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, ``base_sha256`` and
    ``spans`` as text (kind:start:end, comma-joined)."""
    d = find_secrets(df, train(df, id_col, text_col), id_col, text_col)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return d.select(
        F.col("id").alias(id_col), *[count(i) for i in range(len(BASE))], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
