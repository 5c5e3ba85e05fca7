"""Mixing sources to target weights (DataFrame functions only).

The words of a source, document after document in a pseudorandom order, form
one stream that is cut into blocks of ``block_words`` words. A source gets as
many slots as its target needs. Each slot draws its output shard by a keyed
uniform draw, so the source counts of the shards are a multinomial draw given
the source totals. Slot ``k`` of a source points to block ``perm(k)``, where
``perm`` is the source's pseudorandom permutation of its block numbers, gone
through once per pass; the short last block ends each pass. Slots and blocks
are joined by index, and the last slot of a source is cut where the target is
reached. Reruns draw the same mix, since every draw is a hash of its key.

Defined cases: a null text has no words; a null source is a source of its own,
ordered last; a source without words has target 0; rows that share an
identifier are documents of their own, and rows that are equal in every column
lie in the stream one after another; an empty table gives an empty result. Only
the named columns are read, whatever others there are; :func:`mix_documents`
reads all columns and keeps rows apart that differ in any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_cut

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
CHUNK_ROWS = 2000
SLOT_ROWS = 4096
FEISTEL_ROUNDS = 4
WALK = 64


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): weights go
    round by code-point order of the sources, nulls last; together they share
    ``share`` times all words; a target stops at ``most`` times its source and
    the excess is shared again by weight. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src") % len(weights)) + 1).cast("int"))
    s = sizes.withColumn("src", F.row_number().over(order) - 1).withColumn("w", w)
    s = s.withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    s = s.withColumn("all_words", share * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    # sources in the order in which their caps are met as the level rises
    rising = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_cap = F.sum("cap").over(rising) - F.col("cap")
    before_w = F.sum("w").over(rising) - F.col("w")
    s = s.withColumn("level", (F.col("all_words") - before_cap) / (F.col("all_w") - before_w))
    # the first source that stays below its cap sets the level of all that do
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "src", "level"))
    s = s.withColumn("first_level", F.min(open_).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("first_level") * F.col("w"), F.col("cap")))
    return s.select("source", "src", "source_size", target.alias("target"))


def _row_key(df: DataFrame, columns: list[str]) -> Column:
    """128 bits over the given columns, for telling rows apart."""
    text = F.to_json(F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(text, 256), 1, 32)


def _layout(df: DataFrame, id_col: str, text_col: str, source_col: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream (``off``), and the
    sources' sizes. Equal rows (in ``columns``) are one entry with their number
    until their places are known. Long sources are cut into chunks of about
    ``CHUNK_ROWS`` entries: offsets are summed inside chunks and over chunk
    totals."""
    docs = df.select(
        df[id_col].alias("id"), df[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(df[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _row_key(df, columns or [id_col, text_col, source_col]).alias("th"),
    )
    docs = docs.groupBy("id", "source", "size", "th").agg(F.count(F.lit(1)).alias("copies"))
    docs = write_cut(docs.withColumn("h", F.xxhash64("id", "th")), "mix-sizes")
    n = docs.count()
    docs = docs.withColumn("chunk", F.pmod("h", F.lit(max(1, -(-n // CHUNK_ROWS)))))
    docs = docs.withColumn("words", F.col("size") * F.col("copies"))
    totals = docs.groupBy("source", "chunk").agg(F.sum("words").alias("words"))
    sizes = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = F.sum("words").over(
        Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"), F.coalesce(before, F.lit(0)).alias("chunk_off")
    )
    inside = Window.partitionBy("source", "chunk").orderBy("h", "id", "th").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("in_chunk", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    docs = docs.join(starts, docs["source"].eqNullSafe(starts["c_source"]) & (docs["chunk"] == starts["c_chunk"]))
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    off = F.col("chunk_off") + F.col("in_chunk") + F.col("copy") * F.col("size")
    return docs.select("id", "source", "size", "th", off.alias("off")), sizes


def _permute(k: Column, n: Column, *key: Column) -> Column:
    """Place of ``k`` in a pseudorandom permutation of 0..n-1: a Feistel network
    on pairs of numbers below ceil(sqrt(n)), applied again while the result is
    not below n (a walk of more than ``WALK`` steps fails the query)."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def feistel(x: Column) -> Column:
        halves = F.struct(F.floor(x / side).cast("long").alias("l"), (x % side).alias("r"))
        return F.aggregate(
            F.array(*[F.lit(i) for i in range(FEISTEL_ROUNDS)]), halves,
            lambda s, i: F.struct(
                s["r"].alias("l"), ((s["l"] + F.pmod(F.xxhash64(*key, i, s["r"]), side)) % side).alias("r")
            ),
            lambda s: s["l"] * side + s["r"],
        )

    once = feistel(k)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < n, x).otherwise(feistel(x))
    )
    walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("permutation walk too long")).cast("long"))
    return F.when(once < n, once).otherwise(walked)


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The slots of all sources: src, pass, block, words, shard."""
    size, rest = F.col("source_size"), F.col("total") % F.col("source_size")
    # a number of its own: few small rows go in, many come out
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = sources.filter("source_size > 0").withColumn("total", F.least(F.round("target").cast("long"), 2 * size))
    s = s.withColumn("full", F.floor(size / block_words).cast("long"))
    s = s.withColumn("blocks", F.ceil(size / block_words).cast("long"))
    s = s.withColumn(
        "slots", F.floor(F.col("total") / size).cast("long") * F.col("blocks") + F.ceil(rest / block_words).cast("long")
    )
    s = s.withColumn("all_slots", F.sum("slots").over(Window.partitionBy())).filter("slots > 0")
    part = F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_ROWS).cast("long"))
    s = s.withColumn("part", F.explode(part)).repartition(parts, "src", "part")
    lo = F.col("part") * SLOT_ROWS
    s = s.withColumn("k", F.explode(F.sequence(lo, F.least(lo + SLOT_ROWS, F.col("slots")) - 1)))
    s = s.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("int")).withColumn("j", F.col("k") % F.col("blocks"))
    perm = _permute(F.col("j"), F.col("full"), F.lit(seed), F.col("src"), F.col("pass"))
    done = F.col("pass") * size + F.col("j") * block_words
    shards = F.ceil(F.col("all_slots") / shard_slots).cast("long")
    return s.select(
        "src", "k", "pass",
        F.when(F.col("j") < F.col("full"), perm).otherwise(F.col("full")).alias("block"),
        F.least(F.lit(block_words), F.col("total") - done).cast("long").alias("words"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "src", "k"), shards).alias("shard"),
    )


def _pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """Documents cut at the block borders of their source's stream."""
    end = F.col("off") + F.col("size")
    d = docs.filter("size > 0").withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("off") / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))),
    )
    lo, hi = F.col("block") * block_words, (F.col("block") + 1) * block_words
    first = F.greatest(F.col("off"), lo)
    return d.select(
        "src", "off", "block", (first - lo).alias("in_block"), (first - F.col("off")).alias("start"),
        (F.least(end, hi) - first).alias("length"),
    )


def _mix(df, id_col, text_col, source_col, weights, share, most, block_words, shard_slots, seed, columns=None):
    docs, sizes = _layout(df, id_col, text_col, source_col, columns)
    sources = write_cut(source_targets(sizes, weights, share, most), "mix-sources")
    s = sources.withColumnRenamed("source", "s_source")
    docs = docs.join(s, docs["source"].eqNullSafe(s["s_source"])).drop("s_source")
    docs = write_cut(docs, "mix-layout")
    slots = _slots(sources, block_words, shard_slots, seed)
    # the planner takes the generated slots for a few rows: never broadcast them
    taken = slots.hint("merge").join(_pieces(docs, block_words), ["src", "block"]).withColumn(
        "took", F.least(F.col("length"), F.col("words") - F.col("in_block"))
    ).filter("took > 0")
    return docs, taken


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block_words: int = 256, shard_slots: int = 1024, seed: int = 17,
) -> DataFrame:
    """One row per document: ``id_col``, ``size`` (its words), ``source_size``,
    ``target`` (both of its source), ``taken`` (its words in the mix) and
    ``shards``: its words in every output shard that draws some of them, as
    text (shard:words, comma-joined, by shard)."""
    docs, taken = _mix(df, id_col, text_col, source_col, weights, share, most, block_words, shard_slots, seed)
    per_shard = taken.groupBy("src", "off", "shard").agg(F.sum("took").alias("words"))
    shards = F.transform(F.sort_array(F.collect_list(F.struct("shard", "words"))), lambda s: F.concat_ws(":", s["shard"], s["words"]))
    per_doc = per_shard.groupBy("src", "off").agg(F.sum("words").alias("taken"), F.array_join(shards, ",").alias("shards"))
    # documents without words share their offset with the next one
    d = docs.withColumn("key", F.when(F.col("size") > 0, F.col("off")))
    per_doc = per_doc.select(F.col("src").alias("t_src"), F.col("off").alias("t_off"), "taken", "shards")
    out = d.join(per_doc, (d["src"] == per_doc["t_src"]) & (d["key"] == per_doc["t_off"]), "left")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("shards", F.lit("")).alias("shards"),
    )


def mixed_blocks(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block_words: int = 256, shard_slots: int = 1024, seed: int = 17,
) -> DataFrame:
    """The mix itself: for every output shard and slot the document pieces of
    its block: shard, source number, slot, place in the slot, identifier, first
    word and number of words in the document."""
    docs, taken = _mix(df, id_col, text_col, source_col, weights, share, most, block_words, shard_slots, seed)
    ids = docs.filter("size > 0").select("src", "off", "id")
    return taken.join(ids, ["src", "off"]).select(
        "shard", "src", F.col("k").alias("slot"), F.col("in_block").alias("at"), F.col("id").alias(id_col), "start",
        F.col("took").alias("words"),
    )


def mix_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    block_words: int = 256, shard_slots: int = 1024, seed: int = 17,
) -> DataFrame:
    """The mix as documents with the columns of ``df``: one row for each pass
    in which a document is taken; its text holds the words taken in that pass.
    Documents of which no word is taken are not in the mix. A row is dealt to
    the output shard that draws its first word in the pass; every partition
    holds its rows in the order of the shards."""
    docs, taken = _mix(df, id_col, text_col, source_col, weights, share, most, block_words, shard_slots, seed, df.columns)
    cuts = taken.groupBy("src", "off", "pass").agg(
        F.sort_array(F.collect_list(F.struct("start", "took"))).alias("mx_cuts"), F.sum("took").alias("mx_words"),
        F.min(F.struct("start", "shard"))["shard"].alias("mx_shard"),
    )
    rows = cuts.join(docs.filter("size > 0"), ["src", "off"]).select(
        F.col("th").alias("mx_th"), F.col("size").alias("mx_size"), "mx_cuts", "mx_words", "mx_shard"
    )
    whole = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("mx_row"), _row_key(df, df.columns).alias("mx_dth")
    ).dropDuplicates(["mx_dth"])  # rows that are equal in every column
    j = rows.join(whole, rows["mx_th"] == whole["mx_dth"]).sortWithinPartitions("mx_shard", "mx_dth")
    text = F.col("mx_row").getField(text_col).cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD_AND_SPACE), F.lit(0))
    j = j.withColumn("mx_cuts", F.transform("mx_cuts", lambda c: F.struct((c["start"] + 1).cast("int").alias("a"), c["took"].cast("int").alias("n"))))
    part = F.when(F.col("mx_words") == F.col("mx_size"), text).otherwise(
        F.array_join(F.flatten(F.transform("mx_cuts", lambda c: F.slice(words, c["a"], c["n"]))), "")
    )
    j = j.withColumn("mx_part", part)
    row = F.col("mx_row")
    out = {c: row.getField(c) for c in df.columns} | {text_col: F.col("mx_part")}
    if "n_chars" in df.columns:
        out["n_chars"] = F.length("mx_part").cast(df.schema["n_chars"].dataType)
    return j.select(*[v.alias(c) for c, v in out.items()])
