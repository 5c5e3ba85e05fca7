"""Corpus operators C1-C12: tokens, document numbering, offsets, shards,
vocabulary encoding and segmentation.

A document is one row of ``docs(doc_id, text)``; ``doc_id`` is the document
number (0-based line number of a text corpus). A standalone ``</s>`` token
inside a text ends a document as in the reference: :func:`doc_boundaries`
renumbers such rows into several documents before anything else runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera.functions.text import PY_STRIP_CLASS
from sphaera.operators.ordering import with_prefix_sum
from sphaera.params import EOS, MAX_TOKEN_BYTES
from sphaera.session import write_cut

def raw_token_array(text_col: str = "text"):
    """C1 on one text: ``\\r`` deleted, split on runs of space/tab/newline,
    empty strings dropped."""
    text = F.replace(F.col(text_col), F.lit("\r"), F.lit(""))
    for c in "\t\n":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def truncate_token(col, max_bytes: int = MAX_TOKEN_BYTES):
    """A token longer than ``max_bytes`` bytes keeps the characters that
    fit whole into them. A character has at most four bytes, so the border is
    at ``max_bytes`` or up to three bytes before; the byte after it does not
    continue a character."""
    c = F.col(col) if isinstance(col, str) else col
    raw = c.cast("binary")
    cut = F.substring(raw, 1, max_bytes - 3)
    for n in range(max_bytes - 2, max_bytes + 1):
        after = F.hex(F.substring(raw, n + 1, 1))
        cut = F.when((after < "80") | (after > "BF"), F.substring(raw, 1, n)).otherwise(cut)
    return F.when(F.octet_length(c) > max_bytes, cut.cast("string")).otherwise(c)


def tokenize(docs: DataFrame, text_col: str = "text", max_bytes: int | None = None) -> DataFrame:
    """``tokens(doc_id, pos, word)``, ``pos`` 0-based; with ``max_bytes``
    also C3. Literal ``</s>`` tokens are kept; :func:`doc_boundaries` splits on
    them first."""
    t = docs.select("doc_id", F.posexplode(raw_token_array(text_col)).alias("pos", "word"))
    return t if max_bytes is None else t.withColumn("word", truncate_token("word", max_bytes))


def marker_count(text_col: str = "text"):
    """Number of standalone ``</s>`` tokens in a text."""
    return F.size(F.filter(raw_token_array(text_col), lambda x: x == EOS))


MARKER_SPLIT = "(?:^| )</s>(?= |$)"


def doc_boundaries(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A standalone ``</s>`` token ends a document, so a row holding
    ``m`` markers is ``m + 1`` documents (empty ones included).

    Returns ``docs(doc_id, src_id, sub, text)`` where ``doc_id`` is the dense
    document number (first number of a row = rows and markers before it, by a
    two-phase prefix sum) and ``text`` the document's tokens joined by spaces.
    Only needed when the corpus holds markers (see ``corpus_stats``); without
    them the document number is the row id itself.
    """
    arr = raw_token_array(text_col)
    pieces = F.split(F.array_join(arr, " "), MARKER_SPLIT)
    d = docs.select(F.col("doc_id").alias("src_id"), pieces.alias("pieces"))
    d = d.withColumn("n_sub", F.size("pieces"))
    d = with_prefix_sum(d, ["src_id"], "n_sub", "first_no", inclusive=False)
    return d.select(
        "src_id",
        "first_no",
        F.posexplode("pieces").alias("sub", "text"),
    ).select((F.col("first_no") + F.col("sub")).alias("doc_id"), "src_id", "sub", F.trim("text").alias("text"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """C4: documents, tokens (markers excluded), words read by the reference's
    counting pass (tokens plus one ``</s>`` per document) and corpus bytes
    (text plus one newline per row)."""
    arr = raw_token_array(text_col)
    per = docs.select(
        F.size(arr).alias("n"),
        marker_count(text_col).alias("m"),
        (F.octet_length(text_col) + 1).alias("b"),
    )
    return per.agg(
        (F.count(F.lit(1)) + F.sum("m")).cast("bigint").alias("n_docs"),
        (F.sum("n") - F.sum("m")).cast("bigint").alias("n_tokens"),
        (F.sum("n") + F.count(F.lit(1))).cast("bigint").alias("n_words_read"),
        F.sum("b").cast("bigint").alias("n_bytes"),
    )


def doc_offsets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Byte range ``[start_off, end_off)`` of every row in the corpus file
    (text plus its newline), by a two-phase prefix sum."""
    d = docs.select("doc_id", (F.octet_length(text_col) + 1).cast("bigint").alias("n_bytes"))
    d = with_prefix_sum(d, ["doc_id"], "n_bytes", "end_off", inclusive=True)
    return d.select("doc_id", (F.col("end_off") - F.col("n_bytes")).alias("start_off"), "end_off")


def doc_at_offset(offsets: DataFrame, positions: DataFrame, bucket_bytes: int = 1 << 20) -> DataFrame:
    """For each ``positions(pos_id, pos)`` the row whose byte range holds
    ``pos`` (first row with ``end_off > pos``, clamped to the last row).

    Range join as an equi-join on ``pos div bucket_bytes``: every row is
    exploded into the buckets it spans (rows + bytes/bucket rows in total), so
    each position meets only the rows of its own bucket.
    """
    total = offsets.agg(F.max("end_off").alias("total"))
    b = F.lit(bucket_bytes)
    spans = offsets.select(
        "doc_id",
        "start_off",
        "end_off",
        F.explode(F.sequence(F.floor(F.col("start_off") / b), F.floor((F.col("end_off") - 1) / b))).alias("bucket"),
    )
    p = positions.crossJoin(F.broadcast(total)).withColumn(
        "cpos", F.least(F.greatest(F.col("pos"), F.lit(0)), F.col("total") - 1)
    ).withColumn("bucket", F.floor(F.col("cpos") / b))
    return (
        p.join(spans, "bucket")
        .filter((F.col("start_off") <= F.col("cpos")) & (F.col("cpos") < F.col("end_off")))
        .select("pos_id", "pos", "doc_id")
    )


def balanced_shards(offsets: DataFrame, n: int) -> DataFrame:
    """``n`` shards of about equal bytes; whole rows only.
    ``shard = least(n - 1, start_off * n div total)``."""
    total = offsets.agg(F.max("end_off").alias("total"))
    return offsets.crossJoin(F.broadcast(total)).select(
        "doc_id",
        F.least(
            F.lit(n - 1), F.expr(f"cast(start_off as decimal(28,0)) * {int(n)} div cast(total as decimal(28,0))")
        ).cast("int").alias("shard"),
    )


def line_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line (the reference's document grain)."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "text"))


def split_simple(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """C11: evaluation-side tokens: Python ``strip()`` then ``split(' ')``;
    tabs do not split and empty strings are kept."""
    stripped = F.regexp_replace(F.col(text_col), f"^{PY_STRIP_CLASS}+|{PY_STRIP_CLASS}+$", "")
    return docs.select("doc_id", F.posexplode(F.split(stripped, " ")).alias("pos", "word"))


BROADCAST_BYTES = 64 << 20


def lookup_side(vocab: DataFrame, broadcast_rows: int | None = 2_000_000) -> DataFrame:
    """The vocabulary as the small side of a word lookup: broadcast when both
    its rows and its bytes are within bounds, which are counted first."""
    if broadcast_rows is None:
        return vocab
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 40).alias("b")).first()
    small = size["n"] <= broadcast_rows and (size["b"] or 0) <= BROADCAST_BYTES
    return F.broadcast(vocab) if small else vocab


HEAD_ROWS = 500_000


def vocabulary_parts(vocab: DataFrame, broadcast_rows: int | None = 2_000_000, head_rows: int = HEAD_ROWS):
    """``(head, tail)`` of a vocabulary ranked by count for a word lookup. Within
    the bounds of :func:`lookup_side` all of it is the head, which is broadcast,
    and there is no tail. Beyond, the head is its most frequent words, as many as
    the bounds allow, and only words outside it need a shuffle."""
    if broadcast_rows is None:
        return None, vocab
    bytes_of = F.octet_length("word") + 40
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("b")).first()
    if size["n"] <= broadcast_rows and (size["b"] or 0) <= BROADCAST_BYTES:
        return F.broadcast(vocab), None
    rows = min(head_rows, broadcast_rows)
    first = F.col("idx") <= rows
    while rows and (vocab.filter(first).agg(F.sum(bytes_of)).first()[0] or 0) > BROADCAST_BYTES:
        rows //= 2  # long words
        first = F.col("idx") <= rows
    return F.broadcast(vocab.filter(first)), vocab.filter(~first)


def look_up(tokens: DataFrame, vocab: DataFrame, broadcast_rows: int | None = 2_000_000, head_rows: int = HEAD_ROWS) -> DataFrame:
    """The tokens whose ``word`` has a row in ``vocab(word, idx, ...)``, with its
    columns. Frequent words meet it where they are; the others are shuffled."""
    head, tail = vocabulary_parts(vocab, broadcast_rows, head_rows)
    if tail is None:
        return tokens.join(head, "word")
    if head is None:
        return tokens.join(tail, "word")
    rare = tokens.join(F.broadcast(head.select("word")), "word", "left_anti")
    return tokens.join(head, "word").unionByName(rare.join(tail, "word"))


NUMBER_BLOCK = 1 << 18


PARTITION_BYTES = 8 << 20


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Bytes of all texts, and a number of tokens that no document exceeds: each
    but the last is followed by a separator."""
    t = F.col(text_col)
    separators = F.length(t) - F.length(F.translate(t, " \t\n", ""))
    size = docs.agg(F.sum(F.octet_length(t)).alias("bytes"), F.max(separators).alias("most")).first()
    return size["bytes"] or 0, (size["most"] or 0) + 1


def most_tokens(docs: DataFrame, text_col: str = "text") -> int:
    """No document has more tokens than this."""
    return text_size(docs, text_col)[1]


def text_partitions(size: int, least: int) -> int:
    """Partitions for ``size`` bytes of text, at least ``least``: the tokens of
    one are sorted in memory, however large the corpus is."""
    return max(least, -(-size // PARTITION_BYTES))


def numbered(rows: DataFrame, out: str, by: tuple[str, ...] = (), longest: int | None = None, block: int = NUMBER_BLOCK) -> DataFrame:
    """``out``: the 0-based place of a row in its document by ``pos``. A window
    holds a block of positions; a document over a block (``longest`` bounds the
    tokens of all, None: unknown) adds the rows of its earlier blocks, so that
    one long document is spread over many tasks."""
    if longest is not None and longest <= block:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by, "doc_id").orderBy("pos")) - 1)
    rows = write_cut(rows.withColumn("_b", F.floor(F.col("pos") / F.lit(block)).cast("int")), "token-blocks")
    w = Window.partitionBy(*by, "doc_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "doc_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(w)).filter("_before > 0").drop("_n")  # long documents only
    inside = F.row_number().over(Window.partitionBy(*by, "doc_id", "_b").orderBy("pos")) - 1
    rows = rows.withColumn("_in", inside).join(before, [*by, "doc_id", "_b"], "left")
    return rows.withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_b", "_in", "_before")


def encode_tokens(
    tokens: DataFrame, vocab: DataFrame, broadcast_rows: int | None = 2_000_000, longest: int | None = None
) -> DataFrame:
    """In-vocabulary tokens ``(doc_id, pos, idx, cn)``; ``pos`` renumbered
    0-based over the kept tokens of the document, so windows close over the
    dropped ones. ``</s>`` (id 0) never occurs inside a document.

    Beyond the bounds of :func:`lookup_side` only words outside the most frequent
    are shuffled (:func:`look_up`). ``longest`` as in :func:`numbered`.
    """
    j = look_up(tokens, vocab.filter(F.col("idx") > 0).select("word", "idx", "cn"), broadcast_rows)
    j = numbered(j.select("doc_id", "pos", "idx", "cn"), "_pos", longest=longest)
    return j.select("doc_id", F.col("_pos").alias("pos"), "idx", "cn")


def doc_lengths(encoded: DataFrame) -> DataFrame:
    """In-vocabulary tokens per document."""
    return encoded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def segment(kept: DataFrame, max_len: int | None = None, by: tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
    """Kept tokens renumbered ``kpos`` (0-based) and, with ``max_len``, cut
    into runs of that length: ``seg = kpos div max_len``; windows never cross a
    run. Without it a document is one segment.
    ``by``: coarser keys the data is already partitioned on (kept in the
    window keys so no shuffle is added)."""
    k = numbered(kept, "kpos", by, longest)
    return k.withColumn("seg", F.lit(0) if max_len is None else F.floor(F.col("kpos") / F.lit(max_len)).cast("int"))
