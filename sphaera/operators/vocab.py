"""Vocabulary operators V1-V8.

``vocab(idx, word, cn)``: id 0 is ``</s>``; the other words follow by count
descending, ties by word descending in byte order, all ids dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera.operators.ordering import small_prefix, with_global_index
from sphaera.params import EOS


def word_count(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """V1: ``(word, cn)``. Every document contributes one ``</s>`` (so it is
    present even in an empty corpus row); literal ``</s>`` tokens count toward
    it too. One hash aggregate with a map-side partial phase, so a hot word
    costs one row per task before the shuffle."""
    eos = docs.select(F.lit(EOS).alias("word"))
    return tokens.select("word").unionByName(eos).groupBy("word").agg(F.count(F.lit(1)).alias("cn"))


def min_count_filter(counts: DataFrame, min_count: int) -> DataFrame:
    """V2: drop words with ``cn < min_count``; ``</s>`` is exempt."""
    return counts.filter((F.col("cn") >= F.lit(min_count)) | (F.col("word") == EOS))


def vocab_index(counts: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """V3: dense ids. ``</s>`` takes 0 (count 0 if absent); the rest are
    numbered from 1 in ``(cn desc, word desc)`` order by a distributed
    range-partitioned index (no single-task window)."""
    words = counts.filter(F.col("word") != EOS)
    ranked = with_global_index(words, [F.col("cn").desc(), F.col("word").desc()], "idx", start=1,
                               num_partitions=num_partitions)
    eos = counts.filter(F.col("word") == EOS).select("word", "cn")
    eos = eos.unionByName(counts.sparkSession.createDataFrame([(EOS, 0)], "word string, cn bigint")).groupBy(
        "word"
    ).agg(F.max("cn").alias("cn"))
    return eos.select(F.lit(0).cast("bigint").alias("idx"), "word", "cn").unionByName(
        ranked.select(F.col("idx").cast("bigint"), "word", F.col("cn").cast("bigint"))
    )


def build_vocab(tokens: DataFrame, docs: DataFrame, min_count: int, num_partitions: int | None = None) -> DataFrame:
    """V1 -> V2 -> V3."""
    return vocab_index(min_count_filter(word_count(tokens, docs), min_count), num_partitions)


def train_words(vocab: DataFrame) -> DataFrame:
    """V4: total count over the kept vocabulary, ``</s>`` included."""
    return vocab.agg(F.sum("cn").cast("bigint").alias("train_words"), F.count(F.lit(1)).alias("vocab_size"))


def vocab_cap(counts: DataFrame, max_words: int) -> DataFrame:
    """V5: the reference's memory valve re-aimed deterministically: keep words
    with ``cn > t`` for the smallest ``t >= 0`` leaving at most ``max_words``
    words (``</s>`` exempt, not counted). Works on the histogram of counts,
    whose size is bounded by the number of distinct counts."""
    words = counts.filter(F.col("word") != EOS)
    hist = words.groupBy("cn").agg(F.count(F.lit(1)).alias("n"))
    hist = small_prefix(hist, [F.col("cn").desc()], "n", "above", inclusive=False)
    cand = hist.filter(F.col("above") <= F.lit(max_words)).agg(F.min("cn").alias("t"))
    total = words.agg(F.count(F.lit(1)).alias("total"))
    thr = cand.crossJoin(total).select(
        F.when(F.col("total") <= F.lit(max_words), F.lit(0)).otherwise(F.col("t")).alias("t")
    )
    return counts.crossJoin(F.broadcast(thr)).filter((F.col("cn") > F.col("t")) | (F.col("word") == EOS)).drop("t")


def vocab_lookup(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """V6: word -> id, -1 when absent; a vocabulary of checked size is broadcast."""
    from sphaera.operators.corpus import lookup_side

    v = lookup_side(vocab.select("word", "idx"))
    return tokens.join(v, "word", "left").withColumn("idx", F.coalesce(F.col("idx"), F.lit(-1).cast("bigint")))


def import_vocab(vocab_rows: DataFrame, min_count: int, num_partitions: int | None = None) -> DataFrame:
    """V7: an external ``(word, cn)`` list replaces counting; the min-count
    filter and the order are applied again (so a file in any order gives the
    same ids) and ``train_words`` is recomputed by :func:`train_words`.
    Duplicate words keep their last count only if the caller dedupes; the
    reference adds each line as a new entry, so duplicates are summed here."""
    counts = vocab_rows.groupBy("word").agg(F.sum("cn").cast("bigint").alias("cn"))
    return vocab_index(min_count_filter(counts, min_count), num_partitions)


def oov_report(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """V8: tokens and distinct words without an id, and distinct words that
    have one. One left join and one aggregate."""
    distinct = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    j = distinct.join(vocab.select("word", F.lit(1).alias("hit")), "word", "left")
    return j.agg(
        F.sum("n").cast("bigint").alias("n_tokens"),
        F.sum(F.when(F.col("hit").isNull(), F.col("n")).otherwise(0)).cast("bigint").alias("n_oov_tokens"),
        F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("bigint").alias("n_oov_words"),
        F.sum(F.when(F.col("hit").isNotNull(), 1).otherwise(0)).cast("bigint").alias("n_matched_words"),
    )
