"""The ranked vocabulary (V1 to V3) kept up to date as corpus parts arrive.

State are the identifiers counted so far and one row per word: its count and
its place among the words of that count. A part brings counts of the documents
that are new; a document delivered again, in this part or a later one, and a
part committed before, change nothing. Ids follow from the number of words with
a larger count (one row per distinct count) plus that place, so that only
words of counts that some word left or reached are numbered again. Generations
are committed in a :class:`StepLog`, and the last two are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sphaera.operators import corpus as C
from sphaera.operators import vocab as V
from sphaera.operators.ordering import small_prefix, with_global_index
from sphaera.params import EOS
from sphaera.plans.steplog import StepLog
from sphaera.streaming.vocab_stream import DOC_SCHEMA

WORDS = "word string, cn long, nth long"


class VocabularyState:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, StepLog(spark, root)

    def words(self, entries: list[dict] | None = None) -> DataFrame:
        done = self.log.entries() if entries is None else entries
        return self.log.read(done[-1]["words"]) if done else self.spark.createDataFrame([], WORDS)

    def add(self, docs: DataFrame, part: str) -> bool:
        """Count the documents ``(doc_id, text)`` of a part that are new; False
        for a part that was counted before."""
        done = self.log.entries()
        if any(e["part"] == part for e in done):
            return False
        n = len(done)
        new = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        if done:
            seen = self.log.read(*[e["seen"] for e in done])
            new = new.join(seen, "doc_id", "left_anti")
        new = self.log.write(new, f"new-{n}")
        self.log.write(new.select("doc_id"), f"seen-{n}")
        delta = V.word_count(C.tokenize(new), new).select(F.col("word").alias("w"), F.col("cn").alias("more"))
        old = self.words(done)
        both = old.join(delta, old["word"] == delta["w"], "full").select(
            F.coalesce("word", "w").alias("word"), F.col("cn").alias("was"),
            (F.coalesce("cn", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("cn"), "nth", F.col("w").isNotNull().alias("changed"),
        )
        both = self.log.write(both, f"counts-{n}")
        touched = both.filter("changed").select(F.explode(F.array("was", "cn")).alias("c")).filter("c IS NOT NULL").distinct()
        again = both.join(touched, both["cn"] == touched["c"], "left_semi").select("word", "cn")
        again = with_global_index(again, [F.col("cn").desc(), F.col("word").desc()], "at")
        first = again.groupBy(F.col("cn").alias("c")).agg(F.min("at").alias("first"))
        again = again.join(first, again["cn"] == first["c"]).select("word", "cn", (F.col("at") - F.col("first")).alias("nth"))
        rest = both.join(touched, both["cn"] == touched["c"], "left_anti").select("word", "cn", "nth")
        self.log.write(rest.unionByName(again), f"words-{n}")
        self.log.commit(n, {"part": part, "words": f"words-{n}", "seen": f"seen-{n}"})
        for name in (f"words-{n - 2}", f"new-{n}", f"counts-{n}"):
            self.log.drop(name)
        return True

    def vocab(self, min_count: int = 1) -> DataFrame:
        """``(idx, word, cn)`` as :func:`sphaera.operators.vocab.vocab_index`."""
        words = self.words()
        eos = words.filter(F.col("word") == EOS).agg(F.coalesce(F.max("cn"), F.lit(0)).alias("cn"))
        words = words.filter((F.col("word") != EOS) & (F.col("cn") >= min_count))
        # the place among all words of a count, less that of </s> where it comes before
        sep = self.words().filter(F.col("word") == EOS).select(F.col("cn").alias("e_cn"), F.col("nth").alias("e_nth"))
        words = words.join(F.broadcast(sep), (F.col("cn") == F.col("e_cn")) & (F.col("nth") > F.col("e_nth")), "left")
        place = F.col("nth") - F.when(F.col("e_nth").isNotNull(), 1).otherwise(0)
        hist = words.groupBy(F.col("cn").alias("c")).agg(F.count(F.lit(1)).alias("n"))  # one row per distinct count
        hist = small_prefix(hist, [F.col("c").desc()], "n", "larger", inclusive=False).select("c", "larger")
        ranked = words.join(hist, words["cn"] == hist["c"]).select((F.col("larger") + place + 1).cast("bigint").alias("idx"), "word", "cn")
        return eos.select(F.lit(0).cast("bigint").alias("idx"), F.lit(EOS).alias("word"), "cn").unionByName(ranked)


def start_vocabulary_stream(state: VocabularyState, source_dir: str, checkpoint_dir: str, trigger_once: bool = True) -> StreamingQuery:
    """Keep ``state`` up to date with Parquet corpus parts that land in
    ``source_dir``. A micro-batch that is run again after a failure is a part
    that was counted before."""
    docs = state.spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)
    w = docs.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda df, i: state.add(df, f"batch-{i}") and None)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
