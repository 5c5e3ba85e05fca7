"""Structured Streaming form of the corpus count (V1).

The reference has no streams; its vocabulary pass is a scan. When corpus
parts arrive over time (new Parquet files of ``docs(doc_id, text)``), the
same count can run incrementally: the state is one row per distinct word
(the vocabulary itself), updated per micro-batch, and the ranked
vocabulary (V2-V3) is derived from the state whenever it is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sphaera.operators import corpus as C
from sphaera.params import EOS

DOC_SCHEMA = "doc_id bigint, text string"


def streaming_word_counts(docs: DataFrame) -> DataFrame:
    """Running ``(word, cn)`` over a streaming ``docs`` frame, ``</s>``
    counted once per document as in the batch form."""
    tokens = C.tokenize(docs).select("word")
    eos = docs.select(F.lit(EOS).alias("word"))
    return tokens.unionByName(eos).groupBy("word").agg(F.count(F.lit(1)).alias("cn"))


def start_vocab_stream(
    spark: SparkSession, source_dir: str, checkpoint_dir: str, sink, trigger_once: bool = True
) -> StreamingQuery:
    """Count words of Parquet corpus parts landing in ``source_dir``.

    ``sink(batch_df, batch_id)`` receives the updated counts of each
    micro-batch (``update`` mode: only words whose count changed); the
    checkpoint folder makes the query restartable after a failure."""
    docs = spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)
    counts = streaming_word_counts(docs)
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(sink)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
