"""Training-data pipeline over ``documents``: language ID, exact dedup, MinHash
near-dedup, mixing of sources, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but
the last returns the columns of ``documents``. No part of it can be stated in
SQL as a whole (learned labels, BPE tokens), so ``ORACLE_SQL`` is None and the
tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sphaera.llm import language_id
from sphaera.llm.exact_dedup import drop_exact_copies
from sphaera.llm.mixing import mix_documents
from sphaera.llm.near_dedup import drop_near_copies
from sphaera.llm.packing import pack_documents
from sphaera.session import load, write_cut

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language holds at least half of the
    words' probability; texts without letters go."""
    return language_id.keep_identified(docs, language_id.train(docs), least_score=LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier."""
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the
    smallest identifier."""
    return drop_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, as one document for each pass in which words are taken."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placement of every piece in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
