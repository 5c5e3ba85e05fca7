"""Benchmark the headline plans at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: total seconds and per-query seconds. Every query is
forced through the ``noop`` sink (full execution, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sphaera.params import Params  # noqa: E402
from sphaera.session import checkpoint_root, load, local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "c1_tokenize",
    "v3_vocab_index",
    "c8_encode_tokens",
    "c9_segment_documents",
    "g1_skipgram_pairs",
    "g3_word_triples",
    "g4_doc_triples",
    "t3_margin_forward",
    "t6_batch_step",
    "k11_doc_mean_embedding",
    "k10_cluster_report",
    "e4_similarity_report",
    "l7_classification_report",
]

# the trainer at the reference's document-run shape, shortened to two epochs
FIT_PARAMS = Params(dim=100, window=10, iter=2, min_count=5, negative=2)


def run(spark, df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2)
    checkpoint_root(spark)
    from sphaera.plans.catalog import QUERIES

    times = {}
    # warm the JVM once on a tiny scan so the first query is not charged for it
    load(spark, SF_DIR, "documents").limit(10).collect()
    for name in HEADLINE:
        t0 = time.time()
        run(spark, QUERIES[name](spark, SF_DIR))
        times[name] = round(time.time() - t0, 2)
        spark.catalog.clearCache()

    from sphaera.plans.fit import fit
    from sphaera.plans.flagship import doc_classification

    t0 = time.time()
    docs = load(spark, SF_DIR, "documents")
    result = fit(docs, FIT_PARAMS)
    run(spark, result.vectors())
    times["t8_fit_dim100_w10_2ep"] = round(time.time() - t0, 2)
    t0 = time.time()
    report = doc_classification(result, docs).collect()[0]
    times["flagship_knn_lang"] = round(time.time() - t0, 2)

    total = round(sum(times.values()), 2)
    print(json.dumps({
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").split("sf")[-1],
        "flagship_f1_micro": round(float(report["f1_micro"]), 4),
        "flagship_f1_macro": round(float(report["f1_macro"]), 4),
    }))


if __name__ == "__main__":
    main()
