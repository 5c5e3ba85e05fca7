"""sphaera: unit-sphere word, context and document embeddings on Spark.

Every stage is a DataFrame operator: corpus scan, vocabulary, keyed sampling,
window pairing, shard-local Riemannian training merged by shuffles, embedding
I/O and the evaluation jobs (word similarity, clustering, kNN classification).
"""

from sphaera.params import Params

__all__ = ["Params"]
