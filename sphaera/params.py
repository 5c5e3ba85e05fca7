"""Hyper-parameters of the trainer, frozen so a plan can be keyed by them."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values that must equal the reference's defaults for equal results.
EOS = "</s>"  # end-of-document token, always vocabulary id 0
MAX_TOKEN_BYTES = 98  # the byte limit that C3 applies
MAX_SEGMENT = 1000  # the segment length that C9 applies
NOISE_POWER = 0.75  # unigram exponent of the negative-sampling distribution
ALPHA_FLOOR = 1e-4  # learning rate never drops below alpha * 1e-4


@dataclass(frozen=True)
class Params:
    dim: int = 100
    window: int = 5
    sample: float = 1e-3
    negative: int = 2
    margin: float = 0.15
    alpha: float = 0.04
    iter: int = 10
    min_count: int = 5
    seed: int = 1
    # Distributed trainer: documents are grouped into shards of about
    # ``shard_tokens`` in-vocabulary tokens, longer ones are split. An epoch has
    # ``merges`` steps; the shards of a step train side by side from one
    # snapshot, so a step grows with the corpus and their number does not. A
    # step moves a vector by the sum of its shards' changes, but by no more
    # than ``reach``, however many shards there are.
    shard_tokens: int = 100_000
    merges: int = 8
    reach: float = 0.4
    batch_size: int = 4096
    # Off by default: nothing is cut. ``max_token_bytes`` shortens tokens at a
    # character border, ``max_segment`` ends windows after so many kept tokens.
    max_token_bytes: int | None = None
    max_segment: int | None = None
    # Vocabulary tables up to this many rows are broadcast; beyond it the
    # lookups fall back to shuffle joins.
    broadcast_rows: int = 2_000_000

    def __post_init__(self):
        if self.negative <= 0:
            raise ValueError("negative must be > 0")
        if self.dim <= 0 or self.window <= 0 or self.iter <= 0:
            raise ValueError("dim, window and iter must be > 0")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
