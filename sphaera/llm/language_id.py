"""Language of words and documents by a linear-chain conditional random field.

Every word of a text gets scores from its affixes, its character n-grams and a
lexicon, and neighbouring words are tied by learned transition scores; forward
and backward passes give each word a distribution over languages, so text that
switches between languages is labelled word by word. A document's language is
the one with the largest sum of word probabilities, its score their mean.

The field is fitted in NumPy on a bounded sample of labelled rows
(``TRAIN_DOCS`` rows, whole texts), as sequences of segments from rows of
different languages; prediction covers all rows and whole texts, and reads
nothing but the text. Rows with more than ``TRAIN_LONGEST`` characters are not
drawn for the sample, but where a language has no shorter ones its shortest are.

Defined cases: a null text and a text without letters is ``und`` with score 0;
rows without label, text or identifier are not learned from; without any
labelled row every text is ``und``; a row with a null identifier is not held
out; rows with one identifier are predicted one by one; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .task_memory import bounded

UNDETERMINED = "und"
TRAIN_DOCS = 1200
TRAIN_LONGEST = 20_000
LEXICON = 2000
SEGMENT = 15
SEGMENTS = 4
EPOCHS = 6
BATCH = 64
RATE = 0.3
L2 = 1e-5
MAX_CACHED_WORDS = 200_000
BATCH_BYTES = 2_000_000

_runs = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    ws = _runs.findall((text or "").lower())
    if "".join(ws).isalpha():
        return ws
    return [w for w in ws if any(map(str.isalpha, w))]  # numbers such as one half are no words


def features(w: str) -> list[str]:
    """Affixes of up to three characters, n-grams of two and three with the
    word's ends marked, and the word for the lexicon."""
    m = f"^{w}$"
    out = [f"<{w[:i]}" for i in range(1, min(3, len(w)) + 1)]
    out += [f">{w[-i:]}" for i in range(1, min(3, len(w)) + 1)]
    out += [m[i : i + 2] for i in range(len(m) - 1)]
    out += [m[i : i + 3] for i in range(len(m) - 2)]
    out.append(f"={w}")
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    index: dict[str, int]
    weight: np.ndarray  # feature x language
    trans: np.ndarray  # language x language
    start: np.ndarray
    key: str = field(default="")


def _passes(e: np.ndarray, n_at: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences at once. ``e`` holds the words'
    scores step after step, within a step the sequences from the longest down,
    ``n_at`` of them. Returns every word's distribution."""
    off = np.concatenate(([0], np.cumsum(n_at)))
    p = np.exp(e - e.max(1, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd, bwd = np.empty_like(p), np.empty_like(p)
    cur = p[: off[1]] * np.exp(start - start.max())
    for t in range(len(n_at)):
        if t:
            cur = (cur[: n_at[t]] @ a) * p[off[t] : off[t + 1]]
        cur = cur / cur.sum(1, keepdims=True)
        fwd[off[t] : off[t + 1]] = cur
    nxt = np.ones((0, p.shape[1]), p.dtype)
    for t in range(len(n_at) - 1, -1, -1):
        here = np.ones((n_at[t], p.shape[1]), p.dtype)  # sequences that end here
        if len(nxt):
            got = (nxt * p[off[t + 1] : off[t + 2]]) @ a.T
            here[: len(nxt)] = got / got.sum(1, keepdims=True)
        bwd[off[t] : off[t + 1]] = nxt = here
    fwd *= bwd
    fwd /= fwd.sum(1, keepdims=True)
    return fwd


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: each word's place in step order, its
    sequence, and the number of sequences at each step."""
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    n_at = len(lengths) - np.cumsum(np.bincount(lengths, minlength=lengths.max() + 1))[:-1]
    seq = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (np.cumsum(n_at) - n_at)[step] + rank[seq], seq, n_at


def fit(rows: list[tuple[str, str]], seed: int = 5) -> LanguageModel:
    """Fit on (text, language) rows by gradient ascent (Adagrad) on the
    likelihood of the label sequences."""
    rng = np.random.default_rng(seed)
    docs = [(ws, lang) for t, lang in rows if (ws := words(t))]
    langs = sorted({lang for _, lang in docs})
    k = len(langs)
    counts = Counter(w for ws, _ in docs for w in ws)
    lexicon = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    index: dict[str, int] = {}
    place: dict[str, int] = {}
    flat, bounds = [], [0]
    for w in counts:
        place[w] = len(place)
        fs = [f for f in features(w) if f[0] != "=" or w in lexicon]
        flat += [index.setdefault(f, len(index)) for f in fs]
        bounds.append(len(flat))
    flat, bounds = np.array(flat, np.int64), np.array(bounds, np.int64)
    weight, trans, start = np.zeros((max(1, len(index)), k)), np.zeros((k, k)), np.zeros(k)
    seen = [np.full_like(x, 1e-8) for x in (weight, trans, start)]
    number = {lang: i for i, lang in enumerate(langs)}
    segments = [
        (np.array([place[w] for w in ws[i : i + SEGMENT]]), number[lang])
        for ws, lang in docs for i in range(0, len(ws), SEGMENT)
    ]
    for _ in range(EPOCHS if k > 1 else 0):
        order = rng.permutation(len(segments))
        chains = [order[i : i + SEGMENTS] for i in range(0, len(order), SEGMENTS)]
        for b in range(0, len(chains), BATCH):
            part = chains[b : b + BATCH]
            ids = np.concatenate([segments[s][0] for c in part for s in c])
            gold = np.concatenate([np.full(len(segments[s][0]), segments[s][1]) for c in part for s in c])
            lengths = np.array([sum(len(segments[s][0]) for s in c) for c in part])
            spot, seq, n_at = _steps(lengths)
            n_feat = bounds[ids + 1] - bounds[ids]
            first = np.cumsum(n_feat) - n_feat
            at = flat[np.repeat(bounds[ids] - first, n_feat) + np.arange(n_feat.sum())]
            e = np.add.reduceat(weight[at], first, axis=0)
            tm = np.empty_like(e)
            tm[spot] = e
            post = _passes(tm, n_at, trans, start)[spot]
            diff = -post
            diff[np.arange(len(gold)), gold] += 1
            g_w = np.stack([np.bincount(at, np.repeat(diff[:, j], n_feat), len(weight)) for j in range(k)], 1)
            # expected transitions by the products of neighbouring marginals' messages
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            g_t = np.zeros((k, k))
            np.add.at(g_t, (gold[inner], gold[inner + 1]), 1)
            g_t -= _expected_pairs(tm, spot, post, inner, n_at, trans, start)
            heads = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            g_s = np.bincount(gold[heads], minlength=k) - post[heads].sum(0)
            for x, g, s in zip((weight, trans, start), (g_w, g_t, g_s), seen):
                g = g / len(part) - L2 * x
                s += g * g
                x += RATE * g / np.sqrt(s)
    m = LanguageModel(langs, index, weight.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))
    m.key = hashlib.sha256(m.weight.tobytes() + repr((langs, len(index))).encode()).hexdigest()
    return m


def _expected_pairs(tm, spot, post, inner, n_at, trans, start) -> np.ndarray:
    """Expected number of transitions between every two languages: for each
    pair of neighbours, marginal(i) * P(j | i) with the backward message taken
    out of the marginals, which the chain's Markov property allows:
    P(i, j) is proportional to forward(i) A(i, j) emit(j) backward(j)."""
    k = len(start)
    off = np.concatenate(([0], np.cumsum(n_at)))
    p = np.exp(tm - tm.max(1, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd = np.empty_like(p)
    cur = p[: off[1]] * np.exp(start - start.max())
    for t in range(len(n_at)):
        if t:
            cur = (cur[: n_at[t]] @ a) * p[off[t] : off[t + 1]]
        cur = cur / cur.sum(1, keepdims=True)
        fwd[off[t] : off[t + 1]] = cur
    left, right = fwd[spot[inner]], post[inner + 1]
    into = left @ a  # forward message into the right word, without its own score
    pair = left[:, :, None] * a[None] * (right / np.maximum(into, 1e-300))[:, None, :]
    return pair.sum(0).reshape(k, k)


# odd numbers that hash a feature's characters and kind
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
PREFIX, SUFFIX, NGRAM, WORD = (np.uint64(x) for x in range(1, 5))


def _keys(kind: np.uint64, chars: np.ndarray) -> np.ndarray:
    """64-bit keys of equally long character sequences (sequence, character)."""
    h = np.full(chars.shape[:-1], kind, np.uint64) * _MIX[2] + np.uint64(chars.shape[-1])
    for j in range(chars.shape[-1]):
        h = (h + chars[..., j].astype(np.uint64)) * _MIX[j % 2]
        h ^= h >> np.uint64(32)
    return h


def _points(ws: list[str]) -> np.ndarray:
    """Code points of equally long words (word, character)."""
    return np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(ws), -1)


def feature_keys(ws: list[str]) -> np.ndarray:
    """Keys of :func:`features` for equally long words (word, feature)."""
    c = _points(ws)
    n = c.shape[1]
    m = np.concatenate((np.full((len(ws), 1), ord("^")), c, np.full((len(ws), 1), ord("$"))), 1)
    cols = [_keys(PREFIX, c[:, :i])[:, None] for i in range(1, min(3, n) + 1)]
    cols += [_keys(SUFFIX, c[:, n - i :])[:, None] for i in range(1, min(3, n) + 1)]
    cols += [_keys(NGRAM, np.lib.stride_tricks.sliding_window_view(m, k, axis=1)) for k in (2, 3)]
    return np.concatenate([*cols, _keys(WORD, c)[:, None]], 1)


def _key_of(feature: str) -> int:
    kind = {"<": PREFIX, ">": SUFFIX, "=": WORD}.get(feature[0], NGRAM)
    return int(_keys(kind, _points([feature if kind == NGRAM else feature[1:]]))[0])


class _Scores:
    """Word scores of one model, kept over the tasks of a worker; emptied when
    the number of words reaches its bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        keys = np.array([_key_of(f) for f in model.index], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        rows = np.fromiter(model.index.values(), np.int64, len(model.index))[order]
        none = np.zeros((1, len(model.langs)), np.float32)
        self.weight = np.concatenate((model.weight[rows], none))

    def score(self, ws: list[str]) -> np.ndarray:
        """Scores of distinct words, all words of one length at a time."""
        out = np.zeros((len(ws), len(self.model.langs)), np.float32)
        if not len(self.keys):
            return out
        size = np.array([len(w) for w in ws])
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            for part in np.array_split(rows, -(-len(rows) * int(size[rows[0]] + 4) // 200_000)):
                want = feature_keys([ws[i] for i in part])
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                at[self.keys[at] != want] = len(self.keys)
                out[part] = self.weight[at].sum(1)
        return out

    def __call__(self, ws: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(ws) if w not in self.place]
        if len(self.place) + len(new) > MAX_CACHED_WORDS:
            self.place.clear()
            new = list(dict.fromkeys(ws))
        if new:
            base, got = len(self.place), self.score(new)
            while len(self.table) < base + len(new):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[base : base + len(new)] = got
            self.place.update(zip(new, range(base, base + len(new))))
        return self.table[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))]


_scores: dict[str, _Scores] = {}


def forget() -> None:
    """Drop the model and the words that a task has met."""
    _scores.clear()


def label(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of all words, text after text, and the number of words of
    each text."""
    if model.key not in _scores:
        _scores.clear()
        _scores[model.key] = _Scores(model)
    ws = [words(t) for t in texts]
    lengths = np.array([len(w) for w in ws], np.int64)
    if not lengths.sum():
        return np.empty((0, len(model.langs)), np.float32), lengths
    e = _scores[model.key]([w for x in ws for w in x])
    full = lengths[lengths > 0]
    spot, _, n_at = _steps(full)
    tm = np.empty_like(e)
    tm[spot] = e
    return _passes(tm, n_at, model.trans, model.start)[spot], lengths


def _slices(text: pa.Array) -> Iterator[np.ndarray]:
    """The texts in runs of about ``BATCH_BYTES`` bytes, longest first: the
    passes take a step for every word of a run's longest text."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(-size, kind="stable")
    size, lo = np.cumsum(size[order]), 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES)))
        yield order[lo:hi]
        lo = hi


def _best(text: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language (the number of languages for none), score
    and number of switches of every text."""
    k = len(model.langs)
    best, score, switches = np.full(len(text), k), np.zeros(len(text)), np.zeros(len(text), np.int64)
    for at in _slices(text) if k else ():
        post, lengths = label(text.take(pa.array(at)).to_pylist(), model)
        doc = np.repeat(np.arange(len(at)), lengths)
        total = np.stack([np.bincount(doc, post[:, j], len(at)) for j in range(k)], 1)
        some = lengths > 0
        best[at[some]] = total[some].argmax(1)
        score[at[some]] = np.minimum(total[some].max(1) / lengths[some], 1.0)
        top = post.argmax(1)
        turn = (top[1:] != top[:-1]) & (doc[1:] == doc[:-1])
        switches[at] = np.bincount(doc[1:][turn], minlength=len(at))
    return best, score, switches


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``n_switches`` (changes of the
    most likely language from word to word) for every row."""
    names = np.array([*model.langs, UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, switches = _best(b.column("t"), model)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(switches, pa.int64())],
                names=["id", "lang_pred", "score", "n_switches"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t"))
    out = rows.mapInArrow(bounded(run, forget), f"id {kind}, lang_pred string, score double, n_switches long")
    return out.withColumnRenamed("id", id_col)


def keep_identified(
    df: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.5
) -> DataFrame:
    """The rows of ``df``, all columns as they were, whose language is a
    learned one with a score of at least ``least_score``."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, _ = _best(b.column(at), model)
            yield b.filter(pa.array((best < len(model.langs)) & (score >= least_score)))

    return df.mapInArrow(bounded(run, forget), df.schema)


def label_words(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``langs``: the most likely language of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("t")
            for at in _slices(text):
                got: list[list[str]] = [[] for _ in at]
                if model.langs:
                    post, lengths = label(text.take(pa.array(at)).to_pylist(), model)
                    top = np.array(model.langs, dtype=object)[post.argmax(1)]
                    got = [x.tolist() for x in np.split(top, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array(got, pa.list_(pa.string()))], names=["id", "langs"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t"))
    return rows.mapInArrow(bounded(run, forget), f"id {kind}, langs array<string>").withColumnRenamed("id", id_col)


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS
) -> LanguageModel:
    """Fit on a sample of the rows that are not held out, spread evenly over
    the languages by a hash of the identifier."""
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t"), df[lang_col].cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("t").isNotNull())
    # one row per language: rows that may be drawn, and up to which length
    longest = F.greatest(F.length("t"), F.lit(TRAIN_LONGEST))
    sizes = rows.groupBy("lang", longest.alias("top")).count().groupBy("lang").agg(
        F.min("top").alias("top"), F.min_by("count", "top").alias("n")
    ).collect()
    if not sizes:
        return LanguageModel([], {}, np.zeros((1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    each, cut = max(1, max_docs // len(sizes)), 1_000_000
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(cut))
    drawn = F.lit(False)
    for r in sorted(sizes, key=lambda r: r["lang"]):
        share = cut if r["n"] <= each else -(-cut * each // r["n"])
        drawn = F.when(F.col("lang") == r["lang"], (F.length("t") <= r["top"]) & (draw < share)).otherwise(drawn)
    sample = rows.filter(drawn).collect()
    sample.sort(key=lambda r: (str(r["id"]), r["lang"], r["t"]))
    return fit([(r["t"], r["lang"]) for r in sample])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict all rows:
    ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``n_switches``."""
    got = predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)
    return got.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "n_switches")
