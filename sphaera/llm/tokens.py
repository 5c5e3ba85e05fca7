"""Token ids of whole texts by a word-wise BPE tokenizer, inside Python tasks.

The tokenizer lower-cases, drops white space and encodes runs of letters,
single digits and runs of signs each for itself. Texts of ASCII and Latin
letters are cut into these parts here, all texts of a batch as one array of
bytes; equal parts are found by comparing them, and each distinct letter run is
encoded once: all runs of one length are a matrix in which every step merges
each run's best pair. Runs merged before are kept in a table of fixed size. All other parts, and all other texts, go through the
tokenizer as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LONGEST = 24  # bytes; longer letter runs go through the tokenizer
NONE = np.int64(1 << 40)
BATCH_BYTES = 500_000
KNOWN_BITS = 18  # slots for letter runs merged before: 19 MB with ids of 16 bits

# letters that normalisation leaves alone or lower-cases one for one
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-įĲ-ſ]*")
_BLANK = re.compile(r"[\t-\r ]")
BLANK, LETTER, DIGIT, SIGN = range(4)


def _byte_classes() -> np.ndarray:
    t = np.full(256, LETTER, np.uint8)  # the bytes of Latin letters beyond ASCII
    t[:0x80] = SIGN
    t[list(b"\t\n\x0b\x0c\r ")] = BLANK
    t[ord("a") : ord("z") + 1] = LETTER
    t[ord("0") : ord("9") + 1] = DIGIT
    return t


_CLASS = _byte_classes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible
    Latin-1 characters for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _Merges:
    """BPE merges of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in _byte_symbols()], np.int64)
        self.largest_id = max(vocab.values())
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bits = 2 * max(1, len(pairs)).bit_length() // 2 + 2
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.value = np.zeros(size, np.int64)  # rank and merged symbol
        for rank, (a, b) in enumerate(pairs):
            k = vocab[a] << 20 | vocab[b]
            at = int(self._slot(np.array([k]))[0])
            while self.key[at] >= 0:
                at = (at + 1) % size
            self.key[at], self.value[at] = k, rank << 20 | vocab[a + b]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of pairs, NONE for pairs that do not merge."""
        key = (left << 20 | right).ravel()
        at = self._slot(key)
        seen = self.key[at]
        out = np.where(seen == key, self.value[at], NONE)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.key)
            seen = self.key[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out.reshape(left.shape)

    def __call__(self, raw: np.ndarray):
        """Words of one length (word, byte): yields rows and their ids."""
        rows = np.arange(len(raw))
        sym = np.concatenate((self.inner[raw[:, :-1]], self.last[raw[:, -1:]]), 1)
        best = self.find(sym[:, :-1], sym[:, 1:])
        while len(rows):
            n = sym.shape[1]
            if n == 1:
                yield rows, sym
                return
            j = best.argmin(1)
            top = best[np.arange(len(rows)), j]
            live = top != NONE
            if not live.all():
                yield rows[~live], sym[~live]
                rows, sym, best, j, top = rows[live], sym[live], best[live], j[live], top[live]
            at = np.arange(len(rows))
            left = np.arange(n - 1) < j[:, None]
            sym = np.where(left, sym[:, :-1], sym[:, 1:])
            sym[at, j] = top & 0xFFFFF
            best = np.where(left[:, 1:], best[:, :-1], best[:, 1:])
            r = np.flatnonzero(j < n - 2)
            best[r, j[r]] = self.find(sym[r, j[r]], sym[r, j[r] + 1])
            r = np.flatnonzero(j > 0)
            best[r, j[r] - 1] = self.find(sym[r, j[r] - 1], sym[r, j[r]])


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _words(flat: np.ndarray, s: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first LONGEST bytes of parts as words of eight bytes, zero beyond a
    part. ``flat`` ends in at least LONGEST bytes beyond the parts."""
    windows = np.ndarray((len(flat) - 7,), "<u8", flat.tobytes(), 0, (1,))  # the eight bytes from every place
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    return [windows[s + 8 * k] & mask[np.clip(size - 8 * k, 0, 8)] for k in range(LONGEST // 8)]


def _hash(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * _ODD[3]
    for w, odd in zip(words, _ODD):
        h = (h ^ w) * odd
        h ^= h >> np.uint64(29)
    return h


def distinct_parts(flat: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal parts: each group's first part, and every part's group.
    Parts of at most LONGEST bytes are compared whole, as three words of eight
    bytes; a hash only sorts them. A longer part is a group of its own."""
    size = e - s
    words = _words(flat, s, size)
    own = size > LONGEST
    _, first, which = np.unique(_hash(words, size), return_index=True, return_inverse=True)
    same = ~own & (size == size[first][which])
    for w in words:
        same &= w == w[first][which]
    alone = np.flatnonzero(~same)
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate((first, alone)), which


class _Known:
    """Ids of letter runs merged before, a fixed number of slots of one run
    each. A run is compared whole; a new run takes its slot over."""

    def __init__(self, largest_id: int, bits: int = KNOWN_BITS):
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros((1 << bits, LONGEST // 8), np.uint64)  # no run is all zero
        self.n = np.zeros(1 << bits, np.uint8)
        self.ids = np.zeros((1 << bits, LONGEST), np.min_scalar_type(largest_id))

    def slots(self, words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        return (_hash(words, size) * _ODD[0] >> self.shift).astype(np.int64)

    def find(self, words: np.ndarray, slot: np.ndarray):
        """Rows that are known, by their number of ids: rows and ids."""
        rows = np.flatnonzero((self.words[slot] == words).all(1))
        n = self.n[slot[rows]].astype(np.int64)
        order = np.argsort(n, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(order) else ():
            yield rows[at], self.ids[slot[rows[at]], : n[at[0]]]

    def put(self, words: np.ndarray, slot: np.ndarray, ids: np.ndarray) -> None:
        slot, one = np.unique(slot, return_index=True)
        self.words[slot], self.n[slot] = words[one], ids.shape[1]
        self.ids[slot, : ids.shape[1]] = ids[one]


def _cut(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of every part of lower-cased bytes that end in
    three blanks. A contraction is a sign part with its letters."""
    cls = _CLASS[flat]
    start = (cls != BLANK) & ((cls == DIGIT) | np.concatenate(([True], cls[1:] != cls[:-1])))
    quote = np.flatnonzero(start & (flat == ord("'")))
    a, b = flat[quote + 1], flat[quote + 2]
    one = np.isin(a, list(b"stmd"))
    two = np.isin(a, list(b"rv")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    start[quote[one | two] + 1] = False
    rest = np.concatenate((quote[one] + 2, quote[two & ~one] + 3))
    start[rest] |= cls[rest] == LETTER
    edge = start | (cls == BLANK)
    s = np.flatnonzero(start)
    return s, np.flatnonzero(edge)[np.cumsum(edge)[s]], cls[s]


def _pieces(t: str) -> Iterator[str]:
    """A long text in pieces, cut at blanks."""
    lo = 0
    while len(t) - lo > BATCH_BYTES and (m := _BLANK.search(t, lo + BATCH_BYTES)):
        yield t[lo : m.start()]
        lo = m.start()
    yield t[lo:] if lo else t


class _Encoder:
    """Ids of texts by one tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merges = _Merges(path)
        self.known = _Known(int(self.merges.largest_id))
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased plain texts."""
        flat = np.frombuffer(b"\n".join(texts) + b"\n" * 32, np.uint8)
        s, e, cls = _cut(flat)
        first, which = distinct_parts(flat, s, e)
        s1, size, kind = s[first], (e - s)[first], cls[first]
        n_ids = np.zeros(len(first), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        runs = np.flatnonzero((kind == LETTER) & (size <= LONGEST))
        parts = _words(flat, s1[runs], size[runs])
        slot, words = self.known.slots(parts, size[runs]), np.stack(parts, 1)
        new = np.ones(len(runs), bool)
        for r, ids in self.known.find(words, slot):
            found.append((runs[r], ids))
            new[r] = False
        new = np.flatnonzero(new)
        order = new[np.argsort(size[runs[new]], kind="stable")]
        length = size[runs[order]]
        for rows in np.split(order, np.flatnonzero(np.diff(length)) + 1) if len(order) else ():
            for r, ids in self.merges(flat[s1[runs[rows]][:, None] + np.arange(size[runs[rows[0]]])]):
                found.append((runs[rows[r]], ids))
                self.known.put(words[rows[r]], slot[rows[r]], ids)
        other = np.flatnonzero((kind != LETTER) | (size > LONGEST))
        for i, ids in zip(other, self._each([flat[s1[i] : s1[i] + size[i]].tobytes().decode() for i in other])):
            found.append((np.array([i]), ids[None, :]))
        for rows, ids in found:
            n_ids[rows] = ids.shape[1]
        at = np.cumsum(n_ids) - n_ids
        table = np.zeros(int(n_ids.sum()), "<u4")
        for rows, ids in found:
            table[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        n = n_ids[which]
        before = np.concatenate(([0], np.cumsum(n)))
        raw = table[np.repeat(at[which] - before[:-1], n) + np.arange(before[-1])].tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = (4 * before[np.searchsorted(s, ends)]).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        plain, slow, batch, size = [], [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not _PLAIN.fullmatch(t) or any(s in t for s in self.special):
                slow.append(i)
                continue
            for piece in _pieces(t):
                plain.append(i)
                batch.append(piece.lower().encode())
                size += len(batch[-1])
                if size > BATCH_BYTES:
                    for k, ids in zip(plain, self._plain(batch)):
                        out[k] += ids
                    plain, batch, size = [], [], 0
        for k, ids in zip(plain, self._plain(batch) if batch else ()):
            out[k] += ids
        for i, ids in zip(slow, self._each([texts[i] for i in slow])):
            out[i] = ids.astype("<u4").tobytes()
        return out


_encoder = lru_cache(maxsize=2)(_Encoder)


def forget() -> None:
    """Drop the tokenizers that a task has loaded."""
    _encoder.cache_clear()


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers. A null
    text is empty."""
    return _encoder(path)(texts)
