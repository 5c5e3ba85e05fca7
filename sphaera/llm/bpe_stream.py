"""BPE as a streaming transducer with bounded lookahead, and its inverse.

How much of a word must be seen before its first tokens are final follows from
the merge list alone. Take a prefix alone and the same prefix with more text
after it, and apply the merges in order to both. Left of their last common
border both hold the same tokens. A rule (u, v) takes that border away only if
u ends and v begins there, in one of the two, and moves it back by the length
of u; the next rule that moves it comes later in the list, and its v begins
with that u: either it is u, or u was first joined to its right by that same
rule or a later one. The longest chain of such rules (one pass over the list,
:func:`sufficient_lookahead`) bounds how far behind the end of the seen text a
token can still change. So a part of any length is merged in blocks, tokens
that end before the lookahead are emitted, and the next block starts at the
last emitted border: memory is a block, whatever the text.

Texts are cut into letter runs, digits and sign runs. Where they hold ASCII and
Latin letters only, pieces of a bounded size are cut as arrays of bytes, each
distinct part once; any other text goes through the tokenizer's own
normaliser and splitter piece by piece, with the undecided end carried over.
Decoding looks the bytes of each id up and passes them through an incremental
UTF-8 decoder, so that a character may be split over ids and chunks.

Defined cases: a null text is empty and has no ids; the strings of special
tokens in a text become these tokens, as the library does; repeated rows stay
rows; an empty table gives an empty result; only the named columns are read.
Not bounded by a block: a run of combining marks, which normalisation takes as
one character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _PLAIN, LETTER, LONGEST, _byte_symbols, _cut, _Merges, default_tokenizer, distinct_parts

BLOCK = 4096  # bytes of one part that are merged at a time
PIECE = 1 << 16  # characters of a text that are cut at a time
BATCH = 1 << 18  # bytes of plain pieces that are encoded together
MEMO = 20_000  # parts of at most LONGEST bytes whose ids are remembered
_BLANK = re.compile(r"[\t-\r ]")


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """Bytes after which a token cannot change any more. The list must be
    proper: every product once, and after the rules that make its parts."""
    made: dict[str, tuple[int, str]] = {}
    chains: dict[str, tuple[list[int], list[int]]] = {}  # by u: ranks, longest chain up to each
    longest = 0
    for rank, (u, v) in enumerate(pairs):
        if u + v in made:
            raise ValueError(f"two merges make {u + v!r}")
        # the tokens that v begins with; the first time, the rule that joined it to its right is open
        before, t, until = 0, v, rank - 1
        while True:
            if t in chains:
                ranks, longest_to = chains[t]
                i = bisect_right(ranks, until) - 1
                before = max(before, longest_to[i] if i >= 0 else 0)
            if t not in made:
                break
            until, t = min(rank - 1, made[t][0]), made[t][1]
        made[u + v] = rank, u
        reach = before + len(u.removesuffix(suffix) if suffix else u)
        ranks, longest_to = chains.setdefault(u, ([], []))
        if not longest_to or reach > longest_to[-1]:
            ranks.append(rank)
            longest_to.append(reach)
        longest = max(longest, reach)
    seen = {a + b: i for i, (a, b) in enumerate(pairs)}
    if any(seen.get(x, -1) > i for i, pair in enumerate(pairs) for x in pair):
        raise ValueError("a merge comes before the merges that make its parts")
    return longest


class Rules:
    """Vocabulary and merges of one tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        symbols = _byte_symbols()
        self.byte = {ord(c): b for b, c in enumerate(symbols)}
        self.inner = [vocab[c] for c in symbols]
        self.last = [vocab[c + self.suffix] for c in symbols]
        self.matrix = _Merges(path)
        names = dict(vocab) | {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.width = [len(s.removesuffix(self.suffix) if self.suffix else s) for s in self.names]

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of a run of symbols: the best pair first, the leftmost of equals."""
        n, sym = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(*r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1])))]
        heap = [(r, i, new) for r, new, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or rank((sym[i], sym[j])) != (r, new):
                continue
            sym[i], sym[j], k = new, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if x := rank((new, sym[k])):
                    heapq.heappush(heap, (x[0], i, x[1]))
            h = before[i]
            if h >= 0 and (x := rank((sym[h], new))):
                heapq.heappush(heap, (x[0], h, x[1]))
        return [s for s in sym if s >= 0]


class Run:
    """One part of any length, fed in pieces; emits ids once they are final."""

    def __init__(self, rules: Rules, block: int = BLOCK):
        self.rules, self.block, self.held = rules, max(block, 2 * rules.lookahead), b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(data), self.block):
            self.held += data[lo : lo + self.block]
            if len(self.held) > self.block:
                # whether the last byte ends the part is not known yet
                ids = self.rules.merge([self.rules.inner[b] for b in self.held[:-1]])
                final, end = len(self.held) - 1 - self.rules.lookahead, 0
                for n, i in enumerate(ids):
                    if end + self.rules.width[i] > final:
                        break
                    end += self.rules.width[i]
                out += ids[:n]
                self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        raw, self.held = self.held, b""
        return self.rules.merge([self.rules.inner[b] for b in raw[:-1]] + [self.rules.last[raw[-1]]])


@lru_cache(maxsize=1)
def _joining() -> frozenset[int]:
    """Characters that may join the one before them in composed form."""
    out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in map(chr, range(0x110000)):
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            out.add(ord(c))
            out.update(int(x, 16) for x in d.split()[1:])
        elif unicodedata.combining(c):
            out.add(ord(c))
    return frozenset(out)


class AnyText:
    """Ids of a text of any characters, fed in pieces."""

    def __init__(self, rules: Rules, encode_part):
        self.rules, self.part = rules, encode_part
        self.raw, self.head, self.run, self.inside = "", "", None, ""

    def feed(self, piece: str, final: bool = False) -> list[int]:
        self.raw += piece
        cut = len(self.raw)
        while not final and cut and ((c := ord(self.raw[cut - 1])) > 0x7F and c in _joining() or cut == len(self.raw)):
            cut -= 1
        cut = cut if final else max(0, cut - 1)
        text = self.head + self.rules.tok.normalizer.normalize_str(self.raw[:cut])
        self.raw, self.head = self.raw[cut:], ""
        out: list[int] = []
        whole = self.inside + text
        parts = self.rules.tok.pre_tokenizer.pre_tokenize_str(whole) if whole else []
        parts = [(s.translate(self.rules.byte), a, b) for s, (a, b) in parts]
        raw = lambda s: bytes(map(ord, s))
        if self.run is not None and parts and parts[0][1] == 0:  # its first character stands for what went before
            s, _, b = parts.pop(0)
            out += self.run.feed(raw(s[len(self.inside) :]))
            if b == len(whole) and not final:
                return out
            out += self.run.close()
            self.run, self.inside = None, ""
        # a part is decided when two more characters are known behind the start of the next one
        open_ = None if final else next((i for i in range(len(parts) - 1, -1, -1) if parts[i][1] <= len(whole) - 3), 0)
        for i, (s, a, b) in enumerate(parts):
            if open_ is not None and i >= open_:
                if b == len(whole) and b - a > BLOCK:
                    self.run, self.inside = Run(self.rules), "a" if whole[a].isalpha() else "!"
                    out += self.run.feed(raw(s))
                else:
                    self.head = whole[a:]
                break
            out += self.part(raw(s))
        return out


class Encoder:
    """Ids of texts, a bounded piece at a time."""

    def __init__(self, path: str):
        self.rules = Rules(path)
        self.memo: dict[bytes, list[int]] = {}
        names = sorted(self.rules.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def part(self, raw: bytes) -> list[int]:
        """Ids of one whole part."""
        if len(raw) > BLOCK:
            run = Run(self.rules)
            return run.feed(raw) + run.close()
        ids = self.memo.get(raw)
        if ids is None:
            ids = self.rules.merge([self.rules.inner[b] for b in raw[:-1]] + [self.rules.last[raw[-1]]])
            if len(raw) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[raw] = ids
        return ids

    def _plain(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased plain pieces one after another, and the end of each."""
        data = b"\n".join(pieces) + b"\n" * 32
        flat = np.frombuffer(data, np.uint8)
        s, e, cls = _cut(flat)
        first, which = distinct_parts(flat, s, e)
        s1, size, kind = s[first], (e - s)[first], cls[first]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        short = np.flatnonzero((kind == LETTER) & (size <= LONGEST))
        order = short[np.argsort(size[short], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
            for r, ids in self.rules.matrix(flat[s1[rows][:, None] + np.arange(size[rows[0]])]):
                found.append((rows[r], ids))
        for i in np.flatnonzero((kind != LETTER) | (size > LONGEST)):
            found.append((np.array([i]), np.array([self.part(data[s1[i] : s1[i] + size[i]])])))
        n_ids = np.zeros(len(first), np.int64)
        for rows, ids in found:
            n_ids[rows] = ids.shape[1]
        at = np.cumsum(n_ids) - n_ids
        table = np.zeros(int(n_ids.sum()), np.int32)
        for rows, ids in found:
            table[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        n = n_ids[which]
        before = np.concatenate(([0], np.cumsum(n)))
        out = table[np.repeat(at[which] - before[:-1], n) + np.arange(before[-1])]
        ends = np.cumsum([len(t) + 1 for t in pieces])
        return out, before[np.searchsorted(s, ends)]

    def _any(self, text: str) -> Iterator[np.ndarray]:
        for segment in self.special.split(text) if self.special else [text]:
            if segment in self.rules.special:
                yield np.array([self.rules.special[segment]], np.int32)
                continue
            stream = AnyText(self.rules, self.part)
            for lo in range(0, len(segment), PIECE):
                yield np.array(stream.feed(segment[lo : lo + PIECE]), np.int32)
            yield np.array(stream.feed("", final=True), np.int32)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
        """Batches of (text numbers, ids, end of each one's ids), in order; a
        long text comes in several pieces."""
        rows, pieces, size = [], [], 0

        def flush():
            ids, ends = self._plain(pieces)
            return rows, ids, ends.tolist()

        for i, t in enumerate(texts):
            if not t:
                continue
            lo, plain = 0, bool(_PLAIN.fullmatch(t)) and not (self.special and self.special.search(t))
            while plain and lo < len(t):
                hi = len(t)
                if hi - lo > PIECE:  # a piece ends at a blank
                    m = _BLANK.search(t, lo + PIECE // 2, lo + PIECE)
                    if not m:
                        break
                    hi = m.start()
                rows.append(i)
                pieces.append(t[lo:hi].lower().encode())
                size += len(pieces[-1])
                lo = hi
                if size > BATCH:
                    yield flush()
                    rows, pieces, size = [], [], 0
            if lo < len(t):
                if pieces:
                    yield flush()
                    rows, pieces, size = [], [], 0
                for ids in self._any(t[lo:]):
                    yield [i], ids, [len(ids)]
        if pieces:
            yield flush()


class Decoder:
    """Text of ids, fed in chunks. Without a decoder of its own, a tokenizer's
    text is its symbols joined by blanks (``words=False``); with ``words`` the
    symbols' bytes are the text and an end of word is a blank."""

    def __init__(self, rules: Rules, words: bool = False):
        self.lead = 0 if words else 1
        names = rules.names
        if words:
            special = set(rules.special.values())
            raw = [s.encode() if i in special else self._bytes(s, rules) for i, s in enumerate(names)]
        else:
            raw = [(" " + s).encode() for s in names]
        self.table, self.start, self.size = _flat(raw)
        self.reset()

    @staticmethod
    def _bytes(symbol: str, rules: Rules) -> bytes:
        word = symbol.removesuffix(rules.suffix) if rules.suffix else symbol
        return bytes(rules.byte[ord(c)] for c in word) + (b" " if word != symbol else b"")

    def reset(self) -> None:
        self.utf8, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        raw = _look_up(ids, self.table, self.start, self.size)
        if not self.begun and len(ids):
            raw, self.begun = raw[self.lead :], True
        return self.utf8.decode(raw, final)


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def _look_up(ids: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    n = size[ids]
    before = np.cumsum(n) - n
    return table[np.repeat(start[ids] - before, n) + np.arange(int(n.sum()))].tobytes()


def _texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def _rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """Ids of whole texts as chunks: ``row`` (a number of the text's own),
    ``id_col``, ``chunk`` (from 0) and ``ids``. An empty text is one empty
    chunk."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            seen = np.zeros(len(b), np.int64)
            texts = _texts(b, "t")

            def chunks():
                yield from encoder(texts)
                empty = np.flatnonzero(seen == 0).tolist()
                if empty:
                    yield empty, np.zeros(0, np.int32), [0] * len(empty)

            for rows, ids, ends in chunks():
                order = []
                for i in rows:
                    order.append(int(seen[i]))
                    seen[i] += 1
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(rows)), b.column("id").take(pa.array(rows)), pa.array(order, pa.int32()),
                     pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["row", "doc_id", "chunk", "ids"])

    rows = _rows_of(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, chunk int, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None, words: bool = True) -> DataFrame:
    """The inverse over ``row``, ``id_col``, ``chunk``, ``ids``: ``row``,
    ``id_col``, ``chunk`` and ``text``; a row's chunks in order are its text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, last = Decoder(Rules(path), words), None
        for b in batches:
            text = []
            final = b.column("final").to_pylist()
            for row, ids, end in zip(b.column("row").to_pylist(), b.column("ids"), final):
                if row != last:
                    decoder.reset()
                    last = row
                text.append(decoder.feed(ids.values.to_numpy() if ids.values is not None else np.zeros(0, np.int32), end))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("chunk"), pa.array(text, pa.string())],
                names=["row", "doc_id", "chunk", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    last = encoded.groupBy(F.col("row").alias("r")).agg(F.max("chunk").alias("top"))
    rows = encoded.select("row", F.col(id_col).alias("id"), "chunk", "ids")
    rows = rows.join(last, rows["row"] == last["r"]).select("row", "id", "chunk", "ids", (F.col("chunk") == F.col("top")).alias("final"))
    out = rows.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(run, f"row long, doc_id {kind}, chunk int, text string")
    return out.withColumnRenamed("doc_id", id_col)


def token_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """One row per document: ``id_col``, ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by blanks) and ``decoded_sha256`` (of the decoded
    text)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        decoder = Decoder(encoder.rules)
        numbers = _flat([f" {i}".encode() for i in range(len(encoder.rules.names))])
        for b in batches:
            n = len(b)
            count = np.zeros(n, np.int64)
            empty = hashlib.sha256().hexdigest()
            ids_hex, text_hex = [empty] * n, [empty] * n
            at, ids_sha, text_sha = -1, hashlib.sha256(), hashlib.sha256()

            def close():
                text_sha.update(decoder.feed(np.zeros(0, np.int32), True).encode())
                ids_hex[at], text_hex[at] = ids_sha.hexdigest(), text_sha.hexdigest()

            for rows, ids, ends in encoder(_texts(b, "t")):
                decimal = _look_up(ids, *numbers)
                cuts = np.concatenate(([0], np.cumsum(numbers[2][ids])))
                lo = 0
                for i, hi in zip(rows, ends):
                    if i != at:
                        if at >= 0:
                            close()
                        at, ids_sha, text_sha = i, hashlib.sha256(), hashlib.sha256()
                        decoder.reset()
                    piece = decimal[cuts[lo] : cuts[hi]]
                    ids_sha.update(piece[1:] if not count[i] else piece)
                    text_sha.update(decoder.feed(ids[lo:hi]).encode())
                    count[i] += hi - lo
                    lo = hi
            if at >= 0:
                close()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(count), pa.array(ids_hex), pa.array(text_hex)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    out = _rows_of(df, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
