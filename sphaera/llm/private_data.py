"""Personal data by fixed patterns and a character-level BiLSTM with CRF
transitions.

The patterns give the base spans (email, ip, card, phone), each kind leftmost
and without overlap. A bidirectional LSTM over character classes, trained in
NumPy on windows of a bounded sample of rows that are not held out, scores a
tag for every character; learned transition scores tie the tags. Labels are the
base spans, as they are and rewritten in ways that the patterns miss (blanks
around an address's signs, other separators, a phone number without its plus
sign), so that the model adds what the patterns cannot. Texts are scored in
overlapping windows; the scores of windows are averaged where they overlap, and
one best path is decoded over the whole text. Model spans that touch no base
span are added to those if they hold a digit or an at sign, are six characters
long or more and do not begin or end inside a word.

Every window is scored. Decoding is left out only for characters where it is
certain that the best path has no span: where no run of characters around them
gains more by being one than "no span" leads there, the best transitions
included.

Defined cases: a null text is empty and has no spans; without any labelled span
in the table only base spans are found; rows with one identifier are searched
one by one; an empty table gives an empty result; only the two named columns
are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

# ---------------------------------------------------------------- base spans
# the patterns start only where a match can start, so a long run that leads to
# no match is read once
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = t.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(s, 0, e) for s, e in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if 14 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --------------------------------------------------------------------- model
HIDDEN = 8
TAGS = 1 + len(KINDS)
WINDOW, OVERLAP = 512, 32
BATCH_WINDOWS = 2304  # those of a batch of texts at once
DECODE_CELLS = 1 << 19  # characters that are decoded together
LEAST = 6  # shorter model spans are dropped: no kind is that short
TRAIN_DOCS = 2000
TRAIN_PER_TEXT = 8  # spans of a training text, drawn at random, that become windows
TRAIN_WINDOW = 96
TRAIN_SPANS = 1200
STEPS = 500
TRAIN_BATCH = 64

_SIGNS = " \t\n.-+()@_%:/\"'=,;!?#$&*|"
CLASSES = 6 + len(_SIGNS)


def _class_table() -> np.ndarray:
    """Class of every code point: 0 is padding, 1 lower case, 2 upper case, 3
    digit, 4 a letter beyond ASCII, 5 anything else, then single signs."""
    t = np.full(0x110000, 5, np.uint8)
    t[0x80:] = 4
    t[0x2000:0x2070] = 5
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    for i, c in enumerate(_SIGNS):
        t[ord(c)] = 6 + i
    return t


_CLASS = _class_table()


def classes(t: str) -> np.ndarray:
    return _CLASS[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")]


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {}
    for d in "fb":
        p[f"T{d}"] = rng.normal(0, 0.4, (4 * h, CLASSES))
        p[f"T{d}"][h : 2 * h] += 1.0  # remember at first
        p[f"U{d}"] = rng.normal(0, 0.3, (4 * h, h))
        p[f"W{d}"] = rng.normal(0, 0.3, (TAGS, h))
    p["bias"] = np.zeros(TAGS)
    p["trans"] = np.eye(TAGS) * 2.0
    return p


def _gates(z: np.ndarray) -> None:
    """Input, forget and output gates are clipped lines, the update a tanh."""
    s, g = z[: 3 * HIDDEN], z[3 * HIDDEN :]
    s *= 0.2
    s += 0.5
    np.maximum(s, 0, out=s)
    np.minimum(s, 1, out=s)
    np.tanh(g, out=g)


def _run_direction(p: dict, d: str, cls: np.ndarray, n_at: np.ndarray, keep: bool = False):
    """Hidden states (step, unit, window) of one direction. At step t the first
    ``n_at[t]`` windows have a character; windows are sorted by length."""
    steps, n, h = len(cls), cls.shape[1], HIDDEN
    table, u = p[f"T{d}"], p[f"U{d}"]
    hid = np.zeros((steps, h, n), table.dtype)
    c = np.zeros((h, n), table.dtype)
    last = np.zeros((h, n), table.dtype)
    tape = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        m = n_at[t]
        z = np.take(table, cls[t, :m], axis=1)
        z += u @ last[:, :m]
        _gates(z)
        old = c[:, :m].copy() if keep else None
        cm = c[:, :m]
        cm *= z[h : 2 * h]
        cm += z[:h] * z[3 * h :]
        tc = np.tanh(cm)
        if keep:
            tape.append((t, z, old, tc, last.copy()))
        new = hid[t, :, :m]
        np.multiply(tc, z[2 * h : 3 * h], out=new)
        last = hid[t]
    return (hid, tape) if keep else hid


def _emit(p: dict, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Tag scores (step, tag, window)."""
    e = np.matmul(p["Wf"], hf)
    e += np.matmul(p["Wb"], hb)
    e += p["bias"][:, None]
    return e


def _scores(p: dict, cls: np.ndarray, n_at: np.ndarray) -> np.ndarray:
    """Tag scores as of :func:`_run_direction` and :func:`_emit`, for scoring
    alone: states are rows of a window, each gate a block of its own, and the
    gates' lines are folded into their weights."""
    steps, n, h = *cls.shape, HIDDEN
    e = np.empty((steps, TAGS, n), np.float32)
    e[:] = p["bias"][:, None]
    for d in "fb":
        table = np.ascontiguousarray(p[f"T{d}"].reshape(4, h, CLASSES).transpose(0, 2, 1))
        u = np.ascontiguousarray(p[f"U{d}"].reshape(4, h, h).transpose(0, 2, 1))
        table[:3] = table[:3] * 0.2 + 0.5
        u[:3] *= 0.2
        gates, part = np.empty((4, n, h), np.float32), np.empty((n, h), np.float32)
        state, last = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = n_at[t]
            z, c, out, x = gates[:, :m], state[:m], last[:m], cls[t, :m]
            np.matmul(out, u, out=z)
            for k in range(4):
                z[k] += np.take(table[k], x, axis=0, mode="clip", out=part[:m])
            np.clip(z[:3], 0, 1, out=z[:3])
            np.tanh(z[3], out=z[3])
            c *= z[1]
            z[3] *= z[0]
            c += z[3]
            np.tanh(c, out=out)
            out *= z[2]
            e[t, :, :m] += p[f"W{d}"] @ out.T
    return e


def _viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags (step, window) of windows sorted by length, longest first."""
    steps, tags, n = e.shape
    score = e[0].copy()
    back = np.zeros((steps, tags, n), np.uint8)
    rows = np.arange(n)
    for t in range(1, steps):
        m = int((lengths > t).sum())
        best = score[0, :m] + trans[0][:, None]
        for i in range(1, tags):  # of equals the first
            got = score[i, :m] + trans[i][:, None]
            np.copyto(back[t, :, :m], i, where=got > best)
            np.maximum(best, got, out=best)
        score[:, :m] = best + e[t, :, :m]
    tag = np.zeros((steps, n), np.uint8)
    cur = score.argmax(0)
    for t in range(steps - 1, -1, -1):
        on = lengths > t
        tag[t, on] = cur[on]
        if t:
            cur = np.where(on, back[t, cur, rows], cur)
    return tag


def _crf_gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray):
    """Mean log-likelihood of the gold tags and its gradients for equally long
    windows; e is (step, tag, window), gold (step, window)."""
    steps, tags, n = e.shape
    p = np.exp(e - e.max(1, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd, bwd = np.empty_like(p), np.ones_like(p)
    cur = p[0]
    for t in range(steps):
        if t:
            cur = (a.T @ cur) * p[t]
        cur = cur / cur.sum(0)
        fwd[t] = cur
    for t in range(steps - 2, -1, -1):
        b = a @ (bwd[t + 1] * p[t + 1])
        bwd[t] = b / b.sum(0)
    post = fwd * bwd
    post /= post.sum(1, keepdims=True)
    onehot = np.eye(tags)[gold].transpose(0, 2, 1)
    g_e = onehot - post
    left = fwd[:-1]
    right = p[1:] * bwd[1:]
    norm = np.einsum("tin,ij,tjn->tn", left, a, right, optimize=True)
    pair = np.einsum("tin,tjn->ij", left / norm[:, None, :], right) * a
    seen = np.einsum("tin,tjn->ij", onehot[:-1], onehot[1:])
    return post, g_e / n, (seen - pair) / n


def _back_direction(p: dict, d: str, cls: np.ndarray, tape: list, dh_out: np.ndarray, grad: dict) -> None:
    h, n = HIDDEN, cls.shape[1]
    dh, dc = np.zeros((h, n)), np.zeros((h, n))
    g_t, g_u = np.zeros_like(p[f"T{d}"]), np.zeros_like(p[f"U{d}"])
    for t, z, old, tc, last in reversed(tape):
        i, f, o, g = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g, dc * old, dh * tc, dc * i * (1 - g * g)))
        dz[: 3 * h] *= 0.2 * ((z[: 3 * h] > 0) & (z[: 3 * h] < 1))
        g_u += dz @ last.T
        hot = np.zeros((n, CLASSES))
        hot[np.arange(n), cls[t]] = 1
        g_t += dz @ hot
        dh = p[f"U{d}"].T @ dz
        dc = dc * f
    grad[f"T{d}"], grad[f"U{d}"] = g_t, g_u


def fit(windows: np.ndarray, gold: np.ndarray, seed: int = 3, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Train on windows (window, character) of classes and their tags by Adam
    on the CRF likelihood."""
    rng = np.random.default_rng(seed)
    p = _init(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    n_at = np.full(windows.shape[1], min(TRAIN_BATCH, len(windows)))
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), n_at[0], replace=False)
        cls, tags = windows[pick].T.astype(np.int64), gold[pick].T
        hf, tape_f = _run_direction(p, "f", cls, n_at, keep=True)
        hb, tape_b = _run_direction(p, "b", cls, n_at, keep=True)
        _, g_e, g_trans = _crf_gradient(_emit(p, hf, hb), p["trans"], tags)
        grad = {"bias": g_e.sum((0, 2)), "trans": g_trans}
        for d, hid, tape in (("f", hf, tape_f), ("b", hb, tape_b)):
            grad[f"W{d}"] = np.einsum("tkn,thn->kh", g_e, hid)
            _back_direction(p, d, cls, tape, np.matmul(p[f"W{d}"].T, g_e), grad)
        size = np.sqrt(sum((g * g).sum() for g in grad.values()))
        rate = 0.02 * min(1.0, 5.0 / size) * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p[k] += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _cut(size: int) -> list[tuple[int, int]]:
    """Overlapping windows of a text: start and length."""
    return [(s, min(WINDOW, size - s)) for s in range(0, max(1, size - OVERLAP), WINDOW - OVERLAP)]


def _most_gain(trans: np.ndarray) -> tuple[float, float]:
    """What a character inside a span gains by its transition at most, and what
    a span gains by those into and out of it, over a path outside spans."""
    inside, none = float(trans[1:, 1:].max()), float(trans[0, 0])
    # in and out of a span, or none of them where the text begins or ends
    around = max(0.0, float(trans[0, 1:].max()) - none) + max(0.0, float(trans[1:, 0].max()) - none) + max(0.0, none - inside)
    return inside - none, around + 1e-2


def _may_hold_a_span(e: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Windows (step, tag, window) in which a path with a span can beat the one
    without: the best a span can gain over any run of characters, with the
    largest transitions into, inside and out of spans."""
    each, around = _most_gain(trans)
    gain = e[:, 1:].max(1)
    gain -= e[:, 0]
    gain += each
    gain[np.arange(len(gain))[:, None] >= size] = -1e3
    total = np.cumsum(gain, axis=0, dtype=np.float32)
    before = np.minimum.accumulate(np.concatenate((np.zeros((1, total.shape[1]), np.float32), total[:-1])), axis=0)
    return (total - before).max(0) + around > 0


def _may_be_in_a_span(scores: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Characters of stretches (character, tag) that lie in some run which can
    gain by being a span; the best path is outside spans at all others."""
    each, around = _most_gain(trans)
    gain = np.concatenate([x for e in scores for x in (e[:, 1:].max(1) - e[:, 0] + each, [-1e6])])  # no run beyond a stretch
    total = np.cumsum(gain)
    low = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
    may = np.maximum.accumulate(total[::-1])[::-1] - low + around > 0
    return [x[:-1] for x in np.split(may, np.cumsum([len(e) + 1 for e in scores])[:-1])]


def _windows_emissions(flat: np.ndarray, cuts: list[tuple[int, int, int, int]], p: dict):
    """Tag scores (character, tag) of the windows that may hold a span; of all
    others the overlaps with their neighbours."""
    opened: dict[tuple[int, int], np.ndarray] = {}
    edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    order = sorted(cuts, key=lambda w: -w[1])
    for lo in range(0, len(order), BATCH_WINDOWS):
        part = order[lo : lo + BATCH_WINDOWS]
        start = np.array([w[0] for w in part])
        size = np.array([w[1] for w in part])
        steps = int(size[0])
        n_at = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        x = flat[np.minimum(start + np.arange(steps)[:, None], len(flat) - 1)].astype(np.int64)
        e = _scores(p, x, n_at)
        may = _may_hold_a_span(e, size, p["trans"])
        for k, (_, n, doc, s) in enumerate(part):
            if may[k]:
                opened[doc, s] = e[:n, :, k].copy()
            else:
                edges[doc, s] = e[:OVERLAP, :, k].copy(), e[n - OVERLAP : n, :, k].copy()
    return opened, edges


def _stretches(opened: dict, edges: dict) -> list[tuple[int, int, np.ndarray, bool, bool]]:
    """Windows side by side that may hold a span, joined to one stretch of a
    text: document, start, scores, and whether text goes on before and after.
    Where windows overlap, scores are averaged, with those of a window that
    holds no span too."""
    out, step = [], WINDOW - OVERLAP
    for doc, s in sorted(opened):
        if (doc, s - step) in opened:
            continue
        starts = [s]
        while (doc, starts[-1] + step) in opened:
            starts.append(starts[-1] + step)
        end = starts[-1] + len(opened[doc, starts[-1]])
        total = np.zeros((end - s, TAGS), np.float32)
        seen = np.zeros((end - s, 1), np.float32)
        for w in starts:
            e = opened[doc, w]
            total[w - s : w - s + len(e)] += e
            seen[w - s : w - s + len(e)] += 1
        before, after = edges.get((doc, s - step)), edges.get((doc, starts[-1] + step))
        if before is not None:
            total[: len(before[1])] += before[1]
            seen[: len(before[1])] += 1
        if after is not None:
            n = min(len(after[0]), len(opened[doc, starts[-1]]), end - s)
            at = starts[-1] + step - s
            n = min(n, end - s - at)
            total[at : at + n] += after[0][:n]
            seen[at : at + n] += 1
        out.append((doc, s, total / seen, before is not None, after is not None))
    return out


def tag_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the model's spans in every text: windows are scored
    one by one, joined by averaging where they overlap, and decoded as a whole.
    A window in which no span can pay (:func:`_may_hold_a_span`) is not decoded,
    nor is a character elsewhere in no run that can (:func:`_may_be_in_a_span`);
    the best path is outside spans there."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cls = [classes(t) for t in texts]
    base = np.cumsum([0] + [len(c) for c in cls])
    flat = np.concatenate(cls) if cls else np.empty(0, np.uint8)
    trans = p["trans"]
    cuts = [(int(base[i]) + s, n, i, s) for i, c in enumerate(cls) if len(c) for s, n in _cut(len(c))]
    stretches = _stretches(*_windows_emissions(flat, cuts, p))
    found = []
    for (doc, s, scores, before, after), may in zip(stretches, _may_be_in_a_span([x[2] for x in stretches], trans) if stretches else ()):
        edge = np.flatnonzero(np.diff(may, prepend=False, append=False)).tolist()
        found += [(doc, s + a, scores[a:b], before or a > 0, after or b < len(scores)) for a, b in zip(edge[::2], edge[1::2])]
    found.sort(key=lambda x: -len(x[2]))
    lo = 0
    while lo < len(found):
        hi, steps = lo + 1, len(found[lo][2])
        while hi < len(found) and (hi + 1 - lo) * steps <= DECODE_CELLS:
            hi += 1
        part = found[lo:hi]
        size = np.array([len(x[2]) for x in part])
        e = np.zeros((steps, TAGS, len(part)), np.float32)
        for k, (_, _, scores, before, after) in enumerate(part):
            e[: size[k], :, k] = scores
            e[0, :, k] += trans[0] if before else 0  # outside a span before and after
            e[size[k] - 1, :, k] += trans[:, 0] if after else 0
        tags = _viterbi(e, trans, size)
        for k, (doc, s, *_rest) in enumerate(part):
            whole = np.zeros(size[k] + 2, np.int8)
            whole[1:-1] = tags[: size[k], k]
            edge = np.flatnonzero(whole[1:] != whole[:-1])
            for a, b in zip(edge[:-1], edge[1:]):
                if whole[a + 1] and b - a >= LEAST:
                    out[doc].append((int(s + a), int(whole[a + 1]) - 1, int(s + b)))
        lo = hi
    return [sorted(x) for x in out]


def all_spans(texts: list[str], p: dict[str, np.ndarray] | None) -> list[list[tuple[int, int, int]]]:
    """Base spans and, with kinds from ``len(KINDS)`` on, model spans that
    touch none of them; sorted."""
    base = [base_spans(t) for t in texts]
    if p is None:
        return base
    out = []
    for t, b, more in zip(texts, base, tag_spans(texts, p)):
        # a model span names a digit or an address and is no part of a longer word
        fit_ = [
            (s, k + len(KINDS), e) for s, k, e in more
            if (_DIGIT.search(t, s, e) or t.find("@", s, e) >= 0)
            and not (t[s - 1 : s].isalnum() and t[s].isalnum()) and not (t[e : e + 1].isalnum() and t[e - 1].isalnum())
        ]
        out.append(sorted(b + [x for x in fit_ if not any(s < x[2] and x[0] < e for s, _, e in b)]))
    return out


def altered(value: str, kind: int, rng: np.random.Generator) -> str:
    """The same personal data written so that the patterns miss it: an address
    with blanks at its signs, numbers with other separators, a phone number
    without its sign."""
    way = int(rng.integers(2))
    if kind == 0:
        user, host = value.split("@", 1)
        return f"{user} @ {host}" if way else f"{user} @ " + host.replace(".", " . ")
    if kind == 1:
        return value.replace(".", " . ") if way else value.replace(".", ". ")
    digits = [c for c in value if c.isdigit()]
    if kind == 2:
        return ("." if way else "  ").join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    return value[1:] if way else "00" + "/".join("".join(digits[i : i + 3]) for i in range(0, len(digits), 3))


def held_out(ident: Column) -> Column:
    """Rows that the model never learns from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> dict | None:
    """Fit on windows around the base spans, as they are and altered, of a
    sample of rows with digits or an at sign, and on as many windows from
    elsewhere in these rows. The sample is chosen by a hash of the identifier
    and of the text among the rows that are not held out."""
    text = df[text_col].cast("string")
    rows = df.filter(~held_out(df[id_col])).select(text.alias("t"), F.pmod(F.xxhash64(df[id_col], text), F.lit(1_000_000)).alias("h"))
    rows = rows.filter(F.col("t").rlike("[0-9]{2}|@"))
    n = rows.count()
    share = 1_000_000 if n <= max_docs else -(-1_000_000 * max_docs // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [w for t, h in zip(b.column("t").to_pylist(), b.column("h").to_pylist()) for w in _windows(t, h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w[i] for w in got], pa.binary()) for i in range(2)], names=["x", "y"]
            )

    found = rows.filter(F.col("h") < share).mapInArrow(run, "x binary, y binary")
    found = sorted((bytes(r["x"]), bytes(r["y"])) for r in found.collect())  # windows of a bounded sample
    hits = [w for w in found if any(w[1])]
    if not hits:
        return None
    rng = np.random.default_rng(11)
    rest = [w for w in found if not any(w[1])]
    pick = lambda a, k: [a[i] for i in rng.permutation(len(a))[:k]]
    use = pick(hits, 2 * TRAIN_SPANS) + pick(rest, 2 * TRAIN_SPANS)
    x, y = (np.frombuffer(b"".join(w[i] for w in use), np.uint8).reshape(-1, TRAIN_WINDOW) for i in range(2))
    return fit(x, y)


def _window(t: str, tags: np.ndarray, at: int) -> tuple[bytes, bytes]:
    x, y = np.zeros(TRAIN_WINDOW, np.uint8), np.zeros(TRAIN_WINDOW, np.uint8)
    part = t[at : at + TRAIN_WINDOW]
    x[: len(part)], y[: len(part)] = classes(part), tags[at : at + TRAIN_WINDOW]
    return x.tobytes(), y.tobytes()


def _windows(t: str, seed: int, most: int = TRAIN_PER_TEXT) -> list[tuple[bytes, bytes]]:
    """Labelled windows around up to ``most`` spans, as they are and altered,
    and as many elsewhere. A window with a pattern match that failed its check
    is left out: it says neither yes nor no."""
    rng = np.random.default_rng(seed)
    spans = base_spans(t)
    tags = np.zeros(len(t), np.uint8)
    for s, k, e in spans:
        tags[s:e] = k + 1
    doubt = np.zeros(len(t), bool)
    for pattern in (_IP, _CARD, _PHONE):
        for m in pattern.finditer(t):
            if m.end() - m.start() >= 9:
                doubt[m.start() : m.end()] = tags[m.start() : m.end()] == 0
    room = max(1, len(t) - TRAIN_WINDOW + 1)
    some = [spans[i] for i in rng.permutation(len(spans))[:most]]
    out = []
    for s, k, e in some:
        at = min(int(rng.integers(max(0, e - TRAIN_WINDOW), max(1, s + 1))), room - 1)
        if not doubt[at : at + TRAIN_WINDOW].any():
            out.append(_window(t, tags, at))
        left, right = max(0, s - TRAIN_WINDOW // 3), min(len(t), e + TRAIN_WINDOW // 3)
        if not doubt[left:right].any():
            other = altered(t[s:e], k, rng)
            marks = np.concatenate((tags[left:s], np.full(len(other), k + 1, np.uint8), tags[e:right]))
            out.append(_window(t[left:s] + other + t[e:right], marks, 0))
    for at in rng.integers(0, room, min(most, max(2, len(some)))).tolist():
        if not doubt[at : at + TRAIN_WINDOW].any():
            out.append(_window(t, tags, at))
    return out


def quality(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the model adds on held-out rows in which every base span is
    altered: per kind the altered spans that the patterns miss (``n``), those
    that meet a model span (``found``), and over all kinds the model spans
    (``added``) and those among them that meet an altered span (``right``)."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.filter(held_out(df[id_col])).select(text.alias("t"), F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(KINDS), 4), np.int64)
        for b in batches:
            for t, h in zip(b.column("t").to_pylist(), b.column("h").to_pylist()):
                rng, at, out, gold = np.random.default_rng(h & 0x7FFFFFFF), 0, [], []
                for s, k, e in base_spans(t):
                    if s < at:
                        continue
                    out.append(t[at:s])
                    begin = sum(map(len, out))
                    out.append(altered(t[s:e], k, rng))
                    gold.append((begin, k, begin + len(out[-1])))
                    at = e
                got = all_spans(["".join(out) + t[at:]], model)[0]
                base = [x for x in got if x[1] < len(KINDS)]
                more = [x for x in got if x[1] >= len(KINDS)]
                meets = lambda x, many: any(s < x[2] and x[0] < e for s, _, e in many)
                for x in gold:
                    if not meets(x, base):
                        count[x[1], 0] += 1
                        count[x[1], 1] += meets(x, more)
                for x in more:
                    count[x[1] - len(KINDS), 2] += 1
                    count[x[1] - len(KINDS), 3] += meets(x, gold)
        yield pa.RecordBatch.from_arrays([pa.array(KINDS), *map(pa.array, count.T)], names=["kind", "n", "found", "added", "right"])

    per = rows.mapInArrow(run, "kind string, n long, found long, added long, right long")
    return per.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "found", "added", "right")])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end; a model span is named by the kind it found."""
    return ",".join(f"{KINDS[k % len(KINDS)]}:{s}:{e}" for s, k, e in spans)


BATCH_BYTES = 1_000_000


def private_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, ``base_sha256`` (of
    kind:start:end, comma-joined) and ``spans`` (all spans, written likewise;
    code points, end exclusive)."""
    p = model if model is not None else train(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lo = b.column("t"), 0
            size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES)))
                got = all_spans(text.slice(lo, hi - lo).to_pylist(), p)
                base = [[x for x in g if x[1] < len(KINDS)] for g in got]
                n = [pa.array([sum(x[1] == k for x in g) for g in base], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(_joined(g).encode()).hexdigest() for g in base]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), *n, pa.array(sha, pa.string()), pa.array(map(_joined, got), pa.string())],
                    names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )
                lo = hi

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    schema = ", ".join([f"id {kind}", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
