"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

Every kind of span holds a digit or an '@', so that only windows around these are read; the
network is trained in numpy on labelled spans from a grammar of sentences. Windows overlap by half;
their emissions are blended, nearer the middle counting more, and each run of windows is decoded at
once by Viterbi. A span of the network is added if it meets the kind's own check and touches no
base span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at its later digits too, hence the lookbehind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def fits(kind: str, text: str) -> bool:
    """The check of a kind on a found text."""
    digits = _digits(text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return bool(re.search(r"[A-Za-z0-9]\s*@\s*[A-Za-z0-9]", text)) and bool(re.search(r"[A-Za-z0-9]\s*\.\s*[A-Za-z]{2}", text[text.index("@") :]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping in each kind, failures dropped."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # an address begins where the run of local characters before its '@' begins
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            found = m.group()
            if k == 1 and not all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split(".")):
                continue
            if k != 1 and not fits(KINDS[k], found):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


# -- the network ---------------------------------------------------------------------------------

WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 12, 24
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
BATCH = 1024
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 .,;:!?@+-_()[]{}<>/\\\"'%$#*&=|~\n\t"
_CODE = np.full(0x250, 2, np.int64)  # 0: no character, 1: beyond, 2: other below 0x250
for _k, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = 3 + _k
for _c in range(65, 91):
    _CODE[_c] = _CODE[_c + 32]
_CODES = 3 + len(_ALPHABET)


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, p: dict, side: str, keep: bool):
    """Hidden states [T, B, H] for inputs [T, B, E]; with `keep`, what the backward pass needs."""
    steps, batch = x.shape[:2]
    w = p[f"u{side}"]
    pre = x.reshape(-1, x.shape[2]) @ p[f"w{side}"] + p[f"b{side}"]
    pre = pre.reshape(steps, batch, 4 * HIDDEN)
    h = np.zeros((batch, HIDDEN), np.float32)
    c = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        a = pre[t] + h @ w
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        g = np.tanh(a[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out, saved


def _lstm_back(dout: np.ndarray, x: np.ndarray, saved: list, p: dict, side: str, grad: dict) -> np.ndarray:
    steps, batch = dout.shape[:2]
    w = p[f"u{side}"]
    da_all = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    dh = np.zeros((batch, HIDDEN), np.float32)
    dc = np.zeros((batch, HIDDEN), np.float32)
    du = np.zeros_like(w)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        da_all[t] = da
        du += h.T @ da
        dh = da @ w.T
        dc = dc * f
    flat = da_all.reshape(-1, 4 * HIDDEN)
    grad[f"u{side}"] = du
    grad[f"w{side}"] = x.reshape(-1, x.shape[2]).T @ flat
    grad[f"b{side}"] = flat.sum(axis=0)
    return (flat @ p[f"w{side}"].T).reshape(x.shape)


def emissions(codes: np.ndarray, p: dict) -> np.ndarray:
    """Tag scores [B, T, TAGS] of windows of codes [B, T]."""
    x = p["embed"][codes.T]
    forward, _ = _lstm(x, p, "f", False)
    backward, _ = _lstm(x[::-1], p, "r", False)
    return (np.concatenate([forward, backward[::-1]], axis=2) @ p["out"] + p["bias"]).transpose(1, 0, 2)


def allowed() -> np.ndarray:
    """0 where a tag may follow another, -1e4 where not: inside only after begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_slopes(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """Loss and slopes (score, transition) of the negative log-likelihood; scores [T, B, K]."""
    steps, batch, k = scores.shape
    alpha = np.empty_like(scores)
    beta = np.zeros_like(scores)
    start = np.zeros(k, np.float32)
    start[2::2] = -1e4
    alpha[0] = scores[0] + start
    for t in range(1, steps):
        alpha[t] = scores[t] + _lse(alpha[t - 1][:, :, None] + moves[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(moves[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    ds = np.exp(alpha + beta - z[None, :, None])
    dm = np.zeros_like(moves)
    for t in range(1, steps):
        dm += np.exp(alpha[t - 1][:, :, None] + moves[None] + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    rows = np.arange(batch)
    gold = np.zeros(batch)
    for t in range(steps):
        ds[t, rows, tags[t]] -= 1
        gold += scores[t, rows, tags[t]]
        if t:
            np.add.at(dm, (tags[t - 1], tags[t]), -1)
            gold += moves[tags[t - 1], tags[t]]
    return float((z - gold).mean()), ds / batch, dm / batch


def labelled_sentences(count: int = 6000, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of about a window with their spans (start, kind, end), and look-alikes without."""
    r = random.Random(seed)
    syllables = "ba de ki lo mu ra se ti no pa ve zu an er in os th ch é ü ñ".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def filler(n: int) -> str:
        return " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(n))

    def email() -> str:
        plain = lambda n: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(n))
        local = r.choice([f"{plain(r.randint(2, 8))}.{digits(2)}", f"{plain(5)}{r.choice('._-+')}{plain(4)}", plain(6), plain(4).title() + digits(3)])
        host = r.choice([f"mail{digits(1)}.example.com", f"{plain(6)}.com", f"{plain(4)}.{plain(3)}.org", f"{plain(5)}-{plain(3)}.net"])
        at = r.choice(["@"] * 7 + [" @ ", " @", "@ "])
        return local + at + (host.replace(".", " . ") if r.random() < 0.05 else host)

    def ip() -> str:
        dot = r.choice(["."] * 8 + [" . ", ". "])
        return dot.join(str(r.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([14, 14, 14, 13, 17]))
        last = next(c for c in "0123456789" if luhn(body + c))
        body += last
        sep = r.choice(["", "", "", " ", "-", ".", "/"])
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4)) if sep else body

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}"] * 3 + [f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)} {a}.{b}.{c}", f"+1({a}){b}{c}"])

    def other() -> str:
        return r.choice(["Version 2.0.", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"${digits(3)}.{digits(2)}", digits(r.randint(1, 6)), f"{digits(2)}:{digits(2)}", "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"password={''.join(r.choice('0123456789abcdef') for _ in range(16))}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}", f"§ {digits(3)}", f"#{digits(5)}", f"@{word()}", f"{digits(2)} %", f"({digits(2)})"])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(count):
        text, spans = filler(r.randint(0, 9)), []
        for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
            text += r.choice([" ", " ", " ", "\n", ": ", ", ", " (", '"']) if text else ""
            if r.random() < 0.7:
                kind = r.randrange(4)
                found = makers[kind]()
                spans.append((len(text), kind, len(text) + len(found)))
                text += found
            else:
                text += other()
            if r.random() < 0.6:
                text += r.choice([" ", " ", ". ", ", ", "\n", ") ", '" ', "### ", "*** "]) + filler(r.randint(0, 5))
        out.append((text, spans))
    return out


def _training_windows(sentences) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((len(sentences), WINDOW), np.int64)
    tags = np.zeros((len(sentences), WINDOW), np.int64)
    r = np.random.default_rng(3)
    for k, (text, spans) in enumerate(sentences):
        own = codes_of(text)
        tag = np.zeros(len(own), np.int64)
        for start, kind, end in spans:
            tag[start] = 1 + 2 * kind
            tag[start + 1 : end] = 2 + 2 * kind
        cut = int(r.integers(0, max(1, len(own) - WINDOW + 1)))
        while cut < len(own) and tag[cut] and tag[cut] % 2 == 0:
            cut += 1  # a window does not begin inside a span
        own, tag = own[cut : cut + WINDOW], tag[cut : cut + WINDOW]
        codes[k, : len(own)], tags[k, : len(tag)] = own, tag
    return codes, tags


def train(count: int = 6000, passes: int = 7, size: int = 96, rate: float = 6e-3, seed: int = 1) -> dict:
    """Weights by Adam on back-propagation through both directions and the CRF."""
    r = np.random.default_rng(seed)
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": (0.5 * r.standard_normal((_CODES, EMBED))).astype(np.float32), "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
    for side in "fr":
        p |= {f"w{side}": init(EMBED, 4 * HIDDEN), f"u{side}": init(HIDDEN, 4 * HIDDEN), f"b{side}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    codes, tags = _training_windows(labelled_sentences(count, seed=seed + 4))
    fixed, step = allowed(), 0
    total = passes * (len(codes) // size)
    for _ in range(passes):
        order = r.permutation(len(codes))
        for low in range(0, len(order) - size + 1, size):
            some = order[low : low + size]
            c, y = codes[some].T, tags[some].T
            x = p["embed"][c]
            f, saved_f = _lstm(x, p, "f", True)
            b, saved_b = _lstm(x[::-1], p, "r", True)
            both = np.concatenate([f, b[::-1]], axis=2)
            _, ds, dm = _crf_slopes(both @ p["out"] + p["bias"], p["moves"] + fixed, y)
            ds = ds.astype(np.float32)
            grad = {"moves": dm, "out": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS), "bias": ds.sum(axis=(0, 1))}
            dboth = ds @ p["out"].T
            dx = _lstm_back(dboth[:, :, :HIDDEN], x, saved_f, p, "f", grad)
            dx += _lstm_back(np.ascontiguousarray(dboth[::-1, :, HIDDEN:]), x[::-1], saved_b, p, "r", grad)[::-1]
            grad["embed"] = np.zeros_like(p["embed"])
            np.add.at(grad["embed"], c, dx)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * min(1.0, step / 20) * (1 - 0.95 * step / total)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


@functools.lru_cache(1)
def model() -> dict:
    """The trained network, about 10,000 numbers, made once in a session."""
    return train()


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one run of characters: scores [T, TAGS]."""
    best = scores[0].copy()
    best[2::2] -= 1e4
    back = np.empty(scores.shape, np.int8)
    for t in range(1, len(scores)):
        every = best[:, None] + moves
        back[t] = every.argmax(axis=0)
        best = every.max(axis=0) + scores[t]
    out = np.empty(len(scores), np.int64)
    out[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


_BLEND = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def network_spans(texts: list[str], p: dict) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in each text: windows blended, each run of windows decoded at once."""
    runs: list[tuple[int, int, int]] = []  # text, first window, windows
    held: list[np.ndarray] = []
    for n, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hit = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
        if not len(hit):
            continue
        every = common.distinct(np.concatenate([hit // STRIDE, np.maximum(hit // STRIDE - 1, 0)]))
        codes = np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], 1)
        codes = np.concatenate([codes, np.zeros(WINDOW, np.int64)])
        for group in np.split(every, np.flatnonzero(np.diff(every) > 1) + 1):
            runs.append((n, int(group[0]), len(group)))
        held.append(codes[every[:, None] * STRIDE + np.arange(WINDOW)].astype(np.int16))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not runs:
        return out
    windows = np.concatenate(held)
    moves = p["moves"] + allowed()
    at, done, scores = 0, 0, np.zeros((0, WINDOW, TAGS), np.float32)
    for n, first, count in runs:
        parts = []
        need = count
        while need:  # emissions are made a batch at a time, however long the run
            if done == len(scores):
                scores, done = emissions(windows[at : at + BATCH].astype(np.int64), p), 0
                at += BATCH
            take = min(need, len(scores) - done)
            parts.append(scores[done : done + take])
            done += take
            need -= take
        own = np.concatenate(parts)
        length = min((count - 1) * STRIDE + WINDOW, len(texts[n]) - first * STRIDE)
        total = np.zeros(((count - 1) * STRIDE + WINDOW, TAGS), np.float32)
        weight = np.zeros((len(total), 1), np.float32)
        for k in range(count):
            total[k * STRIDE : k * STRIDE + WINDOW] += own[k] * _BLEND[:, None]
            weight[k * STRIDE : k * STRIDE + WINDOW, 0] += _BLEND
        blended = (total / weight)[:length]
        if (blended.argmax(axis=1) == 0).all():
            continue
        tags = viterbi(blended, moves)
        for begin in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():
            end = begin + 1
            while end < length and tags[end] == tags[begin] + 1:
                end += 1
            out[n].append((first * STRIDE + begin, int(tags[begin]) // 2, first * STRIDE + end))
    return out


def stretches(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the unions of overlapping spans, with the kind of the first; spans sorted."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def all_spans(texts: list[str], p: dict) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, sorted by start and kind."""
    own = [k for k, t in enumerate(texts) if _TRIGGER.search(t)]
    found = dict(zip(own, network_spans([texts[k] for k in own], p), strict=True))
    out = []
    for k, text in enumerate(texts):
        if k not in found:
            out.append(([], []))
            continue
        base = base_spans(text)
        every, taken, at = list(base), stretches(base), 0
        for start, kind, end in found[k]:
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free = at == len(taken) or taken[at][0] >= end
            # inside a longer run of letters or digits it is part of something else
            inner = start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
            if free and not inner and fits(KINDS[kind], text[start:end]):
                every.append((start, kind, end))
        out.append((base, sorted(every)))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every row.

    Positions count code points, ends exclusive. Null text counts as empty: no spans. Rows stand
    alone, so repeated rows and empty tables need no rule; texts of any length are read whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    p = model()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                rows = []
                for doc_id, (base, every) in zip(part.column(0).to_pylist(), all_spans(common.texts_of(part.column(1)), p), strict=True):
                    counts = [sum(1 for _, k, _ in base if k == n) for n in range(len(KINDS))]
                    rows.append((doc_id, *counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(every)))
                yield common.batch_of(schema, zip(*rows, strict=True))

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), kernel, SCHEMA)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind, in brackets."""
    out, at = [], 0
    for start, end, kind in stretches(spans):
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with spans masked in text and n_chars (if there) counted anew; null text stays.

    Rows stand alone, so repeated rows and empty tables need no rule.
    """
    names = docs.columns
    p = model()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = part.column(place).to_pylist()
                found = all_spans([t or "" for t in texts], p)
                texts = [t if not every else mask(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[place] = pa.array(texts, columns[place].type)
                if "n_chars" in names:
                    kind = columns[names.index("n_chars")].type
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], kind)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return common.arrow_map(docs, kernel, docs.schema)
