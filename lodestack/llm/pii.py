"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained on a small labelled table (text, spans) with full-batch gradients of the exact likelihood, and
decoded by Viterbi in numpy, many whole texts in step. Only texts with a digit, an ``@``, the word ``dot``, the word
``at`` in brackets, or ``at`` before a name with a full stop are decoded: no other text can hold a span that fulfils its
kind's condition. Spans that the field adds are kept if they fulfil that condition (digits, Luhn sum, parts) and meet no
base span.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .store import bound_batches
from .textkit import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns.
_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: What a text needs to be decoded; means the same to re (ASCII) and to Arrow's expressions.
_TRIGGERS = r"[0-9@]|\b[dD][oO][tT]\b|[\[({<][\x09-\x0D\x20]*[aA][tT][\x09-\x0D\x20]*[\])}>]|\b[aA][tT][\x09-\x0D\x20]+[^\x00-\x20.]+\.[^\x00-\x20.]"
_TRIGGER = re.compile(_TRIGGERS, re.ASCII)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_BLANK = " \t\n\x0b\x0c\r"

#: Tokens from which on a text is decoded in blocks.
LONG = 2048

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_BITS = 15


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _holds(kind: str, text: str) -> bool:
    """The condition that a base match must fulfil."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    digits = "".join(_DIGIT.findall(text))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that hold, by kind as listed, then start (code points, end exclusive)."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # The pattern's matches by their "@": what stands before it is the longest run behind the match before.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            if kind != "phone" or "+" in text:
                found += [(kind, m.start(), m.end()) for m in _BASE[kind].finditer(text) if _holds(kind, m[0])]
    return found


# Words that tell something about data near them.
CUES = frozenset(
    "at dot tel phone call fax mobile mail email e card visa ip host addr address contact www com org net edu http https v version no nr id order page date year by on to is my write reach dial number pay server price item room".split()
)


def shape(token: str, spaced: bool) -> int:
    """A number for how a token looks: length of digits, the sign, the cue word, or the case pattern."""
    if "0" <= token[0] <= "9":
        s = f"d{min(len(token), 20)}{'z' if token[0] == '0' else ''}"
    elif token[0].isalpha():
        low = token.lower()
        s = f"w{low}" if low in CUES else "x" if token.islower() else "X" if token.isupper() else "Xx"
    else:
        s = f"p{token}"
    return zlib.crc32(f"{s}{int(spaced)}".encode())


class Regions:
    """Tokens of many texts, one after the other: spans, features, and each text's first token."""

    def __init__(self, parts: list[str]):
        spans = [[m.span() for m in _TOKEN.finditer(p)] for p in parts]
        self.spans = spans
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
        kept: dict[tuple[str, bool], int] = {}
        ids = np.zeros(self.first[-1], np.uint64)
        i = 0
        for p, s in zip(parts, spans, strict=True):
            end = 0
            for a, b in s:
                key = (p[a:b], a > end)
                v = kept.get(key) if b - a < 24 else shape(*key)  # long ones are rare, and not kept
                if v is None:
                    v = kept[key] = shape(*key)
                ids[i] = v
                end = b
                i += 1
        self.features = _features(ids, self.first)


def _features(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(tokens, 9) feature numbers: shapes of the token and its neighbours, alone and together."""
    n = len(ids)
    region = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def near(k: int) -> np.ndarray:
        at = np.arange(n) + k
        ok = (at >= 0) & (at < n)
        ok[ok] = region[at[ok]] == region[ok]
        out = np.full(n, 7, np.uint64)
        out[ok] = ids[at[ok]]
        return out

    a, b, c, d, e = (near(k) for k in (-2, -1, 0, 1, 2))
    m = np.uint64(0x9E3779B97F4A7C15)
    combos = [(c,), (b,), (d,), (a,), (e,), (b, c), (c, d), (a, b, c), (c, d, e)]
    out = np.zeros((n, len(combos)), np.int64)
    for i, group in enumerate(combos):
        h = np.full(n, i + 1, np.uint64)
        for x in group:
            h = (h ^ x) * m
            h ^= h >> np.uint64(29)
        out[:, i] = (h >> np.uint64(64 - _BITS)).astype(np.int64)
    return out


def _lanes(first: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, int]]:
    """Texts in groups of like length, with the length; a group has about ``most`` places."""
    length = np.diff(first)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and length[order[to]] * (to + 1 - at) <= most and length[order[to]] <= 2 * length[order[at]] + 8:
            to += 1
        yield order[at:to], int(length[order[to - 1]])
        at = to


class Field:
    """Weights of features and of label pairs; start weights."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, start: np.ndarray | None = None):
        k = len(LABELS)
        self.weights = np.zeros((1 << _BITS, k)) if weights is None else weights
        self.moves = np.zeros((k, k)) if moves is None else moves
        self.start = np.zeros(k) if start is None else start
        # An I label needs its kind's B or I before it.
        self.barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])
        self.start_barred = np.array([b[0] == "I" for b in LABELS])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Each token's score by label, summed a feature at a time."""
        out = np.zeros((len(features), len(LABELS)))
        for i in range(features.shape[1]):
            out += self.weights[features[:, i]]
        return out

    def decode(self, r: Regions) -> np.ndarray:
        """Best label of each token."""
        k = len(LABELS)
        emit = self.emissions(r.features)
        out = np.zeros(len(emit), np.int64)
        moves, start = np.where(self.barred, -1e9, self.moves), np.where(self.start_barred, -1e9, self.start)
        for lanes, steps in _lanes(r.first):
            begin, length = r.first[lanes], np.diff(r.first)[lanes]
            if steps > LONG:
                for a, n in zip(begin.tolist(), length.tolist(), strict=True):
                    out[a : a + n] = best_path(emit[a : a + n], moves, start)
                continue
            score = emit[begin] + start
            back = np.zeros((steps, len(lanes), k), np.int8)
            last = score.copy()
            for t in range(1, steps):
                live = t < length
                way = score[:, :, None] + moves
                back[t] = way.argmax(axis=1)
                score = way.max(axis=1) + emit[np.minimum(begin + t, len(emit) - 1)]
                last[live] = score[live]
            label = last.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                live = t < length
                out[(begin + t)[live]] = label[live]
                label = np.where(live, back[t][np.arange(len(lanes)), label], label)
        return out

    def gradient(self, r: Regions, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the gold labels, and its gradient by emission (tokens, labels), label pair and start."""
        k = len(LABELS)
        emit = self.emissions(r.features)
        slope, pairs, starts, total = np.zeros_like(emit), np.zeros((k, k)), np.zeros(k), 0.0
        moves = np.where(self.barred, -1e9, self.moves)
        start = np.where(self.start_barred, -1e9, self.start)
        for lanes, steps in _lanes(r.first):
            begin, length = r.first[lanes], np.diff(r.first)[lanes]
            at = [np.minimum(begin + t, len(emit) - 1) for t in range(steps)]
            alpha = np.zeros((steps, len(lanes), k))
            beta = np.zeros((steps, len(lanes), k))
            alpha[0] = emit[at[0]] + start
            for t in range(1, steps):
                alpha[t] = np.where((t < length)[:, None], _lse(alpha[t - 1][:, :, None] + moves, 1) + emit[at[t]], alpha[t - 1])
            for t in range(steps - 2, -1, -1):
                beta[t] = np.where((t + 1 < length)[:, None], _lse(moves + (emit[at[t + 1]] + beta[t + 1])[:, None, :], 2), 0)
            z = _lse(alpha[-1], 1)
            for t in range(steps):
                live = np.flatnonzero(t < length)
                p = np.exp(alpha[t] + beta[t] - z[:, None])[live]
                g = gold[at[t]][live]
                p[np.arange(len(live)), g] -= 1
                slope[at[t][live]] -= p
                total += emit[at[t][live], g].sum()
                if t == 0:
                    starts -= p.sum(axis=0)
                    total += start[g].sum()
                else:
                    q = np.exp(alpha[t - 1][:, :, None] + moves + (emit[at[t]] + beta[t])[:, None, :] - z[:, None, None])[live].sum(axis=0)
                    was = gold[at[t - 1]][live]
                    np.add.at(pairs, (was, g), 1)
                    pairs -= q
                    total += moves[was, g].sum()
            total -= z.sum()
        return total, slope, pairs, starts


def best_path(emit: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Viterbi labels of one long text: blocks of its tokens move in step, each for every label that may stand before
    it; the blocks' best scores are joined in order, and all blocks are traced back in step. A million tokens take a
    thousand steps each way."""
    n, k = emit.shape
    steps = max(1, math.isqrt(n))
    blocks = -(-n // steps)
    size = np.minimum(steps, n - np.arange(blocks) * steps)  # only the last block may be short
    at = lambda t: np.minimum(np.arange(blocks) * steps + t, n - 1)
    score = moves[None] + emit[at(0)][:, None, :]  # (block, label before it, label)
    score[0] = np.where(np.arange(k)[:, None] == 0, start + emit[0], -np.inf)
    back = np.zeros((steps, blocks, k, k), np.int8)
    for t in range(1, steps):
        way = score[:, :, :, None] + moves
        back[t] = way.argmax(axis=2)
        new = way.max(axis=2) + emit[at(t)][:, None, :]
        score = np.where((t < size)[:, None, None], new, score)
    came, best = np.zeros((blocks, k), np.int64), np.zeros(k)
    for b in range(blocks):
        way = best[:, None] + score[b] if b else score[b]
        came[b], best = way.argmax(axis=0), way.max(axis=0)
    label, before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    last = int(best.argmax())
    for b in range(blocks - 1, -1, -1):
        label[b], before[b] = last, came[b, last]
        last = before[b]
    out, each = np.zeros(n, np.int64), np.arange(blocks)
    for t in range(steps - 1, -1, -1):
        live = t < size
        out[at(t)[live]] = label[live]
        label = np.where(live, back[t][each, before, label], label)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(rows: list[tuple[str, list[Span]]], steps: int = 80, rate: float = 0.3, penalty: float = 0.02) -> Field:
    """A field trained on labelled texts (adaptive steps on the penalised likelihood; same rows, same field)."""
    r = Regions([t for t, _ in rows])
    gold = np.zeros(int(r.first[-1]), np.int64)
    for i, (_, spans) in enumerate(rows):
        for kind, a, b in spans:
            inside = [j for j, (s, e) in enumerate(r.spans[i]) if s >= a and e <= b]
            for n, j in enumerate(inside):
                gold[r.first[i] + j] = 1 + 2 * KINDS.index(kind) + (n > 0)
    used, columns = np.unique(r.features, return_inverse=True)
    columns = columns.reshape(r.features.shape)
    r.features = columns  # only features that occur have weights while training
    f = Field(weights=np.zeros((len(used), len(LABELS))))
    squares = [np.full_like(f.weights, 1e-3), np.full_like(f.moves, 1e-3), np.full_like(f.start, 1e-3)]
    for _ in range(steps):
        _, slope, pairs, starts = f.gradient(r, gold)
        w = np.stack([np.bincount(columns.ravel(), np.repeat(slope[:, k], columns.shape[1]), len(used)) for k in range(len(LABELS))], 1)
        for value, step, square in zip((f.weights, f.moves, f.start), (w, pairs, starts), squares, strict=True):
            step = step - penalty * value
            square += step**2
            value += rate * step / np.sqrt(square)
    weights = np.zeros((1 << _BITS, len(LABELS)))
    weights[used] = f.weights
    return Field(weights, f.moves, f.start)


def spans_of(r: Regions, labels: np.ndarray, i: int) -> list[Span]:
    """Labelled spans of text i."""
    out: list[Span] = []
    for (a, b), x in zip(r.spans[i], labels[r.first[i] : r.first[i + 1]].tolist(), strict=True):
        if x:
            kind = KINDS[(x - 1) // 2]
            if x % 2 or not out or out[-1][0] != kind:
                out.append((kind, a, b))
            else:
                out[-1] = (kind, out[-1][1], b)
    return out


def _fit_for_kind(kind: str, text: str) -> bool:
    """The condition for a span that the field adds."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I) and re.search(r"\.|\bdot\b", text, re.I))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    where = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
    more: dict[int, list[Span]] = {}
    r = Regions([texts[i] for i in where])
    labels = field.decode(r)
    marked = np.unique(np.searchsorted(r.first, np.flatnonzero(labels), "right") - 1)
    for n in marked.tolist():
        i = where[n]
        for kind, a, b in spans_of(r, labels, n):
            if _fit_for_kind(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                more.setdefault(i, []).append((kind, a, b))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return [(b, sorted(b + more[i], key=order) if i in more else b) for i, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def examples(n: int = 500) -> list[tuple[str, list[Span]]]:
    """A small labelled set: ``n`` sentences from the patterns below, the same at each call."""
    rng = np.random.default_rng(7)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(("an", "er", "ti", "lo", "mi", "sa", "ve", "no", "ri", "ka")) for _ in range(int(rng.integers(1, 5))))
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))

    def card() -> str:
        d = pick("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def value(kind: str) -> str:
        octets = [str(rng.integers(256)) for _ in range(4)]
        c = card()
        return {
            "email": lambda: pick((f"{word()}.{word()}@{word()}.com", f"{word()} at {word()} dot {pick(('com', 'org', 'net', 'de'))}", f"{word()} (at) {word()} (dot) org", f"{word()}{num(2)} [at] {word()} [dot] net", f"{word()} @ {word()} . com", f"{word()}[at]{word()}.de")),
            "ip": lambda: pick((".".join(octets), " . ".join(octets), " dot ".join(octets), "[.]".join(octets))),
            "card": lambda: pick((c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")),
            "phone": lambda: pick((f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{pick('23456789')}{num(2)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)}", f"0{num(2)} / {num(7)}", f"{num(3)}.{num(3)}.{num(4)}")),
        }[kind]()

    before = {"email": ("mail", "write to", "contact", "email :", "reach me at"), "ip": ("host", "server at", "ip", "from address"), "card": ("card", "visa", "pay with card no"), "phone": ("call", "tel", "phone :", "fax", "dial", "mobile number")}
    nothing = (
        lambda: f"on 20{num(2)}-0{rng.integers(1, 10)}-1{rng.integers(10)}", lambda: f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/19{num(2)}", lambda: f"price {num(1)},{num(3)}.{num(2)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}",
        lambda: f"v{num(1)}.{num(2)}.{num(1)}.{num(1)}rc", lambda: f"page {num(3)}", lambda: f"order {num(6)}", lambda: f"id {num(9)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"item {num(4)}-{num(2)}", lambda: f"{num(4)} by {num(4)}",
        lambda: f'key = "{num(3)}{word()[:2]}{num(4)}f{num(2)}{word()[:1]}{num(5)}"', lambda: f"{num(12)}", lambda: f"{num(16)}", lambda: f"at {word()} , dot by dot", lambda: f"room {num(2)} . {num(2)} is {num(3)}", lambda: f"{num(3)} % of {num(5)}",
    )
    rows = []
    for _ in range(n):
        text, spans = word().capitalize(), []
        for _ in range(int(rng.integers(1, 3))):
            text += "".join(f" {word()}" for _ in range(int(rng.integers(0, 4))))
            if rng.random() < 0.5:
                text += f" {pick(nothing)()}"
            else:
                kind = pick(KINDS)
                text += f" {pick(before[kind])} " if rng.random() < 0.7 else " "
                v = value(kind)
                spans.append((kind, len(text), len(text) + len(v)))
                text += v
            text += pick(("", ".", ",", " |"))
        rows.append((f"{text} {word()}", spans))
    return rows


def labelled_table(spark: SparkSession, n: int = 500) -> DataFrame:
    """The small labelled set as a table (text, spans)."""
    return spark.createDataFrame([(t, [{"kind": k, "start": a, "end": b} for k, a, b in s]) for t, s in examples(n)], "text string, spans array<struct<kind string, start int, end int>>")


def train(labelled: DataFrame, most: int = 5000) -> Field:
    """A field from a labelled table of at most ``most`` rows (more is an error: training runs on the driver)."""
    rows = labelled.where("text is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} labelled rows; choose a sample")
    return fit(sorted((r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in rows))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row; null text is empty.

    The counts and the digest are of the base spans; ``spans`` has those and what the field adds, ``n_added`` of them.
    Extra columns are ignored, repeated rows judged apart.
    """
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(field)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = part.num_rows
            texts = part.column("text")
            likely = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _TRIGGERS), False).to_numpy(zero_copy_only=False))
            counts = np.zeros((4, n), np.int64)
            digest, spans, added = [none] * n, [""] * n, np.zeros(n, np.int64)
            for i, (base, every) in zip(likely.tolist(), all_spans(texts.take(pa.array(likely)).to_pylist(), known.value), strict=True):
                for kind, _, _ in base:
                    counts[KINDS.index(kind), i] += 1
                digest[i] = hashlib.sha256(written(base).encode()).hexdigest()
                spans[i], added[i] = written(every), len(every) - len(base)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(added)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
