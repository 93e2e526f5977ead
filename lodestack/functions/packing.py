"""Small helpers for what is sequential in a file: packing lines into windows, and matching braces."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.schemas import PIECES, SPANS


def _weights(lines: list[str]) -> np.ndarray:
    return np.maximum(np.array([len(x) // 4 for x in lines], np.int64), 1)


def window_bounds(weights: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of greedy windows of at most ``most`` weight (one line at least); the next starts so that the tail
    shared with the last weighs ``overlap`` or more, but behind the last start."""
    sums = np.concatenate([[0], np.cumsum(weights)])
    out, start = [], 0
    while start < len(weights):
        end = max(start + 1, int(np.searchsorted(sums, sums[start] + most, "right")) - 1)
        out.append((start, end))
        if end >= len(weights):
            break
        tail = min(int(np.searchsorted(sums, sums[end] - overlap, "right")) - 1, end - 1)
        start = tail if tail > start else end
    return out


def line_windows(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start line, end line, text) of the windows of a text."""
    lines = text.splitlines(keepends=True)
    return [(a + 1, b, "".join(lines[a:b])) for a, b in window_bounds(_weights(lines), most, overlap)]


def split_pieces(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens at line ends where possible; a longer line is sliced by characters."""
    if len(text) // 4 <= most:
        return [text]
    lines = text.splitlines(keepends=True) or [text]
    weights = _weights(lines)
    long, out = weights > most, []
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], long.astype(int), [-1]])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if long[a]:
            width = max(most * 4, 1)
            out += [line[i : i + width] for line in lines[a:b] for i in range(0, len(line), width)]
        else:
            out += _pack(lines[a:b], weights[a:b], most)
    return out or [text]


def _pack(lines: list[str], weights: np.ndarray, most: int) -> list[str]:
    """Greedy packing without overlap."""
    sums, start, out = np.concatenate([[0], np.cumsum(weights)]), 0, []
    while start < len(lines):
        end = max(start + 1, int(np.searchsorted(sums, sums[start] + most, "right")) - 1)
        out.append("".join(lines[start:end]))
        start = end
    return out


def block_end(text: str, start: int) -> int:
    """Behind the brace that closes the first one at or after ``start``; the text's end if there is none."""
    first = text.find("{", start)
    if first < 0:
        return len(text)
    # Depth changes in blocks, so that a short body doesn't read the rest of a long file.
    at, depth, size = first, 0, 4096
    while at < len(text):
        codes = np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32)
        run = depth + np.cumsum((codes == 123).astype(np.int64) - (codes == 125))
        closed = np.flatnonzero((run == 0) & (codes == 125))
        if len(closed):
            return at + int(closed[0]) + 1
        at, depth, size = at + len(codes), int(run[-1]), size * 2
    return len(text)


# What starts a block in PHP and Go. Each stands at a line's start behind any blanks (a method behind any
# blanks and METHOD_WORDS, a class behind one of CLASS_WORDS too), which ``openings`` finds by looking back.
PHP_CLASS = re.compile(r"class\s+([A-Za-z_][A-Za-z0-9_]*)\b")
PHP_FUNCTION = re.compile(r"function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")
PHP_NAMESPACE = re.compile(r"namespace\s+([^;]+);")
GO_FUNC = re.compile(r"func\s*(\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(")
GO_STRUCT = re.compile(r"type\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct\b")
GO_PACKAGE = re.compile(r"package\s+([A-Za-z_][A-Za-z0-9_]*)\b")
METHOD_WORDS = ("public", "protected", "private", "static", "final", "abstract")
CLASS_WORDS = ("final", "abstract")

#: (begin, end, type, symbol) in characters.
Spans = list[tuple[int, int, str, str | None]]


def _word_before(text: str, at: int, words: tuple[str, ...]) -> int:
    """Length of the word that ends at ``at``; 0 if none does."""
    return next((len(w) for w in words if text.startswith(w, at - len(w)) and at >= len(w)), 0)


def _line_start(text: str, at: int, many: tuple[str, ...] = (), one: tuple[str, ...] = ()) -> int:
    """The first line start from which blanks and words of ``many`` lead to ``at``; -1 if none does. A word of ``one``
    with blanks behind it may stand once."""
    found, p, blank = -1, at, False
    while True:
        if p == 0 or text[p - 1] == "\n":
            found = p
        if p and text[p - 1].isspace():
            p, blank = p - 1, True
        elif n := _word_before(text, p, many):
            p -= n
        elif blank and (n := _word_before(text, p, one)):
            p, one, blank = p - n, (), False
        else:
            return found


def openings(pattern: re.Pattern, text: str, many: tuple[str, ...] = (), one: tuple[str, ...] = ()) -> Iterator[tuple[int, re.Match]]:
    """(start, match) of a pattern's matches that stand at a line's start, as ``_line_start`` has it; start is there.

    Every blank is looked at once or twice, however many lines of blanks there are.
    """
    m = pattern.search(text)
    while m:
        start = _line_start(text, m.start(), many, one)
        if start >= 0:
            yield start, m
        m = pattern.search(text, m.end() if start >= 0 else m.start() + 1)


def php_spans(text: str, most: int) -> Spans:
    """Classes within budget, else their methods, else windows; and functions outside classes; by start line."""
    space = next(openings(PHP_NAMESPACE, text), None)
    prefix = f"{space[1][1].strip()}\\" if space else ""
    bodies = [(a, block_end(text, m.end()), m[1]) for a, m in openings(PHP_CLASS, text, one=CLASS_WORDS)]
    found: Spans = []
    for a, b, name in bodies:
        body = text[a:b]
        if len(body) // 4 <= most:
            found.append((a, b, "class", prefix + name))
            continue
        methods = list(openings(PHP_FUNCTION, body, METHOD_WORDS))
        if methods:
            stops = [s for s, _ in methods[1:]] + [len(body)]
            found += [(a + s, a + e, "method", f"{name}.{m[1]}") for (s, m), e in zip(methods, stops, strict=True)]
        else:
            found += _windows_of(body, a, most, "text", None)
    starts, reach = [a for a, _, _ in bodies], list(accumulate((b for _, b, _ in bodies), max))
    for a, m in openings(PHP_FUNCTION, text):
        k = bisect_right(starts, a)
        if not k or reach[k - 1] <= a:
            found.append((a, block_end(text, m.end()), "function", prefix + m[1]))
    return found


def go_spans(text: str, most: int) -> Spans:
    """Structs and functions, by start line; a method's symbol has its receiver's first name."""
    package = next(openings(GO_PACKAGE, text), None)
    owner_of_all = package[1][1] if package else None
    named = lambda owner, name: f"{owner}.{name}" if owner else name
    found: Spans = [(a, block_end(text, m.end()), "struct", named(owner_of_all, m[1])) for a, m in openings(GO_STRUCT, text)]
    for a, m in openings(GO_FUNC, text):
        receiver = re.search(r"[A-Za-z_][A-Za-z0-9_]*", m[1] or "")
        found.append((a, block_end(text, m.end()), "function", named(receiver[0] if receiver else owner_of_all, m[2])))
    return found


def _windows_of(body: str, base: int, most: int, kind: str, symbol: str | None) -> Spans:
    out: Spans = []
    lines = body.splitlines(keepends=True)
    sums = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(int)
    for a, b in window_bounds(_weights(lines), most, 64):
        out.append((base + int(sums[a]), base + int(sums[b]), kind, symbol))
    return out


def block_rows(text: str, most: int, find: Callable[[str, int], Spans]) -> list[dict]:
    """SPANS entries of the spans that ``find`` gives, in order of their first lines."""
    found = find(text, most)
    feeds = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = lambda offsets: np.searchsorted(feeds, offsets) + 1
    first = line([a for a, *_ in found]).tolist()
    last = line([max(b - 1, a) for a, b, *_ in found]).tolist()
    rows = [{"begin": a, "start_line": s, "end_line": e, "text": text[a:b], "chunk_type": kind, "symbol_name": symbol} for (a, b, kind, symbol), s, e in zip(found, first, last, strict=True)]
    return sorted(rows, key=lambda r: r["start_line"])


def window_rows(text: str, most: int, overlap: int) -> list[dict]:
    """SPANS entries of the line windows of a text."""
    return [{"begin": 0, "start_line": a, "end_line": b, "text": x, "chunk_type": "text", "symbol_name": None} for a, b, x in line_windows(text, most, overlap)]


FINDERS: dict[str, Callable[[str, int], Spans]] = {"php": php_spans, "go": go_spans}


def helper_spans(text: Column, language: Column, most: int, overlap: int, fallback: int = 64) -> Column:
    """SPANS of text that Spark's own functions can't cut: blocks of the languages of ``FINDERS``; line windows that
    share ``overlap`` for ``text``, and ``fallback`` for other languages and where no block is found. Null text: null."""
    return spans_udf(most, overlap, fallback)(text, language)


def spans_udf(most: int, overlap: int, fallback: int = 64):
    """What ``helper_spans`` calls."""

    def rows(t: str, lang: str) -> list[dict]:
        found = block_rows(t, most, FINDERS[lang]) if lang in FINDERS else []
        return found or window_rows(t, most, overlap if lang == "text" else fallback)

    @F.pandas_udf(SPANS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in parts:
            yield pd.Series([None if t is None else rows(t, k) for t, k in zip(texts, langs, strict=True)], dtype=object)

    return run


def windows(text: Column, most: int, overlap: int) -> Column:
    """PIECES of a text by line windows; null text has none."""
    return windows_udf(most, overlap)(text)


def windows_udf(most: int, overlap: int):
    """What ``windows`` calls."""

    @F.pandas_udf(PIECES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[dict(zip(("start_line", "end_line", "text"), x, strict=True)) for x in line_windows(t or "", most, overlap)] for t in s], dtype=object)

    return run


def token_pieces(text: Column, most: int) -> Column:
    """array<string>: a text cut to at most ``most`` tokens a piece; null text: null."""
    return pieces_udf(most)(text)


def pieces_udf(most: int):
    """What ``token_pieces`` calls."""

    @F.pandas_udf("array<string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([None if t is None else split_pieces(t, most) for t in s], dtype=object)

    return run
