"""Byte-level word finding and hashing over Arrow text batches, vectorised with numpy.

All word classes used here treat a multi-byte UTF-8 character either wholly as word or not at all, so
bytes give the same words as code points. Hashes have 64 bits and depend on the word's bytes alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that a kernel takes at a time (at least one document): bounds a task's memory.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
# Span hashes are two polynomials of the bytes, each modulo a prime below 2 ** 31 with a base of its own: modulo a power of
# two, such texts as those of the Thue-Morse sequence would collide whatever the base.
_PRIMES, _BASES = (2147483647, 2147483629), (1000000933, 1357913579)
_INVERSES = tuple(pow(b, -1, p) for b, p in zip(_BASES, _PRIMES, strict=True))
_pow: dict[tuple[int, int], np.ndarray] = {}

_all = np.arange(256)
_space = (_all == 32) | ((_all >= 9) & (_all <= 13))
#: Lower-cases A-Z.
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
SAME = _all.astype(np.uint8)
#: Everything but blanks (space, tab to carriage return).
NON_BLANK = ~_space
#: Letters a-z (after LOWER), digits and all non-ASCII characters.
ALNUM = ((_all >= 97) & (_all <= 122)) | ((_all >= 48) & (_all <= 57)) | (_all >= 128)
ALNUM_ANY_CASE = ALNUM | ((_all >= 65) & (_all <= 90))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of ``column``, or one row. Before the first and after the
    last, what the worker has freed goes back to the system: workers stay from stage to stage."""
    give_back()
    yield from _cut(batches, column, most)
    give_back()


def give_back() -> None:
    """Have the C library, if it is one that can, return freed memory to the system."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _cut(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = buffers(batch.column(column))[1]
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime below 2**31."""
    have = _pow.get((base, prime))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
            k *= 2
        have = have.astype(np.uint32)
        if size <= 8 * SLICE_BYTES:
            _pow[base, prime] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(running: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of byte spans from ``running_sums`` of their text; length counts. Spans of unequal hashes differ; those of
    equal ones are compared by their bytes where that decides a result (``same_spans``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    most, h = int(starts.max()) + 1, []
    for total, inverse, prime in zip(running, _INVERSES, _PRIMES, strict=True):
        p = np.uint64(prime)
        h.append((total[ends] - total[starts]) % p * powers(inverse, prime, most)[starts] % p)
    return mix((h[0] << np.uint64(31) | h[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def running_sums(data: np.ndarray) -> list[np.ndarray]:
    """What ``span_hash`` needs of a text's bytes. Sums don't overflow: 2**33 terms below 2**31."""
    out, plus = [], data.astype(np.uint16) + np.uint16(1)
    for base, prime in zip(_BASES, _PRIMES, strict=True):
        total = np.zeros(len(data) + 1, np.uint64)
        terms = total[1:]  # summed where they lie: long texts have eight bytes a byte for each prime, and no more
        np.multiply(powers(base, prime, len(data)), plus, out=terms, dtype=np.uint64)
        if len(data) >= 1 << 24:
            terms %= np.uint64(prime)
        np.cumsum(terms, out=terms)
        out.append(total)
    return out


def same_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether each span has the bytes of span ``like``: compared byte by byte, about ``most`` bytes at a time. Both
    spans of a pair must be of one length to be the same."""
    size = ends - starts
    same = size == size[like]
    for i, j in parts(np.where(same, size, 0), most):
        at = np.flatnonzero(same[i:j]) + i
        n = size[at]
        differ = text[runs(starts[at], n)] != text[runs(starts[like[at]], n)]
        bad = np.add.reduceat(np.append(differ, False), np.minimum(np.cumsum(n) - n, len(differ))) if differ.any() else np.zeros(len(at), np.int64)
        same[at[(bad > 0) & (n > 0)]] = False
    return same


def parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a row of sizes into runs of about ``most`` in all, or of one."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def span_ids(text: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's text, a span that has each number): spans get one number if their bytes are equal. Numbers
    are as texts come first."""
    import pandas as pd  # some 50 MB, which workers that only hash don't need

    of, _ = pd.factorize(hashes)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1)) if len(of) else of
    if not same_spans(text, starts, ends, first[of]).all():  # a collision: by the bytes alone
        raw = text.tobytes()
        of, _ = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1))
    return of, first


class Words:
    """The words of a batch of texts.

    text: bytes after the map; starts, ends: each word's span; first: each document's first word, and one more;
    hash: each word's hash; doc: each word's document. keep: what hashes are made of stays, for other spans of the texts.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray = NON_BLANK, lower: np.ndarray = SAME, hashed: bool = True, keep: bool = False):
        data, self.offsets = buffers(texts)
        self.text = data if lower is SAME else lower[data]
        word = is_word[self.text]
        self.is_word = word
        n = len(word)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word
        begins = word & (~before[:-1] | edge[:-1])
        after = np.zeros(n, bool)
        after[: max(n - 1, 0)] = word[1:]
        stops = word & (~after | edge[1:])
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._running = None
        self.hash = span_hash(self.running, self.starts, self.ends) if hashed else None
        if not keep:
            self._running = None

    @property
    def running(self) -> list[np.ndarray]:
        if self._running is None:
            self._running = running_sums(self.text)
        return self._running

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; run i starts at i. Fewer than k: none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + hashes[j : j + n]
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Which window starts keep all k words inside one document: indexes of words."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return runs(first[:-1], n)


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    at = np.cumsum(count) - count
    return np.arange(total) + np.repeat(begin - at, count)


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each document's positions are set."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def cover(n: int, begin: np.ndarray, length) -> np.ndarray:
    """Mask of n positions that lie in any [begin, begin + length)."""
    d = np.bincount(begin, minlength=n + 1) - np.bincount(begin + length, minlength=n + 1)
    return np.cumsum(d)[:n] > 0


def grouped_min(values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """Smallest value of each group [first[i], first[i+1]); ``empty`` for a group without values."""
    out = np.full(len(first) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(first) > 0)
    if len(has):
        out[has] = np.minimum.reduceat(values, first[has])
    return out


class Lookup:
    """Rows of a table by 64-bit key: entries sorted by mixed key, with a bucket index on the top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        at = np.argsort(h)
        self.h, self.values = np.append(h[at], np.uint64(2**64 - 1)), values[at]
        self.bits = max(8, int(2 * len(keys) + 1).bit_length())
        self.begin = np.searchsorted(h[at] >> np.uint64(64 - self.bits), np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it has none."""
        h = mix(keys)
        at = self.begin[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        go = np.flatnonzero(self.h[at] < h)
        while len(go):
            at[go] += 1
            go = go[self.h[at[go]] < h[go]]
        hit = (self.h[at] == h) & (at < len(self.values))
        at[~hit] = -1
        return at
