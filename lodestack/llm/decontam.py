"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` consecutive words. The alphabet is words: a block is two words. A
shift table, indexed by the hash of the block under the window's end, tells how far the search may jump; where it says 0,
the block's bucket lists the patterns that end in it, and these are compared with the text, word hashes first and then
the bytes. Many places of many documents move in step, so that each step is a few numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, settle, whole_rows
from .textkit import ALNUM, LOWER, Words, cover, mix, parts, runs, slices

#: Most bytes of benchmark text that one pass searches for; more text takes more passes.
BLOCK_BYTES = 8 << 20
#: Most pairs of a place in the text and a pattern that are compared at once.
MOST_PAIRS = 1 << 20
_LANE = 256
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class Patterns:
    """Windows of one block of benchmark items, with the tables to search for them.

    All is in flat arrays: the items' lower-cased bytes, their words (starts, ends, hashes), each distinct window's first
    word and length, and the items that have it (``owner``[``owned``[p] : ``owned``[p + 1]]). Windows shorter than
    ``window`` (whole short items) have tables of their own, lest they shorten the jumps of the others. An item without
    an id has windows, but no name.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = 10):
        self.items = [x[0] for x in items]
        w = Words(pa.array([x[1] for x in items], pa.string()), ALNUM, LOWER)
        self.raw, self.starts, self.ends, self.hash = w.text.tobytes(), w.starts.astype(np.int32), w.ends.astype(np.int32), w.hash
        count = np.where(w.counts >= window, w.counts - window + 1, (w.counts > 0).astype(np.int64))
        first, item = runs(w.first[:-1], count), np.repeat(np.arange(len(items), dtype=np.int32), count)
        length = np.minimum(w.counts, window)[item].astype(np.int32)
        key = self._keys(first, length)
        _, rep, of = np.unique(key, return_index=True, return_inverse=True)
        # Windows that differ from the first of their hash are patterns of their own.
        other = length != length[rep][of]
        for j in range(window):
            at = np.flatnonzero(~other & (j < length))
            other[at] |= self.hash[first[at] + j] != self.hash[first[rep[of[at]]] + j]
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(other).tolist():
            of[i] = extra.setdefault(self.hash[first[i] : first[i] + length[i]].tobytes(), len(rep) + len(extra))
        rep = np.concatenate([rep, [np.flatnonzero(of == p)[0] for p in extra.values()]]).astype(np.int64)
        self.first, self.length = first[rep].astype(np.int32), length[rep]
        pair = np.unique(of.astype(np.int64) * max(len(items), 1) + item)
        self.owner = (pair % max(len(items), 1)).astype(np.int32)
        self.owned = np.searchsorted(pair // max(len(items), 1), np.arange(len(rep) + 1)).astype(np.int32)
        self.groups = [_Tables(np.flatnonzero(m), self) for m in (self.length == window, self.length < window) if m.any()]

    def _keys(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of each window."""
        key = length.astype(np.uint64)
        for j in range(int(length.max()) if len(length) else 0):
            at = np.flatnonzero(j < length)
            key[at] = mix(key[at] * _Q + self.hash[first[at] + j])
        return key

    def bytes_of(self, p: int) -> bytes:
        a = self.first[p]
        words = slice(a, a + self.length[p])
        return b" ".join([self.raw[s:e] for s, e in zip(self.starts[words].tolist(), self.ends[words].tolist(), strict=True)])

    def names(self, patterns: Iterable[int]) -> set[str]:
        """Ids of the items that have any of the windows."""
        return {self.items[i] for p in patterns for i in self.owner[self.owned[p] : self.owned[p + 1]].tolist()} - {None}

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first word, words) of all occurrences inside documents."""
        found = [g.search(w, self) for g in self.groups]
        at, pattern, length = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        raw = w.text.tobytes() if len(at) else b""
        same = np.zeros(len(at), bool)
        for i, (a, p, n) in enumerate(zip(at.tolist(), pattern.tolist(), length.tolist(), strict=True)):
            same[i] = b" ".join([raw[s:e] for s, e in zip(w.starts[a : a + n].tolist(), w.ends[a : a + n].tolist(), strict=True)]) == self.bytes_of(p)
        return pattern[same], at[same], length[same]


class _Tables:
    """Shift table and suffix buckets of patterns of like length. The shift table has at most 2 ** 26 entries of a byte."""

    def __init__(self, which: np.ndarray, p: Patterns):
        self.m = m = int(p.length[which].min())
        self.block = b = min(2, m)
        self.most = m - b + 1
        self.bits = min(26, max(10, int(len(which) * self.most * 8).bit_length()))
        self.shift = np.full(1 << self.bits, self.most, np.int8 if self.most < 128 else np.int32)
        first = p.first[which].astype(np.int64)
        for j in range(b, m + 1):
            np.minimum.at(self.shift, self.index(p.hash[first + j - b], p.hash[first + j - 1]) >> np.uint64(64 - self.bits), m - j)
        self.small = min(self.bits, max(10, len(which).bit_length()))
        bucket = self.index(p.hash[first + m - b], p.hash[first + m - 1]) >> np.uint64(64 - self.small)
        # Entries lie by bucket, and in each by a hash of the window's first block: of a hot bucket only those are looked at
        # that also begin as the text does.
        key = self.entry(bucket, self.index(p.hash[first], p.hash[first + b - 1]))
        order = np.argsort(key, kind="stable")
        self.ids, self.keys = which[order].astype(np.int32), key[order]

    def index(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of blocks of two words, or of one."""
        return mix(last if self.block == 1 else before * _Q + last)

    def entry(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return bucket.astype(np.uint64) << np.uint64(64 - self.small) | first >> np.uint64(self.small)

    def search(self, w: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, none = self.m, np.zeros(0, np.int64)
        ends = np.maximum(w.counts - m + 1, 0)  # places where a window may end, by document
        lanes = -(-ends // _LANE)
        if not lanes.sum():
            return none, none, none
        doc = np.repeat(np.arange(len(lanes)), lanes)
        nth = runs(np.zeros(len(lanes), np.int64), lanes)
        at = w.first[doc] + m - 1 + nth * _LANE
        stop = np.minimum(at + _LANE, w.first[doc + 1])
        prev = np.concatenate([w.hash[:1], w.hash[:-1]])
        hits = []
        while len(at):
            h = self.index(prev[at], w.hash[at])
            jump = self.shift[h >> np.uint64(64 - self.bits)].astype(np.int64)
            zero = jump == 0
            if zero.any():
                hits.append((at[zero], (h[zero] >> np.uint64(64 - self.small)).astype(np.int64)))
            at = at + np.maximum(jump, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        if not hits:
            return none, none, none
        at, bucket = (np.concatenate([h[i] for h in hits]) for i in range(2))
        begin = at - m + 1
        key = self.entry(bucket, self.index(w.hash[begin], w.hash[begin + self.block - 1]))
        low = np.searchsorted(self.keys, key)
        n = np.searchsorted(self.keys, key, "right") - low
        found = [self._compared(begin[i:j], low[i:j], n[i:j], w, p) for i, j in parts(n, MOST_PAIRS)]
        return tuple(np.concatenate([f[i] for f in found]) if found else none for i in range(3))

    def _compared(self, begin: np.ndarray, low: np.ndarray, n: np.ndarray, w: Words, p: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, pattern, words) where a pattern of the entries low, low + 1, ... has the text's word hashes."""
        pattern, begin = self.ids[runs(low, n)].astype(np.int64), np.repeat(begin, n)
        length = p.length[pattern].astype(np.int64)
        room = w.first[np.searchsorted(w.first, begin, "right")] - begin
        ok = length <= room
        for j in range(int(length.max()) if len(length) else 0):
            i = np.flatnonzero(ok & (j < length))
            ok[i] = w.hash[begin[i] + j] == p.hash[p.first[pattern[i]] + j]
        return begin[ok], pattern[ok], length[ok]


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[Patterns]]:
    """The benchmark in blocks of about ``block_bytes``, fetched one at a time, and their number. Null texts have no
    windows."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))

    def fetch() -> Iterator[Patterns]:
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield Patterns([(r.item_id, r.text) for r in part.sort("item_id", "text").collect()], window)

    return n, fetch()


def _found(patterns: Patterns, part: pa.RecordBatch) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
    """Words of each document; the hit words (a mask) and item ids of those with any."""
    w = Words(part.column("text"), ALNUM, LOWER)
    pattern, at, length = patterns.search(w)
    hit = cover(len(w.hash), at, length)
    doc = np.searchsorted(w.first, at, "right") - 1
    return w.counts.astype(np.int64), {d: (hit[w.first[d] : w.first[d + 1]], patterns.names(np.unique(pattern[doc == d]).tolist())) for d in np.unique(doc).tolist()}


_MARKS = "__words bigint, __hits bigint, __items array<string>"


def _mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int, block_bytes: int) -> DataFrame:
    """``keep`` columns and __words, __hits, __items of every document row."""
    bound_batches(docs.sparkSession)
    n, passes = _blocks(benchmark, window, block_bytes)
    if n > 1:
        return _mark_by_text(docs, passes, keep)
    kinds, known = dict(docs.dtypes), docs.sparkSession.sparkContext.broadcast(next(passes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, found = _found(known.value, part)
            hits = [int(found[d][0].sum()) if d in found else 0 for d in range(part.num_rows)]
            items = [sorted(found[d][1]) if d in found else [] for d in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(words), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))], [*keep, "__words", "__hits", "__items"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [_MARKS]))


def _mark_by_text(docs: DataFrame, passes: Iterator[Patterns], keep: list[str]) -> DataFrame:
    """As ``_mark``, for several blocks: what each finds is kept for the texts it finds something in, by their digests,
    and joined to the documents at the end."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    texts, found = docs.where("text is not null").select(digest.alias("__digest"), "text"), None
    for patterns in passes:
        known = docs.sparkSession.sparkContext.broadcast(patterns)

        def run(batches: Iterable[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                _, hits = _found(known.value, part)
                at = sorted(hits)
                columns = [part.column("__digest").take(pa.array(at, pa.int64())), pa.array([np.packbits(hits[d][0]).tobytes() for d in at], pa.binary()), pa.array([sorted(hits[d][1]) for d in at], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["__digest", "bits", "items"])

        part = settle(texts.mapInArrow(run, "__digest binary, bits binary, items array<string>").dropDuplicates(["__digest"]), "decontam")
        known.unpersist()
        found = part if found is None else found.unionByName(part)
    each = found.groupBy("__digest").agg(F.collect_list("bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hits = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in row])).sum()) for row in part.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("__digest"), pa.array(hits, pa.int64()), part.column("__items")], ["__d", "__hits", "__items"])

    marks = settle(each.mapInArrow(count, "__d binary, __hits bigint, __items array<string>"), "decontam")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = docs.select(*keep, digest.alias("__digest"), words.alias("__words"))
    return rows.join(marks, F.col("__digest") == F.col("__d"), "left").select(*keep, "__words", F.coalesce("__hits", F.lit(0)).alias("__hits"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), items_sha256 and contaminated of every document row.

    A document of null text or without words is clean; so is everything if the benchmark is empty. Words of an item
    without an id are hit, but count for no item. Rows with equal ids are judged apart; other columns are ignored. The
    patterns of a block are broadcast: ``block_bytes`` bounds them to about 25 times as much (an item is never cut); each
    further block is one more pass over the documents.
    """
    found = _mark(docs, benchmark, ["doc_id"], window, block_bytes)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hits").alias("n_hit"),
        F.col("__items").alias("items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.col("__hits") > 0).alias("contaminated"),
    )


@whole_rows
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, with all their columns."""
    return _mark(docs, benchmark, docs.columns, window, block_bytes).where("__hits = 0").select(*docs.columns)
