"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its runs of non-blank bytes, each with one space before it if there is one, and the runs of what
blank bytes are left. The distinct pre-tokens of a slice of documents form a trie; for each node, that is for each
distinct prefix, the best segmentation is computed once, from those of shorter prefixes, and the number of its pieces is
kept. A document's count is the sum over its pre-tokens of the counts at their terminal nodes.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import bound_batches
from .textkit import NON_BLANK, SAME, SLICE_BYTES, Lookup, Words, running_sums, runs, slices, span_hash, span_ids


class Vocabulary:
    """Pieces (bytes) and their log probabilities. A byte that is no piece is one too, far below all others."""

    def __init__(self, pieces: dict[bytes, float]):
        if not pieces or b"" in pieces:
            raise ValueError("a vocabulary has pieces, none of them empty")
        unknown = min(pieces.values()) - 10.0
        pieces = {bytes([b]): unknown for b in range(256)} | pieces
        names = list(pieces)
        length = np.array([len(x) for x in names], np.int64)
        ends = np.cumsum(length)
        data = np.frombuffer(b"".join(names), np.uint8)
        self.lengths = np.unique(length).tolist()
        self.data, self.starts = data, ends - length
        self.scores = Lookup(span_hash(running_sums(data), ends - length, ends), np.arange(len(names)))
        self.values = np.array(list(pieces.values()))

    def rows(self, running: list[np.ndarray], text: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        """The piece that each span of ``size`` bytes up to ``ends`` is, -1 if none: found by hash, compared by bytes."""
        at = self.scores.rows(span_hash(running, ends - size, ends))
        row = np.where(at >= 0, self.scores.values[np.maximum(at, 0)], -1)
        hit = np.flatnonzero(row >= 0)
        for k in range(size):
            hit = hit[self.data[self.starts[row[hit]] + k] == text[ends[hit] - size + k]]
        out = np.full(len(ends), -1)
        out[hit] = row[hit]
        return out


def from_ranks(path: str) -> Vocabulary:
    """Vocabulary of a file of byte pieces and ranks: Zipf's law in the order of ranks, single bytes behind all others."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    order = sorted(ranks, key=lambda x: (len(x) == 1, ranks[x]))
    total = math.log(sum(1 / (i + 1) for i in range(len(order))))
    return Vocabulary({x: -math.log(i + 1) - total for i, x in enumerate(order)})


def pretokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of all pre-tokens, and each document's first."""
    n = len(w.text)
    starts = w.starts.copy()
    edge = np.zeros(n + 1, bool)
    edge[w.offsets] = True
    joined = (starts > 0) & ~edge[starts] & (w.text[np.maximum(starts - 1, 0)] == 32)
    starts[joined] -= 1
    edge[starts] = True
    edge[w.ends] = True
    cuts = np.flatnonzero(edge)
    return cuts[:-1], cuts[1:], np.searchsorted(cuts[:-1], w.offsets)


def best_counts(running: list[np.ndarray], text: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Pieces in the best segmentation of each span (highest score, then fewest pieces), through the spans' trie."""
    length = ends - starts
    if not len(starts):
        return np.zeros(0, np.int64)
    pos = runs(starts, length) + 1  # behind each byte of each span
    begin = np.repeat(starts, length)
    prefix = span_hash(running, begin, pos)
    _, rep, node_of = np.unique(prefix, return_index=True, return_inverse=True)
    # A prefix is told by the one before it and its last byte: if these agree in each node, its prefixes are equal.
    above = np.where(pos - begin > 1, np.append(0, node_of[:-1]), -1)
    if (above != above[rep][node_of]).any() or (text[pos - 1] != text[pos - 1][rep][node_of]).any():  # a collision
        raw = text.tobytes()
        _, rep, node_of = np.unique(np.array([raw[a:b] for a, b in zip(begin.tolist(), pos.tolist(), strict=True)], object), return_index=True, return_inverse=True)
    end, depth = pos[rep], (pos - begin)[rep]
    # Every piece that ends at a node: (node, node before the piece or -1 for the root, score).
    to, before, score = [], [], []
    for size in vocabulary.lengths:
        deep = np.flatnonzero(depth >= size)
        if not len(deep):
            break
        row = vocabulary.rows(running, text, end[deep], size)
        deep, row = deep[row >= 0], row[row >= 0]
        to.append(deep)
        before.append(np.where(depth[deep] > size, node_of[rep[deep] - size], -1))
        score.append(vocabulary.values[row])
    to, before, score = np.concatenate(to), np.concatenate(before), np.concatenate(score)
    order = np.lexsort((to, depth[to]))
    to, before, score = to[order], before[order], score[order]
    best, count = np.zeros(len(rep) + 1), np.zeros(len(rep) + 1, np.int64)  # the last entry is the root
    cut = np.searchsorted(depth[to], np.arange(1, depth.max() + 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        t, value, pieces = to[a:b], best[before[a:b]] + score[a:b], count[before[a:b]] + 1
        by = np.lexsort((-pieces, value, t))
        last = np.append(t[by][1:] != t[by][:-1], True)
        best[t[by][last]], count[t[by][last]] = value[by][last], pieces[by][last]
    return count[node_of[np.cumsum(length) - 1]]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, slice_bytes: int = 4 * SLICE_BYTES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document row; null and empty text have none. Extra columns are ignored.

    Repeated rows are counted each; of segmentations with equal scores the one of fewest pieces counts. A text of any
    length is taken whole, at least one a slice; a pre-token takes a numpy step a byte of the longest one of its slice.
    """
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=slice_bytes):
            w = Words(part.column("text"), NON_BLANK, SAME, hashed=False)
            starts, ends, first = pretokens(w)
            of, rep = span_ids(w.text, span_hash(w.running, starts, ends), starts, ends)
            counts = best_counts(w.running, w.text, starts[rep], ends[rep], known.value)[of]
            total = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
