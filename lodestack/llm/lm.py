"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by tasks.

Counting packs what a task has seen into sorted, pre-aggregated runs, one for each bucket of the hash space, and shuffles
the packed runs; one task merges the runs of one bucket and writes its sorted arrays to the model's folder. Buckets go by
the hash of the whole n-gram, so a frequent word's bigrams spread over all of them, and their number grows with the
corpus, so a task's share does not. The folder holds

* words-<bucket>.key / .count: hashes of the words in the bucket, sorted, and their counts; a word's id is its place
  over all buckets, so ids follow the hashes; after them come the ids of BEGIN, which stands before a text, and END;
* pairs-<bucket>.key / .count: mixed (previous id, id) pairs, sorted, and their counts;
* stats-<bucket>.cont / .one / .two / .more: by word id, the distinct words before it, and how many words follow it once,
  twice and more often.

Each task writes whole files under their final names in one rename, so repeated and lost tasks do no harm. The folder
must be mounted on all executors (a ``file:`` shared folder).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, local_path, new_path
from .textkit import LOWER, NON_BLANK, Words, mix, slices

#: Tokens whose counts a task holds before it packs them.
HELD = 1 << 21
#: Tokens of training text a bucket, about.
BUCKET_TOKENS = 3 << 20

_C1, _C2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def unmix(h: np.ndarray) -> np.ndarray:
    """What ``mix`` made h from."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(_C2, -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(_C1, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte planes, zstandard."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel().astype(np.int64)


def tally(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and each one's sums of the counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], *(np.add.reduceat(c[order], start) if len(start) else c[:0] for c in counts)


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket from batches sorted by bucket."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != at and rows:
                yield at, rows
                rows = []
            at = row["bucket"]
            rows.append(row)
    if rows:
        yield at, rows


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class _Runs:
    """Counts of keys, given out as packed runs by bucket once many are held."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.counts, self.held = bits, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(keys)

    def give(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, counts = tally(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.held = [], [], 0
        cut = np.searchsorted(_bucket(keys, self.bits), np.arange((1 << self.bits) + 1))
        rows = [(b, pack_sorted(keys[s:e]), pack_counts(counts[s:e])) for b, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if e > s]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])


def _store(folder: str, name: str, values: np.ndarray) -> None:
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    values.tofile(tmp)
    os.replace(tmp, f"{folder}/{name}")


_maps: dict[str, np.ndarray] = {}


def _mapped(path: str, kind: str) -> np.ndarray:
    found = _maps.get(path)
    if found is None:
        found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        _maps[path] = found
    return found


@dataclass
class Model:
    """Places and totals of a model's arrays; small, and sent to every task."""

    folder: str
    word_bits: int
    pair_bits: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first word id of each bucket, and their number
    documents: int = 0
    tokens: int = 0
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(5, np.int64))  # pairs; of those seen 1, 2, 3, 4 times
    cont_counts: np.ndarray = field(default_factory=lambda: np.zeros(5, np.int64))  # words; of those behind 1, 2, 3, 4 others

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def types(self) -> int:
        """Distinct tokens, END among them."""
        return self.words + (self.documents > 0)

    def array(self, name: str, bucket: int, kind: str = "<i8") -> np.ndarray:
        return _mapped(f"{self.folder}/{name.replace('*', str(bucket))}", kind)

    def _find(self, keys: np.ndarray, bits: int, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For ascending keys: bucket, which keys are in it, and where."""
        cut = np.searchsorted(_bucket(keys, bits), np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            have, mine = self.array(f"{name}-*.key", b, "<u8"), keys[cut[b] : cut[b + 1]]
            if len(have):
                at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
                ok = np.flatnonzero(have[at] == mine)
                yield b, cut[b] + ok, at[ok]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word id of each hash, -1 for words not in training."""
        keys, back = np.unique(hashes, return_inverse=True)
        found = np.full(len(keys), -1, np.int64)
        for b, which, at in self._find(keys, self.word_bits, "words"):
            found[which] = self.offsets[b] + at
        return found[back]

    def tokens_of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id before, id, first): every token with the one before it, documents one after the other; END closes each."""
        n = len(w.counts)
        first = w.first + np.arange(n + 1)
        token = np.full(len(w.hash) + n, self.words + 1, np.int64)
        place = np.ones(len(token), bool)
        place[first[1:] - 1] = False
        token[place] = self.ids(w.hash)
        before = np.concatenate([[0], token[:-1]])[: len(token)]
        before[first[:-1]] = self.words
        return before, token, first

    def by_id(self, ids: np.ndarray, names: list[str]) -> np.ndarray:
        """Columns ``names`` of ascending, distinct ids (unknown: -1, all 0)."""
        out = np.zeros((len(names), len(ids)), np.int64)
        edges = np.append(self.offsets, self.words + 2)
        cut = np.searchsorted(ids, edges)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            at = ids[cut[b] : cut[b + 1]] - edges[b]
            for i, name in enumerate(names):
                out[i, cut[b] : cut[b + 1]] = self.array(name, b)[at]
        return out

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        w = Words(texts, NON_BLANK, LOWER)
        before, token, first = self.tokens_of(w)
        ids, back = np.unique(np.concatenate([before, token]), return_inverse=True)
        count, cont, one, two, more = self.by_id(ids, ["words-*.count", "stats-*.cont", "stats-*.one", "stats-*.two", "stats-*.more"])
        v, t = back[: len(before)], back[len(before) :]
        pair = np.zeros(len(token), np.int64)
        both = np.flatnonzero((before >= 0) & (token >= 0))
        keys, again = np.unique(mix((before[both].astype(np.uint64) << np.uint64(32)) | token[both].astype(np.uint64)), return_inverse=True)
        seen = np.zeros(len(keys), np.int64)
        for b, which, at in self._find(keys, self.pair_bits, "pairs"):
            seen[which] = self.array("pairs-*.count", b, "<i8")[at]
        pair[both] = seen[again]
        # Interpolated: discounted pair, then discounted continuation, then uniform over all types and one unknown.
        d, e = discounts(self.pair_counts), discounts(self.cont_counts)
        total = max(int(self.pair_counts[0]), 1)
        rest = (e[1] * self.cont_counts[1] + e[2] * self.cont_counts[2] + e[3] * (self.cont_counts[0] - self.cont_counts[1] - self.cont_counts[2])) / total if self.pair_counts[0] else 1.0
        low = np.maximum(cont - e[np.minimum(cont, 3)], 0) / total + rest / (self.types + 1)
        follows = count.copy()
        follows[ids == self.words] = self.documents
        follows[ids == self.words + 1] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            backoff = np.where(follows > 0, (d[1] * one + d[2] * two + d[3] * more) / follows, 1.0)
            high = np.where(follows[v] > 0, np.maximum(pair - d[np.minimum(pair, 3)], 0) / follows[v], 0.0)
        p = np.log10(high + backoff[v] * low[t])
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))[t]
        cut = first[:-1]
        known = count[t] > 0
        return {"n_tokens": np.diff(first), "n_known": np.add.reduceat(known.astype(np.int64), cut), "base_score": np.add.reduceat(base, cut), "score": np.add.reduceat(p, cut)}


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more; where a count of counts is missing, 0.5, 1 and 1.5."""
    _, n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


def _count(texts: DataFrame, keys: Callable[[Words], np.ndarray], bits: int) -> DataFrame:
    """Packed runs of the keys of all texts, dealt out by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Runs(bits)
        for part in slices(batches):
            held.add(keys(Words(part.column("text"), NON_BLANK, LOWER)))
            if held.held >= HELD:
                yield from held.give()
        yield from held.give()

    return texts.select("text").mapInArrow(run, "bucket int, keys binary, counts binary").repartition(1 << bits, "bucket").sortWithinPartitions("bucket")


def train(texts: DataFrame) -> Model:
    """The model of all texts (column ``text``; null is an empty text), in a new folder of the shared folder."""
    spark = texts.sparkSession
    bound_batches(spark)
    folder = local_path(new_path(spark, "lm"))
    os.makedirs(folder)
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    # Words: at most one for every six bytes or so; buckets are powers of two.
    word_bits = max(0, int((size["b"] or 0) // 6 // BUCKET_TOKENS).bit_length())

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys, counts = tally(np.concatenate([unpack_sorted(r["keys"]) for r in rows]), np.concatenate([unpack_counts(r["counts"]) for r in rows]))
            _store(folder, f"words-{bucket}.key", keys.astype("<u8"))
            _store(folder, f"words-{bucket}.count", counts.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["bucket", "n", "total"])

    found = {r["bucket"]: r for r in _count(texts, lambda w: w.hash, word_bits).mapInArrow(words, "bucket int, n bigint, total bigint").collect()}
    for b in range(1 << word_bits):
        if b not in found:
            _store(folder, f"words-{b}.key", np.zeros(0, "<u8"))
            _store(folder, f"words-{b}.count", np.zeros(0, "<i8"))
    offsets = np.cumsum([0] + [found[b]["n"] if b in found else 0 for b in range(1 << word_bits)])
    if offsets[-1] + 2 >= 1 << 32:
        raise ValueError(f"{offsets[-1]} distinct words; pairs of ids hold 32 bits each")
    tokens = sum(r["total"] for r in found.values()) + size["n"]
    model = Model(folder, word_bits, int(tokens // BUCKET_TOKENS).bit_length(), offsets, size["n"], tokens)
    _store(folder, f"words-{1 << word_bits}.count", np.array([0, size["n"]], "<i8"))  # BEGIN is no token, END is one

    def pair_keys(w: Words) -> np.ndarray:
        before, token, _ = model.tokens_of(w)
        return mix((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a bucket's pairs; gives counts of counts and, by bucket of word id, what its pairs say of their words."""
        names = ["bucket", "ids", "cont", "one", "two", "more", "n"]
        edges = np.append(model.offsets, model.words + 2)
        for bucket, rows in _by_bucket(batches):
            keys, counts = tally(np.concatenate([unpack_sorted(r["keys"]) for r in rows]), np.concatenate([unpack_counts(r["counts"]) for r in rows]))
            _store(folder, f"pairs-{bucket}.key", keys.astype("<u8"))
            _store(folder, f"pairs-{bucket}.count", counts.astype("<i8"))
            n = np.array([len(counts), *((counts == k).sum() for k in (1, 2, 3, 4))])
            plain = unmix(keys)
            zero, one = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
            before, token = plain >> np.uint64(32), plain & np.uint64(0xFFFFFFFF)
            ids, cont, c1, c2, c3 = tally(
                np.concatenate([token, before]), np.append(one, zero), np.append(zero, counts == 1), np.append(zero, counts == 2), np.append(zero, counts > 2)
            )
            cut = np.searchsorted(ids, edges.astype(np.uint64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[b], cut[b + 1])
                blobs = [pack_sorted(ids[s]), *(pack_counts(c[s]) for c in (cont, c1, c2, c3))]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([None], pa.list_(pa.int64()))], names)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([None], pa.binary()) for _ in range(5)), pa.array([n.tolist()], pa.list_(pa.int64()))], names)

    def stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.append(model.offsets, model.words + 2)
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                n = np.sum([r["n"] for r in rows], axis=0)
            else:
                sums = {k: np.zeros(int(edges[bucket + 1] - edges[bucket]), np.int64) for k in ("cont", "one", "two", "more")}
                for r in rows:
                    at = unpack_sorted(r["ids"]).astype(np.int64) - edges[bucket]
                    for k in sums:
                        sums[k][at] += unpack_counts(r[k])
                for k, x in sums.items():
                    _store(folder, f"stats-{bucket}.{k}", x.astype("<i8"))
                cont = sums["cont"]
                n = np.array([(cont > 0).sum(), *((cont == k).sum() for k in (1, 2, 3, 4))])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n.tolist()], pa.list_(pa.int64()))], ["bucket", "n"])

    said = _count(texts, pair_keys, model.pair_bits).mapInArrow(pairs, "bucket int, ids binary, cont binary, one binary, two binary, more binary, n array<bigint>")
    said = said.repartition((1 << word_bits) + 1, "bucket").sortWithinPartitions("bucket").mapInArrow(stats, "bucket int, n array<bigint>").collect()
    there = {r["bucket"] for r in said}
    for r in said:
        if r["bucket"] < 0:
            model.pair_counts = model.pair_counts + np.array(r["n"])
        else:
            model.cont_counts = model.cont_counts + np.array(r["n"])
    edges = np.append(model.offsets, model.words + 2)
    for b in sorted(set(range((1 << word_bits) + 1)) - there):
        for k in ("cont", "one", "two", "more"):
            _store(folder, f"stats-{b}.{k}", np.zeros(int(edges[b + 1] - edges[b]), "<i8"))
    have = set(os.listdir(folder))
    for b in range(1 << model.pair_bits):
        if f"pairs-{b}.key" not in have:
            _store(folder, f"pairs-{b}.key", np.zeros(0, "<u8"))
            _store(folder, f"pairs-{b}.count", np.zeros(0, "<i8"))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every row; null text is empty and has END alone."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = known.value.score(part.column("text"))
            s["perplexity"] = 10 ** np.minimum(-s["score"] / s["n_tokens"], 300)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in s.values())], ["doc_id", *s])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def held_out() -> Column:
    """Rows kept from training: crc32(doc_id as text) mod 5 is 1. A null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row under a model of the
    rows that are not held out. Extra columns are ignored."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
