"""Near-duplicate classes by Order MinHash and banded alignment.

A document is its sequence of shingles (``SHINGLE`` words each; a shorter text is one shingle), every shingle labelled
with its occurrence number so that repeats count. Each of ``sketches`` hash functions samples the ``length`` smallest
labelled shingles and keeps them in text order: two texts agree in a sketch with a probability that follows their edit
similarity. Texts that agree in a sketch share a bucket.

* Equal texts are joined first, by digest; one text of each goes on.
* A bucket of any size yields candidates linear in its size: each member with the bucket's first and last member by
  digest and by length. They are found by pre-aggregated minima, so a hot bucket is never in one task.
* A candidate is a link if the banded alignment of the two shingle sequences has similarity ``SIMILARITY`` or more:
  matched / (n + m - matched), matched being the longest chain of equal labelled shingles in both orders whose diagonal
  stays in the band that this similarity allows. Pairs whose parity bits (``parity``) show too few common shingles for
  that are no links and are not aligned. First each text is aligned with the partner it shares most sketches
  with; of the remaining candidates those between different classes follow.
* Members of one bucket that are still in different classes may resemble each other and no centre (texts that share a
  long passage). They are put in order of their sketches, from each sketch on in turn, and aligned with the next texts of
  other classes (``_neighbours``). What may be left then is found exactly, by common shingles (``_missed``): nothing is
  lost in a bucket, whatever its size.
* Classes are connected components of links and equal texts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, discard, settle, whole_rows
from .textkit import ALNUM, LOWER, Words, grouped_min, mix, runs, slices, windows

SHINGLE, SIMILARITY, SKETCHES, LENGTH = 5, 0.8, 16, 2
#: Most digests (about 50 bytes each) that are broadcast to find their texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A shingle in more texts than this joins them by equal sequences of such shingles, not pair by pair.
COMMON = 32
_MAX = np.uint64(2**64 - 1)


def labelled_shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): occurrence-labelled shingle hashes of each text in text order; text i has first[i]:first[i+1]."""
    w = Words(texts, ALNUM, LOWER)
    n = len(w.counts)
    count = np.where(w.counts >= k, w.counts - k + 1, (w.counts > 0).astype(np.int64))
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    h = np.zeros(first[-1], np.uint64)
    long = w.counts >= k
    h[runs(first[:-1][long], count[long])] = windows(w.hash, k)[runs(w.first[:-1][long], count[long])] if long.any() else 0
    for d in np.flatnonzero(~long & (w.counts > 0)):
        h[first[d]] = windows(w.hash[w.first[d] : w.first[d + 1]], int(w.counts[d]))[0] + np.uint64(w.counts[d])
    # Occurrence numbers: equal hashes of one text, in text order.
    doc = np.repeat(np.arange(n), count)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    label = np.zeros(len(h), np.uint64)
    label[order] = nth.astype(np.uint64)
    return mix(h + label * np.uint64(0x9E3779B97F4A7C15)), first


def sketch(hashes: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """(texts, sketches) Order MinHash values; texts without shingles have rows of 0."""
    n = len(first) - 1
    out = np.zeros((n, sketches), np.int64)
    count = np.diff(first)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    doc = np.repeat(np.arange(n), count)
    for i in range(sketches):
        h = mix(hashes ^ np.uint64((i + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        picks = []
        for _ in range(length):
            low = grouped_min(h, first, _MAX)
            at = np.flatnonzero(h == low[doc])
            at = at[h[at] != _MAX]
            where = np.full(n, -1)
            where[doc[at[::-1]]] = at[::-1]
            picks.append(where)
            h[where[where >= 0]] = _MAX
        order = np.sort(np.stack(picks, 1), axis=1)  # -1: fewer shingles than ``length``
        value = np.full(n, i + 1, np.uint64)
        for j in range(length):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(order[:, j] >= 0, hashes[np.maximum(order[:, j], 0)], 0))
        out[has, i] = value[has].view(np.int64)
    return out


def parity(hashes: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Parity bits of each set of hashes, as 64-bit words: bit i is odd if an odd number of hashes has i for its low bits.

    A set has a power of two of bits, at least two a hash. Folded to one length (``_common``), bits that differ are at most
    the hashes that one of two sets has alone, as common ones cancel out.
    """
    count = np.diff(first)
    words = 2 ** np.ceil(np.log2(np.maximum(1, -(-count // 32)))).astype(np.int64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words, out=at[1:])
    out = np.zeros(at[-1], np.uint64)
    low = hashes.view(np.uint64) & np.repeat(words * 64 - 1, count).astype(np.uint64)
    np.bitwise_xor.at(out, np.repeat(at[:-1], count) + (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out.view(np.int64)))


def _common(n: str, m: str, x: str, y: str, least: float) -> Column:
    """Most hashes that sets of ``n`` and ``m`` with parity bits ``x`` and ``y`` can have in common. Null or any number if
    one set has less than ``least`` times the other's."""
    xor = lambda p, q: p.bitwiseXOR(q)
    words = F.least(F.size(x), F.size(y))

    def folded(z: Column) -> Column:
        for _ in range(math.ceil(math.log2(1 / least))):
            half = F.shiftright(F.size(z), 1)
            z = F.when(F.size(z) > words, F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), xor)).otherwise(z)
        return z

    apart = F.aggregate(F.zip_with(folded(F.col(x)), folded(F.col(y)), lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda total, d: total + d)
    return (F.col(n) + F.col(m) - apart) / 2


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled shingle sequences; 0 if it is below ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1  # unmatched shingles on both sides together
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    hit = np.flatnonzero(b[order][at] == a)
    to = order[at[hit]]
    near = np.abs(hit - to) <= band
    to = to[near]
    if len(to) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    if len(to) > 1 and (np.diff(to) < 0).any():
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        matched = len(tails)
    else:
        matched = len(to)
    found = matched / (n + m - matched)
    return found if found >= least - 1e-12 else 0.0


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _sketched(docs: DataFrame, sketches: int, length: int) -> DataFrame:
    """(doc_id, node, size, values, bits) of every row: digest, number of shingles, sketch and parity bits of its text; all
    null for null."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = labelled_shingles(part.column("text"))
            values = sketch(h, first, sketches, length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * sketches), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(np.diff(first).astype(np.int32)), lists, parity(h, first)], ["doc_id", "node", "size", "values", "bits"])

    return docs.select("doc_id", _digest().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, size int, values array<bigint>, bits array<bigint>")


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, shared): distinct pairs that share a bucket with one of its four centres, a < b, of compatible sizes."""
    me = F.struct("node", "size")
    by_size = F.struct("size", "node")
    centres = rows.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("c0"), F.max(me).alias("c1"), F.min(by_size).alias("c2"), F.max(by_size).alias("c3")).where("n > 1")
    centres = centres.select("i", "value", F.array_distinct(F.array(*[F.struct(F.col(f"c{k}.node").alias("node"), F.col(f"c{k}.size").alias("size")) for k in range(4)])).alias("centres"))
    pairs = rows.join(centres, ["i", "value"]).select("node", "size", F.explode("centres").alias("c"))
    fits = F.least("size", "c.size") >= F.greatest("size", "c.size") * least
    pairs = pairs.where((F.col("node") != F.col("c.node")) & fits)
    return pairs.groupBy(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): shingle sequences, as bytes, of the texts of ``wanted`` (n: digest, d: the doc_id to read it from)."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    marked = docs.where("text is not null").withColumn("node", _digest())
    held = marked.join(wanted, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("node", "text")

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = labelled_shingles(part.column("text"))
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([raw[8 * s : 8 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["node", "s"])

    return settle(held.mapInArrow(shingles, "node binary, s binary"), "neardup-shingles")


def _aligned_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b) of those pairs whose texts align with ``least`` similarity or more, written out."""
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    may = _common("na", "nb", "bits_a", "bits_b", least) >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = settle(pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").where(may).select("a", "da", "b", "db"), "neardup-likely")
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("n"), F.col(f"d{x}").alias("d")) for x in "ab"]))
    wanted = settle(pairs.select(ends.alias("end")).select("end.n", "end.d").distinct(), "neardup-wanted")
    held = _shingled(docs, wanted)
    both = pairs.select("a", "b").join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            ok = [aligned(np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64), least) > 0 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = settle(both.mapInArrow(verify, "a binary, b binary").distinct(), "neardup-links")
    discard(held)
    discard(wanted)
    discard(pairs)
    return links


def _open(distinct: DataFrame, label: DataFrame) -> DataFrame:
    """(node, doc_id, size, values, c) of the members of buckets that hold several classes and pairs that no centre is in.

    c: the member's class.
    """
    held = distinct.where("size > 0").join(label.toDF("l", "label"), F.col("node") == F.col("l"), "left").withColumn("c", F.xxhash64(F.coalesce("label", "node")))
    rows = held.select("node", "c", F.posexplode("values").alias("i", "value"))
    mixed = rows.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 3 and lo < hi")
    members = rows.join(mixed.select("i", "value"), ["i", "value"], "left_semi").select("node").distinct()
    return settle(held.select("node", "doc_id", "size", "values", "c").join(members, "node", "left_semi"), "neardup-open")


def _neighbours(members: DataFrame, least: float, near: int = 2) -> DataFrame:
    """(a, b) of texts of different classes that agree in a sketch and stand at most ``near`` places apart when all are in
    order of that sketch and then the others, from the next one on. Range partitions split buckets of any size; pairs
    over the edge of two partitions are not found here."""
    n = F.size("values")
    turned = F.concat(F.slice("values", F.col("r") + 1, n), F.slice("values", F.lit(1), F.col("r")))
    rows = members.withColumn("r", F.explode(F.sequence(F.lit(0), n - 1))).select("r", turned.alias("key"), "node", "size", "c")
    rows = rows.repartitionByRange("r", "key", "node").sortWithinPartitions("r", "key", "node").select("r", F.get("key", F.lit(0)).alias("v"), "node", "size", "c")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            r, v, c, size = (rows.column(x).to_numpy() for x in ("r", "v", "c", "size"))
            node, old = rows.column("node").combine_chunks(), 0 if last is None else last.num_rows
            for w in range(1, near + 1):
                b = np.arange(max(w, old), len(r))
                a = b - w
                ok = (r[a] == r[b]) & (v[a] == v[b]) & (c[a] != c[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a[ok])), node.take(pa.array(b[ok]))], ["a", "b"])
            last = rows.slice(max(0, len(r) - near)).combine_chunks().to_batches()[0] if len(r) else last

    pairs = rows.mapInArrow(run, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _missed(nodes: DataFrame, docs: DataFrame, least: float, common: int | None = None) -> DataFrame:
    """(a, b) of pairs of ``nodes`` that, if any pair of different classes is similar, connect its two texts.

    Similar texts have ``least`` of each one's shingles in common. So of a text's shingles that texts of other classes
    have too, rarest first, one of the first k - ``least`` * size + 1 of k is in the first ones of both; a text with less
    than ``least`` of such shingles has no partner. Texts with a common shingle of at most ``common`` (``COMMON``) texts
    are paired, if the parity bits of all these shingles allow for enough common ones. Similar texts without one share
    common shingles only: then those with the same sequence of common shingles and the smallest size is as near to either,
    and each text is paired with it alone, for its own sequence and for every one that ``_meeting`` finds for it.
    """
    common = COMMON if common is None else common
    held = _shingled(docs, nodes.select(F.col("node").alias("n"), F.col("doc_id").alias("d")))

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "s"):
            values = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("s")]
            of = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(np.concatenate(values))], [part.schema.names[0], "s"])

    seen = held.join(nodes.select("node", "c"), "node").select("c", "s").mapInArrow(single, "c bigint, s bigint")
    seen = seen.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    seen = settle(seen.select("s", "n"), "neardup-seen")
    shared = held.select("node", "s").mapInArrow(single, "node binary, s bigint").join(seen, "s").groupBy("node").agg(F.collect_list("s").alias("xs"), F.collect_list("n").alias("ns"))
    need = F.ceil(F.col("size") * least - 1e-9).cast("int")
    texts = shared.join(nodes.select("node", "size", "c", need.alias("need")), "node").where(F.size("xs") >= F.col("need")).join(held, "node")
    names = ["node", "size", "c", "k", "h", "g", "first", "hot", "bits", "hot_bits"]
    bits = lambda sets: parity(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "s"):
            rows = []
            for x, n, s, need in zip(*(part.column(c) for c in ("xs", "ns", "s")), part.column("need").to_pylist(), strict=True):
                x, n = x.values.to_numpy(), n.values.to_numpy()
                x, n = x[order := np.lexsort((x, n))], n[order]
                head, hot = x[: len(x) - need + 1], x[n > common]
                in_text = np.frombuffer(s.as_buffer(), np.int64)
                rows.append((len(x), len(hot), md5(in_text[np.isin(in_text, hot)].tobytes()).digest(), head[n[: len(head)] <= common], hot[: max(0, len(hot) - need + 1)], x, hot))
            k, h, g, first, hot, x, all_hot = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(k, pa.int32()), pa.array(h, pa.int32()), pa.array(g, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64())), bits(x), bits(all_hot)], names)

    texts = settle(texts.mapInArrow(ranked, "node binary, size int, c bigint, k int, h int, g binary, first array<bigint>, hot array<bigint>, bits array<bigint>, hot_bits array<bigint>"), "neardup-texts")
    discard(held)
    discard(seen)
    rare = texts.select("node", "size", "c", "k", "bits", F.explode("first").alias("s"))
    t = least / (1 + least) * (F.col("size") + F.col("size_b")) - 1e-9
    enough = (F.least("k", "k_b") >= t) & (_common("k", "k_b", "bits", "bits_b", least) >= t)
    near = rare.alias("x").hint("merge").join(rare.toDF("node_b", "size_b", "c_b", "k_b", "bits_b", "s").alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("c") != F.col("c_b")) & (F.col("node") < F.col("node_b")) & enough)
    hot = texts.where(F.size("hot") > 0).select("node", "size", "c", "h", "g", "hot", "hot_bits")
    groups = hot.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("size", "node", "c", "h", "hot", F.col("hot_bits").alias("bits"))).alias("r"))
    groups = settle(groups.select("g", "lo", "hi", "r.*"), "neardup-groups")
    ends = groups.select(F.col("g").alias("g_b"), F.col("node").alias("node_b"), F.col("size").alias("size_b"), F.col("c").alias("c_b"))
    ends = _meeting(groups, least).join(ends, "g_b")
    same = hot.drop("hot_bits").alias("x").join(ends.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("c") != F.col("c_b")) & (F.col("common") >= t))
    return near.select("node", "node_b").union(same.select("node", "node_b")).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def _meeting(groups: DataFrame, least: float) -> DataFrame:
    """(g, g_b, common) of groups of different classes whose smallest texts may be similar by common shingles, either way
    round, and of each group of several classes with itself. common: the most that they can have in common.

    Such a pair, b the smaller one, has t = part * (size + size_b) shingles in common, part being ``least`` /
    (1 + ``least``). So one of b's first h_b - t + 1 is among a's first h - t + 1: a looks for it by shingle and by steps
    of size that its own h allows; what it finds must be at such a place, be the first that both have, and have enough in
    common by parity bits. So a group of texts that are nearly, but not, similar makes no rows for its pairs.
    """
    part, step = least / (1 + least), math.log(1.03)
    up = lambda x: F.ceil(x - 1e-9).cast("int")
    level = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) / step).cast("int")
    head = lambda t: F.slice("hot", F.lit(1), F.greatest(F.col("h") - t + 1, F.lit(0)))
    mine = ["g", "lo", "hi", "size", "h", "bits"]
    each = lambda rows, t: rows.withColumn("hot", head(up(t))).select(*mine, "level", "hot", F.posexplode("hot").alias("i", "s")).withColumn("hot", F.slice("hot", F.lit(1), F.col("i")))
    small = each(groups.withColumn("level", level(F.col("size"))), 2 * part * F.col("size"))
    low, high = up(F.col("size") * least), F.least("size", F.floor(F.col("h") / part + 1e-9).cast("int") - F.col("size"))
    large = groups.where(low <= high).select(*mine, "hot", F.explode(F.sequence(level(low), level(high))).alias("level"))
    large = each(large, part * (F.col("size") + F.floor(F.exp(F.col("level") * step))))
    other = small.toDF("g_b", "lo_b", "hi_b", "size_b", "h_b", "bits_b", "level_b", "hot_b", "i_b", "s_b")
    mixed = ~((F.col("lo") == F.col("hi")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo") == F.col("lo_b")))
    t = part * (F.col("size") + F.col("size_b")) - 1e-9
    common = _common("h", "h_b", "bits", "bits_b", least)
    close = (F.col("h") - F.col("i") >= t) & (F.col("h_b") - F.col("i_b") >= t) & (common >= t) & ~F.arrays_overlap("hot", "hot_b")
    # Sizes are estimated from the groups' file, so Spark would broadcast what the explodes made of it.
    meet = large.hint("merge").join(other, (F.col("s") == F.col("s_b")) & (F.col("level") == F.col("level_b")) & mixed & close & (F.col("g") != F.col("g_b"))).select("g", "g_b", common.alias("common")).distinct()
    meet = settle(meet, "neardup-meet")
    own = groups.where("lo < hi").select("g", F.col("g").alias("g_b"), F.col("h").cast("double").alias("common"))
    return meet.union(meet.select("g_b", "g", "common")).union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each link's connected component, by label propagation with shortcuts.

    Each round takes the smallest label among neighbours, then follows labels one step, so the rounds grow with the
    logarithm of a component's width rather than with it; every round is written out.
    """
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "components-edges")
    state = settle(edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "components")
    while True:
        near = edges.join(state, edges.b == state.node).groupBy("a").agg(F.min("label").alias("least"))
        step = state.join(near, state.node == near.a).select("node", "label", F.least("label", "least").alias("new"))
        step = settle(step, "components-step")
        jump = step.select(F.col("node").alias("p"), F.col("new").alias("next"))
        new = settle(step.join(jump, step.new == jump.p).select("node", F.least("new", "next").alias("label"), "new", F.col("label").alias("old")), "components")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        state = new.select("node", "label")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links: only the labels that these join are looked at."""
    named = links.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left")
    named = settle(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "components-links")
    if named.isEmpty():
        return label
    now = components(named).toDF("l", "to")
    old = label.join(now, F.col("label") == F.col("l"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return settle(old.union(now.join(label, now.l == label.node, "left_anti")), "components-merged")


def classes(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, length: int = LENGTH) -> DataFrame:
    """(doc_id, node, class_id) of every document row; class_id is the smallest doc_id of its class.

    Equal texts share a class, the empty text too; texts without words have no other links. A null text is a class of
    its own row (class_id is its doc_id). Null ids count last when a class takes its id. Extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = settle(_sketched(docs, sketches, length), "neardup-sketches")
    ids = every.select("doc_id", "node")
    distinct = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(x).alias(x) for x in ("size", "values", "bits")])
    distinct = settle(distinct, "neardup-nodes")
    nodes = distinct.select("node", "doc_id", "size", "bits")
    rows = distinct.where("size > 0").select("node", "size", F.posexplode("values").alias("i", "value"))
    pairs = settle(_candidates(rows, least), "neardup-pairs")
    # First round: for each text, the partner with the most shared sketches.
    ends = pairs.select(F.col("a").alias("node"), F.struct(F.col("shared"), F.col("b").alias("other")).alias("p")).union(pairs.select("b", F.struct("shared", "a")))
    best = ends.groupBy("node").agg(F.max("p").alias("p"))
    best = settle(best.select(F.least("node", "p.other").alias("a"), F.greatest("node", "p.other").alias("b")).distinct(), "neardup-best")
    label = components(_aligned_pairs(best, docs, nodes, least))
    # Second round: what else could join two classes, by a centre or by neighbours in a bucket.
    rest = pairs.join(best, ["a", "b"], "left_anti").join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left")
    rest = rest.where(~(F.coalesce("la", "a") == F.coalesce("lb", "b"))).select("a", "b")
    left = _open(distinct, label)
    rest = settle(rest.union(_neighbours(left, least).join(pairs, ["a", "b"], "left_anti")), "neardup-rest")
    label = merged(label, _aligned_pairs(rest, docs, nodes, least))
    # Third round: all the others.
    left = _open(distinct, label)
    if not left.isEmpty():
        found = settle(_missed(left, docs, least).join(pairs.select("a", "b").union(rest), ["a", "b"], "left_anti"), "neardup-missed")
        label = merged(label, _aligned_pairs(found, docs, nodes, least))
    nodes = nodes.select("node", "doc_id")
    low = label.join(nodes, "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    linked = label.join(low, "label").select("node", "class_id")  # most texts are in no link
    named = nodes.join(linked, "node", "left").select(F.col("node").alias("n"), F.coalesce("class_id", "doc_id").alias("class_id"))
    named = settle(named, "neardup-named")  # so that Spark can split the rows of one text in the join
    return ids.join(named, ids.node == named.n, "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id and class_id of every document row."""
    return classes(docs, **how).select("doc_id", "class_id")


@whole_rows
def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns; null texts all stay.

    Of several rows with that id, one with the smallest text digest stays, whichever of equal rows that is. Text is moved
    once: rows are thinned to one for each id and text where they are read, and meet the chosen ones where that puts them.
    """
    found = settle(classes(docs, **how).where("node is not null"), "neardup-classes")
    key = lambda doc_id, node: F.concat(F.hex(node), F.coalesce(F.concat(F.lit("-"), doc_id.cast("string")), F.lit("")))
    chosen = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")).select(key(F.col("x.doc_id"), F.col("x.node")).alias("__key"))
    one = docs.where("text is not null").withColumn("__key", key(F.col("doc_id"), _digest())).dropDuplicates(["__key"])
    return one.join(chosen, "__key", "left_semi").select(*docs.columns).unionByName(docs.where("text is null"))
