"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``order`` with escape probabilities (method C: a context seen n times
with d distinct successors escapes with d / (n + d)). A text is scored with frozen statistics: its exact code length in
bits under each language's tree; the shortest wins. The trees are learnt from a bounded sample of labelled rows.

The code length of a byte depends on the ``order`` bytes before it alone, so it is tabulated for every such gram seen in
the sample, for all languages side by side, and a text costs one lookup a byte; grams never seen fall back an order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, whole_rows
from .textkit import LOWER, Lookup, buffers, slices

ORDER = 4
#: Most bytes of text a language's tree is learnt from, besides the last row taken.
SAMPLE_BYTES = 384 << 10
#: Most bytes of the tables, which every task holds: about a hundred languages at ``SAMPLE_BYTES`` of like text each.
MOST_BYTES = 1 << 30
#: Bits by which a document in a learnt language may exceed plain bytes.
SLACK_BITS = 128
UNKNOWN = "und"
_START = 10  # what stands before a text


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the lower-cased texts with the ``order`` bytes before it (line feeds before a text), as a number; offsets."""
    data, offsets = buffers(texts)
    n = len(data)
    data = LOWER[data].astype(np.uint64)
    key = data.copy()
    back = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)) if n else np.zeros(0, np.int64)
    for j in range(1, order + 1):
        prev = np.full(n, _START, np.uint64)
        prev[j:] = data[: n - j] if n > j else 0
        prev[back < j] = _START
        key |= prev << np.uint64(8 * j)
    return key, offsets


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


class Trees:
    """Frozen context trees of all languages. counts: (language number, order, gram, times seen), as arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs, self.order = langs, int(order.max()) if len(order) else -1
        if len(gram) * len(langs) * 4 > MOST_BYTES:  # a row of all languages for each gram
            raise ValueError(f"{len(langs)} languages with {len(gram)} grams need too large a table; merge labels or lower sample_bytes")
        self.grams: list[Lookup] = []
        self.escapes: list[Lookup] = []
        below_keys = below = None
        for k in range(self.order + 1):
            m = order == k
            lk, gk, nk = lang[m], gram[m], n[m].astype(np.float64)
            keys, at = np.unique(gk, return_inverse=True)
            ctx, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            seen = np.zeros((len(keys), len(langs)))
            seen[at, lk] = nk
            total, distinct = np.zeros((len(ctx), len(langs))), np.zeros((len(ctx), len(langs)))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            all_ = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, np.log2(np.maximum(distinct, 1) / all_), 0.0)
            shorter = np.full((len(keys), len(langs)), -8.0) if k == 0 else below[np.searchsorted(below_keys, keys & _mask(k - 1))]
            value = np.where(seen > 0, np.log2(np.maximum(seen, 1) / all_[of]), escape[of] + shorter)
            self.grams.append(Lookup(keys, value.astype(np.float32)))
            self.escapes.append(Lookup(ctx, escape.astype(np.float32)))
            below_keys, below = keys, value

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text under each language; bytes of each text."""
        key, offsets = grams(texts, self.order)
        lengths = np.diff(offsets)
        cost = np.zeros((len(lengths), len(self.langs)))
        if not len(key):
            return cost, lengths
        row = self.grams[-1].rows(key)
        lost = np.flatnonzero(row < 0)
        each = self.grams[-1].values[row]
        each[lost] = 0
        for k in range(self.order, -1, -1):
            if not len(lost):
                break
            if k < self.order:
                row = self.grams[k].rows(key[lost] & _mask(k))
                hit = row >= 0
                each[lost[hit]] += self.grams[k].values[row[hit]]
                lost = lost[~hit]
            row = self.escapes[k].rows((key[lost] & _mask(k)) >> np.uint64(8))
            hit = row >= 0
            each[lost[hit]] += self.escapes[k].values[row[hit]]
        each[lost] -= 8
        has = np.flatnonzero(lengths)
        cost[has] = -np.add.reduceat(each, offsets[has], axis=0, dtype=np.float64)
        return cost, lengths


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a Unicode letter; null has none."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def sample(labelled: DataFrame, most: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text): distinct texts of each language, in the order of a hash of the text, until ``most`` bytes are reached."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("key"))
    # First thin each language out to about twice the bound, so that only bounded rows are put in order.
    total = rows.groupBy("lang").agg(F.sum("size").alias("total"))
    part = (F.col("key").cast("double") / 2.0**63 + 1) / 2
    thin = rows.join(F.broadcast(total), "lang").where(part * F.col("total") <= 2.0 * most + (1 << 20)).dropDuplicates(["lang", "text"])
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1))
    return thin.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("lang", "text")


def learn(labelled: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Context trees of all languages among the rows' non-null ``lang``. Grams are counted in Spark over the sample."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = part.column("lang").to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                key, _ = grams(part.column("text").filter(pa.array(langs == lang)), order)
                for k in range(order + 1):
                    gram, n = np.unique(key & _mask(k), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "k", "gram", "n"])

    seen = sample(labelled, sample_bytes).mapInArrow(count, "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    t = seen.toArrow()  # at most (order + 1) rows for each sampled byte
    langs, lang = np.unique(t.column("lang").to_numpy().astype(str), return_inverse=True) if t.num_rows else (np.zeros(0, str), np.zeros(0, int))
    return Trees(langs.tolist(), lang, t.column("k").to_numpy(), t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy())


def identify(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and __lang, __score, __bits (a byte, under the winner) of every row, from its text alone.

    Text that is null or without a letter, or a model without languages, gives ``und`` and score 0. The score compares
    the winner with the others over the evidence of at most 64 bytes; ties go to the first language by name.
    """
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        names = np.array([*t.langs, UNKNOWN], object)
        for part in slices(batches):
            texts = part.column("text")
            if t.langs:
                cost, size = t.bits(texts)
                size = np.maximum(size, 1)
                best = cost.argmin(axis=1)
                low = cost[np.arange(len(best)), best]
                score = 1 / np.exp2((low[:, None] - cost) * np.minimum(1, 64 / size)[:, None]).sum(axis=1)
                ok = has_letter(texts)
                best, score, low = np.where(ok, best, len(t.langs)), np.where(ok, score, 0.0), low / size
            else:
                best, score, low = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(score), pa.array(low)], [*keep, "__lang", "__score", "__bits"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["__lang string, __score double, __bits double"])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows kept from training: crc32(doc_id as text) mod 4 is 2. A null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_split(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row, learnt from the rows that are not held out.

    Repeated rows get the same answer, each for its own text; extra columns are ignored; an empty table gives an empty one.
    """
    out = identify(docs.select("doc_id", "text"), learn(train_split(docs)))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits_per_byte"))


@whole_rows
def keep_known(docs: DataFrame) -> DataFrame:
    """Documents in one of the learnt languages, with all their columns.

    Rejected: text that is null or without a letter, and text whose code length under the best language's tree exceeds
    that of plain bytes (8 bits each) by more than ``SLACK_BITS``: no learnt language tells anything about it. Clean text
    takes 2 to 3 bits a byte; the slack lets short documents pass that hold little but numbers, names or keys. Repeated
    rows are judged alike; an empty table gives an empty one, and so does a model without languages.
    """
    found = identify(docs, learn(train_split(docs)), tuple(docs.columns))
    over = (F.col("__bits") - 8) * F.octet_length("text")
    return found.where((F.col("__lang") != UNKNOWN) & (over <= SLACK_BITS)).select(*docs.columns)
