"""Quality rules with risk-controlled cutoffs.

Text statistics of each document give rule scores in thousandths; a document is rejected if any rule's score reaches its
cutoff. The cutoffs of a stratum (language) are certified on its labelled documents: the share of good documents that all
rules together reject is at most ``alpha``, with confidence 1 - ``delta`` for all strata together.

* The cutoffs lie on a path: steps that each lower one rule's cutoff, those first by which documents labelled bad are the
  most over-represented against unlabelled ones and an eighth of the good ones, by a hash of their ids. The other good
  documents have no say in the path, so they can test it.
* Steps are tested in order by the exact binomial tail of the good documents rejected so far by any rule, and testing
  stops at the first failure (fixed sequence: however many steps there are cost no level, and the union of the rules is
  tested as it is used). The level is split evenly over strata (Bonferroni).
* Strata with too few labels to certify anything share one stratum; if that has too few, it keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, discard, settle
from .textkit import Words, count_in, cover, mix, slices, span_hash, span_ids, window_starts, windows

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of each text: words are runs of non-blank characters; a line counts if it has a word; null is empty."""
    w = Words(texts, keep=True)
    n = len(texts)
    out = {"n_words": w.counts, "n_symbols": count_in(_symbol[w.text], w.offsets), "n_capitals": count_in(_capital[w.text], w.offsets)}
    out["word_chars"] = count_in(w.is_word & ((w.text & 0xC0) != 0x80), w.offsets)
    # Lines: from a document's start or behind a line feed, up to the next.
    cuts = np.flatnonzero(w.text == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], cuts + 1]))
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(w.text)), w.offsets[np.minimum(doc + 1, n)])
    ends = np.where((ends > starts) & (ends <= len(w.text)) & np.isin(ends - 1, cuts), ends - 1, ends)
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.ends, starts, "right")
    starts, ends, doc = starts[has], ends[has], doc[has]
    out["n_lines"] = np.bincount(doc, minlength=n)
    line, _ = span_ids(w.text, span_hash(w.running, starts, ends), starts, ends)
    pair = doc * (int(line.max(initial=0)) + 1) + line
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[np.unique(pair, return_index=True)[1]], minlength=n)
    # Windows of eight words seen twice or more in one document. Words are numbers that tell them apart for certain.
    word, _ = span_ids(w.text, w.hash, w.starts, w.ends)
    at = window_starts(w.first, 8)
    key = windows(mix(word.astype(np.uint64)), 8)[at] + mix(w.doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    if not ((w.doc[a] == w.doc[b]) & np.all([word[a + j] == word[b + j] for j in range(8)], axis=0)).all():  # a collision: by the words
        columns = [w.doc[at], *(word[at + j] for j in range(8))]
        order = np.lexsort(columns[::-1])
        same = np.all([c[order][1:] == c[order][:-1] for c in columns], axis=0)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out["n_repeat_words"] = count_in(cover(len(w.hash), at[twice], 8), w.first)
    return {k: out[k].astype(np.int64) for k in FEATURES}


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and FEATURES (long) of every row; rows with equal ids stay apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(found[k]) for k in FEATURES], [*keep, *FEATURES])

    bound_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{k} bigint" for k in FEATURES])
    return docs.select(*keep, "text").mapInArrow(run, schema)


#: Rule scores in thousandths, higher is worse.
RULES = {
    "symbols": "least(1000, 1000 * n_symbols div greatest(word_chars, 1))",
    "capitals": "least(1000, 1000 * n_capitals div greatest(word_chars, 1))",
    "duplicate_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeated_words": "1000 * n_repeat_words div greatest(n_words, 1)",
    "brevity": "1000 div greatest(n_words, 1)",
    "long_words": "least(1000, 20 * word_chars div greatest(n_words, 1))",
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly, as a regularised incomplete beta function."""
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 20_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + t / c
            c = c if abs(c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return min(1.0, front * total)


def choose_cutoff(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, level: float) -> int | None:
    """Of one rule alone: the lowest score from which to reject so that P(rejected | good) <= alpha is certified at
    ``level`` by a fixed sequence from the highest score down; None: none is.

    scores: distinct, ascending; good, bad: labelled documents with each score.
    """
    n, n_bad, k, caught, found = int(good.sum()), int(bad.sum()), 0, 0, None
    for i in range(len(scores) - 1, -1, -1):
        k, caught = k + int(good[i]), caught + int(bad[i])
        if scores[i] <= 0 or binomial_tail(k, n, alpha) > level:
            break
        if caught and caught * max(n, 1) > 2 * k * max(n_bad, 1):
            found = int(scores[i])
    return found


def needed(alpha: float, level: float) -> int:
    """Good labels from which on a rule set that rejects none of them is certified."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def upper_bound(k: int, n: int, level: float) -> float:
    """Largest rejection rate that k of n good documents rejected don't refute at ``level`` (exact)."""
    low, high = (k / n if n else 0.0), 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > level else (low, mid)
    return high


def path(rule: np.ndarray, score: np.ndarray, bad: np.ndarray, free: np.ndarray) -> list[tuple[str, int]]:
    """(rule, cutoff) steps of a stratum. bad, free: documents labelled bad, and for comparison, with that rule's score.

    A step's lift is the share of bad documents that its cutoff alone rejects over that of the others (of which one
    more is taken to be rejected). Steps with a lift of 2 or more follow each other by lift, then by bad documents.
    """
    steps = []
    for r in np.unique(rule).tolist():
        own = np.flatnonzero(rule == r)
        own = own[np.argsort(-score[own], kind="stable")]
        caught, hit = np.cumsum(bad[own]), np.cumsum(free[own])
        n_bad, n_free = max(int(caught[-1]), 1), int(hit[-1])
        for i, at in enumerate(own.tolist()):
            lift = (caught[i] / n_bad) / ((hit[i] + 1) / (n_free + 1))
            if score[at] > 0 and bad[at] and lift >= 2:
                steps.append((-lift, -int(caught[i]), r, int(score[at])))
    return [(r, s) for _, _, r, s in sorted(steps)]


def certified(good_by_step: dict[int, int], n: int, steps: int, alpha: float, level: float) -> tuple[int, int]:
    """(steps that hold, good documents they reject). good_by_step: good documents by the first step that rejects them."""
    k = held = at = 0
    for i in range(steps):
        k += good_by_step.get(i, 0)
        if binomial_tail(k, n, alpha) > level:
            break
        held, at = i + 1, k
    return held, at


def _scores() -> dict[str, Column]:
    return {k: F.expr(v).cast("int") for k, v in RULES.items()}


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float, delta: float) -> tuple[list[str], DataFrame]:
    """Strata that have cutoffs of their own, and (grp, bound, cut_<rule>...): the cutoffs of those and, as null, of all
    others together; null is also the stratum of documents without one.

    Labels with null quality and ids without a document count for nothing; a document with several labels counts with
    each. What is gathered is bounded by strata, rules and the 1,001 scores.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.sum((F.col("quality") > 0).cast("long")).alias("n_good"), F.sum((F.col("quality") <= 0).cast("long")).alias("n_bad"))
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 8 == 0, F.lit(True))
    free = F.isnull("n_good") | (part & (F.col("n_good") > 0))
    rows = features.where(~F.col("base_failed")).join(marked, "doc_id", "left")
    rows = rows.select("stratum", F.when(~part, F.col("n_good")).alias("n_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), free.cast("long").alias("free"), *[c.alias(k) for k, c in _scores().items()])
    rows = scored = settle(rows, "quality-scores")
    sizes = rows.where("n_good > 0").groupBy("stratum").agg(F.sum("n_good").alias("n"))
    large = sorted(((r["n"], r["stratum"]) for r in sizes.where(F.col("stratum").isNotNull() & (F.col("n") >= needed(alpha, delta / 2))).collect()), reverse=True)
    own: list[str] = []
    while len(own) < len(large) and large[len(own)][0] >= needed(alpha, delta / (len(own) + 2)):
        own.append(large[len(own)][1])
    level = delta / (len(own) + 1)
    rows = rows.withColumn("grp", F.when(F.col("stratum").isin(*own), F.col("stratum")) if own else F.lit(None).cast("string"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("score")) for k in RULES]))
    counts = rows.select("grp", "n_bad", "free", each.alias("r")).groupBy("grp", "r.rule", "r.score").agg(F.sum("n_bad").alias("bad"), F.sum("free").alias("free"))
    top = 1001

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        found = path(pdf.rule.to_numpy(str), pdf.score.to_numpy(), pdf.bad.to_numpy(), pdf.free.to_numpy())
        first = {r: np.full(top, len(found)) for r in RULES}  # by score, the first step that rejects it
        for i, (r, s) in enumerate(found):
            first[r][s:] = np.minimum(first[r][s:], i)
        return pd.DataFrame({"grp": pdf.grp[:1], "steps": [len(found)], "rules": [[r for r, _ in found]], "cuts": [[s for _, s in found]], **{f"at_{r}": [first[r]] for r in RULES}})

    kinds = ", ".join(f"at_{r} array<int>" for r in RULES)
    paths = settle(counts.groupBy("grp").applyInPandas(steps, f"grp string, steps int, rules array<string>, cuts array<int>, {kinds}"), "quality-paths")
    good = rows.where("n_good > 0").join(F.broadcast(paths.withColumnRenamed("grp", "g")), F.col("grp").eqNullSafe(F.col("g")))
    good = good.select("grp", "n_good", F.least(*[F.get(f"at_{r}", F.col(r)) for r in RULES]).alias("step")).groupBy("grp", "step").agg(F.sum("n_good").alias("n"))
    tested = good.withColumnRenamed("grp", "g").join(paths.select("grp", "steps", "rules", "cuts"), F.col("g").eqNullSafe(F.col("grp"))).drop("g")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n, names, cuts = int(pdf.n.sum()), list(pdf.rules.iloc[0]), list(pdf.cuts.iloc[0])
        held, k = certified(dict(zip(pdf.step, pdf.n, strict=True)), n, int(pdf.steps.iloc[0]), alpha, level)
        low = {r: min((c for x, c in zip(names[:held], cuts[:held], strict=True) if x == r), default=None) for r in RULES}
        return pd.DataFrame({"grp": pdf.grp[:1].to_numpy(), "bound": [upper_bound(k, n, level) if held else None], **{f"cut_{r}": pd.array([low[r]], "Int32") for r in RULES}})

    out = tested.groupBy("grp").applyInPandas(test, "grp string, bound double, " + ", ".join(f"cut_{r} int" for r in RULES))
    out = settle(out, "quality-cutoffs")
    for table in (scored, paths):
        discard(table)
    return own, out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Statistics, base_failed, rejected_by (rules, sorted), kept and false_rejection of every document row.

    false_rejection: the certified bound of the share of good documents that the rules reject in the document's stratum;
    null where there are no cutoffs. Null and empty texts have no words, so they fail the base rule (fewer than 20 words,
    or over 30 % of the words in repeated eight-word windows). No labels: no cutoffs, all that pass the base rule stay.
    Extra columns are ignored; repeated rows, and rows of one id, are judged apart, each with its own text.
    """
    docs = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    feats = statistics(docs, ("doc_id", "stratum")).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    feats = settle(feats, "quality-features")
    own, cut = cutoffs(feats, labels, alpha, delta)
    grp = F.when(F.col("stratum").isin(*own), F.col("stratum")) if own else F.lit(None).cast("string")
    out = feats.join(F.broadcast(cut), grp.eqNullSafe(F.col("grp")), "left")  # a row a stratum that has labels enough
    hit = F.filter(F.array(*[F.when(c >= F.col(f"cut_{k}"), F.lit(k)) for k, c in sorted(_scores().items())]), lambda x: x.isNotNull())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(hit))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select("doc_id", "stratum", *FEATURES, "base_failed", "rejected_by", "kept", F.col("bound").alias("false_rejection"))
