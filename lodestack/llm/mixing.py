"""Mixing sources to target word counts with cube-method balanced sampling.

A source whose target is r times its size is taken floor(r) times whole; of its documents, a sample with inclusion
probability r - floor(r) is taken once more. The cube method draws that sample so that its words and its documents
balance: in blocks of documents, probabilities move along the null space of the balancing constraints until all but a
few are 0 or 1 (flight). What stays fractional in the blocks flies again together, level by level, until one small
block of a source is left, whose last few documents are landed by giving up constraints.

Every draw comes from a hash of the block and its documents, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle, whole_rows

#: Documents that fly together.
BLOCK = 2048


def word_count(text: str = "text") -> Column:
    """Words (runs of non-blank characters) of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")), F.lit(0)).cast("long")


def flight(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p (strictly between 0 and 1) until no move keeps the sums of the balancing rows x.T @ p; at most as many
    entries as x has columns stay fractional. Each move's expected change is 0."""
    p = p.copy()
    n, q = x.shape
    live = list(range(min(q + 1, n)))
    rest = iter(range(len(live), n))
    while len(live) > q or (len(live) > 1 and np.linalg.matrix_rank(x[live]) < len(live)):
        u = _null(x[live])
        if u is None:
            break
        v = p[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - v) / u, np.where(u < 0, -v / u, np.inf)).min()
            down = np.where(u > 0, v / u, np.where(u < 0, (v - 1) / u, np.inf)).min()
        v = v + up * u if rng.random() * (up + down) < down else v - down * u
        v[v < 1e-9], v[v > 1 - 1e-9] = 0, 1
        p[live] = v
        live = [i for i in live if 0 < p[i] < 1]
        while len(live) < q + 1 and (i := next(rest, None)) is not None:
            live.append(i)
    return p


def _null(a: np.ndarray) -> np.ndarray | None:
    """A vector u with a.T @ u = 0, by elimination; None if there is none."""
    n, q = a.shape
    m = a.T.astype(float).copy()
    scale = np.abs(m).max(axis=1, keepdims=True)
    m /= np.where(scale > 0, scale, 1)
    pivots: list[int] = []
    r = 0
    for c in range(n):
        if r == q:
            break
        k = r + int(np.abs(m[r:, c]).argmax())
        if abs(m[k, c]) < 1e-9:
            continue
        m[[r, k]] = m[[k, r]]
        m[r] /= m[r, c]
        for i in range(q):
            if i != r:
                m[i] -= m[i, c] * m[r]
        pivots.append(c)
        r += 1
    free = [c for c in range(n) if c not in pivots]
    if not free:
        return None
    u = np.zeros(n)
    u[free[0]] = 1
    for i, c in enumerate(pivots):
        u[c] = -m[i, free[0]]
    return u


def land(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle the last fractional entries: fly on with ever fewer balancing columns (the last given up first), and
    choose the last one by its probability."""
    for q in range(x.shape[1], 0, -1):
        at = np.flatnonzero((p > 0) & (p < 1))
        if len(at):
            p[at] = flight(x[at, :q], p[at], rng)
    at = np.flatnonzero((p > 0) & (p < 1))
    p[at] = rng.random(len(at)) < p[at]
    return p


def _flight(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _fly(pdf, last)


def _fly(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "size", "doc"], na_position="first").reset_index(drop=True)
    rng = np.random.default_rng([int(x) & 0xFFFFFFFFFFFFFFFF for x in (pdf.key.iloc[0], pdf.key.iloc[-1], len(pdf))])
    x = np.stack([pdf["size"] * pdf.n, pdf.n], 1).astype(float)
    p = flight(x, pdf.p.to_numpy(float), rng)
    return pdf.assign(p=land(x, p, rng) if last else p)


def targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of every source, null among them.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` times all words. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until none is above. The table of
    sources is numbered by range partitions and their counts, so no task sees all of them.
    """
    by = settle(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    ranked = by.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id())
    ranked = settle(ranked.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("none", "source")) - 1), "mix-ranks")
    counts = ranked.groupBy("part").count().collect()  # one row a partition
    ahead, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets.append(F.when(F.col("part") == r["part"], F.lit(ahead)))
        ahead += r["count"]
    rank = F.col("nth") + F.coalesce(*offsets, F.lit(0))
    by = settle(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight")), "mix-weights")
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:  # each round caps at least one more source
        s = by.agg(F.sum(F.when(F.col("weight") * rate > F.col("source_size") * most, F.col("source_size") * most)).alias("held"), F.sum(F.when(~(F.col("weight") * rate > F.col("source_size") * most), F.col("weight"))).alias("w")).first()
        new = (total - (s["held"] or 0.0)) / s["w"] if s["w"] else rate
        if not new > rate * (1 + 1e-12):
            break
        rate = new
    return by.select("source", "source_size", F.least(F.col("weight") * rate, F.col("source_size") * most).alias("target"))


def mix(docs: DataFrame, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """``keep`` columns and __size, __source_size, __target, __times (copies of the row that the mix takes) of every row.

    Null text has size 0; such rows, and rows of a source with target 0, are taken as their source's ratio says but add
    no words. Rows that are equal in id, source and size are drawn together. An empty table gives an empty result.
    """
    rows = docs.select(*keep, F.col("source").cast("string").alias("__source"), F.col("doc_id").cast("string").alias("__doc"), word_count().alias("__size"))
    if "text" not in keep:
        rows = settle(rows, "mix-sizes")
    units = rows.groupBy(F.col("__source").alias("source"), F.col("__doc").alias("doc"), F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    units = settle(units, "mix-units")
    plan = targets(units.select("source", F.expr("size * n").alias("size")), **how)
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("source", "s")
    plan = plan.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = settle(plan.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.floor("ratio")).withColumnRenamed("source", "plan_source"), "mix-plan")
    on = F.col("source").eqNullSafe(F.col("plan_source"))
    left = units.join(plan, on).where("p > 0").select("source", "doc", "size", "n", "p", "docs", F.xxhash64("doc", "size", "source").alias("key"))
    done, most = None, plan.agg(F.max("docs")).first()[0] or 0
    while True:
        last = most <= block
        # Blocks of a source by hash, half of ``block`` units each on average; a source's whole rest on the last level.
        number = F.lit(0) if last else F.pmod(F.xxhash64("key", F.lit(most)), F.ceil(F.col("docs") * 2 / block))
        left = left.withColumn("b", number.cast("long"))
        flown = settle(left.groupBy("source", "b").applyInPandas(_flight(last), left.schema).drop("b"), "mix-flight")
        fixed = flown.where("p = 1").select(F.col("source").alias("s"), F.col("doc").alias("d"), F.col("size").alias("z"))
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        left = flown.where("p > 0 and p < 1").drop("docs")
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("source", "s")
        left = settle(left.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-left")
        most = left.agg(F.max("docs")).first()[0] or 0
    taken = units.join(plan, on).join(
        done.withColumn("extra", F.lit(1)), F.col("source").eqNullSafe(F.col("s")) & F.col("doc").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")), "left"
    )
    times = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("__times")
    taken = taken.select(F.col("source").alias("__t_source"), F.col("doc").alias("__t_doc"), F.col("size").alias("__t_size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), times)
    same = F.col("__source").eqNullSafe(F.col("__t_source")) & F.col("__doc").eqNullSafe(F.col("__t_doc")) & (F.col("__size") == F.col("__t_size"))
    return rows.join(taken, same).select(*keep, "__size", "__source_size", "__target", "__times")


def plan_mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) of every document row."""
    out = mix(docs.select("doc_id", "text", "source"), **how)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"))


@whole_rows
def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with all its columns."""
    out = mix(docs, keep=tuple(docs.columns), **how).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
