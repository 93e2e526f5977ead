"""Exact nearest neighbours that leave most vectors unread: rows in cells around pivots, and bounds from the triangle
inequality.

``build`` deals the rows into cells, each row to its nearest pivot, and writes them sorted by cell and by distance to the
pivot, in small pages whose statistics Spark's reader knows. ``nearest`` measures the cells that are nearest to the query
until the filters have let enough rows through; the last of the best so far is a bound. A row can be nearer than the bound
only if its distance to its pivot differs from the query's by no more, and if the query is no farther from the planes that
part its cell from the others: the other pages are never opened. Where the cells don't give a bound, all rows are measured.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import search

#: Most rows that pivots are chosen from, by a hash of their ids, and most pivots; about as many rows to a cell.
SAMPLE_ROWS, MOST_PIVOTS, CELL_ROWS = 20_000, 1024, 500
#: Rows of a page, the least that is read.
PAGE_ROWS = 200


def choose(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres of a sample: far apart at first, then moved to the means of what is nearest to them."""
    centres = [sample[0]]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 0:
        centres.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    found = np.array(centres)
    for _ in range(rounds):
        cell, _ = cells(sample, found)
        for c in range(len(found)):
            if (mine := sample[cell == c]).size:
                found[c] = mine.mean(axis=0)
    return found


def cells(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot and its distance."""
    cell = ((pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T).argmin(axis=1)
    return cell, np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))


def build(rows: DataFrame, path: str, pivots: int | None = None) -> None:
    """Write the index of rows (id, vector and columns to filter or return) below ``path``. Rows without a vector are left
    out. Pivots come from a bounded sample, and every row is indexed. An empty table gives an empty index."""
    rows = rows.where("vector is not null")
    n = rows.count()
    share = max(1, n // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(share)) == 0).select("vector").limit(2 * SAMPLE_ROWS).collect()
    if not some:
        some = rows.select("vector").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["vector"] for r in some] or np.zeros((0, 1)), np.float64)
    centres = choose(sample, pivots or int(min(MOST_PIVOTS, max(1, n // CELL_ROWS)))) if len(sample) else sample
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(centres)

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cell, away = cells(np.stack(frame["vector"].to_numpy()).astype(np.float64), known.value)
                yield frame.assign(cell=cell.astype(np.int32), away=away)

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    placed = rows.mapInPandas(place, f"{kinds}, cell int, away double")
    placed = placed.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")
    placed.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
    centres_ = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    centres_.join(counts, "cell").coalesce(1).write.parquet(f"{path}/cells")  # a row a pivot


def nearest(spark: SparkSession, path: str, vector: list[float], limit: int = 10, repos: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """As ``search.nearest`` over the indexed rows that pass the filters."""
    rows, near, bounds = _bounded(spark, path, vector, limit, repos, languages)
    if near is not None:
        rows = rows.where(bounds)
    found = search.measured(rows, vector).orderBy("distance", "id").limit(limit)
    return found.drop("cell", "away").withColumn("score", search.score(F.col("distance")))


def rows_left(spark: SparkSession, path: str, vector: list[float], limit: int = 10, repos: list[str] | None = None, languages: list[str] | None = None) -> tuple[int, int]:
    """(rows that the bounds leave to be measured, rows that pass the filters) of a search."""
    rows, near, bounds = _bounded(spark, path, vector, limit, repos, languages)
    return (rows if near is None else rows.where(bounds)).count(), rows.count()


def _bounded(spark: SparkSession, path: str, vector: list[float], limit: int, repos: list[str] | None, languages: list[str] | None) -> tuple[DataFrame, float | None, Column | None]:
    """(rows that pass the filters, bound or None if there is none, what rows within it satisfy)."""
    rows = search.filtered(spark.read.parquet(f"{path}/rows"), repos, languages)
    found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    if not found:
        return rows, None, None
    centres, q = np.array([r["centre"] for r in found]), np.array(vector, np.float64)
    away = np.sqrt(((centres - q) ** 2).sum(axis=1))
    order = np.argsort(away, kind="stable")
    ahead = np.cumsum([found[c]["n"] for c in order])
    for most in (4 * limit, 40 * limit):  # enough rows, unless the filters let few through
        first = [found[c]["cell"] for c in order[: int(np.searchsorted(ahead, most)) + 1]]
        best = search.measured(rows.where(F.col("cell").isin(first)), vector).select("distance").orderBy("distance").limit(limit).collect()
        if len(best) == limit:
            break
    else:
        return rows, None, None
    scale = float(np.abs(centres).max(initial=0) + np.abs(q).max(initial=0))
    near = float(np.sqrt(best[-1]["distance"])) + 1e-9 * (1 + scale) * len(q) ** 0.5
    # How far the query lies from the plane between a cell and any other, where it is on the other's side.
    between = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 1e-300))
    beyond = ((away[:, None] ** 2 - away[None, :] ** 2) / (2 * between)).max(axis=1)
    keep = F.lit(False)
    for r, d, plane in zip(found, away.tolist(), beyond.tolist(), strict=True):
        if plane <= near and r["least"] <= d + near and r["most"] >= d - near:
            keep = keep | ((F.col("cell") == r["cell"]) & F.col("away").between(d - near, d + near))
    return rows, near, keep
