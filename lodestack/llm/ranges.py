"""Ranges of a sort key by sampled splitters, in DataFrame functions alone.

A key is a string whose byte order is the order that is wanted. Rows whose keys end in their place in the input
(``salted``) have no hot key: a group of equal rows of any size is cut where its share of the sample says.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys a range.
SAMPLED = 32
#: Most ranges: bounds the splitters, which go to the driver (SAMPLED times as many keys) and into the plan.
MOST_RANGES = 16_384


def salted(rows: DataFrame, name: str = "salt") -> DataFrame:
    """Rows with their place in the input, as a string of fixed width. Tasks that run again give it again, if they read
    their rows in the same order, as scans of files and of settled tables do."""
    return rows.withColumn(name, F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


def sortable(number: Column) -> Column:
    """A string whose byte order is that of a bigint, null first."""
    return F.when(number.isNull(), "0").when(number < 0, F.concat(F.lit("1"), F.hex(number))).otherwise(F.concat(F.lit("2"), F.lpad(F.hex(number), 16, "0")))


def splitters(rows: DataFrame, total: int, key: Column, weight: Column, ranges: int) -> list[str]:
    """Keys that cut salted rows into at most ``ranges`` ranges of about equal weight, from a sample of rows by a hash of
    their salt. total: how many rows there are."""
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2 or not total:
        return []
    some = rows.where(F.pmod(F.xxhash64("salt"), F.lit(max(1, total // (SAMPLED * ranges)))) == 0)
    return cuts(((r["key"], r["weight"]) for r in some.select(key.alias("key"), weight.alias("weight")).collect()), ranges)


def cuts(sample: Iterable[tuple[str, int]], ranges: int) -> list[str]:
    """Ascending distinct keys of a weighted sample that cut it into ``ranges`` of about equal weight."""
    keys = sorted(sample)
    whole, done, found = sum(w for _, w in keys), 0, []
    for key, w in keys:
        if done * ranges >= whole * (len(found) + 1) and (not found or key > found[-1]):
            found.append(key)
        done += w
    return found[: ranges - 1]


def range_of(key: Column, at: list[str]) -> Column:
    """How many of the ascending splitters are no greater than the key: a binary search in the plan."""
    if not at:
        return F.lit(0)
    known = F.split(F.lit("\n".join(at)), "\n")  # folded to one constant
    steps = F.array(*[F.lit(1 << k) for k in range(len(at).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(at)) & (F.get(known, n + step - 1) <= key), n + step).otherwise(n))


def numbered(rows: DataFrame, group: str, key: Column, range_rows: int = 100_000) -> DataFrame:
    """Rows with ``idx``, their place from 0 in the order of ``key`` within ``group``, and ``n``, how many the group has;
    rows of equal keys are in any order. No task sees more of a group than a range: places are counted in each range, and
    the rows of a group's earlier ranges are added.

    rows must be settled tables or cuts of these, as they are read several times; key and group must not be null.
    """
    rows = salted(rows)
    key = F.concat(key, F.lit("!"), F.col("salt"))
    total = rows.count()
    ranges = max(-(-total // range_rows), min(total // 1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = splitters(rows, total, F.concat(F.col(group), F.lit("!"), key), F.lit(1), ranges)
    ranged = rows.withColumn("range", range_of(F.concat(F.col(group), F.lit("!"), key), at)).withColumn("order", key)
    sizes = ranged.groupBy(group, "range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("of"), F.col("range").alias("part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"), F.sum("size").over(Window.partitionBy(group)).alias("n"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy(group, "range").orderBy("order")) - 1)
    found = placed.join(sizes, (F.col(group) == F.col("of")) & (F.col("range") == F.col("part")))
    return found.withColumn("idx", (F.col("ahead") + F.col("place")).cast("long")).drop("salt", "range", "order", "place", "of", "part", "ahead")
