"""Exact duplicates by a content sort, in DataFrame functions alone.

Rows are dealt into ranges of their normalised bytes by sampled splitters, sorted in each range, and compared with the row
before them, byte by byte; equal neighbours are a run. A splitter is the text's first bytes, its SHA-256 and the row's
place in the input, so it is short however long the text is, and a group of copies that is larger than a range is cut
into several. Its runs meet afterwards: only the first and the last row of each range carry their text on, and those that
are equal are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import MOST_RANGES, range_of, salted, splitters
from .store import settle

#: Bytes of a range, about.
RANGE_BYTES = 16 << 20
#: What a row weighs besides its text.
ROW_BYTES = 64
#: Bytes of a text that lead its key.
LEAD = 16


def duplicates(docs: DataFrame, largest: bool = True, normalise=lambda text: text, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: the id of the row that stays of all with the same text,
    and how many have it.

    largest: the row with the largest id stays, else the one with the smallest; null ids are smaller than all, and stay
    last of all with ``largest=False``. Of repeated rows one stays. Null text counts as empty; texts are equal when
    ``normalise`` (a function from column to column) makes them identical. Extra columns are ignored, and an empty table
    gives an empty result. A very long text is one row of its range.
    """
    spark = docs.sparkSession
    rows = salted(docs.select(F.col("doc_id"), normalise(F.coalesce(F.col("text"), F.lit(""))).alias("text")))
    weight = F.octet_length("text") + ROW_BYTES
    total, size = rows.agg(F.count(F.lit(1)), F.sum(weight)).first()
    lead, digest = F.hex(F.substring(F.encode("text", "UTF-8"), 1, LEAD)), F.sha2("text", 256)
    key = F.concat(lead, F.lit("!"), digest, F.col("salt"))
    ranges = min(MOST_RANGES, max(-(-(size or 0) // range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = splitters(rows, total, key, weight, ranges)
    keyed = rows.withColumns({"lead": lead, "text_sha256": digest})
    keyed = keyed.withColumn("range", range_of(F.concat("lead", F.lit("!"), "text_sha256", "salt"), at)).drop("salt").repartitionById(len(at) + 1, "range")
    # The row that stays is the last of its run.
    by_id = F.col("doc_id").asc_nulls_first() if largest else F.col("doc_id").desc_nulls_first()
    order = Window.partitionBy("range").orderBy("lead", "text_sha256", "text", by_id)
    before, last = F.lag("text").over(order), F.lead(F.lit(1)).over(order).isNull()
    compared = keyed.select("doc_id", "text_sha256", "range", "lead", F.when(before.isNull() | (before != F.col("text")), 1).otherwise(0).alias("begins"), F.when(before.isNull() | last, F.col("text")).alias("edge"), F.row_number().over(order).alias("nth"))
    runs = compared.drop("lead").withColumn("run", F.sum("begins").over(Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("range", "run")
    ordered = run.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("doc_id", "text_sha256", "range", "run", "edge", F.last("doc_id").over(ordered).alias("keep_id"), F.count(F.lit(1)).over(ordered).alias("group_size"), (F.last("nth").over(ordered) == F.col("nth")).alias("kept"))
    runs = settle(runs, "content-runs")
    whole = across(runs, largest)
    both = runs.drop("edge").join(F.broadcast(whole), ["range", "run"], "left")
    mine = F.coalesce(F.col("wins"), F.lit(True))
    return both.select("doc_id", F.when(F.col("wins").isNull(), F.col("keep_id")).otherwise(F.col("whole_id")).alias("keep_id"), F.coalesce("whole_size", "group_size").alias("group_size"), (F.col("kept") & mine).alias("kept"), "text_sha256")


def across(runs: DataFrame, largest: bool) -> DataFrame:
    """(range, run, whole_id, whole_size, wins) of the runs that lie in several ranges. At most two rows a range come in,
    so at most 2 ``MOST_RANGES`` go out, whatever the table's size."""
    edges = runs.where(F.col("edge").isNotNull()).groupBy("range", "run").agg(F.first("text_sha256").alias("digest"), F.first("edge").alias("edge"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    rank = F.struct(F.col("keep_id").isNotNull(), F.col("keep_id") if largest else -F.col("keep_id"), "range", "run")
    group = Window.partitionBy("digest", "edge")
    wins = F.max(rank).over(group) == rank
    met = edges.withColumns({"wins": wins, "whole_id": F.when(F.lit(largest), F.max("keep_id").over(group)).otherwise(F.min("keep_id").over(group)), "whole_size": F.sum("group_size").over(group), "several": F.count(F.lit(1)).over(group) > 1})
    return met.where("several").select("range", "run", "whole_id", "whole_size", "wins")
