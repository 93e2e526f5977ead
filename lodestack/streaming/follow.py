"""Structured Streaming form of the incremental index: a stream of file versions and removals, kept as state by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators import extract
from lodestack.plans import index
from lodestack.plans.index import Settings
from lodestack.schemas import FILES
from lodestack.sources.tables import Store

#: A version of a file, or with ``removed`` the end of it, at ``mtime``. Rows without the column are versions.
EVENTS = T.StructType([*FILES.fields, T.StructField("removed", T.BooleanType())])


def follow(spark: SparkSession, source: str, store: Store, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Take in what a Parquet folder of file events (schema EVENTS) has gained since the last run, then stop.

    The store keeps the newest version of each path as state (table ``files``): what comes late, with an older mtime than
    is known, or again, changes nothing, and neither does an old version of a file that was removed since. The chunks,
    manifest, typed rows and summaries of the repositories with news are then brought up to date as ``index.index`` does
    from a whole listing of these; others aren't read. A batch that is run twice gives the same tables.
    """

    def take(batch: DataFrame, _: int) -> None:
        take_in(batch, store, settings)

    stream = spark.readStream.schema(EVENTS).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_in(events: DataFrame, store: Store, settings: Settings | None = None) -> None:
    """Bring the store up to date with a batch of events. Of events of one path the newest counts; of one time a removal
    does, and of equal ones any. Events without a path or time are no events."""
    events = events.where("abs_path is not null and mtime is not null").withColumn("removed", F.coalesce("removed", F.lit(False)))
    order = Window.partitionBy("abs_path").orderBy(F.desc("mtime"), F.desc("removed"), "content")
    store.write("events", events.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*EVENTS.names))
    events = store.read("events", EVENTS)
    repos = events.select("repo_name").distinct()
    known = store.parts("files", EVENTS, repos)
    old = known.select(F.col("abs_path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("removed").alias("_removed"))
    later = (F.col("_mtime") > F.col("mtime")) | ((F.col("_mtime") == F.col("mtime")) & (F.col("_removed") | ~F.col("removed")))
    news = events.join(old, (F.col("abs_path") == F.col("_path")) & later, "left_anti")
    now = known.join(news.select("abs_path"), "abs_path", "left_anti").select(*EVENTS.names).unionByName(news)
    # Contents are kept of the few files that typed rows are made of anew; others are needed once, when they are news.
    needed = extract.extractable(now.select("abs_path", "path")).select("abs_path").distinct().withColumn("typed", F.lit(True))
    state = now.join(needed, "abs_path", "left").withColumn("content", F.when(F.col("typed") & ~F.col("removed"), F.col("content")))
    store.replace("files", state.select(*EVENTS.names), repos)
    index.index(now.where("not removed").select(*FILES.names), store, settings)
    store.compact("files", EVENTS)
    store.clean("files")
    store.clean("events")
