"""Tables and files in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.shared import new_path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and lost executors cost no rework."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a settled table that no later step reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str:
    """The mounted path of a ``file:`` URI, for tasks that memory-map files of the shared folder."""
    if not uri.startswith("file:"):
        raise ValueError(f"{uri}: memory-mapped files need a shared folder that is mounted, as file:///...")
    return "/" + uri[5:].lstrip("/")


#: Most bytes of an Arrow batch that goes to a Python worker, unless the session has it smaller.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: long texts would else come ten thousand at a time, which costs a task
    several times their size in the JVM and in Python. Operators call this before they hand texts to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Columns that operators on whole rows know by name.
KNOWN = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows of the known columns and ``rest``, a struct of all others, and what unpacks such rows. Columns are told apart by
    their places, so that names of any kind don't clash with those that operators use."""
    names = docs.columns
    own = [names.index(c) for c in KNOWN if c in names]
    rest = [i for i in range(len(names)) if i not in own]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    inside = plain.select(*[F.col(f"c{i}").alias(names[i]) for i in own], *([F.struct(*[f"c{i}" for i in rest]).alias("rest")] if rest else []))
    return inside, lambda rows: rows.select(*[F.col(names[i] if i in own else f"rest.c{i}").alias(f"c{i}") for i in range(len(names))]).toDF(*names)


def whole_rows(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of an operator that returns some of its rows: columns of any names go through it unseen."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        inside, unpack = packed(docs)
        return unpack(operator(inside, *args, **how))

    return run
