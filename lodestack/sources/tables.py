"""Reading source files, and the tables of an index: chunks, typed rows, summaries and the manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import text as X
from lodestack.schemas import CATEGORIES, CHUNKS, LIVE, MANIFEST, PAIRED, STORED, SUMMARIES, VECTORS
from lodestack.sources.files import FilesSource


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(abs_path, size, mtime, content) of all files below a folder: UTF-8 with broken bytes dropped, line ends as line
    feeds. Spark's readers skip names that start with a dot or an underscore; ``list_files`` doesn't."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"\Afile:/*", "/")
    return raw.select(path.alias("abs_path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), decoded(F.col("content")).alias("content"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Like ``read_files``, with dot files too: tasks list and read the folders, in Spark's own binary reader's stead."""
    spark.dataSource.register(FilesSource)
    return spark.read.format("corpus_files").load(root)


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; what isn't UTF-8 is dropped, and every line ends with a line feed."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.make_valid_utf8(content.cast("string")), "\ufffd", ""))
    return F.regexp_replace(text, "\r\n?", "\n")


#: Most rows of a table of names that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def small(names: DataFrame) -> DataFrame:
    """A table of names, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(names) if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else names


#: Buckets of repositories that a part has, and so its folders.
BUCKETS = 64
#: Parts of a bucket from which on those are merged that aren't larger than all smaller ones together.
PARTS = 8
#: Most names that are pushed to the scan as a list.
PUSHED = 1000


def without(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of other repositories than ``repos``; a null name is a name."""
    return rows.join(small(repos.select(F.col("repo_name").alias("_r"))), F.col("repo_name").eqNullSafe(F.col("_r")), "left_anti")


class Store:
    """Tables below one folder, for one writer at a time.

    Every write makes a new version of a table from the ones before and then names it current, by creating an empty file
    whose name has the version's number: so a table can be read while it is replaced, and a write that fails at any point
    leaves the one before. ``clean`` deletes what no recent version has.

    Chunks and typed rows lie in parts: a write adds a part with the rows of the repositories that it replaces or adds, in
    a folder for each bucket of repository names, sorted by name. A version is the table of where each repository's rows
    are (LIVE). So a write makes ``BUCKETS`` folders at most however many repositories it has, a read of some repositories
    opens their folders only, deleting touches no data, and null and empty names are names like others. What is replaced
    or deleted stays in its file until ``compact`` writes the bucket anew: a bucket of a part is merged when less than half
    of its rows are live, and the smaller ones of a bucket are when it lies in more than ``PARTS`` parts.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, table: str) -> list[str]:
        """Names of a table's versions, oldest first."""
        return self._names(f"{self.root}/{table}/_versions")

    def write(self, table: str, rows: DataFrame) -> None:
        """A new version of a whole table."""
        last = self.versions(table)
        version = f"{int(last[-1].split('-')[0]) + 1 if last else 1:010}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{table}/{version}")
        fs, p = self._fs(f"{self.root}/{table}/_versions/{version}")
        fs.create(p, False).close()

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The table's current version; an empty one if nothing was written yet."""
        found = self.versions(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{found[-1]}").select(*schema.names) if found else self.spark.createDataFrame([], schema)

    def _add_part(self, table: str, rows: DataFrame) -> DataFrame:
        """Write rows as a part; LIVE of it, counted from what was written. AQE deals a bucket with very many rows out to
        several tasks and files."""
        part = uuid.uuid4().hex
        path = f"{self.root}/{table}/parts/part={part}"
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("repo_name"), F.lit(self.buckets)).cast("int")).hint("rebalance", "bucket")
        bucketed.sortWithinPartitions("bucket", "repo_name").write.partitionBy("bucket").parquet(path)
        if not any(x.startswith("bucket=") for x in self._names(path)):
            return self.spark.createDataFrame([], LIVE)
        written = self.spark.read.schema("repo_name string, bucket int").parquet(path)
        counts = written.groupBy("repo_name", "bucket").agg(F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(totals), "bucket").select("repo_name", F.lit(part).alias("part"), "bucket", "n", "total")  # a row a bucket

    def replace(self, table: str, rows: DataFrame, repos: DataFrame | None = None) -> None:
        """Replace the rows of ``repos`` (repo_name), or of those that ``rows`` has, by ``rows``, which is computed once.
        Rows of repositories that aren't among ``repos`` are added to what the table has."""
        new = self._add_part(table, rows)
        gone = (new if repos is None else repos).select("repo_name").distinct()
        self.write(table, without(self._live(table), gone).unionByName(new))

    def delete_repo(self, table: str, repo_name: str) -> int:
        """Delete a repository's rows; how many they were. Only the table of places is written."""
        live = self._live(table)
        mine = F.col("repo_name").eqNullSafe(repo_name)
        n = live.where(mine).agg(F.sum("n")).first()[0] or 0
        if n:
            self.write(table, live.where(~mine))
        return n

    def _live(self, table: str) -> DataFrame:
        return self.read(table, LIVE)

    def folders(self, table: str, repos: DataFrame | None = None) -> list[tuple[str, int, int, int]]:
        """(part, bucket, live rows, rows) of all folders that are in use, or of those that have rows of ``repos``.
        ``compact`` bounds their number by buckets and the logarithm of the rows."""
        live = self._live(table)
        if repos is not None:
            live = live.join(small(repos.select(F.col("repo_name").alias("_r")).distinct()), F.col("repo_name").eqNullSafe(F.col("_r")), "left_semi")
        found = live.groupBy("part", "bucket").agg(F.sum("n").alias("n"), F.max("total").alias("total")).collect()
        return sorted((r["part"], r["bucket"], r["n"], r["total"]) for r in found)

    def parts(self, table: str, schema: T.StructType, repos: DataFrame | None = None) -> DataFrame:
        """Rows of a table that ``replace`` keeps; of ``repos`` only, if given: then only the folders that have some are
        opened, and of these, where the names are few, only the row groups that may."""
        folders = [x[:2] for x in self.folders(table, repos)]
        rows = self._rows(table, schema, folders)
        if repos is None or not folders:
            return rows
        wanted = repos.select("repo_name").distinct()
        names = [r["repo_name"] for r in wanted.limit(PUSHED + 1).collect()]
        if len(names) <= PUSHED:
            named = F.col("repo_name").isin(*[x for x in names if x is not None])
            return rows.where(named | F.col("repo_name").isNull() if None in names else named)
        return rows.join(small(wanted.withColumnRenamed("repo_name", "_r")), F.col("repo_name").eqNullSafe(F.col("_r")), "left_semi")

    def _rows(self, table: str, schema: T.StructType, folders: list[tuple[str, int]]) -> DataFrame:
        """Live rows of folders."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}/parts"
        kinds = T.StructType([*schema.fields, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(kinds).option("basePath", base).parquet(*[f"{base}/part={p}/bucket={b}" for p, b in folders])
        live = self._live(table).select(F.col("repo_name").alias("_r"), F.col("part").alias("_p"), F.col("bucket").alias("_b"))
        here = (F.col("part") == F.col("_p")) & (F.col("bucket") == F.col("_b")) & F.col("repo_name").eqNullSafe(F.col("_r"))
        return rows.join(small(live), here, "left_semi").select(*schema.names)

    def compact(self, table: str, schema: T.StructType) -> int:
        """Merge folders that are mostly dead or too many (see above) into a new part; how many were."""
        if len(self._names(f"{self.root}/{table}/parts")) < 2:
            return 0
        merge: list[tuple[str, int]] = []
        by: dict[int, list[tuple[str, int, int, int]]] = {}
        for f in self.folders(table):
            by.setdefault(f[1], []).append(f)
        for folders in by.values():
            dead = {f[0] for f in folders if 2 * f[2] < f[3]}
            folders.sort(key=lambda f: f[2])
            if len(folders) - len(dead) > PARTS:
                smaller, upto = 0, 0
                for i, f in enumerate(folders):
                    if f[2] <= smaller:
                        upto = i + 1
                    smaller += f[2]
                dead |= {f[0] for f in folders[: max(upto, 2)]}
            merge += [f[:2] for f in folders if f[0] in dead]
        if not merge:
            return 0
        new = self._add_part(table, self._rows(table, schema, merge))
        gone = self.spark.createDataFrame(merge, "part string, bucket int")
        self.write(table, self._live(table).join(F.broadcast(gone), ["part", "bucket"], "left_anti").select(*LIVE.names).unionByName(new))
        return len(merge)

    def clean(self, table: str, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions of a table, and folders of parts that none of these has. Readers of
        older versions fail; so keep as many as there may be runs while one is read."""
        found = self.versions(table)
        old, rest = found[: max(0, len(found) - keep)], found[max(0, len(found) - keep) :]
        if len(parts := self._names(f"{self.root}/{table}/parts")) > 1:
            used = set()
            for v in rest:
                used |= {(f"part={r['part']}", f"bucket={r['bucket']}") for r in self.spark.read.schema(LIVE).parquet(f"{self.root}/{table}/{v}").select("part", "bucket").distinct().collect()}
            old = old + [f"parts/{p}" for p in parts if p not in {u[0] for u in used}]
            old += [f"parts/{p}/{b}" for p in {u[0] for u in used} for b in self._names(f"{self.root}/{table}/parts/{p}") if b.startswith("bucket=") and (p, b) not in used]
        for v in old:
            for path in (f"{self.root}/{table}/_versions/{v}", f"{self.root}/{table}/{v}"):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def chunks(self, repos: DataFrame | None = None) -> DataFrame:
        """All chunks, or those of ``repos`` (repo_name)."""
        return self.parts("chunks", STORED, repos)

    def write_chunks(self, rows: DataFrame, repos: DataFrame | None = None) -> None:
        """Replace the chunks of ``repos``, or of those that ``rows`` has. ``rows`` is computed once."""
        self.replace("chunks", rows.select(*[F.col(f.name).cast(f.dataType) for f in STORED.fields]), repos)

    def vectors(self, model: str, texts: DataFrame | None = None) -> DataFrame:
        """(digest, vector) of all texts that a model has embedded, or of ``texts`` (digest): few of those are pushed to the
        scan, whose files are sorted by digest, so that it opens their pages only."""
        parts = [f"{self.root}/vectors/{model}/{p}" for p in self._names(f"{self.root}/vectors/{model}") if not p.startswith("_")]
        if not parts:
            return self.spark.createDataFrame([], VECTORS)
        rows = self.spark.read.schema(VECTORS).parquet(*parts)
        if texts is not None:
            few = [bytes(r["digest"]) for r in texts.select("digest").distinct().limit(PUSHED + 1).collect()]
            rows = rows.where(F.col("digest").isin(*few)) if len(few) <= PUSHED else rows
        return rows

    def add_vectors(self, model: str, rows: DataFrame) -> DataFrame:
        """Add vectors of new texts as a file set of its own, and read them back."""
        path = f"{self.root}/vectors/{model}/{uuid.uuid4().hex}"
        staged = f"{self.root}/vectors/{model}/_{uuid.uuid4().hex}"  # not seen by readers until it is whole
        rows.sortWithinPartitions("digest").write.option("parquet.page.row.count.limit", 500).parquet(staged)
        fs, p = self._fs(staged)
        fs.rename(p, self._fs(path)[1])
        return self.spark.read.schema(VECTORS).parquet(path)

    def forget_vectors(self, model: str) -> None:
        fs, path = self._fs(f"{self.root}/vectors/{model}")
        fs.delete(path, True)

    def merge_vectors(self, model: str, used: DataFrame | None = None, most: int = PARTS) -> None:
        """Put the file sets of a model together once there are more than ``most``; only those of ``used`` (digest) texts,
        if given. For one writer at a time, while nothing reads."""
        sets = [p for p in self._names(f"{self.root}/vectors/{model}") if not p.startswith("_")]
        if len(sets) > most or used is not None:
            rows = self.vectors(model).dropDuplicates(["digest"])
            self.add_vectors(model, rows if used is None else rows.join(used.select("digest").distinct(), "digest", "left_semi"))
            for p in sets:
                fs, path = self._fs(f"{self.root}/vectors/{model}/{p}")
                fs.delete(path, True)

    def manifest(self) -> DataFrame:
        """What was indexed; an empty table if its files aren't such a table, so that everything is indexed anew."""
        found = self.versions("manifest")
        try:
            if found and not set(MANIFEST.names) <= set(self.spark.read.parquet(f"{self.root}/manifest/{found[-1]}").columns):
                found = []
        except AnalysisException:
            found = []
        return self.read("manifest", MANIFEST) if found else self.spark.createDataFrame([], MANIFEST)

    def summaries(self) -> DataFrame:
        return self.read("summaries", SUMMARIES)

    def structured(self, category: str, repos: DataFrame | None = None) -> DataFrame:
        return self.parts(category, CATEGORIES[category], repos)

    def save_structured(self, category: str, rows: DataFrame, repos: DataFrame | None = None) -> None:
        """Replace a category's rows of ``repos`` (repo_name), which may have none now; of those that ``rows`` has if no
        repositories are given."""
        self.replace(category, rows.select(*CATEGORIES[category].names), repos)

    def load_structured(self, category: str, repo_name: str) -> DataFrame:
        return self.structured(category, self.spark.createDataFrame([(repo_name,)], "repo_name string"))

    def save_json(self, payloads: DataFrame) -> None:
        """Keep (repo_name, category, payload), payloads being JSON, in parts like typed rows; only the pairs of repository
        and category that ``payloads`` has are replaced. ``payloads`` is computed once."""
        pair = F.to_json(F.array("category", "repo_name"))
        self.replace("json", payloads.select(pair.alias("repo_name"), F.col("repo_name").alias("name"), "category", "payload"))
        self.compact("json", PAIRED)
        self.clean("json")

    def load_json(self) -> DataFrame:
        """(repo_name, category, payload) of all pairs that were saved."""
        return self.parts("json", PAIRED).select(F.col("name").alias("repo_name"), "category", "payload")


def chunk_schema_cast(rows: DataFrame) -> DataFrame:
    """Chunk columns cast to their types; a null symbol stays null."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])


def with_workspace(rows: DataFrame, workspace: str) -> DataFrame:
    return rows.withColumn("workspace", X.workspace_key(F.lit(workspace)))
