"""What changed between two states of a corpus, and upserts into the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.sources.tables import small


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks or has with another mtime, an older one too. Files whose rows are wide should come
    without their content, which ``with_content`` then gets for the changed ones."""
    known = manifest.select(F.col("abs_path"), F.col("mtime").alias("_known")).dropDuplicates(["abs_path"])
    return files.join(known, "abs_path", "left").where(~F.col("mtime").eqNullSafe(F.col("_known")) | F.col("_known").isNull()).select(*files.columns)


def with_content(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Whole rows of ``files`` whose abs_path is in ``changed``. Their paths go to where the files are read, if they are
    counted to be few enough; else both are joined by shuffle."""
    return files.join(small(changed.select("abs_path").distinct()), "abs_path", "left_semi").select(*files.columns)


def deleted_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of scanned repositories whose file is gone."""
    scanned = files.select("repo_name").distinct()
    return manifest.join(scanned, "repo_name", "left_semi").join(files.select("abs_path"), "abs_path", "left_anti").select(*manifest.columns)


def upsert(old: DataFrame, new: DataFrame, by: str = "id") -> DataFrame:
    """Old rows whose key isn't among the new ones, and all new rows (repeats within them stay). by: ``id``, as the
    table's key has it, or ``abs_file_path``, which also drops chunks that a changed file no longer has."""
    return old.join(new.select(by).distinct(), by, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_repo(chunks: DataFrame, repo_name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted)."""
    mine = F.col("repo_name") == repo_name
    return chunks.where(~F.coalesce(mine, F.lit(False))), chunks.where(mine).agg(F.count(F.lit(1)).alias("deleted"))


def chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(abs_path, repo_name, mtime, chunk_count) of processed files; 0 for those without chunks."""
    counts = chunks.groupBy(F.col("abs_file_path").alias("abs_path")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return files.select("abs_path", "repo_name", "mtime").join(counts, "abs_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def next_manifest(manifest: DataFrame, files: DataFrame, processed: DataFrame) -> DataFrame:
    """The manifest without files that are gone and with new mtimes and counts of the processed ones. processed: rows of
    ``chunk_counts``. Repositories that weren't scanned keep their rows."""
    scanned = files.select("repo_name").distinct()
    elsewhere = manifest.join(scanned, "repo_name", "left_anti").select(*manifest.columns)
    stay = manifest.join(scanned, "repo_name", "left_semi").join(files.select("abs_path"), "abs_path", "left_semi").join(processed.select("abs_path"), "abs_path", "left_anti")
    return elsewhere.unionByName(stay.select(*manifest.columns)).unionByName(processed.select(*manifest.columns))
