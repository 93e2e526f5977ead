"""Statistics and summaries of the chunk table and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.schemas import SUMMARIES


def table_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, repositories and languages in order; nulls don't count. Reads two columns."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.array_sort(F.collect_set("repo_name")).alias("repos"), F.array_sort(F.collect_set("language")).alias("languages"))


def table_names(chunks: DataFrame) -> DataFrame:
    """(kind, name, chunks): each repository and language with its number of chunks; nulls don't count. What ``table_stats``
    has in one row, for tables of any number of names."""
    pairs = chunks.groupBy("repo_name", "language").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in (("repo", "repo_name"), ("language", "language"))])
    return pairs.select(F.explode(each).alias("x"), "n").where("x.name is not null").groupBy("x.kind", "x.name").agg(F.sum("n").alias("chunks"))


def run_stats(processed: DataFrame) -> DataFrame:
    """(repo_name, files_processed, chunks_created) of a run and its total, whose repo_name is null."""
    return processed.rollup("repo_name").agg(F.count(F.lit(1)).alias("files_processed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks_created"))


def repo_chunk_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("repo_name").agg(F.sum("chunk_count").alias("chunk_count"))


def summaries(profiles: DataFrame, routes: DataFrame, manifest: DataFrame, previous: DataFrame, processed: DataFrame, stamp: Column) -> DataFrame:
    """SUMMARIES of all profiles. A repository without new chunks in this run keeps the chunk count that its previous
    summary has; without routes or chunks it has 0. ``models`` is always empty."""
    key = F.col("repo_name").alias("name")
    ends = routes.groupBy(key).agg(F.count(F.lit(1)).alias("endpoints_count"))
    counts = repo_chunk_counts(manifest).select(key, F.col("chunk_count").alias("counted"))
    fresh = processed.groupBy(key).agg(F.sum("chunk_count").alias("fresh"))
    old = previous.select("name", F.col("chunk_count").alias("old"))
    rows = profiles.join(ends, "name", "left").join(counts, "name", "left").join(fresh, "name", "left").join(old, "name", "left")
    kept = F.when(F.coalesce("fresh", F.lit(0)) == 0, F.coalesce("old", "counted")).otherwise(F.col("counted"))
    return rows.select(
        "name", "stack", "framework", F.col("key_paths").alias("key_files"), F.array().cast("array<string>").alias("models"),
        F.coalesce("endpoints_count", F.lit(0)).cast("long").alias("endpoints_count"), F.coalesce(kept, F.lit(0)).cast("long").alias("chunk_count"), stamp.alias("last_indexed"),
    ).select(*SUMMARIES.names)


def lookup(payloads: DataFrame, category: str, repo_name: str) -> DataFrame:
    """The payload of a category of a repository: a row or none."""
    return payloads.where((F.col("repo_name") == repo_name) & (F.col("category") == category))


def summary(rows: DataFrame, repo_name: str | None = None) -> DataFrame:
    """One summary, or all by name."""
    return rows.where(F.col("name") == repo_name) if repo_name else rows.orderBy("name")
