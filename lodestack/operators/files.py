"""Repositories and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as X

MAX_FILE_SIZE = 1 << 20

# Which files are indexed unless told otherwise.
DEFAULT_INCLUDE = [
    "**/*.php", "**/*.go", "**/*.ts", "**/*.tsx", "**/*.vue", "**/*.md", "**/*.yaml", "**/*.yml", "**/*.json",
    "**/routes/**", "**/migrations/**", "**/.env.example", "**/docker-compose*.yml",
]
DEFAULT_EXCLUDE = [
    "**/vendor/**", "**/node_modules/**", "**/.rag/**", "**/storage/**", "**/dist/**", "**/build/**", "**/.git/**", "**/docs/swagger*", "**/public/docs/**",
]


def discover_repos(listing: DataFrame, workspace: str, repo_paths: list[str] | None = None, auto_discover: bool = True) -> DataFrame:
    """(repo_root, repo_name) of the workspace and its direct children that hold a ``.git`` folder, and of explicit paths
    that the listing has files below. listing: (abs_path); folders show by the files in them."""
    spark, root = listing.sparkSession, workspace.rstrip("/")
    explicit = [p.rstrip("/") if p.startswith("/") else f"{root}/{p.rstrip('/')}" for p in repo_paths or []]
    below = X.relative_path(F.col("abs_path"), F.lit(root))
    child = F.regexp_extract(below, r"\A(?:([^/]+)/)?\.git/", 1)
    roots = listing.where(F.col("abs_path").startswith(root + "/") & below.rlike(r"\A(?:[^/]+/)?\.git/"))
    found = roots.select(F.when(child == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), child)).alias("repo_root")).where(F.lit(auto_discover))
    if explicit:
        named = spark.createDataFrame([(p,) for p in explicit], "repo_root string")
        found = found.unionByName(listing.join(F.broadcast(named), F.col("abs_path").startswith(F.concat("repo_root", F.lit("/")))).select("repo_root"))
    return found.distinct().select("repo_root", X.base_name(F.col("repo_root")).alias("repo_name"))


def assign_repos(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files with each repository they lie below (nested roots both get a file) and their path in it. files: (abs_path, ...).

    A file's ancestors are exploded and joined by equality, so any number of roots will do and no pair is tried in vain.
    """
    parts = F.split("abs_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.withColumn("repo_root", F.explode(ups))
    return each.join(roots, "repo_root").withColumn("path", X.relative_path(F.col("abs_path"), F.col("repo_root")))


def is_indexed(path: Column, size: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a file is indexed: some include glob matches (if there are any), no exclude glob does, and it isn't over
    the size limit. Uses neither content nor a join, so it prunes the scan."""
    include = DEFAULT_INCLUDE if include is None else include
    exclude = DEFAULT_EXCLUDE if exclude is None else exclude
    wanted = X.matches_any(path, include) if include else F.lit(True)
    return wanted & ~X.matches_any(path, exclude) & (size <= MAX_FILE_SIZE)


def walk_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of a files table that are indexed."""
    return files.where(is_indexed(F.col("path"), F.col("size"), include, exclude))
