"""Vectors for chunks and queries through a pluggable batch function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 100
EmbedFn = Callable[[list[str]], list[list[float]]]


def hashed_words(dim: int = 64) -> EmbedFn:
    """A deterministic embedder without a model: hashed word counts, of unit length. A word's MD5 tells its entry and its
    sign."""
    known: dict[str, tuple[int, int]] = {}

    def place(word: str) -> tuple[int, int]:
        if len(known) > 1_000_000:
            known.clear()
        h = hashlib.md5(word.encode()).digest()
        found = known[word] = int.from_bytes(h[:4], "big") % dim, 1 if h[4] & 1 else -1
        return found

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            words = [known.get(w) or place(w) for w in t.lower().split()]
            if words:
                at = np.array(words)
                out[i] = np.bincount(at[:, 0], weights=at[:, 1], minlength=dim)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def digest(text: Column) -> Column:
    """What names a text's vector among the known ones: the bytes of its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def embed_distinct(chunks: DataFrame, known: DataFrame, embed: EmbedFn, dim: int, keep: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> DataFrame:
    """Rows with the vectors of their texts, each distinct text embedded once, and not at all if ``known`` (digest, vector)
    has it. keep: stores the rows (digest, vector) that are new, and gives them back.

    Texts are dealt out evenly before they are embedded, which costs far more than moving them. Copies of a text, however
    many, are one row from the first task on; a null text is an empty one.
    """
    keyed = chunks.withColumn("digest", digest(F.col("text")))
    texts = keyed.groupBy("digest").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    missing = texts.join(known.select("digest"), "digest", "left_anti")
    fresh = keep(embed_chunks(missing, embed, dim, batch, partitions=2 * chunks.sparkSession.sparkContext.defaultParallelism).select("digest", "vector"))
    return keyed.join(known.select("digest", "vector").unionByName(fresh), "digest").drop("digest")


def embed_chunks(chunks: DataFrame, embed: EmbedFn, dim: int, batch: int = BATCH, column: str = "text", partitions: int = 0) -> DataFrame:
    """Rows with their vector, in batches of ``batch`` texts. A wrong number of vectors, or of a wrong length, fails the
    job with the first chunk id that has none. ``partitions``: deal
    the rows out evenly first, where their files are uneven and embedding costs far more than moving."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    name = _name(chunks)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                vectors = embed(part[column].fillna("").tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts from {part[name].iloc[0]}")
                yield part.assign(vector=[np.asarray(v, np.float32) for v in vectors])

    return with_checked(chunks.repartition(partitions).mapInPandas(run, schema) if partitions else chunks.mapInPandas(run, schema), dim)


def checked(vector: Column, dim: int, name: Column) -> Column:
    """A vector that must have ``dim`` entries."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.format_string(f"chunk %s has a vector of %d entries; {dim} are needed", name, F.size(vector))).cast("array<float>"))


def with_checked(stored: DataFrame, dim: int) -> DataFrame:
    return stored.withColumn("vector", checked(F.col("vector"), dim, F.col(_name(stored)).cast("string")))


def _name(rows: DataFrame) -> str:
    """The column that names a row in messages: id or query_id, else the first one."""
    return next((c for c in ("id", "query_id") if c in rows.columns), rows.columns[0])


def attach(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the vectors of their ids; a chunk without one fails the job. vectors: (id, vector)."""
    both = chunks.join(vectors, "id", "left")
    return both.withColumn("vector", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("no vector for chunk "), "id")).cast("array<float>")))


def embed_query(queries: DataFrame, embed: EmbedFn, dim: int) -> DataFrame:
    """(query_id, text) with vectors; an empty text is an error."""
    filled = queries.withColumn("text", F.when(F.trim("text") != "", F.col("text")).otherwise(F.raise_error(F.lit("a query is empty")).cast("string")))
    return embed_chunks(filled, embed, dim)
