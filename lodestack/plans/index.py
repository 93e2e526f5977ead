"""The composed jobs: index all repositories at once, and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import chunk, detect, embed, extract, files, incremental, search, summary
from lodestack.schemas import CATEGORIES, STORED, SUMMARIES
from lodestack.sources.tables import Store


@dataclass
class Settings:
    """What a run may vary."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    include: list[str] | None = None
    exclude: list[str] | None = None
    dim: int = 64
    embed: embed.EmbedFn | None = None
    #: Names the embedder: texts that a run of it has embedded into the store aren't embedded again. None: nothing is kept.
    model: str | None = None
    upsert_by: str = "id"

    @property
    def named(self) -> str | None:
        return self.model or (None if self.embed else f"hashed-words-{self.dim}")


def index(listing: DataFrame, store: Store, settings: Settings | None = None, full: bool = False, repos: list[str] | None = None) -> DataFrame:
    """Bring the store up to date with the files and return the run's statistics (``summary.run_stats``).

    listing: schema FILES, all files of all repositories, whatever is indexed. Only changed files are chunked and embedded
    unless ``full``, which first drops what the store has of the repositories. Typed rows and summaries are made anew: a
    repository whose settings, say, are gone has none left. Only repositories with changed files get their chunks written
    again, and what changed is found without moving any content.
    """
    s = settings or Settings()
    if repos:
        listing = listing.where(F.col("repo_name").isin(*repos))
    paths = listing.drop("content")
    profiles = _written(store, "profiles", detect.profiles(paths))  # one row a repository
    scanned = profiles.select(F.col("name").alias("repo_name")).distinct()
    indexed = files.walk_files(paths, s.include, s.exclude)
    manifest = store.manifest()
    if full:
        manifest = manifest.join(scanned, "repo_name", "left_anti").select(*manifest.columns)
    changed = _written(store, "changed", incremental.changed_files(indexed, manifest))
    todo = incremental.with_content(files.walk_files(listing, s.include, s.exclude), changed)
    new = _written(store, "run", embedded(store, chunk.chunk_files(todo, s.max_tokens, s.overlap_tokens), s))
    touched = scanned if full else changed.select("repo_name").distinct()
    kept_rows = new if full else incremental.upsert(store.chunks(touched).select(*new.columns), new, s.upsert_by)
    store.write_chunks(kept_rows, touched)
    processed = _written(store, "processed", incremental.chunk_counts(changed, new))
    store.write("manifest", incremental.next_manifest(manifest, indexed, processed))
    wanted = _written(store, "extracted", extract.extractable(listing))  # all content is read once for all extractors
    for category, rows in extract.extract_structured(wanted, profiles).items():
        store.save_structured(category, rows, scanned)
    routes = store.structured("routes", scanned)
    fresh = summary.summaries(profiles, routes, store.manifest(), store.summaries(), processed, X.utc_stamp(F.current_timestamp()))
    kept = store.summaries().join(profiles.select("name"), "name", "left_anti").select(*SUMMARIES.names)
    store.write("summaries", kept.unionByName(fresh))
    for table, schema in (("chunks", STORED), *CATEGORIES.items()):
        store.compact(table, schema)
    store.merge_vectors(s.named or "unnamed")
    for table in ("chunks", "manifest", "summaries", "profiles", "changed", "pieces", "run", "processed", "extracted", *CATEGORIES):
        store.clean(table)
    return summary.run_stats(processed)


def embedded(store: Store, chunks: DataFrame, s: Settings) -> DataFrame:
    """Chunks with their vectors: each distinct text is embedded once, and once only for all runs of a named model."""
    chunks = _written(store, "pieces", chunks)  # cut once, read twice
    model = s.named or "unnamed"
    if not s.named:
        store.forget_vectors(model)
    known = store.vectors(model, chunks.select(embed.digest(F.col("text")).alias("digest")))
    return embed.embed_distinct(chunks, known, s.embed or embed.hashed_words(s.dim), s.dim, lambda rows: store.add_vectors(model, rows))


def _written(store: Store, table: str, rows: DataFrame) -> DataFrame:
    store.write(table, rows)
    return store.read(table, rows.schema)


def search_text(store: Store, query: str, settings: Settings | None = None, repos: list[str] | None = None, languages: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Ranked hits of a text query."""
    if not query.strip():
        raise ValueError("the query is empty")
    s = settings or Settings()
    asked = store.spark.createDataFrame([(0, query)], "query_id int, text string")
    vector = embed.embed_query(asked, s.embed or embed.hashed_words(s.dim), s.dim).first()["vector"]
    return search.search(store.chunks(), vector, repos, languages, limit)
