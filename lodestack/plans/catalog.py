"""Registered queries: every operator over whole shared tables, with DuckDB SQL that gives the same rows.

The shared tables stand for a corpus: ``documents`` are files (source = repository, text = content), ``embeddings`` the
vectors of chunks, ``pages`` block-structured files. Source code, routes, settings and listings are built from the rows
of ``part``, ``supplier``, ``customer``, ``nation`` and ``orders`` by Spark, and parsed back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import packing
from lodestack.functions import text as X
from lodestack.operators import chunk, detect, embed, extract, files, incremental, pivots, search, summary
from lodestack.plans import index, sql
from lodestack.schemas import FILES
from lodestack.sources.shared import new_path
from lodestack.sources.tables import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines name one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint") else F.col(c) for c, k in df.dtypes])


# --- vectors ---------------------------------------------------------------------------------------------------------

_DISTANCE = "list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("repo"), F.col("vec_id") % 5).alias("repo_name"), F.col("label").cast("string").alias("language"))


@query(f"""
select e.vec_id id, 'repo' || (e.vec_id % 5) repo_name, e.label::varchar "language", round(1 / (1 + {_DISTANCE}), 6) score
from embeddings e, embeddings q where q.vec_id = 0 and e.vec_id % 5 in (1, 2, 3) order by {_DISTANCE}, e.vec_id limit 10""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of three repositories that are nearest to vector 0."""
    q = [float(x) for x in _t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    found = search.nearest(search.filtered(_chunk_vectors(spark, sf_dir), ["repo1", "repo2", "repo3"]), q, 10)
    return found.select("id", "repo_name", "language", F.round("score", 6).alias("score"))


@query(f"""
select query_id, id, rank, round(distance, 6) distance from (
  select q.vec_id query_id, e.vec_id id, {_DISTANCE} distance, row_number() over (partition by q.vec_id order by {_DISTANCE}, e.vec_id) rank
  from embeddings e, embeddings q where q.vec_id % 50 = 0) where rank <= 5""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each of the queries (ids divisible by 50), against all rows."""
    rows = _chunk_vectors(spark, sf_dir)
    found = search.nearest_each(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("""
select d.doc_id id, len(e.embedding)::bigint dim, round(list_sum(list_transform(e.embedding::double[], lambda x: x * x)), 4) norm
from documents d join embeddings e on e.vec_id = d.doc_id""")
def attached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of their id; lengths are checked."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    known = d.join(v.select("id"), "id", "left_semi")
    both = embed.with_checked(embed.attach(known, v), 64)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return both.select("id", F.size("vector").cast("long").alias("dim"), F.round(norm, 4).alias("norm"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query("""
select count(*) total_chunks, array_to_string(list_sort(list(distinct source) filter (source is not null)), ',') repos,
  array_to_string(list_sort(list(distinct lang) filter (lang is not null)), ',') languages from documents""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.col("lang").alias("language"))
    return summary.table_stats(d).select("total_chunks", F.array_join("repos", ",").alias("repos"), F.array_join("languages", ",").alias("languages"))


@query("select source repo_name, count(*) files_processed, sum(n_chars // 1000)::bigint chunks_created from documents group by rollup (source)")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.expr("n_chars div 1000").alias("chunk_count"))
    return summary.run_stats(d)


# --- change detection: two states of documents -----------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of their sources; the suffix follows the language."""
    ext = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("en", ".md", "fr", ".ts", "de", ".yaml", "es", ".json")]), F.col("lang")), F.lit(".txt"))
    d = _t(spark, sf_dir, "documents").where("source is not null")
    path = F.concat(F.lit("d"), F.col("doc_id") % 7, F.lit("/"), F.col("doc_id"), ext)
    root = F.concat(F.lit("/w/"), F.col("source"))
    return d.select(
        F.col("source").alias("repo_name"), root.alias("repo_root"), path.alias("path"), F.concat(root, F.lit("/"), path).alias("abs_path"), F.octet_length("text").cast("long").alias("size"),
        (F.lit(1.7e9) + F.col("doc_id")).alias("mtime"), F.col("text").alias("content"), "doc_id",
    )


_FILES_SQL = """
f as (select source repo_name, '/w/' || source repo_root, 'd' || (doc_id % 7) || '/' || doc_id || case lang when 'en' then '.md' when 'fr' then '.ts' when 'de' then '.yaml' when 'es' then '.json' else '.txt' end path,
  1.7e9 + doc_id mtime, text content, doc_id, n_chars, strlen(text) size from documents where source is not null),
now as (select * from f where doc_id % 11 <> 0),
man as (select repo_root || '/' || path abs_path, repo_name, mtime - case when doc_id % 7 = 0 then 1 else 0 end mtime, (doc_id % 4)::bigint chunk_count from f where doc_id % 13 <> 0)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files now, manifest of before): some files are gone, some are new, some have another mtime."""
    f = _files(spark, sf_dir)
    before = F.col("mtime") - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return f.where("doc_id % 11 <> 0"), f.where("doc_id % 13 <> 0").select("abs_path", "repo_name", before.alias("mtime"), (F.col("doc_id") % 4).alias("chunk_count"))


@query(f"with {_FILES_SQL} select repo_root || '/' || path abs_path from now left join man on man.abs_path = repo_root || '/' || path where man.mtime is null or man.mtime <> now.mtime")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, manifest = _states(spark, sf_dir)
    return incremental.changed_files(now, manifest).select("abs_path")


@query(f"with {_FILES_SQL} select abs_path, repo_name from man where repo_name in (select repo_name from now) and abs_path not in (select repo_root || '/' || path from now)")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, manifest = _states(spark, sf_dir)
    return incremental.deleted_files(now, manifest).select("abs_path", "repo_name")


@query(f"""
with {_FILES_SQL}, ch as (select now.repo_root || '/' || path abs_path, now.repo_name, now.mtime, (n_chars % 3)::bigint chunk_count from now left join man on man.abs_path = repo_root || '/' || path where man.mtime is null or man.mtime <> now.mtime)
select * from ch union all
select * from man where abs_path in (select repo_root || '/' || path from now) and abs_path not in (select abs_path from ch)
union all select * from man where repo_name not in (select repo_name from now)""")
def next_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, manifest = _states(spark, sf_dir)
    todo = incremental.changed_files(now, manifest)
    # As many chunks as the text's length modulo 3; files without any count 0.
    n = F.coalesce(F.length("content"), F.lit(0)) % 3
    chunks = todo.select(F.col("abs_path").alias("abs_file_path"), F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= n)).alias("i"))
    return incremental.next_manifest(manifest, now, incremental.chunk_counts(todo, chunks))


@query("""
with old as (select doc_id id, source repo_name, n_chars from documents where doc_id % 3 <> 0), new as (select doc_id id, source repo_name, -n_chars n_chars from documents where doc_id % 5 = 0)
select * from old where id not in (select id from new) union all select * from new""")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo_name"), "n_chars")
    return incremental.upsert(d.where("id % 3 <> 0"), d.where("id % 5 = 0").withColumn("n_chars", -F.col("n_chars")))


@query("select count(*) n, count(distinct source) repos, (select count(*) from documents where source = 'src0') deleted from documents where source is distinct from 'src0'")
def delete_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, gone = incremental.delete_repo(_t(spark, sf_dir, "documents").withColumnRenamed("source", "repo_name"), "src0")
    return rest.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo_name").alias("repos")).join(gone)


@query(f"""
with {_FILES_SQL}, r as (select repo_name, count(*) endpoints_count from now where doc_id % 3 = 0 group by 1), m as (select repo_name, sum(chunk_count) counted from man group by 1),
 p as (select repo_name, sum((doc_id % 3))::bigint fresh from now where doc_id % 2 = 0 group by 1)
select n.repo_name as name, 'unknown' stack, coalesce(endpoints_count, 0)::bigint endpoints_count,
  (case when coalesce(fresh, 0) = 0 then 77 else coalesce(counted, 0) end)::bigint chunk_count
from (select distinct repo_name from now) n left join r using (repo_name) left join m using (repo_name) left join p using (repo_name)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all repositories of the document files; the previous ones say 77 chunks."""
    now, manifest = _states(spark, sf_dir)
    profiles = detect.profiles(now)
    done = now.where("doc_id % 2 = 0").select("repo_name", (F.col("doc_id") % 3).alias("chunk_count"))
    out = summary.summaries(profiles, now.where("doc_id % 3 = 0"), manifest, profiles.select("name", F.lit(77).alias("chunk_count")), done, F.lit("2024-01-01T00:00:00Z"))
    return out.select("name", "stack", "endpoints_count", "chunk_count")


# --- listings: globs, languages, repositories, stacks ----------------------------------------------------------------

# One path an order, with folders and suffixes by its key.
_FOLDERS = ("", "src/", "vendor/lib/", "app/routes/", "docs/", "a/node_modules/b/", "database/migrations/", "x/build/", "public/docs/")
_NAMES = ("A.php", "b.go", "C.TS", "d.tsx", "e.vue", "README.md", "f.yml", "g.json", ".env.example", "docker-compose.dev.yml", "noext", "h.py", "swagger.json")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("size0"))
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") / k % len(xs) + 1).cast("int"))
    return o.select("o_orderkey", F.concat(pick(_FOLDERS, 1), pick(_NAMES, len(_FOLDERS))).alias("path"), (F.col("size0") * 1048).cast("long").alias("size"))


_LISTING_SQL = f"""
l as (select o_orderkey, {list(_FOLDERS)}[(o_orderkey % {len(_FOLDERS)}) + 1] || {list(_NAMES)}[(o_orderkey // {len(_FOLDERS)}) % {len(_NAMES)} + 1] path, o_custkey * 1048 size from orders)"""


@query(f"""
with {_LISTING_SQL} select o_orderkey, path from l where size <= 1048576
  and (regexp_matches(path, '\\.(php|go|ts|tsx|vue|md|yaml|yml|json)$') or path like '%/routes/%' or path like 'routes/%' or path like '%/migrations/%' or path like 'migrations/%' or path like '%.env.example' or regexp_matches(path, '(^|/)docker-compose.*\\.yml$'))
  and not (('/' || path) like '%/vendor/%' or ('/' || path) like '%/node_modules/%' or ('/' || path) like '%/storage/%' or ('/' || path) like '%/dist/%' or ('/' || path) like '%/build/%' or ('/' || path) like '%/docs/swagger%' or ('/' || path) like '%/public/docs/%')""")
def walk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.walk_files(_listing(spark, sf_dir)).select("o_orderkey", "path")


@query(f"""
with {_LISTING_SQL} select o_orderkey, coalesce(map {{'.php': 'php', '.go': 'go', '.ts': 'typescript', '.tsx': 'typescript', '.vue': 'vue', '.md': 'markdown', '.yaml': 'yaml', '.yml': 'yaml'}}[lower(regexp_extract(path, '\\.[^./]*$'))], 'text') lang,
  regexp_extract(path, '[^/]*$') base, substr(sha256(path), 1, 16) key from l""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _listing(spark, sf_dir).select("o_orderkey", X.language(p).alias("lang"), X.base_name(p).alias("base"), X.workspace_key(p).alias("key"))


_MARKERS = (
    ("composer.json", "artisan"), ("composer.json", "x.php"), ("go.mod", "internal/server/s.go"), ("go.mod", "cmd/m.go"), ("package.json", "src/deep/A.vue"), ("package.json", "next.config.js"), ("package.json", "nuxt.config.ts"),
    ("package.json", "sub/next.config.js"), ("Cargo.toml", "src/main.rs"), ("a/b/c.csproj", "x"), ("build.gradle.kts", "y"), ("README.md", "sub/pom.xml"),
)


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of repositories, one a supplier: two marker files by its key, an env file for every third, a .git folder."""
    s = _t(spark, sf_dir, "supplier")
    markers = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in _MARKERS]), (F.col("s_suppkey") % len(_MARKERS) + 1).cast("int"))
    more = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(".env.example"), F.lit(".git/HEAD"))).otherwise(F.array(F.lit(".git/config")))
    root = F.concat(F.lit("/w/repo"), F.col("s_suppkey"))
    return s.select("s_suppkey", F.concat(F.lit("repo"), F.col("s_suppkey")).alias("repo_name"), root.alias("repo_root"), F.explode(F.concat(markers, more)).alias("path")).withColumn("abs_path", F.concat("repo_root", F.lit("/"), "path"))


@query(f"""
select 'repo' || s_suppkey as name, ['laravel', 'php', 'go-chi', 'go', 'vue', 'nextjs', 'nuxt', 'node', 'rust', 'dotnet', 'java', 'unknown'][s_suppkey % {len(_MARKERS)} + 1] stack,
  ['Laravel', 'Generic PHP', 'Chi', 'Generic Go', 'Vue 3', 'Next.js', 'Nuxt', 'Node.js', 'Rust', '.NET', 'Java', 'Unknown'][s_suppkey % {len(_MARKERS)} + 1] framework,
  (s_suppkey % 3 = 0 or s_suppkey % {len(_MARKERS)} in (0, 1, 4)) has_env from supplier""")
def stack_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detect.profiles(_repos(spark, sf_dir))
    return p.select("name", "stack", "framework", F.map_contains_key("key_paths", F.lit("env")).alias("has_env"))


@query("select '/w/repo' || s_suppkey repo_root, 'repo' || s_suppkey repo_name from supplier")
def discover_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover_repos(_repos(spark, sf_dir).select("abs_path"), "/w")


@query(f"""
with r as (select s_suppkey, unnest(list_concat({[list(m) for m in _MARKERS]}[s_suppkey % {len(_MARKERS)} + 1], case when s_suppkey % 3 = 0 then ['.env.example', '.git/HEAD'] else ['.git/config'] end)) path from supplier)
select '/w/repo' || s_suppkey || '/' || path abs_path, '/w/repo' || s_suppkey repo_root, path from r
union all select '/w/repo' || s_suppkey || '/' || path, '/w', 'repo' || s_suppkey || '/' || path from r""")
def assign_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their repository and with the workspace around it, which is a root too."""
    listing = _repos(spark, sf_dir)
    roots = listing.select("repo_root", "repo_name").distinct().union(spark.createDataFrame([("/w", "w")], "repo_root string, repo_name string"))
    return files.assign_repos(listing.select("abs_path"), roots).select("abs_path", "repo_root", "path")


# --- chunks ----------------------------------------------------------------------------------------------------------


@query("""
with recursive l as (select doc_id, unnest(lines) line, generate_subscripts(lines, 1) n from (select doc_id, list_filter(regexp_extract_all(text, '[^\\n]*\\n?'), lambda x: x <> '') lines from documents)),
w as (select doc_id, n, greatest(length(line) // 4, 1) t from l),
p as (select doc_id, list(s order by n) s from (select doc_id, n, sum(t) over (partition by doc_id order by n) s from w) group by 1),
c as (select doc_id, s, 0 a, greatest(1, len(list_filter(s, lambda x: x <= 512))) b from p
 union all
 select doc_id, s, x, greatest(x + 1, len(list_filter(s, lambda y: y <= (case when x = 0 then 0 else s[x] end) + 512))) from (
  select doc_id, s, case when k > a then k else b end x from (select doc_id, s, a, b, least(len(list_filter(s, lambda y: y <= s[b] - 64)), b - 1) k from c where b < len(s))))
select doc_id, a::bigint + 1 start_line, b::bigint end_line from c""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of 512 tokens that share 64, of every document."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(packing.windows(F.col("text"), 512, 64)).alias("w"))
    return d.select("doc_id", F.col("w.start_line").cast("long").alias("start_line"), F.col("w.end_line").cast("long").alias("end_line"))


@query()
def budgeted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all document files, by the chunker of their language, within 256 tokens."""
    return chunk.chunk_files(_files(spark, sf_dir), 256, 32).groupBy("language", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""
with s as (select page_id, instr(html, '<script') - 1 b, regexp_extract(html, '(?s)<script\\b[^>]*>.*?</script>') x, html from pages),
t as (select page_id, instr(html, '<style') - 1 b, regexp_extract(html, '(?s)<style\\b[^>]*>.*?</style>') x, html from pages)
select page_id, 'script' chunk_type, b "begin", b + length(x) "end" from s where x <> '' union all select page_id, 'style', b, b + length(x) from t where x <> ''""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script and style blocks of pages, as of Vue files."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.expr(chunk.vue_spans("html", 512))).alias("s"))
    return p.select("page_id", "s.chunk_type", F.col("s.begin").cast("long").alias("begin"), (F.col("s.begin") + F.length("s.text")).cast("long").alias("end"))


def _sources(df: DataFrame, name: Column, path: Column, content: Column) -> DataFrame:
    root = F.concat(F.lit("/w/"), name)
    return df.select(name.alias("repo_name"), root.alias("repo_root"), path.alias("path"), F.concat(root, F.lit("/"), path).alias("abs_path"), F.octet_length(content).cast("long").alias("size"), F.lit(0.0).alias("mtime"), content.alias("content"))


def _parts(spark: SparkSession, sf_dir: str, path: str, template: str) -> DataFrame:
    """One file a part: ``{key}``, ``{name}`` (letters and _) and ``{size}`` of the template are filled from its row."""
    p = _t(spark, sf_dir, "part")
    values = {"{key}": F.col("p_partkey").cast("string"), "{name}": F.translate("p_name", " -", "__"), "{size}": F.col("p_size").cast("string")}
    content = F.lit(template)
    for k, v in values.items():
        content = F.replace(content, F.lit(k), v)
    return _sources(p, F.lit("parts"), F.concat(F.lit("p"), F.col("p_partkey"), F.lit(path)), content)


def _symbols(chunks: DataFrame) -> DataFrame:
    return _long(chunks.select("id", "chunk_type", "symbol_name", "start_line", "end_line"))


_NAME = "translate(p_name, ' -', '__')"


@query(f"""
select 'parts:p' || p_partkey || '/a.md:' || l id, 'section' chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([2, 4, 7]) l, unnest(['Part ' || {_NAME}, 'Size ' || p_size, 'Key']) s, unnest([6, 6, 8]) e from part)""")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a Markdown file for each part."""
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.md", "front\n# Part {name}\ntext\n## Size {size}\nmore\n\n# Key\n{key}")))


@query(f"""
select 'parts:p' || p_partkey || '/a.ts:' || l id, t chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([2, 5, 6]) l, unnest(['function', 'const', 'class']) t, unnest(['f' || p_partkey, 'SIZE_' || p_size, 'C_' || {_NAME}]) s, unnest([4, 5, 7]) e from part)""")
def typescript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.ts", "import x\nexport default async function f{key}(a) {\n  return {size}\n}\nexport const SIZE_{size} = 1\nexport class C_{name} {\n}\n")))


@query(f"""
select 'parts:p' || p_partkey || '/a.go:' || l id, t chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([2, 6, 10]) l, unnest(['struct', 'function', 'function']) t, unnest(['main.T' || p_partkey, 'main.F_' || {_NAME}, 's.Get' || p_size]) s, unnest([5, 9, 10]) e from part)""")
def go_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.go", "package main\n\ntype T{key} struct {\n  x int\n}\n\nfunc F_{name}() {\n  if x { y() }\n}\nfunc (s *Server) Get{size}() {}\n")))


@query(f"""
select 'parts:p' || p_partkey || '/a.php:' || l id, t chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([3, 6]) l, unnest(['class', 'function']) t, unnest(['App\\C_' || {_NAME}, 'App\\f' || p_partkey]) s, unnest([5, 6]) e from part)""")
def php_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.php", "<?php\nnamespace App;\nfinal class C_{name} {\n  public function size() { return {size}; }\n}\nfunction f{key}() { return 1; }\n")))


@query(f"""
select 'parts:p' || p_partkey || '/docker-compose.yml:' || l id, 'config' chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([3, 5]) l, unnest(['app' || p_partkey, 'db.{{}}']) s, unnest([4, 6]) e from part) where s <> 'db.{{}}'
union all select 'parts:p' || p_partkey || '/docker-compose.yml:5', 'config', 'db' || p_size, 5, 6 from part""")
def compose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/docker-compose.yml", "version: 3\nservices:\n  app{key}:\n    image: x\n  db{size}:\n    image: y\nother: z\n")))


@query("""
select 'parts:p' || p_partkey || '/a.php:' || l id, 'method' chunk_type, 'C' || p_partkey || '.' || s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([3, 7]) l, unnest(['one', 'two']) s, unnest([6, 9]) e from part)
union all select 'parts:p' || p_partkey || '/b.php:' || l, 'text', null, l, e from (select p_partkey, unnest([1, 5]) l, unnest([11, 14]) e from part)""")
def php_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of classes over budget, and line windows of such classes without methods."""
    a = _parts(spark, sf_dir, "/a.php", "<?php\nclass C{key} {\n\n  public static function one() {\n    return 'a text of some length';\n  }\n  function two($x) {\n    return 'another text of some length';\n  }}\n")
    b = _parts(spark, sf_dir, "/b.php", "class D{key} {\n" + "  const N = 'some text of thirty five';\n" * 12 + "}\n")
    both = chunk.chunk_files(a, 30).unionByName(chunk.chunk_files(b, 110))
    return _symbols(both)


@query(f"""
select 'parts:p' || p_partkey || '/a.vue:' || l id, t chunk_type, t symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([1, 4, 5, 13]) l, unnest(['template', 'script', 'script', 'script']) t, unnest([3, 12, 12, 14]) e from part)""")
def vue_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Vue files, of which one is over budget and cut to line windows."""
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.vue", "<template>\n  {key}\n</template>\n<script>\n" + "  const n = 'some text of thirty-odd'\n" * 9 + "</script>\n"), 80))


@query(f"""
select 'parts:p' || p_partkey || '/a.yml:' || l id, 'config' chunk_type, s symbol_name, l start_line, e end_line from (
 select p_partkey, unnest([2, 4, 5]) l, unnest(['size_' || p_size, 'services', 'k.' || {_NAME}]) s, unnest([3, 4, 6]) e from part)""")
def yaml_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level keys of plain YAML files."""
    return _symbols(chunk.chunk_files(_parts(spark, sf_dir, "/a.yml", "# front\nsize_{size}: 1\n  deep: 2\nservices: []\nk.{name} : x\n  - y\n")))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_FILES_IN_SQL = {
    "/a.md": "front\n# Part {name}\ntext\n## Size {size}\nmore\n\n# Key\n{key}", "/a.ts": "import x\nexport default async function f{key}(a) {\n  return {size}\n}\nexport const SIZE_{size} = 1\nexport class C_{name} {\n}\n",
    "/a.vue": "<template>\n  {key}\n</template>\n<script>\n" + "  const n = 'some text of thirty-odd'\n" * 9 + "</script>\n", "/a.yml": "# front\nsize_{size}: 1\n  deep: 2\nservices: []\nk.{name} : x\n  - y\n",
    "/a.go": "package main\n\ntype T{key} struct {\n  x int\n}\n\nfunc F_{name}() {\n  if x { y() }\n}\nfunc (s *Server) Get{size}() {}\n",
}


@query(" union all ".join(f"select * from ({ORACLE_SQL[k]})" for k in ("markdown_chunks", "typescript_chunks", "vue_cuts", "yaml_chunks", "go_chunks")))
def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the parts' files in five languages, by a lateral join in plain SQL."""
    sql.register(spark, 80)
    listing = reduce(DataFrame.unionByName, (_parts(spark, sf_dir, path, template) for path, template in _FILES_IN_SQL.items()))
    return _long(spark.sql("select c.id, c.chunk_type, c.symbol_name, c.start_line, c.end_line from {listing} f, lateral file_chunks(f.repo_name, f.path, f.content) c", listing=listing))


@query(ORACLE_SQL["line_windows"])
def windows_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of every document, by a lateral join in plain SQL."""
    sql.register(spark)
    return _long(spark.sql("select d.doc_id, w.start_line, w.end_line from {documents} d, lateral text_windows(d.text) w", documents=_t(spark, sf_dir, "documents")))


# --- extraction: text from rows, parsed back -------------------------------------------------------------------------


@query("""
select 'parts' repo_name, m "method", '/p/' || p_partkey path, 'C' || p_size || '@x' handler, mw middleware from part, (values ('GET', 'auth'), ('POST', 'auth'), ('RESOURCE', '')) v(m, mw)""")
def laravel_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of one route file a repository; here all parts share one, in the order of their keys."""
    p = _t(spark, sf_dir, "part")
    text = F.format_string("Route::middleware(['auth'])->group(function () {\nRoute::get('/p/%d', C%d@x);\nRoute::post( '/p/%d' , C%d@x );\n});}\nRoute::resource('/p/%d', C%d@x);\n", *["p_partkey", "p_size"] * 3)
    # A file for each part, as if each were in a repository of its own.
    f = _sources(p, F.concat(F.lit("r"), F.col("p_partkey")), F.lit("routes/api.php"), text)
    return extract.routes_laravel(f).select(F.lit("parts").alias("repo_name"), "method", "path", "handler", F.array_join("middleware", ",").alias("middleware"))


@query("""
select 'r' || p_partkey repo_name, m "method", '/p/' || p_size path, h handler from part, (values ('GET', 'h.Get'), ('DELETE', 'h.Del'), ('HANDLEFUNC', 'h.Raw')) v(m, h)""")
def go_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    text = F.format_string("r.Get(\"/p/%d\", h.Get)\nr.Delete('/p/%d', h.Del)\nmux.HandleFunc(\"/p/%d\", h.Raw)\n", *["p_size"] * 3)
    f = _sources(p, F.concat(F.lit("r"), F.col("p_partkey")), F.when(F.col("p_partkey") % 2 == 0, "cmd/m.go").otherwise("x/y.go"), text)
    return extract.routes_go(f).select("repo_name", "method", "path", "handler")


@query("""
select file_name, table_name, columns from (
 select p_partkey || '_create.php' file_name, 't' || p_partkey table_name, 'id,size_' || p_size "columns" from part
 union all select p_partkey || '.sql', 't_' || p_size, 'id INT,price_' || p_partkey || ' DECIMAL' from part)""")
def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    php = F.format_string("Schema::create('t%d', function ($t) { $table->id('id'); $table->int('size_%d'); $table->int('id'); });", "p_partkey", "p_size")
    sql = F.format_string("CREATE TABLE IF NOT EXISTS t_%d (\n  id INT,\n  price_%d DECIMAL,\n  PRIMARY KEY (id)\n);\n", "p_size", "p_partkey")
    a = extract.migrations_laravel(_sources(p, F.lit("r"), F.concat(F.lit("database/migrations/"), F.col("p_partkey"), F.lit("_create.php")), php))
    b = extract.migrations_sql(_sources(p, F.lit("r"), F.concat(F.lit("migrations/"), F.col("p_partkey"), F.lit(".sql")), sql))
    return a.unionByName(b).select("file_name", "table_name", F.array_join("columns", ",").alias("columns"))


@query("""select 'c' || c_custkey repo_name, 'NAME' as name, split_part(c_name, '#', 1) as "default", split_part(c_name, '#', 2) as comment from customer
union all select 'c' || c_custkey, 'NATION', c_nationkey::varchar, 'key ' || c_custkey from customer""")
def env_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a repository for each customer."""
    c = _t(spark, sf_dir, "customer")
    text = F.format_string("# settings\nNAME=%s\n\nno line\nNATION = %d # key %d\n", "c_name", "c_nationkey", "c_custkey")
    f = _sources(c, F.concat(F.lit("c"), F.col("c_custkey")), F.lit(".env.example"), text)
    return extract.env_vars(f).select("repo_name", "name", "default", "comment")


@query("""select 's' || s_suppkey repo_name, 'app' as name, 'img:' || s_nationkey image, '80:' || s_suppkey ports, 'KEY=' || s_suppkey environment, 'db' depends_on from supplier
union all select 's' || s_suppkey, 'db', 'pg', '', '', '' from supplier""")
def compose_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    text = F.format_string("services:\n  app:\n    image: img:%d\n    ports: ['80:%d']\n    environment: {KEY: %d}\n    depends_on: [db]\n  db:\n    image: pg\n", "s_nationkey", "s_suppkey", "s_suppkey")
    f = _sources(s, F.concat(F.lit("s"), F.col("s_suppkey")), F.lit("docker-compose.yaml"), text)
    found = extract.compose_services(f)
    return found.select("repo_name", "name", "image", *[F.array_join(c, ",").alias(c) for c in ("ports", "environment", "depends_on")])


@query("""select 'c' || c_custkey repo_name, '[{"name":"NAME","default":"' || split_part(c_name, '#', 1) || '","comment":"' || split_part(c_name, '#', 2) || '"}]' payload from customer""")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of the settings of each customer's repository."""
    c = _t(spark, sf_dir, "customer")
    f = _sources(c, F.concat(F.lit("c"), F.col("c_custkey")), F.lit(".env.example"), F.concat(F.lit("NAME="), "c_name"))
    out = extract.payloads({"env": extract.env_vars(f)}, f.select(F.col("repo_name").alias("name")).distinct())
    return summary.lookup(out.withColumn("category", F.col("category")), "env", "c1").select("repo_name", "payload").union(out.where("repo_name <> 'c1'").select("repo_name", "payload"))


@query("""
select 's' || s_suppkey repo_name, c category, case c
  when 'routes' then '[{"method":"GET","path":"/s/' || s_suppkey || '","handler":"C@show","middleware":["auth"],"name":null}]'
  when 'migrations' then '[{"file_name":"1_s.php","table_name":"t' || s_nationkey || '","columns":["id","k' || s_suppkey || '"]}]'
  when 'env' then '[{"name":"KEY","default":"' || s_suppkey || '","comment":"of ' || s_nationkey || '"},{"name":"EMPTY","default":"","comment":""}]'
  else case when s_suppkey % 2 = 0 then '[]' else '[{"name":"app","image":"img:' || s_nationkey || '","ports":["80:1"],"environment":["A=1"],"depends_on":[]}]' end end payload
from supplier, (values ('routes'), ('migrations'), ('env'), ('docker')) v(c)""")
def payloads_of_all_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of routes, migrations, settings and services of each supplier's repository; every second has no services."""
    s = _t(spark, sf_dir, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey"))
    texts = {
        "composer.json": F.lit("{}"), "artisan": F.lit(""), "routes/web.php": F.format_string("Route::middleware(['auth'])->group(function () {\nRoute::get('/s/%d', C@show);\n});\n", "s_suppkey"),
        "database/migrations/1_s.php": F.format_string("Schema::create('t%d', function ($t) { $table->id('id'); $table->int('k%d'); });", "s_nationkey", "s_suppkey"), ".env.example": F.format_string("KEY=%d # of %d\nEMPTY=\n", "s_suppkey", "s_nationkey"),
    }
    compose = _sources(s.where("s_suppkey % 2 = 1"), name, F.lit("compose.yml"), F.format_string("services: {app: {image: 'img:%d', ports: ['80:1'], environment: {A: 1}}}\n", "s_nationkey"))
    for path, text in texts.items():
        compose = compose.unionByName(_sources(s, name, F.lit(path), text))
    profiles = detect.profiles(compose)
    return extract.payloads(extract.extract_structured(compose, profiles), profiles).select("repo_name", "category", "payload")


@query("""
select 'repo' kind, source as name, count(*) chunks from documents where source is not null group by source
union all select 'language', lang, count(*) from documents where lang is not null group by lang""")
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories and languages of the documents, with how many each has."""
    return summary.table_names(_t(spark, sf_dir, "documents").select(F.col("source").alias("repo_name"), F.col("lang").alias("language")))


# --- JSON, whole index runs, search in what they store ----------------------------------------------------------------


@query("""select 'c' || c_custkey repo_name, 'NAME' as name, split_part(c_name, '#', 1) as "default", split_part(c_name, '#', 2) as comment from customer""")
def payloads_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each customer's repository, saved as JSON in two goes, the second over a third of the first, and read."""
    c = _t(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    old = _sources(c, name, F.lit(".env.example"), F.when(F.col("c_custkey") % 3 == 0, "OLD=1").otherwise(F.concat(F.lit("NAME="), "c_name")))
    new = _sources(c.where("c_custkey % 3 = 0"), name, F.lit(".env.example"), F.concat(F.lit("NAME="), "c_name"))
    store = Store(spark, new_path(spark, "json"))
    for f in (old, new):
        store.save_json(extract.payloads({"env": extract.env_vars(f)}, f.select(F.col("repo_name").alias("name")).distinct()))
    return extract.payload_rows(store.load_json(), "env")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source (no source: ``none``), and a settings file for each source."""
    d = _t(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    name, root = F.col("source"), F.concat(F.lit("/w/"), F.col("source"))
    texts = d.select(name.alias("repo_name"), root.alias("repo_root"), F.concat(F.lit("d/"), "doc_id", F.lit(".json")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("double").alias("mtime"), F.col("text").alias("content"))
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    content = F.format_string("COUNT=%d # of %s\n", "n", "source")
    env = counts.select(name.alias("repo_name"), root.alias("repo_root"), F.lit(".env.example").alias("path"), F.length(content).cast("long").alias("size"), F.lit(1.0).alias("mtime"), content.alias("content"))
    files = texts.where("content is not null").unionByName(env)
    return files.withColumn("abs_path", F.concat("repo_root", F.lit("/"), "path")).select(*FILES.names)


def _stored(store: Store, stats: DataFrame) -> DataFrame:
    """(kind, key, value): chunks, manifest, settings and summaries of a store, and a run's statistics."""
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.alias("key"), value.cast("string").alias("value"))
    return (
        row(store.chunks(), "chunk", F.col("id"), F.length("text"))
        .union(row(store.manifest(), "file", F.col("abs_path"), F.concat_ws(" ", F.col("mtime").cast("long"), "chunk_count")))
        .union(row(store.structured("env"), "env", F.col("repo_name"), F.concat_ws(" ", "name", "default", "comment")))
        .union(row(store.summaries(), "repo", F.col("name"), F.concat_ws(" ", "stack", "chunk_count", F.map_contains_key("key_files", F.lit("env")).cast("string"))))
        .union(row(stats, "run", F.coalesce("repo_name", F.lit("all")), F.concat_ws(" ", "files_processed", "chunks_created")))
    )


def _windows_sql(name: str, files: str) -> str:
    """CTEs of all chunks (id, abs_path, repo_name, path, o characters before it, n characters) of files (repo_name, path, text): line windows of 512
    tokens that share 64, and lines over that cut every 2,048 characters."""
    return f"""
{name}_l as (select repo_name, path, unnest(lines) line, generate_subscripts(lines, 1) n from (select repo_name, path, list_filter(regexp_extract_all(text, '[^\\n]*\\n?'), lambda x: x <> '') lines from {files})),
{name}_p as (select repo_name, path, list(t order by n) t, list(c order by n) c from (select repo_name, path, n, sum(greatest(length(line) // 4, 1)) over w t, sum(length(line)) over w c from {name}_l window w as (partition by repo_name, path order by n)) group by all),
{name}_c as (select repo_name, path, t, c, 0 a, greatest(1, len(list_filter(t, lambda x: x <= 512))) b from {name}_p
 union all
 select repo_name, path, t, c, x, greatest(x + 1, len(list_filter(t, lambda y: y <= (case when x = 0 then 0 else t[x] end) + 512))) from (
  select repo_name, path, t, c, case when k > a then k else b end x from (select repo_name, path, t, c, a, b, least(len(list_filter(t, lambda y: y <= t[b] - 64)), b - 1) k from {name}_c where b < len(t)))),
{name}_w as (select repo_name, path, a, b, case when a = 0 then 0 else c[a] end o, c[b] - case when a = 0 then 0 else c[a] end n from {name}_c),
{name} as (select repo_name || ':' || path || ':' || (a + 1) || case when i > 0 then '#part' || i else '' end id, '/w/' || repo_name || '/' || path abs_path, repo_name, path, o + i * 2048 o, least(n - i * 2048, case when k > 1 then 2048 else n end)::bigint n
 from (select *, unnest(range(k::bigint)) i from (select *, case when b = a + 1 and n // 4 > 512 then (n + 2047) // 2048 else 1 end k from {name}_w)))"""


_CORPUS_SQL = """
docs as (select coalesce(source, 'none') repo_name, 'd/' || doc_id || '.json' path, doc_id mtime, text, doc_id from documents where text is not null),
env as (select coalesce(source, 'none') repo_name, '.env.example' path, 1 mtime, 'COUNT=' || count(*) || ' # of ' || coalesce(source, 'none') || chr(10) as text, -1 doc_id from documents group by source),
files as (select * from docs union all select * from env),
fits as (select * from files where strlen(text) <= 1048576)"""


def _stored_sql(chunks: str, files: str, env: str, counts: str, run: str) -> str:
    return f"""
select 'chunk' kind, id as key, n::varchar as value from {chunks}
union all select 'file', '/w/' || repo_name || '/' || path, mtime || ' ' || chunk_count from {files}
union all select 'env', repo_name, 'COUNT ' || split_part(split_part(text, '=', 2), ' ', 1) || ' of ' || repo_name from {env}
union all select 'repo', repo_name, 'unknown ' || chunk_count || ' ' || has from {counts}
union all select 'run', coalesce(repo_name, 'all'), count(*) || ' ' || coalesce(sum(chunk_count), 0)::bigint from {run} group by rollup (repo_name)"""


_FIRST_SQL = f"""with recursive {_CORPUS_SQL},
{_windows_sql("one", "fits")},
done as (select repo_name, path, mtime, coalesce(k, 0) chunk_count from fits left join (select abs_path, count(*) k from one group by 1) on abs_path = '/w/' || repo_name || '/' || path),
sums as (select repo_name, sum(chunk_count)::bigint chunk_count, true has from done group by 1)"""


@query(_FIRST_SQL + _stored_sql("one", "done", "env", "sums", "done"))
def index_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first run over all documents stores, and its statistics."""
    store = Store(spark, new_path(spark, "index"))
    stats = index.index(_corpus(spark, sf_dir), store, full=True)
    return _stored(store, stats)


@query(_FIRST_SQL + ", none as (select * from done where false)" + _stored_sql("one", "done", "env", "sums", "none").replace("rollup (repo_name)", "repo_name"))
def index_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a second run over the same documents, which takes in nothing."""
    store = Store(spark, new_path(spark, "index"))
    index.index(_corpus(spark, sf_dir), store)
    return _stored(store, index.index(_corpus(spark, sf_dir), store))


@query(f"""{_FIRST_SQL},
kept as (select * from docs where doc_id % 11 <> 0 union all select * from env where repo_name <> 'src1'),
edited as (select repo_name, path, mtime + 1 mtime, 'edited ' || text as text, doc_id from kept where doc_id % 7 = 0),
fresh as (select * from edited where strlen(text) <= 1048576),
{_windows_sql("two", "fresh")},
redone as (select repo_name, path, mtime, coalesce(k, 0) chunk_count from fresh left join (select abs_path, count(*) k from two group by 1) on abs_path = '/w/' || repo_name || '/' || path),
held as (select repo_name, path, mtime, chunk_count from redone
 union all select d.repo_name, d.path, d.mtime, d.chunk_count from done d join kept f on d.repo_name = f.repo_name and d.path = f.path where f.doc_id % 7 <> 0),
joined as (select id, n from one where id not in (select id from two) union all select id, n from two),
left_env as (select * from env where repo_name <> 'src1'),
tally as (select s.repo_name, case when coalesce(x, 0) > 0 then h.n else s.chunk_count end chunk_count, s.repo_name <> 'src1' has
 from sums s left join (select repo_name, sum(chunk_count)::bigint n from held group by 1) h using (repo_name) left join (select repo_name, sum(chunk_count) x from redone group by 1) using (repo_name))
{_stored_sql("joined", "held", "left_env", "tally", "redone")}""")
def index_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a second run, for which a tenth of the files and one source's settings are gone and a seventh
    has other text: chunks of files that are gone stay, as do those whose id no new chunk has."""
    first = _corpus(spark, sf_dir)
    store = Store(spark, new_path(spark, "index"))
    index.index(first, store)
    doc = F.regexp_extract("path", r"\Ad/(\d+)", 1).try_cast("long")
    kept = first.where(F.when(doc.isNotNull(), doc % 11 != 0).otherwise(F.col("repo_name") != "src1"))
    edit = F.coalesce(doc % 7 == 0, F.lit(False))
    text = F.when(edit, F.concat(F.lit("edited "), "content")).otherwise(F.col("content"))
    kept = kept.withColumns({"mtime": F.col("mtime") + F.when(edit, 1.0).otherwise(0.0), "content": text, "size": F.octet_length(text).cast("long")})
    return _stored(store, index.index(kept, store))


@query(f"""{_FIRST_SQL},
edited as (select repo_name, path, mtime + 1 mtime, 'edited ' || text as text from docs where repo_name = 'src3'),
fresh as (select * from edited where strlen(text) <= 1048576),
{_windows_sql("two", "fresh")},
redone as (select repo_name, path, mtime, coalesce(k, 0) chunk_count from fresh left join (select abs_path, count(*) k from two group by 1) on abs_path = '/w/' || repo_name || '/' || path),
held as (select * from redone union all select * from done where repo_name <> 'src3' or path not in (select path from redone)),
joined as (select id, n from one where id not in (select id from two) union all select id, n from two),
tally as (select s.repo_name, case when s.repo_name = 'src3' then h.n else s.chunk_count end chunk_count, has from sums s left join (select repo_name, sum(chunk_count)::bigint n from held group by 1) h using (repo_name))
{_stored_sql("joined", "held", "env", "tally", "redone")}""")
def index_one_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after a run over one repository, when all have other texts by then."""
    first = _corpus(spark, sf_dir)
    store = Store(spark, new_path(spark, "index"))
    index.index(first, store)
    doc = F.col("path").startswith("d/")
    text = F.when(doc, F.concat(F.lit("edited "), "content")).otherwise(F.col("content"))
    edited = first.withColumns({"mtime": F.col("mtime") + F.when(doc, 1.0).otherwise(0.0), "content": text, "size": F.octet_length(text).cast("long")})
    return _stored(store, index.index(edited, store, repos=["src3"]))


# Hashed words as both engines count them: the first four bytes of a word's MD5 modulo 64, and the last bit of the fifth.
_EMBEDDED_SQL = """
texts as (select id, substr(text, o::bigint + 1, n) t from one join fits using (repo_name, path)),
hashed as (select id, md5(w) h from (select id, unnest(string_split_regex(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), ' ')) w from texts) where w <> ''),
entries as (select id, ('0x' || substr(h, 1, 8))::bigint % 64 k, sum(case when ('0x' || substr(h, 9, 2))::int % 2 = 1 then 1 else -1 end) v from hashed group by all),
norms as (select id, sqrt(sum(v * v)) norm from entries group by 1),
vectors as (select e.id, k, (v / greatest(norm, 1e-12))::float::double v from entries e join norms using (id))"""


@query(f"""with recursive {_CORPUS_SQL},
{_windows_sql("one", "fits")}, {_EMBEDDED_SQL}
select t.id, round(coalesce(sum(v * (k + 1)), 0), 3) weighed, round(coalesce(sum(v * v), 0), 3) squares, coalesce(count(*) filter (v <> 0), 0)::bigint filled from texts t left join vectors using (id) group by t.id""")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all stored chunks, after a first run and one that knows the texts already."""
    store = Store(spark, new_path(spark, "index"))
    index.index(_corpus(spark, sf_dir), store)
    index.index(_corpus(spark, sf_dir), store, full=True)
    v = F.transform("vector", lambda x, i: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return store.chunks().select(
        "id", F.round(total(F.transform(v, lambda x, i: x * (i + 1))), 3).alias("weighed"), F.round(total(F.transform(v, lambda x: x * x)), 3).alias("squares"), F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("filled")
    )




def _vector_chunks(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """A stored chunk for each vector, of the document of its id."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = _t(spark, sf_dir, "documents").join(e, "doc_id")
    line = F.lit(1)
    return d.select(
        key.alias("id"), "text", F.col("source").alias("repo_name"), F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("/w/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id").alias("abs_file_path"), line.alias("start_line"),
        line.alias("end_line"), F.col("lang").alias("language"), F.lit("text").alias("chunk_type"), F.lit(None).alias("symbol_name"), F.lit(0.0).alias("file_mtime"), F.col("embedding").alias("vector"),
    )


@query(f"""
select '/w/' || coalesce(source, 'none') || '/' || doc_id file_path, coalesce(source, '') repo_name, round(1 / (1 + d), 6) score, row_number() over (order by d, doc_id) rank from (
 select doc_id, source, {_DISTANCE} d from documents join embeddings e on e.vec_id = doc_id, (select embedding from embeddings where vec_id = 2) q) order by d, doc_id limit 25""")
def search_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of stored chunks, fifty of which share each id: every row has its own distance."""
    store = Store(spark, new_path(spark, "hits"))
    store.write_chunks(_vector_chunks(spark, sf_dir, F.concat(F.lit("id"), F.col("doc_id") % 10)))
    q = [float(x) for x in _t(spark, sf_dir, "embeddings").where("vec_id = 2").first()["embedding"]]
    found = search.search(store.chunks(), q, limit=25)
    return found.select("file_path", "repo_name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
select '[' || row_number() over (order by d, doc_id) || '] score: ' || printf('%.3f', 1 / (1 + d)) || chr(10) || '/w/' || coalesce(source, 'none') || '/' || doc_id || ':1-1 (' || coalesce(source, '') || ')' || chr(10) || '```' || coalesce(lang, '') || chr(10) || text || chr(10) || '```' shown
from (select doc_id, source, lang, text, {_DISTANCE} d from documents join embeddings e on e.vec_id = doc_id, (select embedding from embeddings where vec_id = 3) q) order by d, doc_id limit 12""")
def search_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as callers see them, whole."""
    store = Store(spark, new_path(spark, "hits"))
    store.write_chunks(_vector_chunks(spark, sf_dir, F.format_string("%012d", "doc_id")))
    q = [float(x) for x in _t(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"]]
    found = search.search(store.chunks(), q, limit=12)
    return found.select(search.rendered(found).alias("shown"))


@query("""
with d as (select source, doc_id from documents join embeddings on vec_id = doc_id)
select 'kept' what, source repo_name, count(*) n, sum(doc_id)::bigint ids from d where source is distinct from 'src1' group by source
union all select 'deleted', 'src1', (select count(*) from d where source = 'src1'), null""")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store has after a repository is deleted from it, and how many chunks were."""
    store = Store(spark, new_path(spark, "hits"))
    store.write_chunks(_vector_chunks(spark, sf_dir, F.col("doc_id").cast("string")))
    n = store.delete_repo("chunks", "src1")
    kept = store.chunks().groupBy("repo_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))
    return kept.select(F.lit("kept").alias("what"), "repo_name", "n", "ids").union(spark.createDataFrame([("deleted", "src1", n, None)], "what string, repo_name string, n bigint, ids bigint"))


@query(f"""
select query_id, id, rank, round(distance, 6) distance from (
  select q.vec_id query_id, e.vec_id id, {_DISTANCE} distance, row_number() over (partition by q.vec_id order by {_DISTANCE}, e.vec_id) rank
  from embeddings e, embeddings q where q.vec_id % 50 = 0) where rank <= 7""")
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven nearest vectors to each of the queries (ids divisible by 50), queries and rows both dealt into blocks."""
    rows = _chunk_vectors(spark, sf_dir)
    found = search.nearest_each(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 7, query_block=4, row_block=max(200, rows.count() // 8))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""
select e.vec_id id, 'repo' || (e.vec_id % 5) repo_name, e.label::varchar "language", round(1 / (1 + {_DISTANCE}), 6) score
from embeddings e, embeddings q where q.vec_id = 7 and e.vec_id % 5 in (0, 2, 3) order by {_DISTANCE}, e.vec_id limit 15""")
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen nearest vectors of three repositories, by an index of cells around pivots over all vectors."""
    rows, path = _chunk_vectors(spark, sf_dir), new_path(spark, "pivots")
    pivots.build(rows, path)
    q = [float(x) for x in rows.where("id = 7").first()["vector"]]
    return pivots.nearest(spark, path, q, 15, ["repo0", "repo2", "repo3"]).select("id", "repo_name", "language", F.round("score", 6).alias("score"))


@query("""
select '/w/' || source || '/' || doc_id file_path, source repo_name, score, rank, '[' || rank || '] score: ' || printf('%.3f', score) head from (
 select *, round(1 / (1 + d), 6) score, row_number() over (order by d, doc_id) rank from (
  select doc_id, source, lang, list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d
  from documents join embeddings e on e.vec_id = doc_id, (select embedding from embeddings where vec_id = 1) q where lang in ('en', 'fr') and source is not null) order by d, doc_id limit 10)""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered hits among stored chunks of two languages: a chunk for each document that has a vector."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = _t(spark, sf_dir, "documents").where("source is not null").join(e, "doc_id")
    line = F.lit(1)
    rows = d.select(
        F.format_string("%012d", "doc_id").alias("id"), "text", F.col("source").alias("repo_name"), F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("/w/"), "source", F.lit("/"), "doc_id").alias("abs_file_path"), line.alias("start_line"),
        line.alias("end_line"), F.col("lang").alias("language"), F.lit("text").alias("chunk_type"), F.lit(None).alias("symbol_name"), F.lit(0.0).alias("file_mtime"), F.col("embedding").alias("vector"),
    )
    store = Store(spark, new_path(spark, "hits"))
    store.write_chunks(rows)
    q = [float(x) for x in e.where("doc_id = 1").first()["embedding"]]
    found = search.search(store.chunks(), q, languages=["en", "fr"], limit=10)
    return found.select("file_path", "repo_name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.substring_index(search.rendered(found), "\n", 1).alias("head"))


@query()
def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all document files, embedded by hashed words and stored, and the ten nearest to the first document's
    text."""
    store = Store(spark, new_path(spark, "search"))
    store.write_chunks(embed.embed_chunks(chunk.chunk_files(_files(spark, sf_dir), 512, 64), embed.hashed_words(64), 64, partitions=2 * spark.sparkContext.defaultParallelism))
    text = _t(spark, sf_dir, "documents").where("text is not null").orderBy("doc_id").first()["text"]
    return search.search(store.chunks(), embed.hashed_words(64)([text])[0], limit=10)
