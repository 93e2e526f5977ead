"""Typed rows from source text: routes, migrations, environment variables and compose services."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import text as X
from lodestack.schemas import CATEGORIES, DOCKER

# The patterns of routes and migrations.
LARAVEL_ROUTE = r"""(?i)Route::(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]\s*,\s*(.+?)\)\s*;"""
LARAVEL_RESOURCE = r"""(?i)Route::resource\s*\(\s*['"]([^'"]+)['"]\s*,\s*(.+?)\)\s*;"""
LARAVEL_GROUP = r"(?i)Route::middleware\((.*?)\)\s*->\s*group\s*\(\s*function"
GO_ROUTE = r"""(?i)\b(?:\w+\.)?(Get|Post|Put|Delete|Patch|Route)\s*\(\s*['"]([^'"]+)['"]\s*,\s*([^\n\r\)]+)"""
GO_HANDLE_FUNC = r"""(?i)\b(?:mux|http)\.HandleFunc\s*\(\s*['"]([^'"]+)['"]\s*,\s*([^\n\r\)]+)"""
LARAVEL_TABLE = r"""(?i)Schema::create\s*\(\s*['"]([^'"]+)['"]"""
LARAVEL_COLUMN = r"""(?i)\$table->\w+\s*\(\s*['"]([^'"]+)['"]"""
SQL_TABLE = r"""(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"]?([a-zA-Z_][\w]*)[`"]?\s*\((.*?)\)\s*;"""
SQL_CONSTRAINTS = ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CONSTRAINT", "INDEX")
LARAVEL_ROUTE_FILES = ("routes/api.php", "routes/web.php")
GO_ROUTER_FILES = ("main.go", "server.go", "routes.go", "router.go")
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def _no_list() -> Column:
    return F.array().cast("array<string>")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _lines(files: DataFrame) -> DataFrame:
    """(repo_name, path, abs_path, n, line): stripped, numbered lines that aren't empty."""
    lines = files.select("repo_name", "path", "abs_path", F.posexplode(F.split("content", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("n", "line"))
    return lines.withColumn("line", X.strip(F.col("line"))).where("line <> ''")


def routes_laravel(files: DataFrame, strict_scope: bool = False) -> DataFrame:
    """ROUTES of the two route files. A middleware group holds from its line until its braces, counted on every line from
    a depth of 1, are closed: as the group's own line opens one more, routes behind a closed group still get its
    middleware. ``strict_scope`` counts from 0 and so ends a group where its own brace ends. The state is one window a file."""
    lines = _lines(files.where(F.col("path").isin(*LARAVEL_ROUTE_FILES))).dropDuplicates(["abs_path", "n"])
    group = F.col("line").rlike(LARAVEL_GROUP)
    file = Window.partitionBy("abs_path")
    seg = lines.withColumn("seg", F.sum(group.cast("int")).over(file.orderBy("n")))
    braces = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    here = Window.partitionBy("abs_path", "seg").orderBy("n")
    seg = seg.withColumn("depth", F.lit(0 if strict_scope else 1) + F.sum(braces).over(here))
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    active = (F.col("seg") > 0) & ~F.coalesce(F.bool_or(F.col("depth") <= 0).over(before), F.lit(False))
    scoped = seg.withColumn("middleware", F.when(active, X.quoted_list(F.regexp_extract(F.first("line").over(here), LARAVEL_GROUP, 1))).otherwise(_no_list()))
    route = scoped.where(F.col("line").rlike(LARAVEL_ROUTE)).select("repo_name", "path", "n", F.lit(0).alias("k"), F.upper(F.regexp_extract("line", LARAVEL_ROUTE, 1)).alias("method"), F.regexp_extract("line", LARAVEL_ROUTE, 2).alias("p"), F.regexp_extract("line", LARAVEL_ROUTE, 3).alias("handler"), "middleware")
    resource = scoped.where(F.col("line").rlike(LARAVEL_RESOURCE)).select("repo_name", "path", "n", F.lit(1).alias("k"), F.lit("RESOURCE").alias("method"), F.regexp_extract("line", LARAVEL_RESOURCE, 1).alias("p"), F.regexp_extract("line", LARAVEL_RESOURCE, 2).alias("handler"), "middleware")
    return _route_rows(route.unionByName(resource))


def _route_rows(found: DataFrame) -> DataFrame:
    """ROUTES and where they stand: file, place."""
    return found.select("repo_name", "method", X.strip(F.col("p")).alias("path"), X.strip(F.col("handler")).alias("handler"), "middleware", F.lit(None).cast("string").alias("name"), F.col("path").alias("file"), "n", "k")


def routes_go(files: DataFrame) -> DataFrame:
    """ROUTES of the usual router files and all Go files below cmd and internal, or of all Go files of a repository that
    has none of these. A file that is listed twice counts once; only its routes are compared for that."""
    go = files.where(F.col("path").endswith(".go"))
    likely = F.col("path").isin(*GO_ROUTER_FILES) | F.col("path").startswith("cmd/") | F.col("path").startswith("internal/")
    repos = go.groupBy("repo_name").agg(F.bool_or(likely).alias("has"))  # one row a repository, without content
    chosen = go.join(repos, "repo_name").where(likely | ~F.col("has"))
    c = F.col("content")
    verbs = F.arrays_zip(F.transform(_all(c, GO_ROUTE, 1), F.upper).alias("method"), _all(c, GO_ROUTE, 2).alias("p"), _all(c, GO_ROUTE, 3).alias("handler"))
    funcs = F.arrays_zip(F.transform(_all(c, GO_HANDLE_FUNC, 1), lambda x: F.lit("HANDLEFUNC")).alias("method"), _all(c, GO_HANDLE_FUNC, 1).alias("p"), _all(c, GO_HANDLE_FUNC, 2).alias("handler"))
    kind = "array<struct<method:string,p:string,handler:string>>"
    rows = chosen.select("repo_name", "path", "abs_path", F.posexplode(F.concat(verbs.cast(kind), funcs.cast(kind))).alias("n", "r")).dropDuplicates(["abs_path", "n"])
    return _route_rows(rows.select("repo_name", "path", "n", F.lit(0).alias("k"), "r.*", _no_list().alias("middleware")))


def migrations_laravel(files: DataFrame) -> DataFrame:
    """MIGRATIONS: the first table that each migration file creates, with its columns in first-seen order."""
    mine = files.where(F.col("path").rlike(r"(?s)\Adatabase/migrations/[^/]+\.php\z") & F.col("content").rlike(LARAVEL_TABLE))
    return mine.select("repo_name", X.base_name(F.col("path")).alias("file_name"), F.regexp_extract("content", LARAVEL_TABLE, 1).alias("table_name"), F.array_distinct(_all(F.col("content"), LARAVEL_COLUMN, 1)).alias("columns"), F.col("path").alias("file"), F.lit(0).alias("n"))


def migrations_sql(files: DataFrame) -> DataFrame:
    """MIGRATIONS: every table that a SQL migration creates; columns are its lines but for those of constraints."""
    mine = files.where(F.col("path").rlike(r"(?s)\A(?:database/)?migrations/[^/]+\.sql\z"))
    both = F.arrays_zip(_all(F.col("content"), SQL_TABLE, 1).alias("t"), _all(F.col("content"), SQL_TABLE, 2).alias("b"))
    rows = mine.select("repo_name", "path", F.posexplode(both).alias("n", "m"))
    clean = F.transform(F.split("m.b", "\r\n|[\n\r]"), lambda x: F.regexp_replace(X.strip(x), ",+$", ""))
    constraint = lambda x: F.array_contains(F.array(*[F.startswith(F.upper(x), F.lit(k)) for k in SQL_CONSTRAINTS]), True)
    columns = F.filter(clean, lambda x: (x != "") & ~constraint(x))
    return rows.select("repo_name", X.base_name(F.col("path")).alias("file_name"), F.col("m.t").alias("table_name"), columns.alias("columns"), F.col("path").alias("file"), "n")


def env_vars(files: DataFrame) -> DataFrame:
    """ENV of each root ``.env.example``: text behind the first ``#`` of a value is its comment; repeats stay."""
    lines = _lines(files.where("path = '.env.example'")).where(~F.col("line").startswith("#") & F.contains(F.col("line"), F.lit("=")))
    key, value = X.split_first(F.col("line"), "=")
    lines = lines.select("repo_name", "n", X.strip(key).alias("name"), X.strip(value).alias("value"))
    default, comment = X.split_first(F.col("value"), "#")
    return lines.select("repo_name", "name", X.strip(default).alias("default"), X.strip(F.coalesce(comment, F.lit(""))).alias("comment"), "n")


#: Nodes of a document: the place of each (its number among its siblings, from the root down), what the node above it is,
#: its key in a map, what it is itself (map, list, text or other) and its text (of maps and lists from the third level on).
NODES = "array<struct<place:array<int>,inside:string,name:string,kind:string,value:string>>"
#: Nodes below this depth stay inside the text of those at it.
NODE_DEPTH = 4


def document_nodes(text: str | None) -> list[tuple]:
    """NODES of a YAML text, in its order and without the root; of broken YAML none."""
    import yaml

    kind = lambda v: {dict: "map", list: "list", str: "text"}.get(type(v), "other")
    try:
        todo = [((), yaml.safe_load(text or ""))]
    except yaml.YAMLError:
        return []
    out = []
    while todo:
        place, node = todo.pop()
        if len(place) < NODE_DEPTH and kind(node) in ("map", "list"):
            named = node.items() if kind(node) == "map" else ((None, x) for x in node)
            for i, (name, x) in enumerate(named):
                out.append(((*place, i), kind(node), None if name is None and kind(node) == "list" else str(name), kind(x), str(x) if len(place) > 1 or kind(x) in ("text", "other") else None))
                todo.append(((*place, i), x))
    return sorted(out)


def compose_services(files: DataFrame) -> DataFrame:
    """DOCKER: services of each repository's first compose file by name, in its order. A helper gives the nodes of the
    file (PyYAML, on the executors); what a service is made of is told from these by Spark's functions."""
    rank = F.coalesce(*[F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate(COMPOSE_FILES)])
    mine = files.where(F.col("path").isin(*COMPOSE_FILES))
    first = mine.groupBy("repo_name").agg(F.min_by("path", rank).alias("path"))

    @F.pandas_udf(NODES)
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(document_nodes)

    chosen = mine.join(first, ["repo_name", "path"]).select("repo_name", parse("content").alias("nodes"))
    below = lambda nodes, top: F.filter(nodes, lambda x: (F.size(x["place"]) == F.size(top["place"]) + 1) & (F.slice(x["place"], 1, F.size(top["place"])) == top["place"]))
    root = F.filter("nodes", lambda x: (F.size(x["place"]) == 1) & (x["inside"] == "map") & (x["name"] == "services"))
    each = chosen.select("repo_name", "nodes", F.explode(root).alias("root")).where("root.kind = 'map'")
    each = each.select("repo_name", "nodes", F.posexplode(below(F.col("nodes"), F.col("root"))).alias("n", "service")).where("service.kind = 'map'")
    each = each.withColumn("fields", below(F.col("nodes"), F.col("service")))
    named = lambda k: F.get(F.filter("fields", lambda x: x["name"] == k), F.lit(0))
    field = {k: named(k) for k in ("image", "ports", "environment", "depends_on")}
    values = lambda k: F.coalesce(F.transform(below(F.col("nodes"), field[k]), lambda x: x["value"]), F.array())
    names = lambda k: F.transform(below(F.col("nodes"), field[k]), lambda x: x["name"])
    pairs = F.transform(below(F.col("nodes"), field["environment"]), lambda x: F.concat(x["name"], F.lit("="), x["value"]))
    of = lambda k, how: F.when(field[k]["kind"] == "map", how).otherwise(values(k))
    letters = F.filter(F.split(field["ports"]["value"], ""), lambda c: c != "")
    return each.select(
        "repo_name", F.col("service.name").alias("name"), F.coalesce(field["image"]["value"], F.lit("")).alias("image"), F.when(field["ports"]["kind"] == "text", letters).otherwise(of("ports", names("ports"))).alias("ports"),
        of("environment", pairs).alias("environment"), of("depends_on", names("depends_on")).alias("depends_on"), "n",
    )


@dataclass(frozen=True)
class Extractor:
    """Rows of a category from the files of some stacks (none: of all). paths: whether it reads a file."""

    category: str
    find: Callable[[DataFrame], DataFrame]
    paths: Callable[[Column], Column]
    stacks: tuple[str, ...] = ()


#: What is extracted. Further extractors can be added; those of one category give the same columns.
EXTRACTORS = [
    Extractor("routes", routes_laravel, lambda p: p.isin(*LARAVEL_ROUTE_FILES), ("laravel",)),
    Extractor("routes", routes_go, lambda p: p.endswith(".go"), ("go", "go-chi")),
    Extractor("migrations", migrations_laravel, lambda p: p.startswith("database/migrations/"), ("laravel",)),
    Extractor("migrations", migrations_sql, lambda p: p.endswith(".sql"), ("go", "go-chi")),
    Extractor("env", env_vars, lambda p: p == ".env.example"),
    Extractor("docker", compose_services, lambda p: p.isin(*COMPOSE_FILES)),
]


def extractable(files: DataFrame, extractors: list[Extractor] = EXTRACTORS) -> DataFrame:
    """Rows of the files that some extractor reads."""
    wanted = F.lit(False)
    for x in extractors:
        wanted = wanted | x.paths(F.col("path"))
    return files.where(wanted)


def extract_structured(files: DataFrame, profiles: DataFrame, extractors: list[Extractor] = EXTRACTORS) -> dict[str, DataFrame]:
    """The categories of typed rows of all repositories. files: whole table, whatever is indexed; profiles: name and
    stack. Each extractor gets its own paths, which are chosen before stacks are joined."""
    out: dict[str, DataFrame] = {}
    for x in extractors:
        mine = files.where(x.paths(F.col("path")))
        if x.stacks:
            mine = mine.join(profiles.where(F.col("stack").isin(*x.stacks)).select(F.col("name").alias("repo_name")).distinct(), "repo_name", "left_semi")
        found = x.find(mine)
        out[x.category] = out[x.category].unionByName(found) if x.category in out else found
    return out


def payloads(found: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """(repo_name, category, payload): JSON of each category of each repository, empty ones too, in order of appearance."""
    out = None
    for category, rows in found.items():
        columns = [c for c in CATEGORIES[category].names if c != "repo_name"]
        order = [c for c in ("file", "n", "k") if c in rows.columns]
        items = rows.groupBy("repo_name").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("row")))), lambda x: x["row"]).alias("items"))
        empty = profiles.select(F.col("name").alias("repo_name"))
        one = empty.join(items, "repo_name", "left").select("repo_name", F.lit(category).alias("category"), F.coalesce(F.to_json("items", {"ignoreNullFields": "false"}), F.lit("[]")).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def payload_rows(payloads: DataFrame, category: str) -> DataFrame:
    """The typed rows (schema of the category) that its payloads hold; text that isn't such JSON has none."""
    schema = CATEGORIES[category]
    kind = T.ArrayType(T.StructType([f for f in schema.fields if f.name != "repo_name"]))
    rows = payloads.where(F.col("category") == category).select("repo_name", F.explode(F.from_json("payload", kind)).alias("r"))
    return rows.where("r is not null").select("repo_name", "r.*").select(*schema.names)
