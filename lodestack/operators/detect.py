"""Stack of each repository, from marker files in its whole listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (stack, language, framework, markers that must all be there, key paths), first match wins.
STACKS = [
    ("laravel", "php", "Laravel", ["composer", "artisan"], {"routes": "routes/api.php", "migrations": "database/migrations", "models": "app/Models", "controllers": "app/Http/Controllers", "env": ".env.example", "docker": "docker-compose.yml", "tests": "tests"}),
    ("php", "php", "Generic PHP", ["composer"], {"env": ".env.example", "docker": "docker-compose.yml", "tests": "tests"}),
    ("go-chi", "go", "Chi", ["gomod", "internal_server"], {"docker": "docker-compose.yml", "tests": "tests"}),
    ("go", "go", "Generic Go", ["gomod"], {"docker": "docker-compose.yml", "tests": "tests"}),
    ("vue", "typescript", "Vue 3", ["package", "vue"], {"env": ".env.example", "docker": "docker-compose.yml", "tests": "tests"}),
    ("nextjs", "typescript", "Next.js", ["package", "next"], {}),
    ("nuxt", "typescript", "Nuxt", ["package", "nuxt"], {}),
    ("node", "javascript", "Node.js", ["package"], {}),
    ("rust", "rust", "Rust", ["cargo"], {}),
    ("dotnet", "csharp", ".NET", ["dotnet"], {}),
    ("java", "java", "Java", ["java"], {}),
    ("unknown", "unknown", "Unknown", [], {}),
]


def markers(path: Column) -> dict[str, Column]:
    """Marker predicates of one path; a folder shows by a path below it."""
    return {
        "composer": path == "composer.json", "artisan": (path == "artisan") | path.startswith("artisan/"), "gomod": path == "go.mod", "internal_server": path.startswith("internal/server/"),
        "package": path == "package.json", "vue": path.rlike(r"(?s)(\A|/)[^/]*\.vue(/|\z)"), "next": path.rlike(r"(?s)\Anext\.config\.[^/]*(/|\z)"), "nuxt": path.rlike(r"(?s)\Anuxt\.config\.[^/]*(/|\z)"),
        "cargo": path == "Cargo.toml", "dotnet": path.rlike(r"(?s)(\A|/)[^/]*\.(csproj|sln)(/|\z)"), "java": (path == "pom.xml") | path.rlike(r"(?s)\Abuild\.gradle[^/]*(/|\z)"),
        "cmd": path.startswith("cmd/"), "internal": path.startswith("internal/"), "env": path == ".env.example", "compose": path == "docker-compose.yml",
    }


def profiles(listing: DataFrame) -> DataFrame:
    """(name, path, stack, language, framework, key_paths) of each repository. listing: (repo_name, repo_root, path) of
    all its files, whatever is indexed. One map-side combined aggregate; no content is read."""
    found = listing.groupBy("repo_name", "repo_root").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, c in markers(F.col("path")).items()])

    def first(pick) -> Column:
        out = None
        for row in STACKS:
            hit = F.lit(True)
            for m in row[3]:
                hit = hit & F.col(f"_{m}")
            out = F.when(hit, pick(row)) if out is None else out.when(hit, pick(row))
        return out

    empty = F.create_map().cast("map<string,string>")
    fixed = first(lambda r: F.create_map(*[F.lit(x) for p in r[4].items() for x in p]) if r[4] else empty)
    # Go with the chi layout names its folders; every stack names env and compose files that are there.
    extra = [F.when(cond, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, v, cond in (
        ("cmd", "cmd", (F.col("stack") == "go-chi") & F.col("_cmd")), ("internal", "internal", (F.col("stack") == "go-chi") & F.col("_internal")),
        ("env", ".env.example", F.col("_env") & ~F.map_contains_key("fixed", F.lit("env"))), ("docker", "docker-compose.yml", F.col("_compose") & ~F.map_contains_key("fixed", F.lit("docker"))),
    )]
    named = found.select("*", first(lambda r: F.lit(r[0])).alias("stack"), first(lambda r: F.lit(r[1])).alias("language"), first(lambda r: F.lit(r[2])).alias("framework"), fixed.alias("fixed"))
    keys = F.map_concat("fixed", F.map_from_entries(F.filter(F.array(*extra), lambda e: e.isNotNull())))
    return named.select(F.col("repo_name").alias("name"), F.col("repo_root").alias("path"), "stack", "language", "framework", keys.alias("key_paths"))
