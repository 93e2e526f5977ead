"""Files to chunks: one row a file until the last explode, so chunking needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import packing
from lodestack.functions import text as X
from lodestack.schemas import CHUNKS, SPANS

# What starts a block in each language.
MARKDOWN_HEADER = r"^(#{1,3})\s+(.+)$"
TYPESCRIPT_EXPORT = r"^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const)\b"
TYPESCRIPT_SYMBOL = r"\b(?:function|class|const)\s+([A-Za-z_][A-Za-z0-9_]*)"
YAML_KEY = r"^([A-Za-z0-9_.-][^:\n]*)\s*:"
COMPOSE_SERVICE = r"^\s{2}([A-Za-z0-9_.-]+)\s*:\s*$"
VUE_BLOCKS = ("template", "script", "style")

def _span(begin: str, line: str, text: str, kind: str, symbol: str) -> str:
    last = f"sp.line + {X.line_feeds('sp.text')} - int(endswith(sp.text, '\n'))"
    return X.let(f"struct({begin} as begin, {line} as line, {text} as text)", "sp", f"struct(sp.begin as begin, sp.line as start_line, greatest({last}, sp.line) as end_line, sp.text as text, {kind} as chunk_type, {symbol} as symbol_name)")


def _piece(kind: str, symbol: str) -> str:
    return _span("p.begin", "p.line", "p.text", kind, symbol)


def markdown_spans(text: str, most: int) -> str:
    """Sections of levels 1 to 3; each runs to the next header of its own level or above, so parents hold children."""
    levels = f"transform(hs, p -> length({X.group('p.text', MARKDOWN_HEADER, 1)}))"
    # For each level: the headers of that level or above, and how many of them each header has before or at it.
    ends = ", ".join(f"filter(sequence(0, greatest(size(lv), 1) - 1), i -> get(lv, i) <= {k}) as at{k}, {X.running(f'transform(lv, x -> int(x <= {k}))')} as n{k}" for k in (1, 2, 3))
    stop = "coalesce(case get(lv, j) when 1 then get(e.at1, get(e.n1, j + 1)) when 2 then get(e.at2, get(e.n2, j + 1)) else get(e.at3, get(e.n3, j + 1)) end, size(hs))"
    section = _span("p.begin", "p.line", f"array_join(transform(slice(hs, j + 1, {stop} - j), x -> x.text), '')", "'section'", X.stripped(X.group("p.text", MARKDOWN_HEADER, 2)))
    return X.let(X.matched_pieces(text, MARKDOWN_HEADER), "hs", X.let(levels, "lv", X.let(f"struct({ends})", "e", f"transform(hs, (p, j) -> {section})")))


def typescript_spans(text: str, most: int) -> str:
    """Exported functions, classes and constants, each to the next export."""
    kind = "case when ln rlike r'\\bfunction\\b' then 'function' when ln rlike r'\\bclass\\b' then 'class' else 'const' end"
    export = X.let("regexp_extract(p.text, r'\\A[^\\n]*', 0)", "ln", _piece(kind, f"nullif({X.group('ln', TYPESCRIPT_SYMBOL, 1)}, '')"))
    return f"transform({X.matched_pieces(text, TYPESCRIPT_EXPORT)}, p -> {export})"


def yaml_spans(text: str, most: int, name: str = "element_at(split(path, '/'), -1)") -> str:
    """Top-level keys; in a compose file with services, its services instead."""
    key = X.stripped(X.group("p.text", YAML_KEY, 1))
    keys = f"transform(top, p -> {_piece("'config'", key)})"
    service = _span("sv.begin + p.begin", "sv.line + p.line - 1", "p.text", "'config'", X.group("p.text", COMPOSE_SERVICE, 1))
    services = X.let(f"get(filter(top, p -> {key} = 'services'), 0)", "sv", f"transform({X.matched_pieces('sv.text', COMPOSE_SERVICE)}, p -> {service})")
    inner = X.let(f"if(contains({name}, 'docker-compose'), {services}, null)", "inner", f"if(size(inner) > 0, inner, {keys})")
    return X.let(X.matched_pieces(text, YAML_KEY), "top", inner)


def vue_spans(text: str, most: int) -> str:
    """template, script and style blocks in text order."""

    def blocks(tag: str) -> str:
        pattern = f"(?s)<{tag}\\b[^>]*>.*?</{tag}>"
        return f"transform({X.matched_pieces(text, pattern)}, p -> {_span('p.begin', 'p.line', f"regexp_extract(p.text, r'{pattern}', 0)", f"'{tag}'", f"'{tag}'")})"

    return f"array_sort(concat({', '.join(blocks(t) for t in VUE_BLOCKS)}))"


#: Chunkers by language, of Spark's own functions: (SQL of the text, token budget) -> SQL of SPANS. Further languages can
#: be added; those of ``packing.FINDERS`` go by its helper, all others by line windows.
CHUNKERS: dict[str, Callable[[str, int], str]] = {"markdown": markdown_spans, "typescript": typescript_spans, "yaml": yaml_spans, "vue": vue_spans}


def _cut_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Vue blocks over budget as line windows that keep type and symbol, their lines counted on from the block's first."""
    over = (F.col("language") == "vue") & (F.col("chunk_type") != "text") & (X.tokens(F.col("text")) > most)
    cut = rows.withColumn("w", packing.windows(F.when(over, F.col("text")), most, 64))
    whole = F.array(F.struct(F.lit(1).alias("start_line"), (F.col("end_line") - F.col("start_line") + 1).alias("end_line"), F.col("text").alias("text")))
    cut = cut.withColumn("w", F.explode(F.when(F.size("w") > 0, F.col("w")).otherwise(whole)))
    return cut.withColumns({"text": F.col("w.text"), "end_line": F.col("start_line") + F.col("w.end_line") - 1, "start_line": F.col("start_line") + F.col("w.start_line") - 1}).drop("w")


def enforce_budget(chunks: DataFrame, most: int) -> DataFrame:
    """Cut chunks over the budget; lines of the parts are estimated evenly. ``most`` of 0 or less: nothing is cut."""
    if most <= 0:
        return chunks
    over = X.tokens(F.col("text")) > most
    cut = chunks.withColumn("parts", packing.token_pieces(F.when(over, F.col("text")), most))
    cut = cut.withColumn("parts", F.when(over, F.col("parts")).otherwise(F.array("text")))
    cut = cut.withColumn("n", F.size("parts")).select("*", F.posexplode("parts").alias("i", "part"))
    each = F.greatest(F.floor(F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)) / F.col("n")), F.lit(1)).cast("int")
    start = F.col("start_line") + F.col("i") * each
    end = F.when(F.col("i") < F.col("n") - 1, F.col("start_line") + (F.col("i") + 1) * each - 1).otherwise(F.col("end_line"))
    parted = F.col("n") > 1
    return cut.withColumns({
        "id": F.when(F.col("i") > 0, F.format_string("%s#part%d", "id", "i")).otherwise(F.col("id")), "text": F.col("part"),
        "start_line": F.when(parted, start).otherwise(F.col("start_line")), "end_line": F.when(parted, F.greatest(end, start)).otherwise(F.col("end_line")),
    }).select(*chunks.columns)


def chunk_files(files: DataFrame, most: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks (schema CHUNKS) of a files table (schema FILES); null content has none.

    Files whose language has a chunker but no block, and all others, are cut to line windows; only the latter use
    ``overlap``, the former 64. Chunk ids are not unique across repositories of one name or blocks of one line. The files
    are read once: Spark's functions cut what they can, and only the text of other files goes to the Python helper.
    """
    language = X.language(F.col("path"))
    files = files.where(F.col("content") != "").select("repo_name", "path", "abs_path", "mtime", language.alias("language"), "content")
    native = F.coalesce(*[F.when(F.col("language") == name, F.expr(f("content", most)).cast(SPANS)) for name, f in CHUNKERS.items()])
    cut = files.withColumn("spans", native)
    cut = cut.withColumn("more", packing.helper_spans(F.when(F.coalesce(F.size("spans"), F.lit(0)) <= 0, F.col("content")), F.col("language"), most, overlap))
    rows = cut.select("repo_name", "path", "abs_path", "mtime", "language", F.explode(F.coalesce("more", "spans")).alias("r"))
    rows = rows.select("repo_name", "path", "abs_path", "mtime", "language", "r.text", "r.start_line", "r.end_line", "r.chunk_type", "r.symbol_name")
    out = _cut_blocks(rows, most).select(
        F.format_string("%s:%s:%d", "repo_name", "path", "start_line").alias("id"), "text", "repo_name", F.col("path").alias("file_path"), F.col("abs_path").alias("abs_file_path"),
        F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "language", "chunk_type", "symbol_name", F.col("mtime").alias("file_mtime"),
    )
    return enforce_budget(out, most).select(*CHUNKS.names)
