"""The chunkers as table functions of SQL.

    from lodestack.plans import sql
    sql.register(spark)
    spark.sql("select f.repo_name, c.* from files f, lateral file_chunks(f.repo_name, f.path, f.content) c")

They are SQL functions over Spark's own expressions: a lateral join with one is a projection of the files, not a join.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestack.functions import packing
from lodestack.functions import text as X
from lodestack.operators import chunk
from lodestack.schemas import SPANS

_BLOCK = "start_line int, end_line int, chunk_type string, symbol_name string, text string"


def _language() -> str:
    """SQL of a path's language."""
    name = "element_at(split(path, '/'), -1)"
    cases = " ".join(f"when '{suffix}' then '{language}'" for suffix, language in X.LANGUAGE_BY_SUFFIX.items())
    return f"case lower(regexp_extract({name}, r'(?s)^.+(\\.[^.]+)$', 1)) {cases} else 'text' end"


def _cut(spans: str) -> str:
    return f"select b.start_line, b.end_line, b.chunk_type, b.symbol_name, b.text from (select explode({spans}) b)"


def register(spark: SparkSession, most: int = 512, overlap: int = 64) -> None:
    """Register, for the session:

    * ``markdown_blocks(content)``, ``typescript_blocks(content)``, ``vue_blocks(content)``, ``yaml_blocks(path, content)``:
      a text's blocks, by Spark's functions alone;
    * ``text_windows(content)``: its line windows;
    * ``file_chunks(repo_name, path, content)``: the chunks of a file, as ``chunk.chunk_files`` has them with the same token
      budget and overlap. A null or empty content has none.
    """
    helpers = {"corpus_spans": packing.spans_udf(most, overlap), "corpus_windows": packing.windows_udf(most, overlap), "corpus_cuts": packing.windows_udf(most, 64), "corpus_pieces": packing.pieces_udf(most)}
    for name, udf in helpers.items():
        spark.udf.register(name, udf)

    def function(name: str, takes: str, gives: str, body: str) -> None:
        spark.sql(f"create or replace temporary function {name}({takes}) returns table ({gives}) return {body}")

    for name, spans in chunk.CHUNKERS.items():
        function(f"{name}_blocks", "path string, content string" if name == "yaml" else "content string", _BLOCK, _cut(spans("content", most)))
    function("text_windows", "content string", "start_line int, end_line int, text string", "select w.start_line, w.end_line, w.text from (select explode(corpus_windows(content)) w)")
    native = "case " + " ".join(f"when lang = '{name}' then cast({spans('content', most)} as {SPANS})" for name, spans in chunk.CHUNKERS.items()) + " end"
    over = "b.text is not null and int(length(b.text) / 4) > {most}".format(most=most)
    whole = "array(struct(1 as start_line, b.end_line - b.start_line + 1 as end_line, b.text as text))"
    budget = f"int(length(t) / 4) > {most}" if most > 0 else "false"
    last = "if(i < n - 1, s + (i + 1) * each - 1, e)"
    function(
        "file_chunks", "repo_name string, path string, content string", "id string, text string, start_line int, end_line int, language string, chunk_type string, symbol_name string",
        f"""select concat(repo_name, ':', path, ':', s, if(i > 0, concat('#part', i), '')), part, if(n > 1, s + i * each, s), if(n > 1, greatest({last}, s + i * each), e), lang, chunk_type, symbol_name from (
          select *, int(greatest(floor(greatest(e - s + 1, 1) / n), 1)) each from (
            select lang, chunk_type, symbol_name, s, e, size(parts) n, posexplode(parts) as (i, part) from (
              select lang, chunk_type, symbol_name, s, e, if({budget}, corpus_pieces(if({budget}, t, null)), array(t)) parts from (
                select lang, b.chunk_type, b.symbol_name, b.start_line + w.start_line - 1 s, b.start_line + w.end_line - 1 e, w.text t from (
                  select lang, b, explode(if(size(cut) > 0, cut, {whole})) w from (
                    select lang, b, corpus_cuts(if(lang = 'vue' and b.chunk_type <> 'text' and {over}, b.text, null)) cut from (
                      select lang, explode(coalesce(corpus_spans(if(coalesce(size(spans), 0) <= 0, content, null), lang), spans)) b from (
                        select *, {native} spans from (select {_language()} lang, repo_name, path, nullif(content, '') content)))))))))""",
    )
