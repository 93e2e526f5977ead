"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_list = T.ArrayType(_s)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: One row a source file; ``path`` is relative to the repository, ``abs_path`` names the file everywhere.
FILES = _table(repo_name=_s, repo_root=_s, path=_s, abs_path=_s, size=_l, mtime=_d, content=_s)
CHUNKS = _table(id=_s, text=_s, repo_name=_s, file_path=_s, abs_file_path=_s, start_line=_i, end_line=_i, language=_s, chunk_type=_s, symbol_name=_s, file_mtime=_d)
STORED = T.StructType([*CHUNKS.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
ROUTES = _table(repo_name=_s, method=_s, path=_s, handler=_s, middleware=_list, name=_s)
MIGRATIONS = _table(repo_name=_s, file_name=_s, table_name=_s, columns=_list)
ENV = _table(repo_name=_s, name=_s, default=_s, comment=_s)
DOCKER = _table(repo_name=_s, name=_s, image=_s, ports=_list, environment=_list, depends_on=_list)
CATEGORIES = {"routes": ROUTES, "migrations": MIGRATIONS, "env": ENV, "docker": DOCKER}
SUMMARIES = _table(name=_s, stack=_s, framework=_s, key_files=T.MapType(_s, _s), models=_list, endpoints_count=_l, chunk_count=_l, last_indexed=_s)
MANIFEST = _table(abs_path=_s, repo_name=_s, mtime=_d, chunk_count=_l)
#: Where the rows of a table's repositories are: a part (one write) and its bucket; how many they are, and how many rows
#: that bucket of the part has in all.
LIVE = _table(repo_name=_s, part=_s, bucket=_i, n=_l, total=_l)
#: Vectors of texts by their digests.
VECTORS = _table(digest=T.BinaryType(), vector=T.ArrayType(T.FloatType()))
#: Payloads in a store: ``repo_name`` is the key of repository and category together, ``name`` the repository.
PAIRED = _table(repo_name=_s, name=_s, category=_s, payload=_s)
HITS = _table(chunk_text=_s, file_path=_s, repo_name=_s, start_line=_i, end_line=_i, language=_s, chunk_type=_s, symbol_name=_s, score=_d)

#: Blocks of a file that become chunks: characters before it, its lines, text, type and symbol.
SPANS = "array<struct<begin:int,start_line:int,end_line:int,text:string,chunk_type:string,symbol_name:string>>"
#: A run of lines that becomes a chunk.
PIECES = "array<struct<start_line:int,end_line:int,text:string>>"
