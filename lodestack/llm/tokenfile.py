"""Token-id files of bit-plane or byte-plane chunks.

A file set is a Parquet table that Spark writes and commits, so it can be in any store and survives lost executors.
Documents are in ascending doc_id order (nulls first), cut into shards by range; each shard is one run of token ids,
every document's followed by the end id, cut into chunks of ``CHUNK`` ids (the last may be short). A chunk row has

* shard, chunk: its place; n_tokens: its ids; first_token: ids of its shard before it; bytes: size of its planes;
* planes: its ids transposed into planes, each compressed with zstandard - four byte planes (plane k has byte k of
  every id, little end first) or 32 bit planes (plane k has bit k of every id, packed);
* crc32 of its ids as little-endian unsigned 32-bit integers, checked by the reader;
* doc_ids, doc_begins, doc_lengths: the documents that begin in it (place in the shard, ids with the end id);
* continues: where the document began that runs into it, null if none does.

The chunk index is a second, small table of the set: everything but planes and documents, with each chunk's global first
token, by which ``read_range`` finds any range of ids without touching other chunks. Chunks are decoded where they lie;
only documents that run over several of them are moved, to be put together.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bound_batches, new_path, packed
from .textkit import SLICE_BYTES, buffers, running_sums, runs, slices, span_hash, span_ids

CHUNK = 1 << 16
END_ID = 2
#: Text bytes that a shard holds, about.
SHARD_BYTES = 24 << 20
#: Most shards whose starts are broadcast.
BROADCAST_ROWS = 1_000_000
#: Distinct pieces of a generation whose ids a worker remembers.
REMEMBERED = 300_000

CHUNK_SCHEMA = (
    "shard int, chunk int, n_tokens bigint, first_token bigint, bytes bigint, crc32 bigint, continues bigint, planes array<binary>, doc_ids array<bigint>, doc_begins array<bigint>, doc_lengths array<bigint>"
)

_bytes = np.arange(256)
_BLANK = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
# First bytes of white space beyond ASCII, among other characters.
_MAYBE_BLANK = _BLANK | np.isin(_bytes, [0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = ((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) & (_bytes < 128)
# ASCII letters, and those of two bytes from U+00C0 on that are letters to every version of the rule.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
_SIGN = (_bytes > 32) & (_bytes < 127) & ~_LETTER & ~((_bytes >= 48) & (_bytes <= 57)) & (_bytes != 39)


def pieces(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start (UTF-8 bytes; ``offsets`` of the texts and their end).

    The tokenizer's own rule splits a text before the last white space ahead of a word, behind it too unless it is a
    space, and between a letter and a sign other than the apostrophe, whatever else is near; pieces are cut at such places
    only, so that encoding them one by one gives the text's ids. Where a byte could begin other white space, nothing is
    cut.
    """
    n = len(text)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        letter, sign = _LETTER[text], _SIGN[text]
        latin = (text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7)  # letters of two bytes
        begins = letter.copy()
        begins[:-1] |= latin
        letter[1:] |= latin
        last = _BLANK[text[:-1]] & ~_MAYBE_BLANK[text[1:]]
        cut[: n - 1] = last
        cut[np.maximum(offsets[1:] - 1, 0)] = False  # nothing follows a text's last character
        cut[1:n] |= (letter[:-1] & sign[1:]) | (sign[:-1] & begins[1:]) | (last & (text[:-1] != 32))
    cut[offsets] = True
    return np.flatnonzero(cut)[:-1]


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable in Latin-1, else the next
    letter from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


#: Settings of a vocabulary file under which texts may be encoded piece by piece.
_PIECEWISE = {
    "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False, "byte_fallback": False},
}


def piecewise(settings: dict) -> bool:
    """Whether a vocabulary file has the splitting rule that ``pieces`` knows, and nothing that looks over its pieces."""

    def agrees(want, have) -> bool:
        return isinstance(have, dict) and all(agrees(v, have.get(k)) for k, v in want.items()) if isinstance(want, dict) else want == have or (want is False and have is None)

    return agrees(_PIECEWISE, settings)


class Encoder:
    """Encodes texts with a tokenizers file: as the library does, but each distinct piece once.

    Pieces are remembered in two generations of ``REMEMBERED`` each, so that frequent ones stay. Literals of added tokens
    (``<|endoftext|>``, say) give those tokens' ids: a text that holds one is encoded whole, not by pieces. So is every
    text if the file's rules are not those that ``pieces`` knows (``piecewise``).
    """

    def __init__(self, path: str):
        # One thread: Spark has a task on each core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        with open(path, "rb") as f:
            settings = json.load(f)
        self.literals, self.piecewise = [t["content"] for t in settings.get("added_tokens") or []], piecewise(settings)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are ordinary text
        self.letters = str.maketrans({chr(b): x for b, x in enumerate(_byte_letters())})
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer as it comes."""
        return type(self.tokenizer).from_file(self.path)

    def ids_of(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = [p for p in distinct if p not in known]
        known.update((p, older[p]) for p in missing if p in older)
        new = [p for p in missing if p not in older]
        # Letters, with or without a space before them, are one word of the vocabulary's model, which then needs no
        # splitting, only its own letters for the bytes.
        tokenize, letters, rest = self.tokenizer.model.tokenize, self.letters, []
        for p in new:
            word = p[1:] if p[0] == 32 else p
            if word.isalpha():
                known[p] = array("I", [t.id for t in tokenize("\u0120" + word.decode() if p[0] == 32 else p.decode())]).tobytes()
            elif _LATIN.fullmatch(word):
                known[p] = array("I", [t.id for t in tokenize(p.decode("latin-1").translate(letters))]).tobytes()
            else:
                rest.append(p)
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        return list(map(known.__getitem__, distinct))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        marked = np.full(len(texts), not self.piecewise)
        for x in self.literals if self.piecewise else ():
            marked |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode(texts)
        out = self._encode(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
        for i in np.flatnonzero(marked).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py() or "", add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        text, offsets = buffers(texts)
        starts = pieces(text, offsets)
        ends = np.append(starts[1:], len(text))
        of, rep = span_ids(text, span_hash(running_sums(text), starts, ends), starts, ends)
        raw = text.tobytes()
        found = self.ids_of([raw[a:b] for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), "<u4")[runs(begin[of], size[of])].tobytes()
        total = np.concatenate([[0], np.cumsum(size[of])]) * 4
        cut = total[np.searchsorted(starts, offsets)].tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a Python worker keeps it, and the pieces it remembers, from task to task."""
    return Encoder(path)


def pack(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Compressed planes of a block of ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = [np.packbits((raw[:, k >> 3] >> (k & 7)) & 1) for k in range(32)] if bits else [raw[:, k] for k in range(4)]
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(p.tobytes()) for p in planes]


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    """The block of n ids whose planes these are (4: byte planes, 32: bit planes)."""
    z = zstandard.ZstdDecompressor()
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        data = np.frombuffer(z.decompress(p), np.uint8)
        if len(planes) == 4:
            raw[:, k] = data
        else:
            raw[:, k >> 3] |= np.unpackbits(data, count=n) << (k & 7)
    return raw.view("<u4").ravel()


class _Shard:
    """Collects the documents of one shard and gives out full chunks."""

    def __init__(self, shard: int, chunk: int, bits: bool):
        self.shard, self.size, self.bits = shard, chunk, bits
        self.held: list[bytes] = []
        self.pending, self.done, self.nth = 0, 0, 0
        self.docs: list[tuple[int | None, int, int]] = []
        self.open: tuple[int, int] = (0, 0)  # begin and end of the last document that began in a chunk given out

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.done + self.pending, len(ids) // 4))
        self.held.append(ids)
        self.pending += len(ids) // 4

    def chunks(self, rest: bool = False) -> Iterator[dict]:
        if not self.pending or (self.pending < self.size and not rest):
            return
        ids = np.frombuffer(b"".join(self.held), "<u4")
        at = 0
        while len(ids) - at >= self.size or (rest and at < len(ids)):
            block = ids[at : at + self.size]
            end = self.done + len(block)
            cut = next((i for i, d in enumerate(self.docs) if d[1] >= end), len(self.docs))
            own, self.docs = self.docs[:cut], self.docs[cut:]
            planes = pack(block, self.bits)
            continues = self.open[0] if self.open[1] > self.done else None
            if own:
                self.open = own[-1][1], own[-1][1] + own[-1][2]
            yield {
                "shard": self.shard, "chunk": self.nth, "n_tokens": len(block), "first_token": self.done, "bytes": sum(map(len, planes)), "crc32": zlib.crc32(block.tobytes()), "continues": continues, "planes": planes,
                "doc_ids": [d[0] for d in own], "doc_begins": [d[1] for d in own], "doc_lengths": [d[2] for d in own],
            }
            self.nth, self.done, at = self.nth + 1, end, at + len(block)
        self.held, self.pending = [ids[at:].tobytes()], len(ids) - at


_arrow = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32())] + [(c, pa.int64()) for c in ("n_tokens", "first_token", "bytes", "crc32", "continues")] + [("planes", pa.list_(pa.binary()))] + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_begins", "doc_lengths")]
)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES, bits: bool = False) -> None:
    """Encode ``text`` of every row (null: empty) and write chunks to ``path``/chunks and their index to ``path``/index.

    Shards are ranges of doc_id, and of a hash of the text among rows of one id, which stay next to each other. An empty
    table gives empty tables. tokenizer: the vocabulary file, at a path that every executor has.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, end = _Shard(TaskContext.get().partitionId(), chunk, bits), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, most=3 * SLICE_BYTES):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(tokenizer).encode(part.column("text")), strict=True):
                shard.add(doc_id, ids + end)
            if rows := list(shard.chunks()):
                yield pa.RecordBatch.from_pylist(rows, _arrow)
        if rows := list(shard.chunks(rest=True)):
            yield pa.RecordBatch.from_pylist(rows, _arrow)

    # The text's hash splits one id with very many rows (no id, say) over shards.
    ordered = docs.withColumn("key", F.xxhash64("text")).repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    ordered.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    index = read_chunks(docs.sparkSession, path).drop("continues", "planes", "doc_ids", "doc_begins", "doc_lengths")
    index.join(shard_starts(docs.sparkSession, path), "shard").withColumn("global_first", F.col("shard_start") + F.col("first_token")).drop("shard_start").write.parquet(f"{path}/index")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids in the shards before it. One row a shard, so bounded by input bytes / ``shard_bytes``;
    groups of shards are summed first, so that no task sees all of them. Marked for broadcast up to ``BROADCAST_ROWS``."""
    totals = read_chunks(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.col("shard").bitwiseAND(~1023))
    upto = lambda w: F.coalesce(F.sum("n").over(w.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).withColumnRenamed("part", "shard")
    parts = parts.select(F.col("shard").alias("part"), upto(Window.partitionBy()).alias("ahead"))
    found = totals.withColumn("before", upto(Window.partitionBy("part"))).join(parts, "part").select("shard", (F.col("ahead") + F.col("before")).alias("shard_start"))
    return F.broadcast(found) if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found


def _decoded(row: dict, path: str) -> np.ndarray:
    """The ids of a chunk row, checked."""
    ids = unpack(row["planes"], row["n_tokens"])
    if zlib.crc32(ids.tobytes()) != row["crc32"]:
        raise ValueError(f"{path}: shard {row['shard']}, chunk {row['chunk']}: wrong checksum")
    return ids


_PARTS = ["shard", "doc_id", "begin", "n", "at", "ids"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, the end id among them, and the ids of all documents before it."""

    def run(batches: Iterable[pa.RecordBatch], broken: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                ids, first = _decoded(row, path), row["first_token"]
                docs = list(zip(row["doc_ids"], row["doc_begins"], row["doc_lengths"], strict=True))
                parts = [(d, b, n, b, ids[b - first : b - first + n]) for d, b, n in docs if (b - first + n > len(ids)) == broken]
                if broken and row["continues"] is not None:
                    parts.insert(0, (None, row["continues"], None, first, ids[: docs[0][1] - first] if docs else ids))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(parts), pa.int32()), *columns, pa.array([p[4].tobytes() for p in parts], pa.binary())], _PARTS)

    bound_batches(spark)
    kinds = "shard int, doc_id bigint, begin bigint, n bigint, at bigint, ids binary"
    chunks = read_chunks(spark, path)
    whole = chunks.mapInArrow(partial(run, broken=False), kinds).select("shard", "doc_id", "begin", "ids")
    end, last = F.col("first_token") + F.col("n_tokens"), F.try_element_at("doc_begins", F.lit(-1)) + F.try_element_at("doc_lengths", F.lit(-1))
    parts = chunks.where(F.col("continues").isNotNull() | F.coalesce(last > end, F.lit(False))).mapInArrow(partial(run, broken=True), kinds)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("ids").alias("ids")))), lambda x: x["ids"])
    joined = parts.groupBy("shard", "begin").agg(F.max("doc_id").alias("doc_id"), F.unhex(F.array_join(ordered, "")).alias("ids"))
    found = whole.unionByName(joined)
    return found.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "ids")


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(start, ids) of the ids from place ``start`` on, ``n`` of them or to the end, in parts by chunk. The index tells
    which chunks hold them, and only their rows are read; a range has about n / ``CHUNK`` of those."""
    index = spark.read.parquet(f"{path}/index").where((F.col("global_first") < start + n) & (F.col("global_first") + F.col("n_tokens") > start))
    wanted = {(r["shard"], r["chunk"]): r["global_first"] for r in index.select("shard", "chunk", "global_first").collect()}
    shards: dict[int, list[int]] = {}
    for s, c in wanted:
        shards.setdefault(s, []).append(c)
    there = F.lit(False)
    for s, chunks in shards.items():
        there = there | ((F.col("shard") == s) & F.col("chunk").between(min(chunks), max(chunks)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = wanted[row["shard"], row["chunk"]]
                a, b = max(start - first, 0), min(start + n - first, row["n_tokens"])
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([_decoded(row, path)[a:b].tobytes()], pa.binary())], ["start", "ids"])

    return read_chunks(spark, path).where(there).mapInArrow(run, "start bigint, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write all documents to a new file set in the shared folder and digest what it reads back.

    Repeated rows and rows of one id each have their own run of ids; null text has the end id alone; an empty table gives
    an empty result. Extra columns are ignored.
    """
    path = new_path(docs.sparkSession, "tokens")
    write(packed(docs)[0], path, tokenizer, **how)
    return digest(docs.sparkSession, path)
