"""Registered queries of the training-data operators, over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contentsort, decontam, langid, lm, merkle, mixing, neardup, pii, quality, tokencount, tokenfile, urltrust, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
p as (select distinct item_id, least(10, len(w)) k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') x from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
o as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') x from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from p) where len(w) >= k)),
m as (select doc_id, i, o.k, item_id from o join p on o.k = p.k and o.x = p.x),
h as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from m) group by 1),
t as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, item_id::varchar s from m where item_id is not null) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join t using (doc_id)"""


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokencount.from_ranks(tokenizer_path("byte_bpe_50k.tiktoken")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "false_rejection")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.duplicates(_table(spark, sf_dir, "documents"))


OP12_SQL = """
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 kept, sha256(coalesce(text, '')) text_sha256
from documents window w as (partition by coalesce(text, ''))"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text"))) + ")"


# CRC-32, bit by bit: xor with the polynomial where the last bit is set.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of trees: (tree, level, idx, n, hash) from leaves (tree, idx, n, hash)."""
    return f"""{name}(tree, level, idx, n, hash) as (select tree, 0, idx, n, hash from {leaves} union all
  select tree, level + 1, idx // 2, (n + 1) // 2, sha256(hash || coalesce(other, '')) from (select *, lead(hash) over (partition by tree order by idx) other from {name} where n > 1) where idx % 2 = 0)"""


def _climb_sql(name: str, start: str, nodes: str) -> str:
    """Each start (key, tree, level, idx, hash, proof) up to its tree's last node."""
    return f"""{name}(key, tree, level, idx, n, hash, proof) as (select key, tree, 0, idx, n, hash, proof from {start} union all
  select key, c.tree, c.level + 1, c.idx // 2, (c.n + 1) // 2, sha256(case when s.hash is null then c.hash when c.idx % 2 = 1 then s.hash || c.hash else c.hash || s.hash end), proof || coalesce(s.hash, '')
  from {name} c left join {nodes} s on s.tree = c.tree and s.level = c.level and s.idx = xor(c.idx, 1) where c.n > 1)"""


OP13_SQL = f"""
with recursive h as (select doc_id, coalesce('v' || lang, 'n') tree, {_leaf_sql("n_chars")} leaf, case when {_CRC_SQL} % 7 = 0 then {_leaf_sql("n_chars + 1")} end bad from documents),
l as (select *, leaf hash, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by tree) n, row_number() over () key from h),
{_tree_sql("up", "l")},
t as (select tree of, '' tree, row_number() over (order by tree) - 1 idx, count(*) over () n, hash from up where n = 1),
{_tree_sql("over_all", "t")},
s as (select key, tree, idx, n, coalesce(bad, leaf) hash, '' proof from l),
{_climb_sql("first_climb", "s", "up")},
s2 as (select key, t.tree, t.idx, t.n, c.hash, c.proof from first_climb c join t on c.tree = t.of where c.n = 1),
{_climb_sql("second_climb", "s2", "over_all")}
select doc_id, leaf, t.hash subroot, r.hash root, sha256(c.proof) proof_sha256, c.hash folded_root, c.hash = r.hash verified
from l join second_climb c using (key) join t on t.of = l.tree, (select hash from over_all where n = 1) r where c.n = 1"""


QUERIES = {"op1_url_trust": op1_url_trust, "op2_decontamination": op2_decontamination, "op3_token_files": op3_token_files, "op4_language_id": op4_language_id, "op5_personal_data": op5_personal_data, "op6_language_model": op6_language_model, "op7_token_counts": op7_token_counts, "op8_near_duplicates": op8_near_duplicates, "op9_mixing": op9_mixing, "op10_quality_rules": op10_quality_rules, "op11_whitening": op11_whitening, "op12_exact_dedup": op12_exact_dedup, "op13_merkle_manifest": op13_merkle_manifest}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op12_exact_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
