"""Merkle manifest of a dataset: per-group hash trees under one root, built level by level, and proofs by a recursive query.

Every row is a leaf; H is the lower-case hexadecimal SHA-256 of its inputs one behind another, digests as hexadecimal text.
The leaves of a group (language) are in order of doc_id; level by level, every two nodes become their H, a single last
one its own H, until one is left, the group's subroot. The subroots, in order of their groups, are the leaves of the last
tree, whose last node is the root.

Built levels are stored as node rows that name the node above them (``levels``). A row climbs ``STRIDE`` levels at once: it
has the siblings on the way, and its parent is the node that many levels up, so that proofs of a large table take few steps
and each step's rows are few bytes. A recursive query (``climb``) starts at every leaf's own hash, or at that of its
tampered row, follows the parents to the root, appends the siblings and folds the hash with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered, sortable
from .store import settle

#: Levels that a node row climbs; a block of 2 ** STRIDE neighbours is put together to build them.
STRIDE = 10
#: Most upper node rows that are broadcast (some 700 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Most rows of a level that one task builds, to spare the shuffle.
FEW_ROWS = 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value in a leaf: its length in bytes and its text, ``-`` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row; ``changed`` columns take other values than the row's."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def tampered(doc_id: Column, every: int = 7) -> Column:
    """Whether a row is tampered with: the CRC-32 of its decimal id is divisible by ``every``; no id: never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


_PAIRS = "transform(sequence(0, (size(x) - 1) div 2), i -> sha2(concat(get(x, 2 * i), coalesce(get(x, 2 * i + 1), '')), 256))"
# array<array<string>>: the block's own hashes, and those of each level above them up to its top.
_LEVELS = f"aggregate(sequence(1, depth), array(hashes), (done, k) -> concat(done, array(get(transform(array(element_at(done, -1)), x -> {_PAIRS}), 0))))"


def levels(rows: DataFrame, stride: int = STRIDE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Node rows of one built stride. rows: tree, level, idx (place in the level), n (nodes of the tree's level), hash.

    Node rows: tree, level, idx, n, hash, up_level, up_idx, up_hash (the parent; level -1: the tree's last node), siblings
    (by level; null where a node is its level's single last one) and the ``keep`` columns. A tree of one node has it for
    its parent.
    """
    width = 1 << stride
    packed = F.array_sort(F.collect_list(F.struct("idx", "hash", *keep)))
    blocks = rows.where("n > 1").groupBy("tree", "level", "n", F.shiftright("idx", stride).alias("up_idx")).agg(packed.alias("own"))
    blocks = blocks.withColumns({"hashes": F.col("own.hash"), "depth": F.when(F.col("n") >= width, stride).otherwise(F.length(F.bin(F.col("n") - 1)))})
    blocks = blocks.withColumn("built", F.expr(_LEVELS))
    blocks = blocks.withColumns({"up_hash": F.get(F.element_at("built", -1), F.lit(0)), "up_level": F.when(F.col("n") <= width, -1).otherwise(F.col("level") + stride)})
    kept = "".join(f", o.{c} as {c}" for c in keep)
    nodes = F.expr(f"transform(own, (o, p) -> struct(o.idx as idx, o.hash as hash{kept}, transform(sequence(0, depth - 1), k -> unhex(get(get(built, k), shiftright(p, k) ^ 1))) as siblings))")
    nodes = blocks.select("tree", "level", "n", "up_level", "up_idx", "up_hash", F.explode(nodes).alias("node")).select("tree", "level", "n", "node.*", "up_level", "up_idx", "up_hash")
    alone = rows.where("n = 1").select("tree", "level", "n", "idx", "hash", *keep, F.array().cast("array<binary>").alias("siblings"), F.lit(-1).alias("up_level"), F.col("idx").alias("up_idx"), F.col("hash").alias("up_hash"))
    return nodes.unionByName(alone)


def above(nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Rows of the level that node rows climb to, but for the trees' last nodes."""
    first = nodes.where(f"idx % {1 << stride} = 0 and up_level <> -1")
    return first.select("tree", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.ceil(F.col("n") / (1 << stride)).cast("long").alias("n"), F.col("up_hash").alias("hash"))


def few(rows: DataFrame) -> DataFrame:
    """Rows in one task if they are counted to be few."""
    return rows.coalesce(1) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def build(leaves: DataFrame, stride: int = STRIDE, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows of the leaves, node rows of all levels above, last nodes of the trees). leaves: settled rows of tree,
    level 0, idx, n, hash and the ``keep`` columns."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    first = nodes = settle(levels(few(leaves), stride, keep), "merkle-leaves")
    upper, last = first.drop(*keep).limit(0), []
    while True:
        last.append(nodes.where("up_level = -1 and idx = 0").select("tree", F.col("up_hash").alias("hash")))
        if most <= 1 << stride:
            break
        nodes = settle(levels(few(above(nodes, stride)), stride), "merkle-nodes")
        upper, most = upper.unionByName(nodes), (most + (1 << stride) - 1) >> stride
    return first, upper, reduce(DataFrame.unionByName, last)


# A hash folded with the siblings of its row, as bytes: each sibling stands left of odd places and right of even ones.
_FOLDED = "unhex(aggregate({siblings}, struct({hash} as h, {idx} as i), (a, s) -> struct(sha2(case when s is null then a.h when a.i % 2 = 1 then concat(lower(hex(s)), a.h) else concat(a.h, lower(hex(s))) end, 256) as h, shiftright(a.i, 1) as i), a -> a.h))"

_CLIMB = """
with recursive climb(doc_id, leaf, subroot, folded, proof, tree, level, idx) as (
  select doc_id, unhex(hash), unhex(if(up_level = -1, up_hash, null)), {start}, {first}, tree, up_level, up_idx from {{leaves}}
  union all
  select c.doc_id, c.leaf, coalesce(c.subroot, unhex(if(n.up_level = -1, n.up_hash, null))), {fold}, {append}, n.up_tree, n.up_level, n.up_idx
  from climb c join {{nodes}} n on c.tree = n.tree and c.level = n.level and c.idx = n.at
)
select doc_id, lower(hex(leaf)) leaf, lower(hex(subroot)) subroot, sha2(lower(hex(proof)), 256) proof_sha256, lower(hex(folded)) folded_root
from climb where tree = '' and level = -1"""


def _bytes(array: str) -> str:
    return f"aggregate({array}, unhex(''), (b, s) -> concat(b, coalesce(s, unhex(''))))"


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256, folded_root of every leaf row (with ``start``, the hash to fold), by a
    recursive query over node rows. nodes: as of ``levels``, with at (the place by which rows below name them) and up_tree. Few node rows are broadcast, many are joined by
    shuffle."""
    spark = leaves.sparkSession
    sql = _CLIMB.format(
        start=_FOLDED.format(siblings="siblings", hash="start", idx="idx"), first=_bytes("siblings"), fold=_FOLDED.format(siblings="n.siblings", hash="lower(hex(c.folded))", idx="n.idx"), append=f"concat(c.proof, {_bytes('n.siblings')})"
    )
    if nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    key = "spark.sql.cteRecursionRowLimit"
    limit = spark.conf.get(key)
    spark.conf.set(key, "-1")  # a row a leaf and step
    try:
        # Each step deals its rows out anew, maybe to very many tasks; a file for each would cost more than the rows.
        return settle(spark.sql(sql, leaves=leaves, nodes=nodes).coalesce(-(-leaves.count() // FEW_ROWS) or 1), "merkle-climb")
    finally:
        spark.conf.set(key, limit)


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``.

    A null language is a group of its own, the first one; rows of equal ids are in order of their hashes, and repeated rows
    are a leaf each, in any order (they are alike). Null values are written as ``-``, empty and very long texts as they
    are. Tampering adds 1 to n_chars; a row whose n_chars or doc_id is null verifies. Extra columns are ignored. An empty
    table gives an empty result.
    """
    bad = F.when(tampered(F.col("doc_id")), leaf(n_chars=F.col("n_chars") + 1))
    tree = F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("n"))
    hashed = docs.select(*[F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c) for c in COLUMNS])
    rows = settle(hashed.select("doc_id", tree.alias("tree"), F.lit(0).alias("level"), leaf().alias("hash"), bad.alias("bad")), "merkle-rows")
    placed = numbered(rows.withColumn("start", F.coalesce("bad", "hash")).drop("bad"), "tree", F.concat(sortable(F.col("doc_id")), F.lit("!"), "hash"))
    leaves, nodes, subroots = build(settle(placed, "merkle-placed"), stride, ("doc_id", "start"))
    # The last tree's leaves are the groups' last nodes: their parent rows are found by the group's name.
    tops = settle(numbered(few(subroots.withColumn("group", F.lit(""))), "group", F.col("tree")).select(F.lit("").alias("tree"), F.lit(0).alias("level"), "idx", "n", "hash", F.col("tree").alias("of")), "merkle-tops")
    joint, over, root = build(tops, stride, ("of",))
    linked = lambda df: df.select("tree", "level", "at", "idx", "siblings", "up_tree", "up_level", "up_idx", "up_hash")
    own = lambda df: df.withColumns({"at": F.col("idx"), "up_tree": F.col("tree")})
    entry = joint.withColumns({"up_tree": F.col("tree"), "tree": F.col("of"), "level": F.lit(-1), "at": F.lit(0).cast("long")})
    links = settle(linked(own(nodes)).unionByName(linked(own(over))).unionByName(linked(entry)), "merkle-links")
    climbed = climb(leaves, links)
    found = climbed.withColumn("root", F.lit((root.first() or [None, None])[1]).cast("string"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
