"""Content sort, Merkle manifest and whitening against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import contentsort, merkle, queries, ranges, whitening

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, salt int, `range` string, run string, tree int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, n_chars), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, None if i == 5 else f"s{(i or 0) % 2}", n, 1, "r", "x", 2) for i, t, g, n in rows], DOCS)


ODD = [(1, "a", "en", 1), (2, "a", "en", 1), (3, None, "de", None), (4, "", "de", 0), (5, "é" * 40_000, None, 40_000), (6, "é" * 40_000, "en", 40_000), (7, "é" * 39_999 + "è", "en", None), (None, "a", "en", 1), (2, "a", "en", 1), (2, "b", "en", 1), (9, "A", "fr", 1), (None, None, None, None)]


def plain_duplicates(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = (known[-1] if largest else known[0]) if known else None
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("range_bytes", [1, 1 << 20])
def test_content_sort_equals_plain_groups(spark, range_bytes, largest):
    """In ranges so small that groups are cut, too."""
    rows = ODD + [(100 + i, f"copy {i % 3}" if i % 2 else f"own {i}", "en", 5) for i in range(120)]
    got = contentsort.duplicates(docs(spark, rows), largest, range_bytes=range_bytes)
    assert sorted_rows(got) == plain_duplicates([(r[0], r[1]) for r in rows], largest)


def test_content_sort_of_a_hot_group_is_dealt_out(spark, monkeypatch):
    """A third of all rows is one text: it lies in several ranges, and is one group."""
    monkeypatch.setattr(ranges, "SAMPLED", 50)
    kept = []
    monkeypatch.setattr(contentsort, "settle", lambda df, name: kept.append(df) or df)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = {r.doc_id: r for r in contentsort.duplicates(rows, range_bytes=10_000).collect()}
    assert len({r["range"] for r in kept[0].where(F.col("text_sha256") == F.sha2(F.lit("hot"), 256)).collect()}) > 3
    assert all(got[i].keep_id == (2997 if i % 3 == 0 else i) and got[i].group_size == (1000 if i % 3 == 0 else 1) and got[i].kept == (i == 2997 or i % 3 > 0) for i in range(3000))


def test_content_sort_normalises_and_takes_empty_tables(spark):
    rows = docs(spark, ODD)
    got = contentsort.duplicates(rows, normalise=lambda t: F.lower(t))
    assert sorted_rows(got) == plain_duplicates([(i, (t or "").lower()) for i, t, _, _ in ODD])
    none = contentsort.duplicates(rows.limit(0))
    assert none.isEmpty() and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_content_sort_has_no_python(spark, small):
    plan = queries.op12_exact_dedup(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ranges(spark):
    assert ranges.cuts([(c, 1) for c in "abcdefgh"], 4) == ["c", "e", "g"]
    assert ranges.cuts([("a", 100), ("b", 1)], 4) == ["b"] and ranges.cuts([], 3) == []
    keys = spark.createDataFrame([(k,) for k in ("", "b", "bb", "c", "z")], "k string")
    for at in ([], ["b"], ["b", "c"], ["a", "b", "bb", "c", "d", "e", "y"]):
        assert {r.k: r.n for r in keys.select("k", ranges.range_of(F.col("k"), at).alias("n")).collect()} == {k: sum(a <= k for a in at) for k in ("", "b", "bb", "c", "z")}
    numbers = spark.createDataFrame([(x,) for x in (None, -(2**63), -5, -1, 0, 1, 9, 2**63 - 1)], "x bigint").select("x", ranges.sortable(F.col("x")).alias("k"))
    assert [r.x for r in sorted(numbers.collect(), key=lambda r: r.k)] == [None, -(2**63), -5, -1, 0, 1, 9, 2**63 - 1]


def test_places_in_groups(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    got = ranges.numbered(rows, "g", ranges.sortable(F.col("x")), range_rows=40).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [r.idx for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, add=0):
    n = r.n_chars if r.n_chars is None else r.n_chars + add
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)])


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_way(levels, i):
    """(sibling or None, whether it stands to the left) of each level."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, bool(i & 1)))
        i >>= 1
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees.append(plain_tree([plain_leaf(r) for r in groups[g]]))
    joint = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            way = plain_way(trees[k], i) + plain_way(joint, k)
            h = plain_leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for sibling, left in way:
                h = digest(h) if sibling is None else digest(sibling, h) if left else digest(h, sibling)
            out.append((r.doc_id, plain_leaf(r), trees[k][-1][0], joint[-1][0], digest(*[s for s, _ in way if s]), h, h == joint[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("stride", [2, 10])
def test_manifest_equals_plain_trees(spark, stride):
    rows = docs(spark, ODD + [(20 + i, f"t{i}", ("en", "de", "x")[i % 3], i) for i in range(75)])
    got = sorted_rows(merkle.manifest(rows, stride))
    assert got == plain_manifest(rows.collect())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in (ODD[:1], ODD[4:5] + ODD[:1] * 3):
        df = docs(spark, rows)
        assert sorted_rows(merkle.manifest(df)) == plain_manifest(df.collect())
    none = merkle.manifest(docs(spark, []))
    assert none.isEmpty() and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_with_joins_by_shuffle_and_its_setting(spark, monkeypatch):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = docs(spark, [(i, f"t{i}", "en", i) for i in range(70)])
    assert sorted_rows(merkle.manifest(rows, 3)) == plain_manifest(rows.collect()) and spark.conf.get(key) == before


VECTORS = "vec_id bigint, embedding array<float>, x string, component int, n string"


def whitened(spark, vectors, wanted=16):
    df = spark.createDataFrame([(i, v, "x", 0, "n") for i, v in vectors], VECTORS)
    return whitening.whiten(df, wanted).collect()


def plain_whitening(vectors, wanted):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in vectors])
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    y = u - u.mean(axis=0)
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return n, ((n * x - total) ** 2).sum(axis=1), ((x - total / n) @ q) / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[0].tolist()) for i in range(300, 400)] + [(1, base[1].tolist()), (None, base[2].tolist())]
    bad = [(1000, None), (1001, [None] + base[0].tolist()[1:]), (1002, [float("nan")] * 24), (1003, [float("inf")] * 24), (1004, []), (1005, [-float("inf")] + base[0].tolist()[1:])]
    got = whitened(spark, vectors + bad, 16)
    n, far, white, explained = plain_whitening(vectors, 16)
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n} == {300}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    place = {i: k for k, (i, _) in enumerate(vectors)}
    for r in got:
        k = place[r.vec_id]
        assert r.deviation == far[k] and abs(abs(r.whitened) - abs(white[k, r.component - 1])) < 1e-8 and abs(r.explained - explained[r.component - 1]) < 1e-12
    signs = {np.sign(r.whitened * white[place[r.vec_id], r.component - 1]) for r in got if r.component == 1}
    assert len(signs) == 1


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []  # no variance
    flat = whitened(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    far = whitened(spark, [(i, [1e5 * i, 1e5 * (i % 2)]) for i in range(6)])
    assert {r.component for r in far} == {1, 2} and far[0].identity_error < 1e-9
    with pytest.raises(ValueError, match="as many"):
        whitened(spark, [(1, [1.0]), (2, [1.0, 2.0])])
    with pytest.raises(Exception, match="too large"):
        whitened(spark, [(1, [1e30]), (2, [1.0])])


@pytest.mark.parametrize("spectrum", [np.arange(1, 41) / 40, np.r_[[5.0] * 3, [4.0] * 2, np.arange(35) / 100], np.ones(40), 10.0 ** -np.arange(40), np.r_[[3.0] * 12, [2.0] * 8, [1.0] * 20], np.r_[[5.0] * 3, np.zeros(37)]])
def test_components_equal_those_of_a_dense_solver(spectrum):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((40, 40)))[0]
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 16)
    want = np.sort(spectrum)[::-1][: len(values)]
    assert len(values) == min(16, int((spectrum > 40e-14 * spectrum.max()).sum()))
    assert np.abs(values - want).max() < 1e-13 * spectrum.max() * 10 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * spectrum.max() * 10
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(6)
    for d in (1, 2, 9, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in rng.standard_normal(20) * d**0.5:
            assert whitening.inertia(a, shift) == (e > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.inertia(np.zeros((3, 3)), 0.0) == 0
