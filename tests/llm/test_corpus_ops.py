"""Token files, the language model, token counts, near duplicates and mixing against plain versions; the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestack.llm import lm, mixing, neardup, queries, tokencount, tokenfile
from lodestack.llm.textkit import mix as mix_hash

from test_filters import odd  # noqa: I001

BPE = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)  # as it comes


def test_encoder_equals_library(tokenizer):
    rng = random.Random(1)
    e = tokenfile.Encoder(BPE)
    texts = ["", " ", "don't  we'll", "a\x85b", "x\x1cy \x1c !\x1c!", "<|endoftext|>", "\n\n x"]
    texts += ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "b9", "é", "!", "\u00a0", "\u3000", "\x1c", "'s", "1", "\x85", "(", ",", "×", "ü", "_", "²", "日"]) for _ in range(12)) for _ in range(3000)]
    got = e.encode(pa.array([*texts, None]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 3)
    e = tokenfile.Encoder(BPE)
    for t in ("one two three four five", "two six seven", "one two eight"):
        assert np.frombuffer(e.encode(pa.array([t]))[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    for n in (1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
        assert (tokenfile.unpack(tokenfile.pack(ids, bits), n) == ids).all() and len(tokenfile.pack(ids, bits)) == (32 if bits else 4)


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, small, tokenizer, tmp_path, bits):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = f"file://{tmp_path}/t"
    tokenfile.write(docs, path, BPE, chunk=3000, shard_bytes=100_000, bits=bits)
    got = {r.doc_id: r for r in tokenfile.digest(spark, path).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    index = spark.read.parquet(f"{path}/index").orderBy("global_first").collect()
    assert len({r.shard for r in index}) > 1 and index[-1].global_first + index[-1].n_tokens == start
    assert [r.global_first for r in index] == np.cumsum([0] + [r.n_tokens for r in index])[:-1].tolist()


def test_token_files_odd_rows(spark):
    rows = tokenfile.round_trip(odd(spark), BPE).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 2, 3, 4] and rows[-2].n_tokens == 1
    assert tokenfile.round_trip(odd(spark).limit(0), BPE).count() == 0


def test_token_files_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)  # as it comes
    texts = ["one<|endoftext|>two", "<|endoftext|>", " a <|endoftext|>  <|endoftext|>b!\n", "plain <|endof text|>", None, "don't (stop)"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = 0
    for r, t in zip(tokenfile.round_trip(d, BPE).orderBy("doc_id").collect(), texts, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ranges_and_long_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(BPE), random.Random(3)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (3, 900, 1, 0, 5000, 2, 40, 700)]
    path = f"file://{tmp_path}/t"
    tokenfile.write(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, BPE, chunk=64, shard_bytes=9000)
    each = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == each and [r.start for r in got] == np.cumsum([0] + [len(x) for x in each])[:-1].tolist()
    every = [i for x in each for i in x]
    for start, n in ((0, 1), (63, 2), (64, 64), (1000, 900), (len(every) - 5, 100), (len(every), 3)):
        parts = sorted(tokenfile.read_range(spark, path, start, n).collect(), key=lambda r: r.start)
        assert [i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist()] == every[start : start + n]
        assert not parts or parts[0].start == start


def test_other_vocabularies_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(BPE, "rb") as f:
        settings = json.load(f)
    assert tokenfile.piecewise(settings)
    settings["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings))
    plain, texts = Tokenizer.from_file(str(other)), ["one two", "", "x\ny (z)", "a<|endoftext|>b"]
    for path in (str(other), queries.tokenizer_path("word_bpe_49k.json")):
        plain, e = Tokenizer.from_file(path), tokenfile.Encoder(path)
        assert not e.piecewise and [np.frombuffer(g, "<u4").tolist() for g in e.encode(pa.array([*texts, None]))] == [plain.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_unmix():
    x = np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64)
    assert (lm.unmix(mix_hash(x)) == x).all() and (lm.unpack_sorted(lm.pack_sorted(np.sort(x))) == np.sort(x)).all()


def test_language_model(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3000)  # many buckets
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in lm.score_held_out(docs).collect()}
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + ["</s>"] for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs = collections.Counter(w for t in train for w in t), collections.Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v, cont, follows, kinds = sum(c.values()), len(c), collections.Counter(w for _, w in pairs), collections.Counter(), {}
    for (a, _), k in pairs.items():
        follows[a] += k
        kinds.setdefault(a, [0] * 4)[min(k, 3)] += 1
    discounts = lambda xs: lm.discounts(np.array([len(xs), *(sum(x == k for x in xs) for k in (1, 2, 3, 4))]))
    d2, d1 = discounts(list(pairs.values())), discounts(list(cont.values()))
    rest = sum(d1[min(x, 3)] for x in cont.values()) / len(pairs)

    def p(a, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / len(pairs) + rest / (v + 1)
        if a not in follows:
            return low
        return max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) / follows[a] + sum(d2[k] * kinds[a][k] for k in (1, 2, 3)) / follows[a] * low

    assert abs(sum(p("the", w) for w in c) + sum(d2[k] * kinds["the"][k] for k in (1, 2, 3)) / follows["the"] * rest / (v + 1) - 1) < 1e-9
    for i, t in texts.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t)), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)


def test_language_model_odd_rows(spark):
    d = odd(spark)
    rows = lm.score_held_out(d).collect()
    assert len(rows) == 7 and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert lm.score_held_out(d.limit(0)).count() == 0
    untrained = lm.score_held_out(d.where("doc_id is null")).first()
    assert untrained.score == 0 and untrained.train_tokens == 0


def plain_count(word, pieces):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        best.append(max((best[j][0] + pieces[word[j:i]], best[j][1] - 1) for j in range(max(0, i - 130), i) if word[j:i] in pieces))
    return -best[-1][1]


def test_token_counts(spark, small):
    import base64

    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    order = sorted(ranks, key=lambda x: (len(x) == 1, ranks[x]))
    total = math.log(sum(1 / (i + 1) for i in range(len(order))))
    pieces = {x: -math.log(i + 1) - total for i, x in enumerate(order)}
    texts = ["", "  a", "a  b", "x\n y \n\n z ", " ", "é ñ", "a" * 300, None] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(15).collect()]
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r for r in tokencount.count_tokens(d, tokencount.from_ranks(path)).collect()}
    memo = {}
    for i, t in enumerate(texts):
        words = re.findall(rb" ?[^ \t-\r]+|[ \t-\r]+?(?= [^ \t-\r])|[ \t-\r]+", (t or "").encode())
        for w in words:
            if w not in memo:
                memo[w] = plain_count(w, pieces)
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(words), sum(memo[w] for w in words))
    assert tokencount.count_tokens(odd(spark), tokencount.Vocabulary({b"a": -1.0})).count() == 7
    with pytest.raises(ValueError):
        tokencount.Vocabulary({})


def test_alignment():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(400):
        a = rng.sample(range(100), rng.randint(1, 40))
        b = [x for x in a if rng.random() < 0.93] + rng.sample(range(100, 120), rng.randint(0, 4))
        if b and rng.random() < 0.3:
            b.insert(0, b.pop())
        want = (m := lcs(a, b)) / (len(a) + len(b) - m)
        got = neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_near_duplicates(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in docs]
    for k, r in enumerate(docs[:60]):  # near copies: two words in a hundred changed, so all are well above the limit
        w = (r.text or "").split(" ")
        if len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
            rows += [(10_000 + k, " ".join(w)), (20_000 + k, " ".join(w))]
    d = spark.createDataFrame([(*x, "e") for x in rows], "doc_id bigint, text string, class_id string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    # All pairs, exactly.
    h, first = neardup.labelled_shingles(pa.array([t for _, t in rows]))
    sets = [h[first[i] : first[i + 1]] for i in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s.tolist() for j in holders[x] if j > i}:
            if rows[i][1] == rows[j][1] or neardup.aligned(s, sets[j]) > 0:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = {x: min(g) for g in groups.values() for x in g}
    assert got == want
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(want.values())


@pytest.mark.parametrize("common", [3, 32])
def test_near_duplicates_with_shared_passage(spark, monkeypatch, common):
    monkeypatch.setattr(neardup, "COMMON", common, raising=False)
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for share in (0.80, 0.84, 0.88):
        passage, own = words(int(400 * share)), 400 - int(400 * share)
        for _ in range(120):
            text = passage + words(own)
            want[len(rows)] = len(rows)
            rows.append((len(rows), " ".join(text)))
            if len(rows) % 4 == 0:  # a near copy with another end
                want[len(rows)] = len(rows) - 1
                rows.append((len(rows), " ".join(text[:-6] + words(6))))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_missed_pairs_of_common_shingles(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(300)
    texts = [passage + words(60) for _ in range(20)] + [passage[:290], passage + words(2)]  # like the last two, not one another
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    h, first = neardup.labelled_shingles(pa.array([" ".join(t) for t in texts]))
    sets = [h[a:b] for a, b in zip(first[:-1], first[1:])]
    digest = d.select("doc_id", neardup._digest().alias("node")).toPandas()
    node = {r.doc_id: bytes(r.node) for r in digest.itertuples()}
    n = spark.createDataFrame([(node[i], i, len(s), i) for i, s in enumerate(sets)], "node binary, doc_id bigint, size int, c bigint")
    got = {(bytes(r.a), bytes(r.b)) for r in neardup._missed(n, d, 0.8, 5).collect()}
    links = [(i, j) for i in range(22) for j in range(i) if neardup.aligned(sets[i], sets[j]) > 0]
    found = {i: {j for a, b in links for j in (a, b) if i in (a, b) and tuple(sorted((node[a], node[b]))) in got} | {i} for i in range(22)}
    assert links
    for _ in range(22):
        found = {i: set().union(*(found[j] for j in x)) for i, x in found.items()}
    assert all(j in found[i] for i, j in links)


def test_common_shingles_by_parity_bits(spark):
    rng = np.random.default_rng(7)
    rows = []
    for least in (0.8, 0.3):
        for _ in range(60):
            x = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
            keep = rng.integers(math.ceil(least * len(x)), len(x) + 1)
            y = np.concatenate([x[:keep], rng.integers(0, 2**63, rng.integers(0, max(1, int(len(x) / least) - keep))).astype(np.uint64)])
            bits = neardup.parity(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).to_pylist()
            rows.append((least, int(keep), len(x), len(y), *bits))
    d = spark.createDataFrame(rows, "least double, keep int, n int, m int, x array<bigint>, y array<bigint>")
    for least in (0.8, 0.3):
        got = d.where(f"least = {least}D").select("keep", "n", "m", neardup._common("n", "m", "x", "y", least).alias("most")).collect()
        assert all(r.keep <= r.most <= (r.n + r.m) / 2 for r in got)
        assert all(r.most == r.keep for r in got if r.n == r.m == r.keep)
    assert neardup.parity(np.zeros(0, np.uint64), np.zeros(1, np.int64)).to_pylist() == []


def test_template_group_makes_few_pairs(spark):
    """Texts of one template that nearly resemble one another; some have a near copy."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts, want = words(300), [], []
    for i in range(160):
        t = list(template)
        for k in rng.sample(range(300), 7):
            t[k] = words(1)[0]
        texts.append(t)
        want.append(len(texts) - 1)
        if i % 20 == 0:
            texts.append(t[:-2] + words(2))
            want.append(want[-1])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    h, first = neardup.labelled_shingles(pa.array([t for _, t in rows]))
    sets = [h[a:b] for a, b in zip(first[:-1], first[1:])]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if neardup.aligned(sets[i], sets[j]) > 0}
    assert links == {(x, i) for i, x in enumerate(want) if x != i}
    at = {bytes(r.node): r.doc_id for r in d.select("doc_id", neardup._digest().alias("node")).collect()}
    n = spark.createDataFrame([(x, i, len(sets[i]), i) for x, i in at.items()], "node binary, doc_id bigint, size int, c bigint")
    got = {tuple(sorted((at[bytes(r.a)], at[bytes(r.b)]))) for r in neardup._missed(n, d, 0.8).collect()}
    assert links <= got and len(got) < 2 * len(texts)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()} == dict(enumerate(want))


def test_only_likely_pairs_are_read(spark, monkeypatch):
    settle, read = neardup.settle, []

    def counted(df, name):
        out = settle(df, name)
        if name == "neardup-wanted":
            read.append(out.count())
        return out

    monkeypatch.setattr(neardup, "settle", counted)
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(120)
    texts = [passage + words(80) for _ in range(40)]
    texts.append(texts[7][:-2] + words(2))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert got == {i: 7 if i == 40 else i for i in range(41)} and sum(read) <= 4


def test_near_duplicates_odd_rows(spark):
    d = odd(spark)
    assert neardup.near_duplicates(d).count() == 7 and neardup.near_duplicates(d.limit(0)).count() == 0
    kept = sorted((str(r.doc_id), "null" if r.text is None else r.text[:5]) for r in neardup.keep_one(d).collect())
    assert kept == [("1", "a b c"), ("2", "null"), ("2", "z"), ("3", ""), ("4", "é é é"), ("None", "q")]


def test_components(spark):
    path = [(f"n{i:03}".encode(), f"n{i + 1:03}".encode()) for i in range(20)] + [(b"x", b"y")]
    got = {bytes(r.node): bytes(r.label) for r in neardup.components(spark.createDataFrame(path, "a binary, b binary")).collect()}
    assert set(got.values()) == {b"n000", b"x"} and len(got) == 23


def test_flight_keeps_sums():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 500, 300).astype(float), rng.uniform(0.05, 0.95, 300)
    x = np.stack([size, np.ones(300)], 1)
    q = mixing.flight(x, p, np.random.default_rng(1))
    assert np.allclose(x.T @ q, x.T @ p) and ((q > 0) & (q < 1)).sum() <= 2
    runs = np.mean([mixing.land(x, mixing.flight(x, p, np.random.default_rng(s)), np.random.default_rng(s)) for s in range(300)], axis=0)
    assert abs(runs - p).max() < 0.15  # inclusion probabilities hold


def test_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.plan_mix(docs, block=8).toPandas()
    text = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == text
    sums = collections.Counter()
    for i, n in text.items():
        sums[source[i]] += n
    names = sorted(sums)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sums[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sums[s]}
        if not over:
            break
        full |= over
    got["source"] = got.doc_id.map(source)
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == sums[s]
        assert abs(g.taken.sum() - target[s]) <= 1.5 * g["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.plan_mix(docs.repartition(7), block=8).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_odd_rows(spark):
    d = odd(spark)
    assert mixing.plan_mix(d).count() == 7 and mixing.plan_mix(d.limit(0)).count() == 0
    taken = mixing.take_mix(d)
    assert taken.columns == d.columns and taken.limit(50).count() <= 14


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "token_files"]
    ids = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.collect()} <= ids
    out = corpus_pipeline.run(spark, small)
    rows = out.orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist() and len(rows) == docs.count()


def test_pipeline_stages_on_odd_rows(spark, small):
    """Null and empty texts go first; of equal texts one stays; rows keep all their columns; nothing of nothing."""
    rows = [(1, "the cat sat on the mat", "en", "s", 22), (1, "the cat sat on the mat", "en", "s", 22), (None, "the cat sat on the mat", None, None, None), (2, None, None, None, None), (3, "", "fr", "s", 0), (4, "le chat est sur la table " * 9000, "fr", "t", 5), (5, "a dog and a bone", "en", "s", 3)]
    odd = ("node", "class_id", "__key", "__size", "__source", "__words", "__lang", "__copy", "rest", "a.b", "Text", "c0", "it`s")
    docs = spark.createDataFrame([(*r, *[f"{k} {r[0]}" for k in range(len(odd))]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in odd))
    want = [{1, None, 4, 5}, {1, 4, 5}, {1, 4, 5}, {1, 4, 5}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} <= ids
        assert all(tuple(r)[5:] == tuple(f"{k} {r[0]}" for k in range(len(odd))) for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
