"""URL trust, decontamination, language, personal data and quality against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import decontam, langid, pii, quality, queries, urltrust

ODD = "doc_id bigint, text string, lang string, source string, n_words string, verdict string"


def odd(spark):
    """Nulls, empty texts, repeated rows, equal ids, extra columns with names of results."""
    rows = [(1, "a b c", "en", "s", "x", "y"), (1, "a b c", "en", "s", "x", "y"), (2, None, None, None, None, None), (None, "q", "en", None, "x", "y"), (3, "", "fr", "s", "x", "y"), (4, "é " * 30000, "fr", "t", "x", "y"), (2, "z", "en", "s", "", "")]
    return spark.createDataFrame(rows, ODD)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")


def test_rules_and_urls(spark):
    rows = [
        (1, "http://A.B.ORG/x", "", "z"), (2, "http://example.org/es/1", "", None), (3, "x://www.example.org/en/12?q", "", None), (4, "http://c.com/fr/a#b", "", None), (5, "http://c.com/de/", "", None), (6, "http://notorg/de/", "", None),
        (7, None, None, None), (8, "none", "", None), (9, "http://example.org/en/2", "", None), (10, "http://x.com", "", None), (11, "http://myexample.org/es/", "", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltrust.judge(pages(spark, rows)).collect()}
    assert got[1] == ("a.b.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][2] is None and got[7] == ("", "", None, "allow") and got[8][:2] == ("", "")
    assert got[9][2] == "org/" and got[10][:3] == ("x.com", "", None) and got[11][2] == "org/"
    assert urltrust.judge(pages(spark, [])).count() == 0


def test_propagation(spark):
    """Both walks against dense matrices."""
    rng = random.Random(2)
    hosts = [f"h{i}.net" for i in range(12)]
    links = collections.Counter((a, b) for _ in range(40) if (a := rng.choice(hosts)) != (b := rng.choice(hosts)))
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, n bigint")
    seeds = spark.createDataFrame([(h, int(i == 0), int(i in (3, 4))) for i, h in enumerate(hosts)], "host string, n_allow bigint, n_block bigint")
    got = {r.host: (r.trust, r.distrust) for r in urltrust.propagate(edges, seeds, tolerance=1e-12, most=120).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((12, 12))
    for (a, b), n in links.items():
        m[at[a], at[b]] = n
    for k, (w, s) in enumerate(((m, np.eye(12)[0]), (m.T, (np.eye(12)[3] + np.eye(12)[4]) / 2))):
        step = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
        x = np.linalg.solve(np.eye(12) - 0.85 * step.T, 0.15 * s)
        x /= x.sum()
        assert np.allclose([got[h][k] for h in hosts], x, atol=1e-6)


def test_links_decide(spark):
    rows = [(1, "http://good.org/a", '<a href="http://friend.net/">', None), (2, "http://friend.net/x", "", None), (3, "http://bad.net/x", "<A HREF = '//spam.com/de/1'>", None), (4, "http://spam.com/de/1", "", None), (5, "http://alone.net/", "", None)]
    got = {r.page_id: r.verdict for r in urltrust.judge(pages(spark, rows)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def plain_hits(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,", "é", "d.e", "--"]) for _ in range(n))
    items = [(i, text(rng.choice((0, 1, 3, 12, 14)))) for i in range(12)] + [(90, None), (91, "Z"), (92, "Z")]
    docs = [(i, text(rng.choice((0, 2, 40, 900)))) for i in range(60)] + [(60, None), (61, ""), (61, "z y"), (None, "z")]
    docs += [(100 + i, f"x {t} y") for i, t in items if t]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id bigint, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in decontam.mark(d, b, block_bytes=block_bytes).collect()], key=str)
    want = sorted(plain_hits(docs, items), key=str)
    assert got == want and any(w[2] for w in want)
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not w[2] for w in want)
    assert decontam.mark(d, b.limit(0)).where("contaminated").count() == 0 and decontam.mark(d.limit(0), b).count() == 0


def test_decontamination_query_equals_sql(same):
    same(queries.QUERIES["op2_decontamination"], queries.ORACLE_SQL["op2_decontamination"])


def plain_bits(train, text, order):
    seq = lambda t: b"\n" * order + t.encode()
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        b = seq(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i + 1]] += 1
    total, b = 0.0, seq(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            near = {g: c for g, c in counts[k].items() if g[:-1] == b[i - k : i]}
            n, d = sum(near.values()), len(near)
            if near and (c := near.get(b[i - k : i + 1])):
                total -= math.log2(c / (n + d))
                break
            total -= math.log2(d / (n + d)) if near else 0
        else:
            total += 8
    return total


def test_code_lengths(spark):
    train = {"a": ["the cat sat on the mat", "an other thing"], "b": ["le chat est là", "où est le chat"]}
    rows = spark.createDataFrame([(t, k) for k, ts in train.items() for t in ts], "text string, lang string")
    trees = langid.learn(rows, order=3)
    asked = ["the chat", "zzz éé", "q", "le mat où"]
    assert trees.langs == ["a", "b"]
    assert np.allclose(trees.bits(pa.array(asked))[0], [[plain_bits(train[k], t, 3) for k in "ab"] for t in asked], atol=1e-4)


def test_language_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    d = odd(spark)
    got = langid.predict(d)
    assert got.count() == d.count() and {r.lang_pred for r in got.where("doc_id = 3 or score = 0").collect()} == {"und"}
    assert {r.lang_pred for r in langid.predict(d.withColumn("lang", d.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}
    assert langid.predict(d.limit(0)).count() == 0
    kept = langid.keep_known(d)
    assert kept.columns == d.columns and kept.where("text is null or text = ''").count() == 0


def test_base_spans():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "-", "+", " ", "1", "23", "255", "é", "(", "4111 1111 1111 1111", "+49 30 123456", "1.2.3.4", "x@y.z"]) for _ in range(rng.randint(0, 9)))
        want = []
        for kind in pii.KINDS:
            for m in pii._BASE[kind].finditer(t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
                want += [(kind, m.start(), m.end())] * ok
        assert pii.base_spans(t) == want


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.examples())


def test_field_gradient():
    r = pii.Regions(["call 030 123", "a at b dot com", "x"])
    f, rng = pii.Field(), np.random.default_rng(0)
    f.moves, f.start = rng.normal(size=(9, 9)), rng.normal(size=9)
    gold = np.array([0, 7, 8, 0, 0, 0, 0, 0, 0])
    assert len(gold) == r.first[-1]
    value, _, pairs, starts = f.gradient(r, gold)
    f.moves[0, 1] += 1e-6
    assert abs((f.gradient(r, gold)[0] - value) / 1e-6 - pairs[0, 1]) < 1e-3
    f.moves[0, 1] -= 1e-6
    f.start[1] += 1e-6
    assert abs((f.gradient(r, gold)[0] - value) / 1e-6 - starts[1]) < 1e-3


def test_viterbi_against_all_paths():
    import itertools

    r = pii.Regions(["a 1 b", "2 c"])
    f, rng = pii.Field(), np.random.default_rng(1)
    f.weights, f.moves, f.start = rng.normal(size=f.weights.shape), rng.normal(size=(9, 9)), rng.normal(size=9)
    emit = f.weights[r.features].sum(axis=1)
    got = f.decode(r)
    for a, b in zip(r.first[:-1], r.first[1:], strict=True):
        best = max(
            (p for p in itertools.product(range(9), repeat=int(b - a)) if not f.start_barred[p[0]] and not any(f.barred[x, y] for x, y in zip(p, p[1:]))),
            key=lambda p: f.start[p[0]] + sum(emit[a + i, x] for i, x in enumerate(p)) + sum(f.moves[x, y] for x, y in zip(p, p[1:])),
        )
        assert tuple(got[a:b]) == best


def test_field_on_held_out(field):
    held = pii.examples(700)[500:]
    r = pii.Regions([t for t, _ in held])
    labels = field.decode(r)
    got = {(i, s) for i in range(len(held)) for s in pii.spans_of(r, labels, i)}
    want = {(i, s) for i, (_, spans) in enumerate(held) for s in spans}
    assert len(got & want) >= 0.95 * max(len(got), len(want))


def test_added_spans(spark, field):
    texts = ["write to john at mail dot com now", "call (555) 123-4567 today", "on 2024-01-02 at 10:30, version 1.2.3", "me@x.org and +49 30 1234567", None, ""]
    d = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in pii.find(d, field).collect()}
    assert got[0].spans == "email:9:29" and got[0].n_email == 0 and got[1].spans == "phone:5:19" and got[2].spans == "" and got[3].spans == "email:0:8,phone:13:27" and got[3].n_phone == 1 and got[4].spans == got[5].spans == ""
    assert pii.find(odd(spark), field).count() == 7 and pii.find(d.limit(0), field).count() == 0
    table = pii.labelled_table(spark, 20)
    assert table.count() == 20
    with pytest.raises(ValueError):
        pii.train(table, most=5)


def test_at_with_full_stop(spark, field):
    texts = ["write to anna[at]milo.de", "write to anna (at) milo.de now", "write to anna at milo.de", "we met at noon. Then we left"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find(d, field).collect()}
    assert got == {0: "email:9:24", 1: "email:9:26", 2: "email:9:24", 3: ""}
    held = pii.examples(700)[500:]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id bigint, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.find(d, field).collect()}
    found = [f"{k}:{a}:{b}" in got[i] for i, (_, spans) in enumerate(held) for k, a, b in spans if k == "email"]
    assert sum(found) >= 0.95 * len(found)


def plain_statistics(t):
    t = t or ""
    words, seen, dup, lines = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0, 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), lines, sum("A" <= c <= "Z" for c in t))


def test_statistics():
    rng = random.Random(8)
    texts = [None, "", "\n", "a\na\n", "x\n", "é é\né é"] + ["".join(rng.choice(["a ", "b ", "é", "\n", "#", " \n", "日 ", "QÉ"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    got = quality.text_statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality.FEATURES) == plain_statistics(t)


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (200, 1, 0.02), (50, 0, 0.1), (30, 30, 0.5), (1000, 12, 0.02)):
        assert abs(quality.binomial_tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-10


def test_cutoffs_are_certified():
    scores, good, bad = np.array([0, 10, 20, 30]), np.array([2000, 40, 1, 0]), np.array([10, 5, 50, 60])
    cut = quality.choose_cutoff(scores, good, bad, 0.02, 0.01)
    assert cut == 20  # 41 of 2041 good ones would go at 10: not certified to be 2 % at most
    assert quality.choose_cutoff(scores, good // 100, bad, 0.02, 0.01) is None  # too few labels
    assert quality.choose_cutoff(scores, np.array([2000, 0, 5, 5]), np.array([9000, 0, 5, 5]), 0.02, 0.01) is None  # no better than chance


def test_quality_on_planted_rule(spark):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 4 == 0
        rows.append((i, ("##" if bad else "ab") + " word" * 30 + " ###" * (20 * bad) + f" w{i}", "en" if i % 2 else None, "z"))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame([(a, b.replace(" word", f" w{a}") if a % 4 else b, c, d) for a, b, c, d in rows], "doc_id bigint, text string, lang string, kept string")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert len(kept) == 6000 and not any(kept[i] for i in range(0, 6000, 4))
    assert quality.judge(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0
    assert quality.judge(odd(spark), spark.createDataFrame([(1, None)], "doc_id bigint, quality int")).where("kept").count() == 0


def plain_cutoffs(rows, alpha, delta):
    """rows: (stratum, scores by rule, label or None, held for the path). (own strata, {stratum: (bound, {rule: cutoff})})."""
    good = [r for r in rows if r[2] == 1 and not r[3]]
    sizes = sorted(((sum(r[0] == s for r in good), s) for s in {r[0] for r in good} - {None}), reverse=True)
    own = []
    for n, s in sizes:
        if (1 - alpha) ** n > delta / (len(own) + 2):
            break
        own.append(s)
    level, out = delta / (len(own) + 1), {}
    for g in [*own, None]:
        mine = [r for r in rows if (r[0] if r[0] in own else None) == g]
        bad, free, held = [r[1] for r in mine if r[2] == 0], [r[1] for r in mine if r[2] is None or (r[2] == 1 and r[3])], [r[1] for r in mine if r[2] == 1 and not r[3]]
        steps = []
        for rule in quality.RULES:
            for s in {b[rule] for b in bad} - {0}:
                caught, hit = sum(b[rule] >= s for b in bad), sum(f[rule] >= s for f in free)
                lift = caught / len(bad) / ((hit + 1) / (len(free) + 1))
                if lift >= 2:
                    steps.append((-lift, -caught, rule, s))
        cut, k, best = {}, 0, ({}, 0)
        for _, _, rule, s in sorted(steps):
            cut = cut | {rule: min(s, cut.get(rule, 9999))}
            k = sum(any(h[r] >= c for r, c in cut.items()) for h in held)
            if sum(math.comb(len(held), i) * alpha**i * (1 - alpha) ** (len(held) - i) for i in range(k + 1)) > level:
                break
            best = (cut, k)
        out[g] = best
    return own, out


def test_judge_equals_plain_version(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1600):
        lang = "en" if i % 2 else rng.choice(["fr", "de", None])
        bad = rng.random() < 0.25
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(15, 60))]
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "AB" for w in words] if kind == 0 else [w + "%$" for w in words] if kind == 1 else words
        elif rng.random() < 0.02:
            words[0] += "#" * 40
        rows.append((i, " ".join(words), lang))
        if rng.random() < 0.7:
            labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, marks, alpha=0.03).collect()}
    label = dict(labels)
    plain = []
    for i, t, lang in rows:
        st = {k: int(v[0]) for k, v in quality.text_statistics(pa.array([t])).items()}
        n = max(st["n_words"], 1)
        scores = {
            "symbols": min(1000, 1000 * st["n_symbols"] // max(st["word_chars"], 1)), "capitals": min(1000, 1000 * sum("A" <= c <= "Z" for c in t) // max(st["word_chars"], 1)), "duplicate_lines": 1000 * st["n_dup_lines"] // max(st["n_lines"], 1),
            "repeated_words": 1000 * st["n_repeat_words"] // n, "brevity": 1000 // n, "long_words": min(1000, 20 * st["word_chars"] // n),
        }
        failed = st["n_words"] < 20 or 100 * st["n_repeat_words"] > 30 * st["n_words"]
        plain.append((i, lang, scores, failed))
    own, cuts = plain_cutoffs([(lang, s, label.get(i), zlib.crc32(str(i).encode()) % 8 == 0) for i, lang, s, failed in plain if not failed], 0.03, 0.05)
    assert own == ["en"] and all(cuts[g][0] for g in cuts)
    rejected = 0
    for i, lang, s, failed in plain:
        cut = cuts[lang if lang in own else None][0]
        hit = sorted(r for r, c in cut.items() if s[r] >= c)
        assert (got[i].base_failed, got[i].kept, got[i].rejected_by) == (failed, not failed and not hit, [] if failed else hit)
        rejected += bool(hit)
        assert 0 < got[i].false_rejection <= 0.03
    assert rejected > 100


def test_words_of_items_without_id_are_hit(spark):
    words = " ".join(f"x{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    for rows in ([(None, words)], [(None, words), ("i", words)]):
        b = spark.createDataFrame(rows, "item_id string, text string")
        for block_bytes in (1 << 20, 20):  # one block, and one for each item
            got = {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.contaminated) for r in decontam.mark(docs, b, block_bytes=block_bytes).collect()}
            assert got == {1: (14, 12, ["i"] if len(rows) == 2 else [], True), 2: (2, 0, [], False), 3: (0, 0, [], False)}
            assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, b, block_bytes=block_bytes).collect()) == [2, 3]


def test_patterns_stay_small():
    import pickle
    import time

    rng = np.random.default_rng(5)
    items = [(f"i{k}", " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))) for k in range(64)]
    size = sum(len(t) for _, t in items)
    began = time.time()
    p = decontam.Patterns(items)
    assert len(pickle.dumps(p)) < 40 * size and time.time() - began < 30
    assert len(p.first) == 64 * 3991


def test_hot_suffixes_stay_small():
    """Words by Zipf's law: buckets of frequent word pairs hold very many patterns, and are looked at in bounded parts."""
    import tracemalloc

    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(3000)])
    text = lambda n: " ".join(words[np.minimum(rng.zipf(1.3, n) - 1, 2999)])
    items = [(f"i{k}", text(4000)) for k in range(100)]
    p = decontam.Patterns(items)
    docs = [text(200_000) + " " + items[7][1][:3000] + " " + text(9)]
    part = pa.record_batch([pa.array(docs)], ["text"])
    tracemalloc.start()
    counts, found = decontam._found(p, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and counts[0] > 200_000 and "i7" in found[0][1]
    w, own = docs[0].split(), {}
    for name, t in items:
        x = t.split()
        for i in range(len(x) - 9):
            own.setdefault(tuple(x[i : i + 10]), set()).add(name)
    hit, names = np.zeros(len(w), bool), set()
    for i in range(len(w) - 9):
        if tuple(w[i : i + 10]) in own:
            hit[i : i + 10] = True
            names |= own[tuple(w[i : i + 10])]
    assert (found[0][0] == hit).all() and found[0][1] == names


def test_long_tokens_are_described_whole():
    a, b = "x" * 30, "x" * 29 + "X"
    assert pii.shape(a, False) != pii.shape(b, False)
    one, two = (pii.Regions([f"to {t} now"]).features[1] for t in (a, b))
    assert one[0] != two[0]


def test_other_languages_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    finnish = "Suomen kieli on yksi maailman kielistä ja sitä puhuu noin viisi miljoonaa ihmistä pääasiassa Suomessa, mutta myös Ruotsissa ja Norjassa asuu suomenkielisiä."
    more = spark.createDataFrame([(10**6, finnish), (10**6 + 1, "Это предложение написано на русском языке и состоит из нескольких слов, как и другие."), (10**6 + 2, "1234 5678"), (10**6 + 3, "A."), (10**6 + 4, None)], "doc_id bigint, text string")
    kept = langid.keep_known(docs.unionByName(more, allowMissingColumns=True))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids & set(range(10**6, 10**6 + 5)) == {10**6 + 3}
    clean = {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert len(clean - ids) <= 0.01 * len(clean) and kept.columns == docs.columns
    assert langid.keep_known(docs.limit(0)).count() == 0


def test_long_paths_equal_step_by_step():
    rng, f = np.random.default_rng(0), pii.Field()
    for n in (1, 2, 5, 50, 777):
        emit, moves, start = rng.normal(size=(n, 9)), np.where(f.barred, -1e9, rng.normal(size=(9, 9))), np.where(f.start_barred, -1e9, 0.0)
        score, back = start + emit[0], []
        for t in range(1, n):
            way = score[:, None] + moves
            back.append(way.argmax(axis=0))
            score = way.max(axis=0) + emit[t]
        want = [int(score.argmax())]
        for b in back[::-1]:
            want.append(int(b[want[-1]]))
        assert pii.best_path(emit, moves, start).tolist() == want[::-1]


def test_long_numeric_text(spark):
    import time

    field, began = pii.fit(sorted(pii.examples(120))), time.time()
    text = " ".join(str(i * 7919 % 100003) for i in range(140000)) + " call +49 170 1234567"
    base, every = pii.all_spans([text], field)[0]
    assert ("phone", text.index("+49"), len(text)) in every and time.time() - began < 60
