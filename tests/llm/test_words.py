"""The byte-level word kernel against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa

from lodestack.llm import textkit as T

TEXTS = [None, "", " ", "a", "Aé b\n\nc", "x\x00y z", "日本 語", "a  b\tc\x0bd"] + ["".join(random.Random(i).choice("aB é\n\t1-_日\x00") for _ in range(i % 23)) for i in range(300)]


def test_words():
    for lower, is_word, pattern in ((T.SAME, T.NON_BLANK, r"[^\x20\x09-\x0D]+"), (T.LOWER, T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = T.Words(pa.array(TEXTS), is_word, lower)
        raw = w.text.tobytes()
        by_hash = {}
        for i, t in enumerate(TEXTS):
            t = t or ""
            if lower is T.LOWER:
                t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
            a, b = w.first[i], w.first[i + 1]
            got = [raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
            assert got == re.findall(pattern, t)
            for x, h in zip(got, w.hash[a:b].tolist(), strict=True):
                assert by_hash.setdefault(h, x) == x
        assert len(by_hash) == len(set(by_hash.values()))


def test_sliced_arrays():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    parts = list(T.slices([batch, batch.slice(0, 0)], most=16))
    assert [x for p in parts for x in p.column("text").to_pylist()] == TEXTS and len(parts) > 10
    assert np.concatenate([T.Words(p.column("text")).counts for p in parts]).tolist() == T.Words(pa.array(TEXTS)).counts.tolist()


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    table = T.Lookup(keys, np.arange(len(keys)))
    asked = np.concatenate([keys, keys + np.uint64(1)])
    row = table.rows(asked)
    known = set(keys.tolist())
    assert all((r >= 0) == (k in known) for k, r in zip(asked.tolist(), row.tolist(), strict=True)) and (table.values[row[: len(keys)]] == np.arange(len(keys))).all()
    assert (T.Lookup(np.zeros(0, np.uint64), np.zeros(0)).rows(asked) == -1).all()


def thue_morse(n):
    """A text of n letters a and b, and its complement: hashes modulo a power of two take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(1 << k) for k in range(9, 15)]


def test_hashes_of_thue_morse_texts_differ():
    for a, b in PAIRS:
        assert len(set(T.Words(pa.array([a, b])).hash.tolist())) == 2


def poor_hash(running, starts, ends):
    return (ends - starts).astype(np.uint64)


def odd_texts():
    return [a for p in PAIRS for a in p] + [f"{a}\n{b}\n{a}" for a, b in PAIRS[:3]] + [" ".join([*"abcdefgh", *"ijklmnop", *"abcdefgh", "x", *"qrstuvwx"])] + [t for t in TEXTS if t]


def plain_pieces(vocabulary, text):
    """Pieces of the best segmentation of each pre-token."""
    total = 0
    for token in re.findall(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?=$| ?[^\x20\x09-\x0D])", text):
        best = [(0.0, 0)] + [None] * len(token)
        for e in range(1, len(token) + 1):
            found = [(best[b][0] + vocabulary[token[b:e]], best[b][1] - 1) for b in range(max(0, e - 8), e) if token[b:e] in vocabulary]
            best[e] = max(found)
        total -= best[-1][1]
    return total


def test_equality_is_of_bytes(monkeypatch):
    """Operators that tell texts apart do so by their bytes, however poor the hash is."""
    from tokenizers import Tokenizer

    from lodestack.llm import quality, queries, tokencount, tokenfile

    path, texts = queries.tokenizer_path("byte_bpe_50k.json"), odd_texts()
    plain = Tokenizer.from_file(path)
    wanted = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    pieces = {bytes([b]): -9.0 for b in range(256)} | {b"ab": -3.0, b"ba": -3.1, b"abba": -5.0, b" a": -4.0, b"bab": -4.5}
    words = ["ab", "ba", "abba", "baab", "abab", "babab", "bbbb"]
    few = [" ".join(words), "abbabaab baababba", "a", ""]
    real = T.span_hash
    for hashes in (real, poor_hash):
        for module in (T, quality, tokenfile):
            monkeypatch.setattr(module, "span_hash", hashes)
        assert tokenfile.Encoder(path).encode(pa.array(texts)) == wanted
        got = quality.text_statistics(pa.array(texts))
        for i, t in enumerate(texts):
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(w) < 400 else set()
            assert (got["n_dup_lines"][i], got["n_repeat_words"][i]) == (len(lines) - len(set(lines)), len(twice))
    vocabulary = tokencount.Vocabulary(pieces)
    w = T.Words(pa.array(few), hashed=False)
    starts, ends, first = tokencount.pretokens(w)
    counts = tokencount.best_counts(w.running, w.text, starts, ends, vocabulary)
    assert [int(counts[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)] == [plain_pieces(pieces, t.encode()) for t in few]


def test_trie_nodes_are_told_by_bytes(monkeypatch):
    """Prefixes of one hash that differ are nodes of their own."""
    from lodestack.llm import tokencount

    pieces = {b"a": -1.0, b"b": -2.0, b"ab": -1.5, b"bb": -9.0}
    vocabulary = tokencount.Vocabulary(pieces)
    real = T.span_hash
    w = T.Words(pa.array(["ab bb ba", "aab bab"]), hashed=False)
    starts, ends, _ = tokencount.pretokens(w)
    want = tokencount.best_counts(w.running, w.text, starts, ends, vocabulary)
    calls = []

    def poor_first(running, s, e):
        calls.append(1)
        return poor_hash(running, s, e) if len(calls) == 1 else real(running, s, e)

    monkeypatch.setattr(tokencount, "span_hash", poor_first)
    assert (tokencount.best_counts(w.running, w.text, starts, ends, vocabulary) == want).all()


def test_same_spans():
    text = np.frombuffer(b"abcabdabc", np.uint8)
    starts, ends = np.array([0, 3, 6, 2, 4]), np.array([3, 6, 9, 2, 9])
    for part in (1, 4, 1 << 20):
        assert T.same_spans(text, starts, ends, np.array([0, 0, 0, 3, 0]), part).tolist() == [True, False, True, True, False]
    assert T.same_spans(text, starts[:0], ends[:0], starts[:0]).tolist() == []
