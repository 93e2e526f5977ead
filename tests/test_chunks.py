"""Chunkers on small files, and the packing helpers against plain loops."""

import collections
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestack.functions import packing
from lodestack.functions import text as X
from lodestack.operators import chunk
from lodestack.schemas import FILES


def files(spark, **named):
    rows = [("my-repo", "/w/my-repo", p, f"/w/my-repo/{p}", len(c or ""), 5.0, c) for p, c in named.items()]
    return spark.createDataFrame(rows, FILES)


def chunks(spark, path, content, most=512, overlap=64):
    out = chunk.chunk_files(files(spark, **{path: content}), most, overlap)
    return out.orderBy("start_line", "id").collect()


INVOICE = """<?php

namespace Billing\\Pdf;
use Other\\Thing;
/** A bill. */
final class Invoice extends Thing
{
    private int $cents = 0;
    public static function of(array $lines): self { $x = new self(); foreach ($lines as $l) { $x->add($l); } return $x; }
    protected function add(array $line): void { $this->cents += $line['cents']; }
}
"""


def test_php_classes_stay_whole_within_the_budget_and_fall_apart_into_methods_beyond_it(spark):
    kinds = lambda most: [(c.chunk_type, c.symbol_name) for c in chunks(spark, "src/Invoice.php", INVOICE, most)]
    assert kinds(512) == [("class", "Billing\\Pdf\\Invoice")]
    assert kinds(40) == [("method", "Invoice.of"), ("method", "Invoice.add")]
    (whole,) = chunks(spark, "src/Invoice.php", INVOICE)
    assert whole.text.strip().startswith("final class Invoice") and whole.text.endswith("}") and whole.end_line == INVOICE.count("\n")
    loose = "<?php\n\n  function tax_of($cents)\n{\n  return intdiv($cents * 19, 100);\n}\n$x = tax_of(5);\n"
    (tax,) = chunks(spark, "tax.php", loose)
    assert (tax.chunk_type, tax.symbol_name, tax.end_line) == ("function", "tax_of", 6) and tax.text.endswith("}")


def test_go_functions_methods_and_structs(spark):
    text = "package queue\n\nimport \"sync\"\n\ntype Ring struct {\n\tmu sync.Mutex\n\tbuf []byte\n}\n\nfunc (r *Ring) Push(b byte) { r.buf = append(r.buf, b) }\n\nfunc merge(opts map[string]struct{}, more ...int) (n int) {\n\tn = len(opts)\n\treturn\n}\n"
    found = chunks(spark, "queue/ring.go", text)
    assert [c.symbol_name for c in found] == ["queue.Ring", "r.Push", "queue.merge"]
    assert found[0].text.strip() == "type Ring struct {\n\tmu sync.Mutex\n\tbuf []byte\n}"
    assert found[2].text.strip() == "func merge(opts map[string]struct{}"  # a block ends with the first brace that is closed, here the parameter's


def test_typescript_exports_run_to_the_next_one(spark):
    text = "// head\nconst hidden = 0\nexport default class Cart {\n  total = 0\n}\n\n  export const VAT = hidden\nexport function* none() {}\nexport async function pay(c: Cart) {\n  return c\n}"
    found = chunks(spark, "web/cart.tsx", text)
    assert [(c.chunk_type, c.symbol_name, c.start_line, c.end_line) for c in found] == [("class", "Cart", 3, 6), ("const", "VAT", 7, 7), ("function", None, 8, 8), ("function", "pay", 9, 11)]
    assert "".join(c.text for c in found) == text[text.index("export default") :]


def test_vue_blocks_are_cut_to_windows_beyond_the_budget(spark):
    text = "<script setup lang='ts'>\n" + "".join(f"const field{i} = ref({i})\n" for i in range(25)) + "</script>\n\n<style scoped>b { top: 0 }</style>\n<template><p>hi</p></template>\n"
    assert [(c.chunk_type, c.start_line, c.end_line) for c in chunks(spark, "Form.vue", text)] == [("script", 1, 27), ("style", 29, 29), ("template", 30, 30)]
    cut = [c for c in chunks(spark, "Form.vue", text, 40) if c.symbol_name == "script"]
    assert len(cut) > 2 and (cut[0].start_line, cut[-1].end_line) == (1, 27) and all(b.start_line <= a.end_line + 1 for a, b in zip(cut, cut[1:]))


def test_markdown_sections_hold_their_children(spark):
    text = "intro\n# Guide\nhello\n### Deep\ndeep\n## Use\nrun it\n#### not one\n# End \nbye\n"
    found = chunks(spark, "docs/guide.md", text)
    assert [(c.symbol_name, c.start_line, c.end_line) for c in found] == [("Guide", 2, 8), ("Deep", 4, 5), ("Use", 6, 8), ("End", 9, 10)]
    first = found[0]
    assert (first.id, first.abs_file_path, first.file_mtime, first.chunk_type) == ("my-repo:docs/guide.md:2", "/w/my-repo/docs/guide.md", 5.0, "section")


def test_yaml_keys_and_compose_services(spark):
    text = "name: shop\nservices:\n  # front\n  web-1:\n    build: .\n  cache.main:\n    image: redis\n    x: 1\nvolumes: {}\n"
    assert [(c.symbol_name, c.start_line) for c in chunks(spark, "deploy/values.yml", text)] == [("name", 1), ("services", 2), ("volumes", 9)]
    assert [(c.symbol_name, c.start_line, c.end_line) for c in chunks(spark, "deploy/docker-compose.prod.yml", text)] == [("web-1", 4, 5), ("cache.main", 6, 8)]


def test_line_windows_share_lines(spark):
    lines = [f"{i:03} " + "word " * (i % 7) + "\n" for i in range(90)]
    found = chunks(spark, "notes.txt", "".join(lines), 30, 10)
    weights = [max(len(x) // 4, 1) for x in lines]
    assert [(c.start_line - 1, c.end_line) for c in found] == loop_windows(weights, 30, 10)
    assert all(c.text == "".join(lines[c.start_line - 1 : c.end_line]) for c in found)


def test_no_chunks_and_long_lines(spark):
    assert chunks(spark, "a.txt", "") == [] and chunks(spark, "a.txt", None) == []
    found = chunks(spark, "a.txt", "x" * 1000, 50)
    assert [c.id for c in found] == ["my-repo:a.txt:1"] + [f"my-repo:a.txt:1#part{i}" for i in range(1, 5)] and "".join(c.text for c in found) == "x" * 1000


def loop_windows(weights, most, overlap):
    """Windows found line by line."""
    out, a = [], 0
    while True:
        b, total = a, 0
        while b < len(weights) and (b == a or total + weights[b] <= most):
            total += weights[b]
            b += 1
        out.append((a, b))
        if b >= len(weights):
            return out
        tail, c = 0, b
        while c > a and tail < overlap:
            c -= 1
            tail += weights[c]
        c = b - 1 if overlap <= 0 else c
        a = c if c > a else b


def test_windows_against_loop():
    rng = random.Random(3)
    for _ in range(3000):
        w = [rng.randint(1, 9) for _ in range(rng.randint(1, 25))]
        most, overlap = rng.randint(1, 25), rng.randint(0, 12)
        import numpy as np

        assert packing.window_bounds(np.array(w), most, overlap) == loop_windows(w, most, overlap)


def test_pieces_keep_text():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice(["a", "bb\n", "\n", "x" * 40, "y" * 9 + "\n"]) for _ in range(rng.randint(0, 20)))
        found = packing.split_pieces(t, 5)
        assert "".join(found) == t and (len(t) // 4 <= 5 or all(len(p) // 4 <= 5 or "\n" in p for p in found))


def test_block_end():
    text = "f {" + "a{b}" * 3000 + "} rest"
    assert packing.block_end(text, 0) == len(text) - 5 and packing.block_end("none", 0) == 4 and packing.block_end("{ open", 0) == 6


@pytest.mark.parametrize("path,wanted", [("a.ts", "typescript"), ("A.PHP", "php"), (".env.example", "text"), (".md", "text"), ("x/y.tsx", "typescript"), ("a.b.vue", "vue"), ("noext", "text")])
def test_language(spark, path, wanted):
    assert spark.range(1).select(X.language(F.lit(path))).first()[0] == wanted


PATTERNS = {  # what ``openings`` must find, as one expression each
    "class": (re.compile(r"^\s*(?:final\s+|abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b", re.M), packing.PHP_CLASS, {"one": packing.CLASS_WORDS}),
    "method": (re.compile(r"^\s*(?:public|protected|private|static|final|abstract|\s)*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", re.M), packing.PHP_FUNCTION, {"many": packing.METHOD_WORDS}),
    "function": (re.compile(r"^\s*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", re.M), packing.PHP_FUNCTION, {}),
    "func": (re.compile(r"^\s*func\s*(\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(", re.M), packing.GO_FUNC, {}),
    "struct": (re.compile(r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct\b", re.M), packing.GO_STRUCT, {}),
}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_openings(name):
    whole, core, how = PATTERNS[name]
    rng = random.Random(name)
    bits = ["\n", "\n", "\n\n", " ", "\t", "class", "class A", "function", "function f(", " f(", "public ", "static", "final ", "final", "abstract\n", "x", "{", "}", "func", "func (s *T) g(", "type", "type T struct", " struct", "\x1c", " "]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [(a, m.end(), m.groups()) for a, m in packing.openings(core, t, **how)] == [(m.start(), m.end(), m.groups()) for m in whole.finditer(t)], repr(t)


def test_long_files_are_cut_in_linear_time(spark):
    ts = "".join(f"export const X{i} = {{ a: {i}, b: 'some text of a line, and some more of it to fill it up' }}\n" for i in range(4000))
    md = "".join(f"{'#' * (i % 3 + 1)} T{i}\ntext\n" for i in range(4000))
    php = "<?php\nclass A {\n" + "\n" * 4000 + "  public function f() { }\n" + " \n" * 30000 + "}\n" + "x();\n" * 600
    rows = [("r", "/r", name, f"/r/{name}", len(t), 0.0, t) for name, t in (("a.ts", ts), ("b.md", md), ("c.php", php))]
    files = spark.createDataFrame(rows, FILES)
    began = time.time()
    got = collections.Counter(r.language for r in chunk.chunk_files(files).select("language").collect())
    assert got["typescript"] == 4000 and got["markdown"] == 4000 and got["php"] >= 1
    assert time.time() - began < 40  # a few seconds; what grows with the square takes minutes


def test_marks_in_text(spark):
    t = "export const A = ''\nexport const B = 1\n"
    files = spark.createDataFrame([("r", "/r", "a.ts", "/r/a.ts", len(t), 0.0, t)], FILES)
    assert [r.text for r in chunk.chunk_files(files).orderBy("start_line").collect()] == [t[: t.index("export const B")], t[t.index("export const B") :]]


def test_table_functions_of_sql_equal_the_chunkers(spark):
    from lodestack.plans import sql

    long = "word " * 900
    named = {
        "a.md": f"# A\n{long}\n## B\nb\n", "b.ts": "export const A = 1\nexport class B {\n}\n", "c/docker-compose.yml": "services:\n  web:\n    image: x\n", "d.yaml": "k: 1\n", "e.vue": "<script>\n" + "let x = 1\n" * 60 + "</script>\n<style>a{}</style>\n",
        "User.PHP": INVOICE, "f.go": "package p\nfunc F() {\n}\n", "g.txt": "".join(f"line {i}\n" for i in range(200)), "h.json": long, "i.md": "no header\n", "j.txt": "", "k.txt": None,
    }
    rows = files(spark, **named)
    sql.register(spark, 60, 20)
    got = spark.sql("select c.* from {rows} f, lateral file_chunks(f.repo_name, f.path, f.content) c", rows=rows)
    want = chunk.chunk_files(rows, 60, 20).select(*got.columns)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(got) == plain(want) and got.count() > 30
    blocks = spark.sql("select b.symbol_name from {rows} f, lateral markdown_blocks(f.content) b where f.path = 'a.md'", rows=rows)
    assert sorted(r.symbol_name for r in blocks.collect()) == ["A", "B"] and "Python" not in blocks._jdf.queryExecution().executedPlan().toString()
