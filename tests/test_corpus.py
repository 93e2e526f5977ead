"""Extractors, globs, store and whole runs on a small corpus."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import detect, embed, extract, files, incremental, search, summary
from lodestack.plans import index
from lodestack.schemas import CHUNKS, FILES, LIVE, MANIFEST
from lodestack.sources import tables
from lodestack.sources.tables import Store
from lodestack.streaming import follow

ENV = "A=1\n# c\nB=x # note\nDB_PASSWORD= # Leave empty\nnoeq\nexport C='q'\nE=a=b\n"
WEB = "<?php\nRoute::middleware(['auth', 'x'])->group(function () {\n  Route::get('/a', [A::class, 'i']);\n});\nRoute::resource('p', P::class);\n}\nRoute::post('/z', 'Z@z');\n"
CODE = {
    "lar": {
        "composer.json": "{}", "artisan": "x", "app/User.php": "<?php\nclass User {}\n", "routes/api.php": WEB, "database/migrations/1_u.php": "Schema::create('users', function ($t) { $t->id('id'); $table->string('name'); $table->string('name'); });",
        ".env.example": ENV, "docker-compose.yml": "services:\n  app:\n    image: x\n    ports: ['80:80']\n    environment: {A: 1}\n  db:\n    image: y\n    depends_on: [app]\n", ".git/HEAD": "x", "README.md": "# A\n", "vendor/x.php": "<?php",
    },
    "gos": {"go.mod": "m", "internal/server/s.go": 'package s\nfunc A() { r.Get("/a", h.List) }\n', "x/y.go": 'mux.HandleFunc("/b", z)', "migrations/1.sql": "CREATE TABLE IF NOT EXISTS users (\n id INT,\n UNIQUE (id)\n);\n"},
}


def corpus(spark, mtime=1.0, skip=()):
    rows = [(r, f"/w/{r}", p, f"/w/{r}/{p}", len(c), mtime, c) for r, fs in CODE.items() for p, c in fs.items() if p not in skip]
    return spark.createDataFrame(rows, FILES)


@pytest.mark.parametrize("pattern,path,wanted", [
    ("**/*.php", "a/b.php", True), ("**/*.php", "b.php", True), ("*.php", "a/b.php", True), ("**/*.php", "b.PHP", False), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.c", "abc", False), ("x{1}", "x{1}", True), ("**/docker-compose*.yml", "d/docker-compose.dev.yml", True),
])
def test_globs(spark, pattern, path, wanted):
    assert spark.range(1).select(X.matches_any(F.lit(path), [pattern])).first()[0] is wanted


def test_size_limit_and_no_patterns(spark):
    rows = spark.createDataFrame([("a.md", 1 << 20), ("b.md", (1 << 20) + 1), ("c.bin", 1)], "path string, size bigint")
    assert [r.path for r in files.walk_files(rows).collect()] == ["a.md"]
    assert {r.path for r in files.walk_files(rows, include=[], exclude=[]).collect()} == {"a.md", "c.bin"}


def test_repos(spark):
    listing = spark.createDataFrame([(p,) for p in ("/w/.git/HEAD", "/w/a/.git/x", "/w/b/c/.git/x", "/w/d/f", "/w/e/.github/x")], "abs_path string")
    assert {r.repo_root for r in files.discover_repos(listing, "/w").collect()} == {"/w", "/w/a"}
    assert {r.repo_root for r in files.discover_repos(listing, "/w", ["d", "/w/none"], auto_discover=False).collect()} == {"/w/d"}


def test_profiles(spark):
    p = {r.name: r for r in detect.profiles(corpus(spark)).collect()}
    assert p["lar"].stack == "laravel" and p["lar"].key_paths["routes"] == "routes/api.php"
    assert p["gos"].stack == "go-chi" and p["gos"].key_paths == {"docker": "docker-compose.yml", "tests": "tests", "internal": "internal"}


def test_extractors(spark):
    f = corpus(spark)
    found = {k: v.collect() for k, v in extract.extract_structured(f, detect.profiles(f)).items()}
    routes = {(r.method, r.path): list(r.middleware) for r in found["routes"] if r.repo_name == "lar"}
    # The group's own brace counts too, so its middleware lasts to one brace more.
    assert routes == {("GET", "/a"): ["auth", "x"], ("RESOURCE", "p"): ["auth", "x"], ("POST", "/z"): []}
    strict = {r.path: list(r.middleware) for r in extract.routes_laravel(f.where("repo_name = 'lar'"), strict_scope=True).collect()}
    assert strict == {"/a": ["auth", "x"], "p": [], "/z": []}
    assert [(r.name, r.default, r.comment) for r in sorted(found["env"], key=lambda r: r.n)] == [("A", "1", ""), ("B", "x", "note"), ("DB_PASSWORD", "", "Leave empty"), ("export C", "'q'", ""), ("E", "a=b", "")]
    assert {(r.table_name, tuple(r.columns)) for r in found["migrations"]} == {("users", ("name",)), ("users", ("id INT",))}
    assert [(r.name, r.image, list(r.ports), list(r.environment), list(r.depends_on)) for r in sorted(found["docker"], key=lambda r: r.n)] == [("app", "x", ["80:80"], ["A=1"], []), ("db", "y", [], [], ["app"])]
    assert {r.handler for r in found["routes"] if r.repo_name == "gos"} == {"h.List"}  # likely files first
    rows = extract.payloads(extract.extract_structured(f, detect.profiles(f)), detect.profiles(f))
    assert rows.count() == 8 and summary.lookup(rows, "env", "gos").first().payload == "[]" and summary.lookup(rows, "env", "none").isEmpty()


COMPOSE = {
    "a: [": [], "services: [1]": [], "- x": [], "": [], "services: text": [], "- services: {web: {image: i}}": [], "services: {one: 1, two: [x], three: null}": [],
    "services: {web: {}}": [("web", "", [], [], [])],
    "x-base: &b {image: base:1}\nservices:\n  2: *b\n  api:\n    image: null\n    ports: [8080, '53:53/udp', 1.5]\n    environment: [A=1, B]\n    depends_on: {cache: {condition: up}, 2: {}}\n":
        [("2", "base:1", [], [], []), ("api", "None", ["8080", "53:53/udp", "1.5"], ["A=1", "B"], ["cache", "2"])],
    "services:\n  w:\n    ports: 81\n    environment: {K: 1, L: null, M: true, N: [1]}\n    depends_on: [p, 3]\n  v: {ports: '9:9', depends_on: w, environment: x, image: {a: b}}\n":
        [("w", "", [], ["K=1", "L=None", "M=True", "N=[1]"], ["p", "3"]), ("v", "{'a': 'b'}", ["9", ":", "9"], [], [])],
}


def test_compose_services(spark):
    texts = list(COMPOSE)
    found = extract.compose_services(listing(spark, *[(f"r{i}", "compose.yml", t) for i, t in enumerate(texts)], ("both", "compose.yaml", "services: {late: {}}"), ("both", "docker-compose.yaml", "services: {first: {}}"), ("sub", "x/compose.yml", "services: {no: {}}"))).collect()
    for i, t in enumerate(texts):
        assert [(r.name, r.image, r.ports, r.environment, r.depends_on) for r in sorted(found, key=lambda r: r.n) if r.repo_name == f"r{i}"] == COMPOSE[t], t
    assert [(r.repo_name, r.name) for r in found if not r.repo_name.startswith("r")] == [("both", "first")]


def test_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.chunks().isEmpty() and store.summaries().isEmpty()
    first = {r.repo_name: (r.files_processed, r.chunks_created) for r in index.index(corpus(spark), store).collect()}
    assert first[None][0] == 10 and first[None][1] == store.chunks().count()
    assert index.index(corpus(spark), store).isEmpty()  # nothing changed
    s = {r.name: r for r in summary.summary(store.summaries()).collect()}
    assert s["lar"].endpoints_count == 3 and s["lar"].chunk_count > 0 and s["lar"].models == []
    # A newer README, and no api.php any more: one file is processed, the other's chunks stay by id.
    again = corpus(spark, skip=("routes/api.php",)).withColumn("mtime", F.when(F.col("path") == "README.md", 0.5).otherwise(F.col("mtime")))
    assert {r.repo_name: r.files_processed for r in index.index(again, store).collect()}[None] == 1
    assert store.manifest().where("abs_path like '%api.php'").isEmpty() and not store.chunks().where("file_path = 'routes/api.php'").isEmpty()
    index.index(again, store, full=True)
    assert store.chunks().where("file_path = 'routes/api.php'").isEmpty()
    hits = index.search_text(store, "class User", repos=["lar"], limit=2).collect()
    assert hits[0].repo_name == "lar" and hits[0].score >= hits[1].score and [h["rank"] for h in hits] == [1, 2]
    assert index.search_text(store, "class User", languages=["ts"]).isEmpty()  # languages go by name
    with pytest.raises(ValueError):
        index.search_text(store, " ")
    stay, gone = incremental.delete_repo(store.chunks(), "lar")
    assert gone.first().deleted + stay.count() == store.chunks().count()


def test_upsert_keeps_repeats(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, text string")
    new = spark.createDataFrame([("a", "y"), ("a", "z")], "id string, text string")
    assert sorted((r.id, r.text) for r in incremental.upsert(old, new).collect()) == [("a", "y"), ("a", "z"), ("b", "x")]


def test_vectors(spark):
    rows = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(250)], "id string, text string")
    sizes = []

    def count(texts):
        assert len(texts) <= 100
        return [[float(len(t))] * 3 for t in texts]

    assert embed.embed_chunks(rows, count, 3).count() == 250 and sizes == []
    for bad in (lambda t: [[1.0] * 3] * (len(t) - 1), lambda t: [[1.0] * 2] * len(t)):
        with pytest.raises(Exception, match="vector"):
            embed.embed_chunks(rows, bad, 3).select(F.sum(F.size("vector"))).collect()
    with pytest.raises(Exception, match="no vector for chunk c1"):
        embed.attach(rows.where("id = 'c1'"), spark.createDataFrame([], "id string, vector array<float>")).collect()


def test_nearest(spark):
    rows = spark.createDataFrame([(f"c{i:02}", [float(i), 0.0], f"r{i % 2}", "go", f"t{i}") for i in range(20)], "id string, vector array<float>, repo_name string, language string, text string")
    assert [r.id for r in search.nearest(search.filtered(rows, ["r1"]), [3.9, 0.0], 3).collect()] == ["c03", "c05", "c01"]
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [19.0, 0.0])], "query_id bigint, vector array<float>")
    assert {(r.query_id, r["rank"], r.id) for r in search.nearest_each(rows, q, 2).collect()} == {(1, 1, "c00"), (1, 2, "c01"), (2, 1, "c19"), (2, 2, "c18")}
    assert search.nearest_each(rows, q.limit(0), 2).isEmpty() and search.nearest_each(rows.limit(0), q, 2).isEmpty()


def test_nearest_in_blocks_equals_broadcast(spark):
    """More queries than are broadcast, ids and queries that repeat, ties, and blocks merged in two steps."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"c{i % 290}", [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)] + [("none", None)], "id string, vector array<float>")
    q = spark.createDataFrame([(i % 70, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(75)] + [(99, None)], "query_id int, vector array<float>")
    plain = lambda df: sorted((r.query_id, r["rank"], r.distance, r.id) for r in df.collect())
    want = plain(search.nearest_each(rows, q, 4))
    assert len(want) == 300
    for query_block, row_block in ((10, 100), (74, 1000), (20, 3)):
        assert plain(search.nearest_each(rows, q, 4, query_block, row_block)) == want
    assert search.nearest_each(rows.limit(0), q, 4, 10, 10).isEmpty()


def test_best_of_tiles_equals_the_whole_order(monkeypatch):
    """Ties, null ids, vectors that are no numbers, sums that overflow or vanish, and lengths that hide the distances."""
    import numpy as np
    import pyarrow as pa

    for name, n in {"TILE_QUERIES": 3, "TILE_ROWS": 7, "SLICE": 5, "KEPT": 2}.items():
        monkeypatch.setattr(search, name, n)
    rng = np.random.default_rng(4)
    ids = [None if i % 13 == 0 else f"c{i * 7 % 50}" for i in range(60)]
    for kind, scale, shift in ((np.float32, 1, 0), (np.float32, 1e-25, 0), (np.float32, 1e18, 0), (np.float32, 1e30, 0), (np.float32, 2**-8, 3000), (np.float64, 1, 0), (np.float64, 1e-170, 0), (np.float64, 1e200, 0)):
        v, q = ((rng.integers(-2, 3, (n, 4)) * scale + shift).astype(kind) for n in (60, 8))
        v[5, 1], v[9, 0] = np.nan, np.inf
        for limit in (1, 4, 100):
            best = search._Best(q, limit)
            with np.errstate(all="ignore"):
                for at in range(0, 60, 11):
                    best.see(v[at : at + 11], pa.array(ids[at : at + 11], pa.string()))
                asked, distance, found = best.found()
                want = []
                for k in range(8):
                    d = np.cumsum((q[k].astype(float) - v) ** 2, axis=1)[:, -1].tolist()
                    order = sorted(range(60), key=lambda i: (d[i] != d[i], 0 if d[i] != d[i] else d[i], ids[i] is not None, ids[i] or ""))  # noqa: B023
                    want += [(k, d[i], ids[i]) for i in order[:limit]]
            assert str(list(zip(asked.tolist(), distance.tolist(), found.to_pylist(), strict=True))) == str(want), (kind, scale, limit)


def test_blocks_move_rows_once(spark):
    """Rows and queries are shuffled once, however many blocks they make."""
    rows = spark.range(400).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    q = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vector")
    context = spark.sparkContext

    def moved():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    got = search.nearest_each(rows, q, 2, query_block=4, row_block=50).collect()
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(k, n, k if n == 1 else (k - 1 if k else 1)) for k in range(0, 400, 2) for n in (1, 2)}
    assert sum(n for k, n in moved().items() if k not in before) < 400 + 200 + 200 * 8 * 2 + 100  # with the best of eight blocks


def test_pivots_leave_most_rows_unread_and_lose_none(spark, tmp_path):
    import numpy as np

    from lodestack.operators import pivots

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 5
    vectors = [(centres[i % 30] + rng.standard_normal(16) * 0.3).tolist() for i in range(3000)]
    rows = spark.createDataFrame([(f"c{i}", v, f"r{i % 4}", "go" if i % 10 else None) for i, v in enumerate(vectors)] + [("none", None, "r1", "go")], "id string, vector array<double>, repo_name string, language string")
    pivots.build(rows, f"{tmp_path}/i", 30)
    plain = lambda df: [(r.id, round(r.distance, 9), round(r.score, 9)) for r in df.orderBy("distance", "id").collect()]
    for k in (0, 17, 1234):
        q = [x + 0.01 for x in vectors[k]]
        for how in ({}, {"repos": ["r1", "r2"]}, {"languages": ["go"]}):
            assert plain(pivots.nearest(spark, f"{tmp_path}/i", q, 10, **how)) == plain(search.nearest(search.filtered(rows, **how), q, 10))
        left, rest = pivots.rows_left(spark, f"{tmp_path}/i", q, 10)
        assert rest == 3000 and left < 600
    assert len(plain(pivots.nearest(spark, f"{tmp_path}/i", q, 10, languages=["none"]))) == 0
    assert len(plain(pivots.nearest(spark, f"{tmp_path}/i", q, 5000))) == 3000  # no bound: all rows
    pivots.build(rows.limit(0), f"{tmp_path}/none")
    assert pivots.nearest(spark, f"{tmp_path}/none", q, 3).isEmpty()


def test_texts_are_embedded_once_over_all_runs(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def counted(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    named = index.Settings(dim=1, embed=counted, model="counted")
    first = [("a", "x.json", "one\n"), ("b", "y.json", "one\n"), ("b", "z.json", "two two\n")]
    index.index(listing(spark, *first), store, named)
    assert seen.value == 2
    more = [*first, ("c", "v.json", "two two\n"), ("c", "w.json", "three\n")]
    index.index(listing(spark, *more), store, named, full=True)
    assert seen.value == 3
    vectors = lambda: sorted((r.repo_name, r.text, r.vector[0]) for r in store.chunks().collect())
    want = sorted((r, t, float(len(t))) for r, _, t in more)
    assert vectors() == want
    store.merge_vectors("counted", most=0)
    assert sorted(r.vector[0] for r in store.vectors("counted").collect()) == [4.0, 6.0, 8.0]
    store.merge_vectors("counted", store.chunks().where("repo_name = 'a'").select(embed.digest(F.col("text")).alias("digest")))
    assert [r.vector[0] for r in store.vectors("counted").collect()] == [4.0]
    index.index(listing(spark, *more), store, index.Settings(dim=1, embed=counted), full=True)  # a model without a name
    assert seen.value == 6 and vectors() == want


def test_rendered(spark):
    row = spark.createDataFrame([(1, 0.5, "/w/a.go", 3, 9, "r", "go", "main.F", "code")], "rank int, score double, file_path string, start_line int, end_line int, repo_name string, language string, symbol_name string, chunk_text string")
    assert row.select(search.rendered(row)).first()[0] == "[1] score: 0.500\n/w/a.go:3-9 (r)\nsymbol: main.F\n```go\ncode\n```"


def test_reading_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"one\r\ntwo\xff\rthree")
    (tmp_path / "a" / ".env.example").write_text("A=1\n")
    read = tables.read_files(spark, str(tmp_path)).collect()
    assert [(r.abs_path, r.content) for r in read] == [(f"{tmp_path}/a/x.txt", "one\ntwo\nthree")]
    listed = {r.abs_path: r.content for r in tables.list_files(spark, str(tmp_path)).collect()}
    assert listed == {f"{tmp_path}/a/x.txt": "one\ntwo\nthree", f"{tmp_path}/a/.env.example": "A=1\n"}


def test_file_source(spark, tmp_path):
    """All files, in folders of any depth and by any name, with what Spark's reader gives of those that it sees."""
    from lodestack.sources.files import FilesReader

    names = ["top.md", ".hidden", "a/_x/y.go", "a/.git/HEAD", "a/b/c/d/e.txt", "a/b/empty", "b/..odd/z"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if "empty" in n else f"{n}\r\n".encode() * (i + 1) + b"\xff")
    got = {r.abs_path: (r.size, r.mtime, r.content) for r in tables.list_files(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {f"{tmp_path}/{n}" for n in names} and got[f"{tmp_path}/top.md"][2] == "top.md\n"
    for r in tables.read_files(spark, str(tmp_path)).collect():
        assert got[r.abs_path] == (r.size, r.mtime, r.content)
    folders = FilesReader({"path": str(tmp_path)}).partitions()
    assert {(f.path.removeprefix(str(tmp_path)), f.recursive) for f in folders} == {("", False), ("/a", False), ("/b", False), ("/a/_x", True), ("/a/.git", True), ("/a/b", True), ("/b/..odd", True)}


def test_store_survives_odd_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("manifest", spark.createDataFrame([("/a", "r", 1.0, 2)], MANIFEST))
    store.write("manifest", store.manifest().unionByName(spark.createDataFrame([("/b", "r", 1.0, 2)], MANIFEST)))  # reads what it replaces
    assert store.manifest().count() == 2
    assert tables.chunk_schema_cast(spark.createDataFrame([], CHUNKS)).schema.names == CHUNKS.names


def test_stream(spark, tmp_path):
    source, store = f"{tmp_path}/in", Store(spark, f"{tmp_path}/store")
    corpus(spark).where("repo_name = 'lar'").write.parquet(source)
    follow.follow(spark, source, store, f"{tmp_path}/cp").awaitTermination()
    n = store.chunks().count()
    assert n > 0
    corpus(spark).write.mode("append").parquet(source)
    follow.follow(spark, source, store, f"{tmp_path}/cp").awaitTermination()
    assert store.chunks().where("repo_name = 'lar'").count() == n and store.chunks().count() > n


def contents(store):
    """What a store has, for comparing stores."""
    rows = lambda df, *names: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    return {
        "chunks": rows(store.chunks(), "id", "text", "file_mtime", "vector"), "manifest": rows(store.manifest(), "abs_path", "mtime", "chunk_count"),
        "summaries": rows(store.summaries(), "name", "stack", "endpoints_count", "chunk_count"), **{c: rows(store.structured(c), *s.names) for c, s in index.CATEGORIES.items()},
    }


def test_stream_equals_runs_over_whole_listings(spark, tmp_path):
    """New versions, removals, late and repeated events: the stream has what runs over the listings of these times have."""
    event = lambda repo, path, mtime, content: (repo, f"/w/{repo}", path, f"/w/{repo}/{path}", len(content or ""), mtime, content, content is None)
    a1, a2, a3 = ("a", "x.json", 1.0, "one\n"), ("a", "x.json", 2.0, "two\nlines\n"), ("a", "x.json", 3.0, None)
    env1, env2 = ("a", ".env.example", 1.0, "A=1\n"), ("a", ".env.example", 2.0, "A=2\nB=3\n")
    go, b1 = ("a", "go.mod", 1.0, "m\n"), ("b", "y.md", 1.0, "# T\nt\n")
    batches = [[a1, env1, go, b1, a2, a1], [a3, a1, env2, env1, b1], [a2, ("b", "y.md", 1.0, None)]]
    listings = [[a2, env1, go, b1], [env2, go, b1], [env2, go]]
    source, streamed, batch = f"{tmp_path}/in", Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/b")
    for events, whole in zip(batches, listings, strict=True):
        spark.createDataFrame([event(*e) for e in events], follow.EVENTS).write.mode("append").parquet(source)
        follow.follow(spark, source, streamed, f"{tmp_path}/cp").awaitTermination()
        index.index(spark.createDataFrame([event(*e)[:-1] for e in whole], FILES), batch)
        assert contents(streamed) == contents(batch)


def listing(spark, *named):
    return spark.createDataFrame([(r, f"/w/{r}", p, f"/w/{r}/{p}", len(c), 1.0, c) for r, p, c in named], FILES)


def test_typed_rows_of_files_that_are_gone_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    both = [("a", ".env.example", "X=1\n"), ("b", ".env.example", "Y=2\n"), ("a", "go.mod", "m"), ("a", "main.go", 'r.Get("/x", h)\n')]
    index.index(listing(spark, *both), store)
    assert sorted((r.repo_name, r.name) for r in store.structured("env").collect()) == [("a", "X"), ("b", "Y")]
    assert store.summaries().where("name = 'a'").first().endpoints_count == 1
    index.index(listing(spark, *both[1:3]), store)
    assert [(r.repo_name, r.name) for r in store.structured("env").collect()] == [("b", "Y")]
    assert store.load_structured("env", "b").count() == 1 and store.load_structured("env", "a").isEmpty() and store.structured("routes").isEmpty()
    assert store.summaries().where("name = 'a'").first().endpoints_count == 0
    index.index(listing(spark, both[2]), store, repos=["a"])  # b isn't scanned and stays
    assert store.structured("env").count() == 1


def test_failed_write_keeps_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("/a", "r", 1.0, 2)], MANIFEST)
    store.write("manifest", rows)
    with pytest.raises(Exception, match="broken"):
        store.write("manifest", rows.withColumn("abs_path", F.raise_error(F.lit("broken")).cast("string")))
    assert [r.abs_path for r in store.manifest().collect()] == ["/a"]
    store.write("manifest", rows.withColumn("abs_path", F.lit("/b")))
    store.write("manifest", rows.withColumn("abs_path", F.lit("/c")))
    store.clean("manifest", keep=1)
    assert [r.abs_path for r in store.manifest().collect()] == ["/c"] and len(store.versions("manifest")) == 1


def test_manifest_that_is_none_reads_as_empty_but_chunks_do_not(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("manifest", spark.createDataFrame([(1,)], "x int"))
    assert store.manifest().isEmpty() and store.manifest().columns == MANIFEST.names
    store.write("summaries", spark.createDataFrame([("a",)], "name string"))
    assert store.summaries().first().chunk_count is None


def test_only_touched_repositories_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    index.index(listing(spark, ("a", "x.json", "one\n"), ("b", "y.json", "two\n")), store)
    index.index(listing(spark, ("a", "x.json", "one\n"), ("b", "y.json", "two\n"), ("b", "z.json", "three\n")), store)
    assert sorted((r.repo_name, r.text) for r in store.chunks().collect()) == [("a", "one\n"), ("b", "three\n"), ("b", "two\n")]
    live = {r.repo_name: r for r in store.read("chunks", LIVE).collect()}
    assert live["a"].part != live["b"].part
    assert {p.name for p in (tmp_path / "chunks" / "parts" / f"part={live['b'].part}").iterdir() if p.is_dir()} == {f"bucket={live['b'].bucket}"}


def stored(spark, *rows):
    """Chunks of (id, repository, text, vector)."""
    from lodestack.schemas import STORED

    return spark.createDataFrame([(i, t, r, "f", f"/w/{r}/f", 1, 1, "go", "text", None, 0.0, v) for i, r, t, v in rows], STORED)


def kept(store, repos=None):
    return sorted(((r.id, r.repo_name, r.text) for r in store.chunks(repos).collect()), key=str)


def test_null_and_empty_names_are_names(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_chunks(stored(spark, ("1", None, "a", [0.0]), ("2", "", "b", [0.0]), ("3", "x", "c", [0.0])))
    assert kept(store) == [("1", None, "a"), ("2", "", "b"), ("3", "x", "c")]
    store.write_chunks(stored(spark, ("4", None, "d", [0.0])))
    assert kept(store) == [("2", "", "b"), ("3", "x", "c"), ("4", None, "d")]
    assert kept(store, spark.createDataFrame([(None,), ("",)], "repo_name string")) == [("2", "", "b"), ("4", None, "d")]
    store.write_chunks(stored(spark).limit(0), spark.createDataFrame([(None,)], "repo_name string"))
    assert kept(store) == [("2", "", "b"), ("3", "x", "c")]


def test_chunks_are_embedded_once_a_write(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def counted(texts):
        seen.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = stored(spark, *[(str(i), f"r{i % 7}", f"text {i}", None) for i in range(90)]).drop("vector")
    store.write_chunks(embed.embed_chunks(rows, counted, 1))
    assert store.chunks().count() == 90 and seen.value == 90


def test_reading_some_repositories_opens_their_folders_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for run in range(3):
        store.write_chunks(stored(spark, *[(f"{run}-{i}", f"r{run}-{i}", "t", [0.0]) for i in range(60)]))
    wanted = spark.createDataFrame([("r1-7",)], "repo_name string")
    some = store.chunks(wanted)
    assert [r.id for r in some.collect()] == ["1-7"]
    opened = lambda rows: {f.rsplit("/", 1)[0] for f in rows.inputFiles() if "/parts/" in f}
    assert len(opened(some)) == 1 < len(opened(store.chunks()))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "In(repo_name, [r1-7])" in plan or "EqualTo(repo_name,r1-7)" in plan


def test_an_incremental_run_reads_only_touched_repositories(spark, tmp_path, monkeypatch):
    store, opened = Store(spark, str(tmp_path)), []
    real = Store._rows
    monkeypatch.setattr(Store, "_rows", lambda self, table, schema, folders: opened.append((table, len(folders))) or real(self, table, schema, folders))
    names = [f"r{i}" for i in range(40)]
    index.index(listing(spark, *[(r, "x.json", f"{r}\n") for r in names]), store)
    opened.clear()
    changed = listing(spark, *[(r, "x.json", f"{r}\n") for r in names]).withColumn("mtime", F.when(F.col("repo_name") == "r3", 2.0).otherwise(1.0))
    assert {r.repo_name: r.files_processed for r in index.index(changed, store).collect()} == {"r3": 1, None: 1}
    assert [n for table, n in opened if table == "chunks"] == [1]
    assert store.chunks().count() == 40


def test_storage_is_bounded_after_many_runs(spark, tmp_path):
    """Replacing and adding repositories for many runs leaves few folders, and no more dead rows than live ones."""
    store, want = Store(spark, str(tmp_path), buckets=4), {}
    for run in range(50):
        names = [f"r{k}" for k in (run % 5, 5 + run % 11, 20 + run)]
        store.write_chunks(stored(spark, *[(f"{n}-{run}-{i}", n, "t", [0.0]) for n in names for i in range(3)]))
        want |= {n: [f"{n}-{run}-{i}" for i in range(3)] for n in names}
        store.compact("chunks", tables.STORED)
        store.clean("chunks", keep=1)
    assert sorted(r.id for r in store.chunks().select("id").collect()) == sorted(i for ids in want.values() for i in ids)
    folders = store.folders("chunks")
    live, total = sum(f[2] for f in folders), sum(f[3] for f in folders)
    on_disk = spark.read.schema("id string").parquet(f"{tmp_path}/chunks/parts/*/*").count()
    assert live == 3 * len(want) and total <= 2 * live and on_disk == total and len(folders) <= 4 * (tables.PARTS + 8)


def test_many_small_repositories_make_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.concat(F.lit("r"), "id").alias("repo_name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.STORED.fields[3:]])
    store.write_chunks(rows)
    assert store.chunks().count() == 20_000 and len(list((tmp_path / "chunks" / "parts").rglob("*.parquet"))) <= 64


def test_deleting_touches_no_data(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_chunks(stored(spark, *[(str(i), f"r{i % 3}", "t", [0.0]) for i in range(30)]))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks" / "parts").rglob("*.parquet")}
    before = files()
    assert store.delete_repo("chunks", "r1") == 10 and store.delete_repo("chunks", "r1") == 0 and store.delete_repo("chunks", None) == 0
    assert files() == before and {r.repo_name for r in store.chunks().collect()} == {"r0", "r2"}
    store.write_chunks(stored(spark, ("new", "r1", "t", [0.0])))
    assert kept(store, spark.createDataFrame([("r1",)], "repo_name string")) == [("new", "r1", "t")]


def test_search_measures_rows_of_one_id_apart(spark):
    rows = stored(spark, ("same", "r", "near", [0.0, 0.0]), ("same", "r", "far", [4.0, 0.0]), ("b", "r", "middle", [1.0, 0.0]), ("c", "r", "none", None), (None, "r", "no id", [0.5, 0.0]))
    found = [(r.chunk_text, r.score) for r in search.search(rows, [0.0, 0.0], limit=10).orderBy("rank").collect()]
    assert found == [("near", 1.0), ("no id", 1 / 1.25), ("middle", 0.5), ("far", 1 / 17)]
    assert [r.chunk_text for r in search.search(rows, [0.0, 0.0], limit=2).orderBy("rank").collect()] == ["near", "no id"]


def test_json_is_replaced_by_pair_and_read_back(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "repo_name string, category string, payload string")
    assert store.load_json().isEmpty()
    store.save_json(rows(("a", "env", '[{"name":"X","default":"","comment":"c"}]'), ("a", "docker", "[]"), ("b", "env", "[]")))
    store.save_json(rows(("b", "env", '[{"name":"Y","default":"1","comment":""}]')))
    assert sorted((r.repo_name, r.category) for r in store.load_json().collect()) == [("a", "docker"), ("a", "env"), ("b", "env")]
    got = extract.payload_rows(store.load_json().unionByName(rows(("c", "env", "no json"))), "env")
    assert got.columns == ["repo_name", "name", "default", "comment"] and sorted(map(tuple, got.collect())) == [("a", "X", "", "c"), ("b", "Y", "1", "")]


def test_json_of_many_repositories_makes_few_files(spark, tmp_path):
    """Files don't grow with repositories, saves replace whole pairs, and null and empty names, line feeds and null payloads come back."""
    store = Store(spark, str(tmp_path), buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "repo_name string, category string, payload string")
    store.save_json(rows(*[(f"r{i}", c, "[0]") for i in range(100) for c in ("env", "docker")], (None, "env", "none"), ("", "env", "empty\nname"), ("r1", None, None)))
    assert len(list(tmp_path.rglob("*.parquet"))) <= 20
    for k in range(1, 4):
        store.save_json(rows(*[(f"r{i}", "env", f"[{k}]") for i in range(50)], ("", "env", f"empty {k}")))
    got = {(r.repo_name, r.category): r.payload for r in store.load_json().collect()}
    want = {(f"r{i}", c): "[3]" if i < 50 and c == "env" else "[0]" for i in range(100) for c in ("env", "docker")}
    assert got == want | {(None, "env"): "none", ("", "env"): "empty 3", ("r1", None): None} and store.load_json().count() == len(got)
    stored = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "json" / "parts")).count()
    assert stored <= 2 * len(got) + 102  # dead rows go: of the pairs, and of the two versions that are kept


def test_queries_are_embedded(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id int, text string")
    got = {r.query_id: r.vector for r in embed.embed_query(q, embed.hashed_words(8), 8).collect()}
    assert set(got) == {1, 2} and all(len(v) == 8 for v in got.values())
    with pytest.raises(Exception, match="empty"):
        embed.embed_query(q.withColumn("text", F.lit(" ")), embed.hashed_words(8), 8).collect()
    with pytest.raises(Exception, match="chunk 1 has"):
        embed.with_checked(spark.createDataFrame([("z", 1, [0.5])], "other string, id int, vector array<float>"), 2).collect()
    assert tables.with_workspace(q, "/w").first().workspace == tables.with_workspace(q, "/w").collect()[1].workspace


def test_nearest_with_nulls_and_equal_ids(spark):
    rows = spark.createDataFrame([("a", [0.0]), ("b", None), ("c", [5.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0]), (1, [4.0]), (2, None)], "query_id int, vector array<float>")
    got = sorted((r.query_id, r.id, r.distance, r["rank"]) for r in search.nearest_each(rows, q, 1).collect())
    assert got == [(1, "a", 1.0, 1), (1, "c", 1.0, 1)]
    assert [r.id for r in search.nearest(rows, [9.0], 3).collect()] == ["c", "a"]


def test_routes_of_files_listed_twice_count_once(spark):
    go = listing(spark, ("a", "main.go", 'r.Get("/x", h)\n'), ("a", "routes/api.php", "Route::get('/y', C@x);\n"))
    twice = go.union(go)
    assert extract.routes_go(twice).count() == 1 and extract.routes_laravel(twice).count() == 1


def test_extractors_can_be_added(spark):
    notes = extract.Extractor("notes", lambda files: files.select("repo_name", F.length("content").alias("n")), lambda p: p.endswith(".note"), ("go",))
    files_ = listing(spark, ("a", "x.note", "abc"), ("b", "x.note", "abcd"), ("a", "go.mod", ""))
    found = extract.extract_structured(files_, detect.profiles(files_), [*extract.EXTRACTORS, notes])
    assert set(found) == {"routes", "migrations", "env", "docker", "notes"} and [tuple(r) for r in found["notes"].collect()] == [("a", 3)]
    assert extract.extractable(files_, [notes]).count() == 2
