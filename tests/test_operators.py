"""Operators without SQL of their own: parsers, scans, packing, snapshots, streams, providers."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bundle, incremental, relations, search
from tessera.sources import providers, scan
from tessera.streaming import watch


def test_text_functions(spark):
    def fnv(s):
        h = 2166136261
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "authToken", "é", "😀x", "sign:token"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r.h for r in df.select(T.fnv1a(F.col("s")).alias("h")).collect()] == [fnv(w) for w in words]
    got = spark.createDataFrame([("getUserName HTTPServer x_1 9 é",)], "s string").select(T.tokenize(F.col("s")).alias("t"), T.simple_name(F.lit("method:A.b")).alias("n"), T.search_names(F.lit("method:A.b")).alias("m"), T.language_of(F.lit("a/B.TSX")).alias("l")).first()
    assert got.t == ["get", "user", "name", "httpserver", "x_1", "9"] and got.n == "b" and got.m == ["method:A.b", "A.b", "b"] and got.l == "typescript"


def test_scan(spark, tmp_path):
    for name, content in {"a.js": b"x", "dist/b.js": b"x", "lib/c.log": b"x", "lib/keep.log": b"x", "n.bin": b"a\0b", "big.txt": b"x" * (scan.MOST_BYTES + 1), "out/deep/k.log": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rules = [r for line in ("# c", "*.log", "!keep.log", "/out/") if (r := scan.Rule.parse(line))]
    files = scan.read_tree(spark, str(tmp_path)).drop("content").unionByName(spark.createDataFrame([(".env.local", 1, False)], "path string, size long, binary boolean"))
    got = {r.path: r.reason for r in scan.decide(files, rules).collect()}
    assert got == {"a.js": "included", "dist/b.js": "default-ignore-dir", "lib/c.log": "gitignore", "lib/keep.log": "included-by-gitignore-negation", "n.bin": "binary", ".env.local": "default-env-file", "big.txt": "too-large", "out/deep/k.log": "gitignore"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 300)), min_size=1, max_size=8), st.integers(10, 500))
def test_packing_equals_a_loop(spark, items, budget):
    room, want = budget, []
    for i, (h, s) in enumerate(items):
        body = room - h - 24
        if body <= 0:
            break
        used = h + (s if s <= body else max(0, body - 15) + 15)
        want.append((i, s > body, used))
        room -= used + 2
    df = spark.createDataFrame([("g", i, "h" * h, "s" * s) for i, (h, s) in enumerate(items)], "g string, i int, header string, body string")
    got = [(r.i, r.cut, r.used) for r in bundle.pack(df, "g", ["i"], F.length("header"), F.length("body"), budget).orderBy("i").collect()]
    assert got == want


def test_snapshot_is_published_behind_a_pointer(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    incremental.publish({"files": df}, str(tmp_path), "v1")
    new = incremental.upsert(df, spark.createDataFrame([("b", "3"), ("c", "4")], df.schema))
    incremental.publish({"files": new}, str(tmp_path), "v2")
    assert sorted(map(tuple, spark.read.parquet(incremental.current(spark, str(tmp_path)) + "/files").collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    incremental.check_compatible({}, "p", 3, 0)
    with pytest.raises(ValueError):
        incremental.check_compatible({"embedding_provider": "q", "embedding_dims": "3"}, "p", 3, 1)


def test_watch_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + timedelta(seconds=20)), ("a", t + timedelta(minutes=5)), ("b", t + timedelta(hours=3))]
    spark.createDataFrame(rows, "path string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen: list = []
    stream = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    q = watch.watch(stream, "ts", "path", "1 minute", "1 minute", lambda df, n: seen.extend((r.path, r.n) for r in df.collect()), f"{tmp_path}/state")
    q.awaitTermination(120)
    assert sorted(seen) == [("a", 1), ("a", 2)]


def test_nearby_tests_and_paths(spark):
    files = spark.createDataFrame([("a/auth.js",), ("t/auth.test.js",), ("t/auth.spec.js",), ("b/other.js",)], "path string")
    assert sorted((r.path, r.test_path) for r in relations.nearby_tests(files).where("path = 'a/auth.js'").collect()) == [("a/auth.js", "t/auth.spec.js"), ("a/auth.js", "t/auth.test.js")]
    imports = spark.createDataFrame([("a/x.js", "./auth"), ("a/x.js", "../b/other.js"), ("a/x.js", "lib"), ("a/x.js", "./none")], "importer string, source string")
    got = {r.source: r.target for r in relations.resolve_imports(imports, files).collect()}
    assert got == {"./auth": "a/auth.js", "../b/other.js": "b/other.js", "lib": None, "./none": None}


def _fake(url, body, headers):
    assert url == "http://h/embeddings" and headers == {"authorization": "Bearer k"}
    return {"data": [{"embedding": [float(len(body["input"])), 1.0]}]}


def test_providers(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    got = providers.embed(df, providers.Provider("embeddings", "http://h/", "m", 2, "k", _fake)).orderBy("id").collect()
    assert [r.vector for r in got] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        providers.Provider("embed", "", "m", 2)
    with pytest.raises(ValueError):
        providers.Provider("embed", "u", "m", 2, post=lambda *a: {"embeddings": [[1.0]]}).vector("x")


def test_requests_are_bounded():
    assert search.Request().limit == 8
    for bad in ({"limit": 0}, {"limit": 26}, {"max_chars": 499}, {"references": 101}):
        with pytest.raises(ValueError):
            search.Request(**bad)
    with pytest.raises(ValueError):
        scan._overrides(("*.js", "!keep.js"))


def test_unknown_modes_are_refused(spark):
    none = spark.createDataFrame([], "path string, start_line int, end_line int, symbol string, text string")
    with pytest.raises(ValueError):
        search.search(none, none, "path", "text", modes=("fuzzy",))
    asked = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert search.search(none, asked, "item_id", "text").count() == 0 and search.search(none, asked.limit(0), "item_id", "text").count() == 0


def test_search_takes_odd_rows(spark):
    rows = [("a/b.py", 1, 3, "function:load_user", "def load_user(): pass"), (None, 1, 1, None, None), ("c.py", 2, 2, "$", ""), ("a/b.py", 1, 3, "function:load_user", "def load_user(): pass")]
    chunks = spark.createDataFrame(rows, "path string, start_line int, end_line int, symbol string, text string")
    asked = spark.createDataFrame([(1, "load_user"), (2, ""), (3, None)], "item_id long, text string")
    found = search.search(chunks, asked, "item_id", "text", 2, search.MODES).collect()
    assert {(r.item_id, r["mode"]) for r in found} == {(i, m) for i in (1, 2, 3) for m in search.MODES}
    first = next(r for r in found if r.item_id == 1 and r["mode"] == "hybrid" and r["rank"] == 1)
    assert first.path == "a/b.py" and first.symbol_score == 1.0 and first.why == "exact symbol match"


def test_watch_with_a_feed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(seconds=s)) for s in (0, 1, 2, 100, 101)] + [(1, start + timedelta(hours=1)), (1, start + timedelta(hours=2))]
    spark.createDataFrame(rows, "path long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("path long, ts timestamp").parquet(str(tmp_path / "events"))
    feed = watch.with_feed(lambda df, _: df.agg(F.count(F.lit(1)).alias("bursts"), F.sum("n").alias("events")), str(tmp_path / "feed"))
    query = watch.watch(stream, "ts", "path", "10 seconds", "1 minute", feed, str(tmp_path / "state"), every="1 second")
    watch.drain(query)
    told = spark.read.json(str(tmp_path / "feed" / "*"))
    assert not query.isActive and told.agg(F.sum("bursts"), F.sum("events")).first()[:] == (3, 6)


def test_nested_rules_and_last_wins(spark):
    files = spark.createDataFrame([(p, 1, False) for p in ("a.log", "lib/a.log", "lib/keep.log", "lib/sub/x.txt", "gen/x.txt", "lib/gen/x.txt", "lib/c[1].txt")], "path string, size long, binary boolean")
    rules = scan.load_rules(spark.createDataFrame([("", "# all\n*.log\n/gen/\n"), ("lib", "!keep.log\nsub/\nc[1].txt\n")], "base string, text string"))
    got = {r.path: (r.reason, r.rule) for r in scan.decide_nested(files, rules).collect()}
    assert got == {
        "a.log": ("gitignore", "*.log"), "lib/a.log": ("gitignore", "*.log"), "lib/keep.log": ("included-by-gitignore-negation", "keep.log"), "lib/sub/x.txt": ("gitignore", "sub"),
        "gen/x.txt": ("gitignore", "gen"), "lib/gen/x.txt": ("included", None), "lib/c[1].txt": ("gitignore", "c[1].txt"),
    }
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "path string, n long"), spark.createDataFrame([("b", 2), ("b", 3)], "path string, n long")
    assert sorted(map(tuple, incremental.upsert(old, new, order="n").collect())) == [("a", 1), ("b", 3)]
    assert incremental.stamped(old).columns[-1] == "indexed_at"
