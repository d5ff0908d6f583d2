"""The data source of trees: hidden names, folders that stay closed, pushed filters, ignore files, a stream."""

import os

import pytest

from tessera.sources import scan, tree

FILES = {
    "a.js": b"x", ".gitignore": b"*.log\n!keep.log\n", "lib/.gitignore": b"deep/\n", ".env": b"KEY=1", "_under/x.py": b"1", ".hidden/y.py": b"2", "lib/a.log": b"l", "lib/keep.log": b"k",
    "lib/deep/z.js": b"z", "node_modules/m/index.js": b"m", "lib/dist/d.js": b"d", "bin/n.bin": b"a\0b", "big.txt": b"x" * (scan.MOST_BYTES + 1),
}


@pytest.fixture
def root(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    tree.register(spark)
    return tmp_path / "t"


def _read(spark, root, **options):
    return spark.read.format("tree").options(path=str(root), **options).load()


def test_all_names_but_closed_folders(spark, root):
    for splits in (1, 3, 64):
        rows = {r.path: r for r in _read(spark, root, splits=splits).collect()}
        assert set(rows) == set(FILES) - {"node_modules/m/index.js", "lib/dist/d.js"}
        assert all(rows[p].size == len(FILES[p]) for p in rows) and bytes(rows[".env"].content) == b"KEY=1"
        assert rows["bin/n.bin"].binary and rows["big.txt"].content is None and not rows["a.js"].binary
    assert set(FILES) == {r.path for r in _read(spark, f"file://{root}", prune="").collect()}
    assert _read(spark, root / "none").count() == 0


def test_ignored_and_unwanted_folders_are_not_opened(spark, root):
    """Folders that can't be listed do no harm as long as nothing asks for them."""
    closed = tree.Tree({"path": str(root)})
    opened: list = []
    plain = tree.Tree.below
    try:
        tree.Tree.below = lambda self, folder: opened.append(folder) or plain(self, folder)
        list(closed.walk([""]))
        assert "lib" in opened and not {"node_modules", "lib/dist"} & set(opened)
        opened.clear()
        parts = closed.plan(["lib/a"])
        assert {f for p in parts for f in p.files} == {"lib/a.log"} and set(opened) == {"", "lib"}
    finally:
        tree.Tree.below = plain


def test_filters_reach_the_plan(spark, root):
    assert sorted(r.path for r in _read(spark, root).where("path like 'lib/%'").collect()) == ["lib/.gitignore", "lib/a.log", "lib/deep/z.js", "lib/keep.log"]
    assert [r.path for r in _read(spark, root).where("path = 'lib/a.log'").collect()] == ["lib/a.log"]
    assert sorted(r.path for r in _read(spark, root).where("path in ('a.js', '.hidden/y.py')").collect()) == [".hidden/y.py", "a.js"]
    assert _read(spark, root).where("path like 'lib/%' and path = 'a.js'").count() == 0


def test_ignore_files_reach_the_rules(spark, root):
    files = _read(spark, root)
    rules = scan.load_rules(tree.ignore_files(files))
    got = {r.path: r.reason for r in scan.decide_nested(files.drop("content"), rules).collect()}
    assert got["lib/a.log"] == "gitignore" and got["lib/keep.log"] == "included-by-gitignore-negation" and got["lib/deep/z.js"] == "gitignore"
    assert got[".hidden/y.py"] == "included" and got["big.txt"] == "too-large" and got["bin/n.bin"] == "binary" and got[".env"] == "default-env-file"


def test_a_stream_tells_what_changed(spark, root, tmp_path):
    seen: list = []

    def run():
        rows = spark.readStream.format("tree").option("path", str(root)).load().select("path", "size")
        query = rows.writeStream.foreachBatch(lambda df, _: seen.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run()
    assert {p for batch in seen for p, _ in batch} == set(FILES) - {"node_modules/m/index.js", "lib/dist/d.js"}
    seen.clear()
    (root / "lib" / "new.js").write_bytes(b"12345")
    os.utime(root / "a.js", ns=(2**61, 2**61))
    run()
    assert [x for batch in seen for x in batch] == [("a.js", 1), ("lib/new.js", 5)]
