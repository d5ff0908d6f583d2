"""Blocks and chunks by windows over lines, against a plain walk over each file."""

import random

from tessera.sources import code, indents, symbols

WORDS = ["def f{}(a):", "class C{}:", "async def g{}():", "@deco", "@deco(1)", "x = {}", "# note", "", "   ", "return", "défi = {}", "def é{}(): pass", "define(1)", "class_ = 1"]
INDENTS = ["", "  ", "    ", "\t", "\t  ", "        ", "      ", " "]


def _texts(n: int, seed: int) -> list[str | None]:
    """Files of random lines: indentations of any depth, tabs, dedents to no level, decorators of other widths, both line ends."""
    r = random.Random(seed)
    made: list[str | None] = [None, "", "\n", "def a(): pass", "@x\n@y\ndef a():\n\n\n  # end\n\n", "class A:\n\tdef b(self):\n\t\tpass\n    def c(self): pass\n", "\x0cdef a():\n \x0c b\n"]
    for _ in range(n):
        depth, lines = 0, []
        for i in range(r.randint(1, 40)):
            depth = max(0, min(len(INDENTS) - 1, depth + r.choice([-3, -1, 0, 0, 1, 1])))
            lines.append((INDENTS[depth] if r.random() < 0.7 else r.choice(INDENTS)) + r.choice(WORDS).format(i))
        made.append(r.choice(["\n", "\r\n"]).join(lines))
    return made


def test_random_files(spark):
    texts = _texts(300, 3)
    files = spark.createDataFrame([(f"f{i}.py", t) for i, t in enumerate(texts)], "path string, text string").repartition(3)
    got = sorted(map(tuple, indents.blocks(files).collect()))
    want = sorted((f"f{i}.py", b.kind, b.name, b.start, b.end) for i, t in enumerate(texts) for b in code.blocks_of(t or "", "python"))
    assert got == want and len(got) > 1000
    chunks = indents.chunks(files, 6, 2).select("path", "start_line", "end_line", "symbol", "is_gap", "text")
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, chunks.collect())) == order((f"f{i}.py", *c) for i, t in enumerate(texts) for c in code.chunked(t or "", "python", 6, 2))


def test_no_python_worker_for_indented_files(spark):
    files = spark.createDataFrame([("a.py", "def a():\n  pass"), (None, "def b(): pass")], "path string, text string")
    made = indents.chunks(files)
    assert "Python" not in made._jdf.queryExecution().toString()
    assert [tuple(r) for r in made.collect()] == [("a.py", 1, 2, "function:a", False, "def a():\n  pass")]
    assert symbols.blocks(files.unionByName(spark.createDataFrame([("b.js", "function c() {}")], files.schema))).count() == 2
    assert indents.blocks(files.limit(0)).count() == indents.chunks(files.limit(0)).count() == 0


def test_deep_and_long_files(spark):
    """Rows under levels stay as many as lines and characters: a file nested 300 deep and one of 100,000 definitions."""
    deep = "\n".join(" " * i + f"def f{i}():" for i in range(300)) + "\nend"
    long = "def f():\n" * 100_000
    files = spark.createDataFrame([("deep.py", deep), ("long.py", long)], "path string, text string")
    got = {p: [tuple(r)[1:] for r in indents.blocks(files).where(f"path = '{p}'").orderBy("start_line").collect()] for p in ("deep.py", "long.py")}
    assert got["deep.py"] == [("function", f"f{i - 1}.f{i}" if i else "f0", i + 1, 300) for i in range(300)]
    assert len(got["long.py"]) == 100_000 and got["long.py"][77] == ("function", "f", 78, 78)
