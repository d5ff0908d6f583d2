"""Chunks and symbols of source files: exact ranges, names and links."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources import code, symbols

TS = """import base, { pick as choose, type Row } from "./lib.js";
import * as all from 'pkg';
import "side";
interface Shape { area: number }

@sealed
export class Depot<T> extends Base {
  #count = 0;
  constructor(private readonly rows: Row[]) { super(); }

  async take<U extends T>(id: string): Promise<{ ok: boolean }> {
    const clean = (v: U) => {
      return v; // }
    };
    if (id) { const hidden = () => 1; }
    return clean(await this.rows.find<U>(id)) as any;
  }

  put = async (row: Row) => {
    return `}${row.id}{`;
  };
  static make() { return new Depot([]); }
}

export const build = async <T extends Shape>(
  input: T,
): Promise<T> => {
  return input;
};

export const table = {
  async create(req) {
    return build(req.body);
  },
  drop: (id) => id / 2,
  size: 3,
};
const quiet = 1, loud = function () { return /[/}]/.test("x"); };
enum Colour { Red, Green }
export { quiet as silent, loud };
export default Depot;
"""


def test_typescript_blocks():
    found = [(b.kind, b.name, b.start, b.end) for b in code.blocks_of(TS, "typescript")]
    assert found == [
        ("type", "Shape", 4, 4), ("class", "Depot", 7, 23), ("method", "Depot.constructor", 9, 9), ("method", "Depot.take", 11, 17), ("function", "Depot.take.clean", 12, 14),
        ("method", "Depot.put", 19, 21), ("method", "Depot.make", 22, 22), ("function", "build", 25, 29), ("export", "table", 31, 37), ("method", "table.create", 32, 34),
        ("method", "table.drop", 35, 35), ("function", "loud", 38, 38), ("enum", "Colour", 39, 39), ("export", "loud", 40, 40), ("export", "silent", 40, 40),
    ]


def test_typescript_entries(spark):
    rows = symbols.entries(spark.createDataFrame([("a/m.ts", TS)], "path string, text string")).cache()
    assert sorted((r.source, r.imported_name, r.local_name, r.line) for r in symbols.imports(rows).collect()) == [("./lib.js", "Row", "Row", 1), ("./lib.js", "default", "base", 1), ("./lib.js", "pick", "choose", 1), ("pkg", "*", "all", 2), ("side", "*", "*", 3)]
    assert sorted((r.name, r.local_name) for r in symbols.exports(rows).collect()) == [("Depot", "Depot"), ("build", "build"), ("default", "Depot"), ("loud", "loud"), ("silent", "quiet"), ("table", "table")]
    files = spark.createDataFrame([("a/m.ts", TS)], "path string, text string")
    defined = {(r.kind, r.name): (r.line, r.end_line, r.exported, r.signature) for r in symbols.definitions(rows, symbols.symbol_chunks(files).where("not is_gap")).collect()}
    assert defined["class", "Depot"] == (7, 23, True, "export class Depot<T> extends Base {")
    assert defined["method", "Depot.take"][:3] == (11, 17, False) and defined["function", "loud"][2] and not defined["type", "Shape"][2]
    linked = {(r.name, r.line): r.target_symbol for r in symbols.references(files, rows, symbols.definitions(rows, symbols.symbol_chunks(files).where("not is_gap"))).collect()}
    assert linked["build", 33] == "function:build" and linked["clean", 16] == "function:Depot.take.clean" and linked["Base", 7] is None
    assert not {"pick", "area", "body", "find", "test", "ok"} & {name for name, _ in linked}


def test_chunks(spark):
    files = spark.createDataFrame([("m.ts", TS), ("t.txt", "one\n\ntwo\n"), ("e.py", ""), ("n.js", None)], "path string, text string")
    rows = {(r.path, r.start_line, r.end_line): (r.symbol, r.is_gap) for r in symbols.symbol_chunks(files).collect()}
    assert rows["m.ts", 1, 3] == (None, True) and rows["m.ts", 7, 23] == ("class:Depot", False) and rows["m.ts", 12, 14] == ("function:Depot.take.clean", False)
    assert rows["m.ts", 41, 42] == ("export:silent", True)  # a gap is named after the block that begins last before it
    assert rows["t.txt", 1, 4] == (None, True) and not any(p in ("e.py", "n.js") for p, *_ in rows)


def test_oversized_blocks_are_windowed():
    text = "export function rebuild(rows) {\n  const out = [];\n  for (const r of rows) {\n    out.push(r.id);\n  }\n  return out;\n}"
    assert [c[:3] for c in code.chunked(text, "typescript", 4, 1)] == [(1, 4, "function:rebuild"), (4, 7, "function:rebuild")]


def test_python_chunks():
    text = "@dataclass\nclass Store:\n    @classmethod\n    def make(cls):\n        # note\n        return cls()\n\n    async def load(self, key):\n        def decode(v):\n            return v\n        return decode(key)\n\ndef single(): pass\nX = 1\n"
    assert [(b.kind, b.name, b.start, b.end) for b in code.blocks_of(text, "python")] == [("class", "Store", 1, 11), ("function", "Store.make", 3, 6), ("function", "Store.load", 8, 11), ("function", "load.decode", 9, 10), ("function", "single", 13, 13)]


def test_brackets_that_do_not_pair():
    found = [(e.what, e.kind, e.name, e.start, e.end, e.exported) for e in code.javascript("export class A {\n  f() {}\n}\nfunction g() {\n  return '}';\n}\nconst h = (x) => x;\n}\n")]
    assert [f[1:] for f in found if f[0] == "definition"] == [("class", "A", 1, 3, True), ("function", "g", 4, 6, False), ("function", "h", 7, 7, False)]


@pytest.mark.parametrize("language", ["javascript", "python"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=" \n{}()[]`'\"/*$=>;,.:@#abclassfunctionexportdefaultconst", max_size=120))
def test_any_text_is_read(language, text):
    """Whatever a file holds, it is read to its end, and lines outside of chunks are blank."""
    lines = text.split("\n")
    covered = {n for a, b, *_ in code.chunked(text, language) for n in range(a, b + 1)}
    assert all(n in covered or not line.strip() for n, line in enumerate(lines, 1))


def test_any_depth_and_many_declarations():
    """Nested functions and templates by the thousand, and a file of unpaired brackets, in time that grows with the file."""
    import time

    depth, began = 3000, time.perf_counter()
    found = code.javascript("".join(f"function f{i}() {{\n" for i in range(depth)) + "}\n" * depth)
    assert {e.name.rpartition(".")[2] for e in found if e.what == "definition"} >= {"f0", f"f{depth - 1}"}
    text = "`${" * depth + "x" + "}`" * depth + " tail"
    assert code._template(text, 0) == len(text) - len(" tail")
    lines = ["function g(", *(f"const a{i} = () => {{ run('{{'); // }}" for i in range(3000))]
    assert len([e for e in code.by_lines(lines) if e.what == "block"]) == 3001
    assert time.perf_counter() - began < 20
