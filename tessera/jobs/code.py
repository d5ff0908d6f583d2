"""Queries of source files' chunks and symbols, with their SQL.

The files are made by Spark from suppliers: one of JavaScript or Python for each, with
a function, a class and a method whose lengths follow from the supplier. The SQL says
what each template declares; it reads no code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relations
from tessera.session import table
from tessera.sources import symbols

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: src/s<key>.js for odd suppliers, src/s<key>.py for even ones."""
    k, n = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 7).cast("int")
    body = lambda line, n: F.concat_ws("", F.array_repeat(F.lit(line), n))
    js = F.concat(
        F.lit("import { helper, other as near } from './s"), (F.col("s_suppkey") + 2).cast("string"), F.lit(".js'; // }\n\nexport function load"), k, F.lit("(a) {\n"), body("  helper(a, `}${a}`);\n", n), F.lit("}\n\nclass Store"), k,
        F.lit(" {\n  get(a) {\n    return load"), k, F.lit("(a) + '{';\n  }\n}\nconst limit"), k, F.lit(" = "), k, F.lit(";\n"),
    )
    py = F.concat(F.lit("import os\n\n@cached\ndef load"), k, F.lit("(a):\n"), body("    use(a)\n", n + 1), F.lit("\nclass Store"), k, F.lit(":\n    def get(self):\n        return load"), k, F.lit("(self)\n\nLIMIT = "), k, F.lit("\n"))
    odd = F.col("s_suppkey") % 2 == 1
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), k, F.when(odd, ".js").otherwise(".py")).alias("path"), F.when(odd, js).otherwise(py).alias("text"))


#: First and last lines of what the templates hold: block, method, tail.
_FILES = """f as (select s_suppkey as k, (s_suppkey % 7)::int as n, s_suppkey % 2 = 1 as js, 'src/s' || s_suppkey || case when s_suppkey % 2 = 1 then '.js' else '.py' end as path from supplier),
b as (select path, k, n, js, 'function' as kind, 'load' || k as name, 3 as a, case when js then 4 + n else 5 + n end as z from f
  union all select path, k, n, js, 'class', 'Store' || k, case when js then 6 + n else 7 + n end, case when js then 10 + n else 9 + n end from f
  union all select path, k, n, js, case when js then 'method' else 'function' end, 'Store' || k || '.get', case when js then 7 + n else 8 + n end, 9 + n from f),
c as (select path, a as start_line, z as end_line, kind || ':' || name as symbol, false as is_gap, case when kind = 'function' and name not like 'Store%' and not js then '@cached' when name like '%.get' then (case when js then 'get(a) {' else 'def get(self):' end)
    when kind = 'class' then 'class Store' || k || case when js then ' {' else ':' end else 'export function load' || k || '(a) {' end as first from b
  union all select path, 1, 2, null, true, case when js then 'import { helper, other as near } from ''./s' || (k + 2) || '.js''; // }' else 'import os' end from f
  union all select path, case when js then 11 + n else 10 + n end, 12 + n, case when js then 'method' else 'function' end || ':Store' || k || '.get', true, case when js then 'const limit' || k || ' = ' || k || ';' else 'LIMIT = ' || k end from f)"""


@query(f"with {_FILES} select path, start_line, end_line, symbol, is_gap, first from c")
def symbol_chunks(spark, sf_dir):
    c = symbols.symbol_chunks(source_files(spark, sf_dir))
    return c.select("path", "start_line", "end_line", "symbol", "is_gap", F.trim(F.substring_index("text", "\n", 1)).alias("first"))


@query(f"""with {_FILES} select path, kind, name, a as line, z as end_line, (js and kind = 'function') as exported, first as signature from b join c using (path) where c.start_line = a and c.symbol = kind || ':' || name
union all select path, split_part(symbol, ':', 1), split_part(symbol, ':', 2), start_line, end_line, false, first from c where is_gap and symbol is not null""")
def symbol_definitions(spark, sf_dir):
    """What files declare and chunks say, merged."""
    files = source_files(spark, sf_dir)
    return symbols.definitions(symbols.entries(files), symbols.symbol_chunks(files))


@query(f"""with {_FILES} select path, 'import' as what, 'helper' as name, 'helper' as local_name, './s' || (k + 2) || '.js' as source, 1 as line from f where js
union all select path, 'import', 'other', 'near', './s' || (k + 2) || '.js', 1 from f where js union all select path, 'export', 'load' || k, 'load' || k, '', 3 from f where js""")
def import_export_rows(spark, sf_dir):
    rows = symbols.entries(source_files(spark, sf_dir))
    brought = symbols.imports(rows).select("path", F.lit("import").alias("what"), F.col("imported_name").alias("name"), "local_name", "source", "line")
    return brought.unionByName(symbols.exports(rows).select("path", F.lit("export").alias("what"), "name", "local_name", F.lit("").alias("source"), "line"))


@query(f"""with {_FILES} select path, name, line, kind, target_symbol, count(*) as n from (
  select path, 'a' as name, 3 as line, 'identifier' as kind, null as target_symbol from f where js
  union all select path, x, l::int, 'identifier', null from f, unnest(['helper', 'a']) t(x), unnest(range(4, 4 + n)) u(l) where js
  union all select path, 'a', 7 + n, 'identifier', null from f where js union all select path, 'a', 8 + n, 'identifier', null from f where js
  union all select path, 'load' || k, 8 + n, 'identifier', 'function:load' || k from f where js
  union all select path, x, 1, 'token', null from f, unnest(['import', 'os']) t(x) where not js union all select path, 'cached', 3, 'token', null from f where not js
  union all select path, 'def', 4, 'token', null from f where not js union all select path, 'load' || k, 4, 'token', 'function:load' || k from f where not js
  union all select path, 'use', l::int, 'token', null from f, unnest(range(5, 6 + n)) u(l) where not js
  union all select path, 'class', 7 + n, 'token', null from f where not js union all select path, 'store' || k, 7 + n, 'token', null from f where not js
  union all select path, x, 8 + n, 'token', case when x = 'get' then 'function:Store' || k || '.get' end from f, unnest(['def', 'get', 'self']) t(x) where not js
  union all select path, x, 9 + n, 'token', null from f, unnest(['return', 'self']) t(x) where not js union all select path, 'load' || k, 9 + n, 'token', 'function:load' || k from f where not js
  union all select path, 'limit', 11 + n, 'token', null from f where not js union all select path, k::varchar, 11 + n, 'token', null from f where not js) group by all""")
def linked_references(spark, sf_dir):
    files = source_files(spark, sf_dir)
    rows = symbols.entries(files)
    found = symbols.references(files, rows, symbols.definitions(rows, symbols.symbol_chunks(files)))
    return found.groupBy("path", "name", "line", "kind", "target_symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_FILES}, l as (select path, unnest(range(1, 13 + n))::int as line from f) select l.path, line, arg_max(kind || ':' || name, a) as symbol from l left join b on b.path = l.path and a <= line group by all""")
def nearest_symbol_asof(spark, sf_dir):
    """The block that begins last before each line, by an as-of join."""
    files = source_files(spark, sf_dir)
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "x")).select("path", (F.col("at") + 1).alias("line"))
    marks = symbols.blocks(files).select("path", F.col("start_line").alias("line"), F.concat("kind", F.lit(":"), "name").alias("symbol"))
    return relations.nearest_before(lines, marks, "path", "line", "symbol")


@query(r"""with l as (select doc_id, unnest(string_split_regex('# Title ' || doc_id || chr(10) || text || chr(10) || '###### ' || source, '\r?\n')) as t, generate_subscripts(string_split_regex('# Title ' || doc_id || chr(10) || text || chr(10) || '###### ' || source, '\r?\n'), 1)::int as line from documents)
select doc_id || '.md' as path, 'heading' as kind, regexp_extract(t, '^#{1,6}\s+(.+)$', 1) as name, line from l where regexp_matches(t, '^#{1,6}\s+(.+)$')""")
def markdown_headings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n###### "), "source")
    return symbols.line_symbols(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text")))
