"""Chunks and symbols of source files: one pass over each file with brackets where it lies, windows over the lines of others, then joins and aggregates by file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import language_of, simple_name
from tessera.operators.chunking import token_references, with_ids
from tessera.sources import code, indents

#: What a line of a language may declare, for readers without blocks; the first that fits.
LINE_PATTERNS = {
    "python": (("class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)")),
    "markdown": (("heading", r"^#{1,6}\s+(.+)$"),),
    "javascript": tuple((kind, "^" + pattern) for kind, pattern in code.LINES),
    "typescript": tuple((kind, "^" + pattern) for kind, pattern in code.LINES),
}
_PARSED = ("javascript", "typescript")


def _by_file(files: DataFrame, schema: str, made) -> DataFrame:
    """made(path, text, language) of each file (path, text), as rows; files are read a few at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                rows = [(path, *row) for path, text, language in zip(part.path, part.text, part.language) for row in made(text or "", language)]
                yield pd.DataFrame(rows, columns=["path", *columns])

    columns = [c.split()[0] for c in schema.split(", ")]
    return files.select("path", "text", language_of(F.col("path")).alias("language")).mapInPandas(run, f"path string, {schema}")


def _by_language(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are read by indentation, and all others."""
    indented = language_of(F.col("path")) == "python"
    return files.where(indented), files.where(~F.coalesce(indented, F.lit(False)))


def symbol_chunks(files: DataFrame, most: int = 80, overlap: int = 8) -> DataFrame:
    """path, language, start_line, end_line, symbol, is_gap, text and id of each chunk.

    Files of known languages are cut at their functions, classes and the like: gaps, blocks and the blocks
    within them, each windowed. A gap carries the symbol that begins last before it. Other files are windowed.
    Chunks with the same id (blocks with the same lines) are kept once.
    """
    schema = "start_line int, end_line int, symbol string, is_gap boolean, text string"
    indented, others = _by_language(files)
    out = _by_file(others, schema, lambda text, language: code.chunked(text, language, most, overlap)).unionByName(indents.chunks(indented, most, overlap))
    return with_ids(out.withColumn("language", language_of(F.col("path")))).dropDuplicates(["path", "id"])


def entries(files: DataFrame) -> DataFrame:
    """path, what (definition, import, export, reference), kind, name, line, end_line, exported, other, source, column of parsed languages."""
    schema = "what string, kind string, name string, line int, end_line int, exported boolean, other string, source string, column int"
    known = files.where(language_of(F.col("path")).isin(*_PARSED))
    made = _by_file(known, schema, lambda text, _: code.javascript("\n".join(text.split("\r\n"))))
    return made.where("what <> 'block'")


def blocks(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line, end_line of the blocks that chunks are cut at."""
    indented, others = _by_language(files)
    made = _by_file(others, "kind string, name string, start_line int, end_line int", lambda text, language: ((e.kind, e.name, e.start, e.end) for e in code.blocks_of(text, language)))
    return made.unionByName(indents.blocks(indented))


def imports(rows: DataFrame) -> DataFrame:
    """path, source, imported_name, local_name, line, each once; from entries."""
    found = rows.where("what = 'import'").groupBy("path", "source", F.col("name").alias("imported_name"), F.col("other").alias("local_name"))
    return found.agg(F.min("line").alias("line"))


def exports(rows: DataFrame) -> DataFrame:
    """path, name, local_name, line, each once; from entries."""
    return rows.where("what = 'export'").groupBy("path", "name", F.col("other").alias("local_name")).agg(F.min("line").alias("line"))


def chunk_definitions(chunks: DataFrame) -> DataFrame:
    """Definitions that chunks' symbols say, with the first line of code as signature."""
    kind, name = F.substring_index("symbol", ":", 1), F.regexp_replace("symbol", "^[^:]*:", "")
    first = F.substring(F.regexp_replace(F.substring_index("text", "\n", 1), "^\\s+|\\s+$", ""), 1, 240)
    return chunks.where("symbol is not null").select("path", kind.alias("kind"), name.alias("name"), F.col("start_line").alias("line"), "end_line", first.alias("signature"), F.lit(False).alias("exported"))


def definitions(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, kind, name, line, end_line, signature, exported: what entries declare and chunks say; the latter hold where both do.

    Exported is what says so itself or whose name, or simple name, the file exports.
    """
    own = rows.where("what = 'definition'").select("path", "kind", "name", "line", "end_line", F.col("other").alias("signature"), "exported", F.lit(0).alias("order"))
    both = own.unionByName(chunk_definitions(chunks).withColumn("order", F.lit(1)))
    # Of equals the last one holds: chunks behind entries, the longest of each.
    merged = both.groupBy("path", "kind", "name", "line").agg(F.max_by(F.struct("end_line", "signature", "exported"), F.struct("order", "end_line")).alias("d"))
    merged = merged.select("path", "kind", "name", "line", "d.end_line", "d.signature", "d.exported")
    named = rows.where("what = 'export'").select("path", F.col("name").alias("key")).distinct().withColumn("hit", F.lit(True))
    for i, key in enumerate((F.col("name"), simple_name(F.col("name")))):
        merged = merged.withColumn("key", key).join(named.withColumnRenamed("hit", f"hit{i}"), ["path", "key"], "left").drop("key")
    return merged.withColumn("exported", F.col("exported") | F.coalesce("hit0", F.lit(False)) | F.coalesce("hit1", F.lit(False))).drop("hit0", "hit1")


def references(files: DataFrame, rows: DataFrame, defined: DataFrame) -> DataFrame:
    """path, name, line, column, kind, target_symbol: identifiers of parsed files, tokens of all others.

    A name is linked to the file's own last definition of that simple name, by an aggregate and an equi-join.
    """
    parsed = rows.where("what = 'reference'").select("path", "name", "line", "column", F.lit("identifier").alias("kind"))
    others = token_references(files.where(~language_of(F.col("path")).isin(*_PARSED))).select("path", "name", "line", "column", F.lit("token").alias("kind"))
    symbol = F.concat("kind", F.lit(":"), "name")
    own = defined.groupBy("path", simple_name(F.col("name")).alias("name")).agg(F.max_by(symbol, F.struct("line", "name")).alias("target_symbol"))
    return parsed.unionByName(others).distinct().join(own, ["path", "name"], "left")


def line_symbols(files: DataFrame) -> DataFrame:
    """path, kind, name, line of the declarations and headings that lines begin, by patterns alone."""
    lines = files.select("path", language_of(F.col("path")).alias("language"), F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "text"))
    none = F.lit(None).cast("struct<kind:string,name:string>")
    found = none
    for language, patterns in LINE_PATTERNS.items():
        own = none
        for kind, pattern in reversed(patterns):
            own = F.when(F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, 1).alias("name"))).otherwise(own)
        found = F.when(F.col("language") == language, own).otherwise(found)
    return lines.select("path", found.alias("s"), (F.col("at") + 1).alias("line")).where("s is not null").select("path", "s.kind", "s.name", "line")
