"""Cut texts into overlapping line windows, and find the references on their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fnv1a, let, tokenize


def line_windows(files: DataFrame, max_lines: int = 80, overlap: int = 8) -> DataFrame:
    """files (path, text, ...) as chunks: start_line, end_line (from 1) and text; blank chunks are dropped.

    A narrow transformation: a file's windows are cut where the file lies.
    """
    step = max(max_lines - overlap, 1)

    def windows(lines):
        n = F.size(lines)
        last = F.greatest(F.lit(0), F.ceil((n - max_lines) / step)).cast("int")
        cut = lambda k: F.struct((k * step + 1).alias("start_line"), F.least(n, k * step + max_lines).alias("end_line"), F.array_join(F.slice(lines, k * step + 1, F.lit(max_lines)), "\n").alias("text"))
        return F.transform(F.sequence(F.lit(0), last), cut)

    rest = [c for c in files.columns if c not in ("text", "start_line", "end_line")]
    out = files.select(*rest, F.inline(let(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1), windows)))
    out = out.withColumn("text", F.regexp_replace("text", "^\\s+|\\s+$", ""))
    return out.where(F.col("text") != "")


def window_of(line, n_lines, max_lines: int = 80, overlap: int = 8):
    """(start_line, end_line) of the smallest of a file's windows around a line, the first among equals: by arithmetic, without a join."""
    step = max(max_lines - overlap, 1)
    last = F.greatest(F.lit(0), F.ceil((n_lines - max_lines) / step)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((line - max_lines) / step)).cast("int")
    # Only the last window may be smaller than the others.
    k = F.when((last * step < line) & (n_lines - last * step < max_lines), last).otherwise(first)
    return F.struct((k * step + 1).cast("int").alias("start_line"), F.least(n_lines, k * step + max_lines).cast("int").alias("end_line"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with their id: path, lines and the text's hash."""
    hashed = F.lower(F.hex(fnv1a(F.col("text"))))
    return chunks.withColumn("id", F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(":"), hashed))


def token_references(files: DataFrame) -> DataFrame:
    """path, name, line, column, n_lines: each token of a line once, where the lower-case line first holds it (from 0)."""
    lines = files.select("path", F.split("text", "\r?\n", -1).alias("lines"))
    lines = lines.select("path", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line_text"))
    tokens = lines.select("path", "n_lines", (F.col("at") + 1).alias("line"), F.lower("line_text").alias("low"), F.explode(F.array_distinct(tokenize(F.col("line_text")))).alias("name"))
    return tokens.select("path", "name", "line", "n_lines", F.greatest(F.lit(0), F.instr(F.col("low"), F.col("name")) - 1).alias("column"))
