"""Rows and stated queries: every row with every query, and texts with the passages that they hold."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Shares of the rows that meet a block of queries each.
CHUNKS = 64


def with_every(rows: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """rows with the columns of each query.

    Up to ``most`` queries are broadcast. More are dealt into blocks of about half as many;
    each share of the rows meets each block in an equi-join, so no group outgrows a task.
    """
    n = queries.count()
    if n <= most:
        return rows.join(F.broadcast(queries), F.lit(True))
    blocks = -(-2 * n // most)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    left = rows.withColumn("__chunk", dealt(rows, CHUNKS)).withColumn("__block", every(blocks))
    right = queries.withColumn("__block", dealt(queries, blocks)).withColumn("__chunk", every(CHUNKS))
    return left.join(right, ["__chunk", "__block"]).drop("__chunk", "__block")


def in_blocks(queries: DataFrame, key: str, most: int) -> Iterator[list[Row]]:
    """Rows of stated queries, sorted by key, in blocks of about ``most``, one at a time on the driver.

    Blocks follow from the key's hash, so nothing numbers all queries in one task.
    """
    n = queries.count()
    blocks = 1 if n <= most else -(-5 * n // (4 * most))
    for i in range(blocks if n else 0):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).collect()
        if rows:
            yield sorted(rows, key=lambda r: r[key])


def holding(rows: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str, most: int = 1 << 24) -> DataFrame:
    """(key, passage_key): which texts hold which passages, each walked through once with all passages of a block.

    A block has passages of some ``most`` characters, so its automaton is bounded; each further block is one more scan.
    No pair is made that isn't a result. Null and empty passages are held by no text, nor is anything by a null text.
    """
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, {passage_key} {passages.schema[passage_key].dataType.simpleString()}"
    known = passages.select(F.col(passage_key).alias("id"), F.col(passage).alias("p")).where("length(p) > 0")
    size = known.agg(F.sum(F.length("p"))).first()[0] or 0
    if not size:
        return rows.select(key).join(passages.select(passage_key), F.lit(False))
    blocks, found = -(-size // most), None

    def walk(wanted: list[tuple]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of: dict[str, list] = {}
            for i, p in wanted:
                of.setdefault(p, []).append(i)
            held = ahocorasick.Automaton()
            for p, ids in of.items():
                held.add_word(p, ids)
            held.make_automaton()
            for batch in batches:
                out = [(k, i) for k, t in zip(batch.k, batch.t) if t for i in {i for _, ids in held.iter(t) for i in ids}]
                yield pd.DataFrame(out, columns=[key, passage_key]) if out else pd.DataFrame({key: batch.k[:0], passage_key: batch.k[:0]})

        return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, kinds)

    for b in range(blocks):
        wanted = [(r.id, r.p) for r in known.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).collect()]  # some ``most`` characters
        if wanted:
            part = walk(wanted)
            found = part if found is None else found.unionByName(part)
    return found
