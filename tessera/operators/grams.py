"""A stored index of trigrams: finds the chunks that may hold a substring, so that few are read for the exact test.

Each task that reads chunks writes them as blocks, without a shuffle: a block's chunks are
numbered in the order of their places, and a row for each trigram of three characters has
the numbers of the chunks that hold it, as steps in bytes. One more row (ALL) has every number.

A token that is sought must have all its trigrams in a chunk; those of the parts between
underscores, as an underscore stands for any character. A token with parts of one or two
characters alone is found through all trigrams that begin with the longest of them: chunks
end in two line ends, so that every character begins one. So no token needs a scan.

A search takes the first candidates of each query by place, reads their texts from the
folders of the tasks that wrote them, and tests them. A query that has neither found enough
nor run out of candidates is asked again, with eight times as many.

Null paths, symbols and texts are empty for the search. Rows that share a place are all
kept. An index of no rows finds nothing; queries without a key or without tokens find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import let, tokenize
from tessera.operators.postings import numbers, varints
from tessera.operators.search import SOUGHT
from tessera.session import with_checkpoints

#: Characters and rows of a block; characters that are cut into trigrams at a time.
BLOCK, ROWS, STRIDE = 1 << 22, 1 << 14, 1 << 20
#: Tokens that one task intersects in a block.
TOGETHER = 4096
#: Characters of a part, and parts of a token, whose trigrams are asked for; the exact test sees all of them.
ASKED, PARTS = 64, 8
#: Candidates of all queries, and bytes of their keys, that are broadcast to the scan of their texts; more are joined by shuffle.
SENT, SENT_BYTES = 200_000, 1 << 23
#: The row of a block that has the numbers of all its chunks.
ALL = -1
PLACE = ["path", "start_line", "end_line"]
_SCHEMA = "kind string, part int, block long, gram long, n int, docs binary, number int, path string, start_line int, end_line int, symbol string, text string"


def trigrams(low: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers of three times 21 bits, in rising order."""
    found = np.zeros(0, np.int64)
    for at in range(0, max(len(low) - 2, 0), STRIDE):
        u = np.frombuffer(low[at : at + STRIDE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        found = np.union1d(found, u[:-2] << 42 | u[1:-1] << 21 | u[2:])
    return found


def postings(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of trigrams of numbered chunks: the trigrams, how many chunks hold each, and their numbers as steps in bytes."""
    gram = np.concatenate([*each, np.full(len(each), ALL)]).astype(np.int64)
    doc = np.concatenate([np.repeat(np.arange(len(each)), [len(x) for x in each]), np.arange(len(each))]).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    new = np.r_[True, gram[1:] != gram[:-1]]
    raw, begin = varints(np.where(new, doc, np.r_[0, np.diff(doc)]))
    first = np.flatnonzero(new)
    cut = [*begin[first].tolist(), len(raw)]
    return gram[first], np.diff(np.r_[first, len(gram)]), [raw[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def _block(part: int, block: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    """The chunks of a block and the rows of its trigrams; rows: PLACE, symbol, text and the lower-case haystack."""
    rows.sort(key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:3]))
    names = [*PLACE, "symbol", "text"]
    texts = pd.DataFrame([r[:5] for r in rows], columns=names).assign(kind="texts", part=part, block=block, number=np.arange(len(rows)), gram=None, n=None, docs=None)
    gram, n, docs = postings([trigrams(r[5]) for r in rows])
    found = pd.DataFrame({"gram": gram, "n": n, "docs": docs}).assign(kind="grams", part=part, block=block, number=None, **dict.fromkeys(names))
    order = [c.split()[0] for c in _SCHEMA.split(", ")]
    yield texts[order]
    yield found[order]


def _haystack() -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(F.concat(none(F.col("path")), F.lit("\n"), none(F.col("symbol")), F.lit("\n"), none(F.col("text")), F.lit("\n\n")))


@dataclass
class Grams:
    """An index: its session and folder."""

    spark: SparkSession
    folder: str

    def _kind(self, kind: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.folder).where(F.col("kind") == kind)

    def rows(self) -> DataFrame:
        """(block, gram, n, docs)"""
        return self._kind("grams").select("block", "gram", "n", "docs")

    def chunks(self) -> DataFrame:
        """(part, block, number) and the chunks."""
        return self._kind("texts").select("part", "block", "number", *PLACE, "symbol", "text")

    def size(self) -> int:
        """How many chunks there are, from one row of each block."""
        return self.rows().where(F.col("gram") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def build(chunks: DataFrame, folder: str) -> Grams:
    """Index chunks (path, start_line, end_line, symbol, text) in a new folder, each where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for row in batch.itertuples(index=False, name=None):
                held.append(row)
                size += len(row[5])
                if size >= BLOCK or len(held) >= ROWS:
                    yield from _block(part, part << 32 | made, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield from _block(part, part << 32 | made, held)

    read = chunks.select(F.col("path").cast("string"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.col("symbol").cast("string"), F.col("text").cast("string"), _haystack().alias("hay"))
    read.mapInPandas(run, _SCHEMA).write.partitionBy("kind", "part").option("compression", "zstd").parquet(folder)
    return Grams(chunks.sparkSession, folder)


def wanted(tokens: DataFrame) -> DataFrame:
    """(token, level, value, need) of tokens (token): the trigrams, or beginnings of level characters, that find it, and how many must be there."""
    code = lambda p, i: F.ascii(F.substr(p, i, F.lit(1))).cast("long")
    gram = lambda p, i: F.shiftleft(code(p, i), 42).bitwiseOR(F.shiftleft(code(p, i + 1), 21)).bitwiseOR(code(p, i + 2))
    parts = F.filter(F.split("token", "_"), lambda p: p != "")
    whole = F.transform(F.slice(F.filter("parts", lambda p: F.length(p) > 2), 1, PARTS), lambda p: F.substr(p, F.lit(1), F.lit(ASKED)))
    exact = F.array_distinct(F.flatten(F.transform(whole, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: gram(p, i)))))
    best = F.get(F.array_sort(F.col("parts"), lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    begins = let(best, lambda p: F.when(p.isNull(), F.struct(F.lit(3).alias("level"), F.lit(ALL).cast("long").alias("value")))
                 .when(F.length(p) == 2, F.struct(F.lit(2).alias("level"), F.shiftleft(code(p, F.lit(1)), 21).bitwiseOR(code(p, F.lit(2))).alias("value")))
                 .otherwise(F.struct(F.lit(1).alias("level"), code(p, F.lit(1)).alias("value"))))
    made = tokens.select("token", parts.alias("parts")).select("token", exact.alias("exact"), begins.alias("begins"))
    keys = F.when(F.size("exact") > 0, F.transform("exact", lambda g: F.struct(F.lit(3).alias("level"), g.alias("value")))).otherwise(F.array("begins"))
    return made.select("token", F.inline(keys), F.greatest(F.size("exact"), F.lit(1)).alias("need"))


def candidates(index: Grams, tokens: DataFrame, most: int) -> DataFrame:
    """(token, block, number): the first chunks of each block, at most ``most``, that have all trigrams of a distinct token (token)."""
    asked = wanted(tokens)
    spread = max(1, -(-tokens.count() // TOGETHER))
    shift = {3: F.col("gram"), 2: F.shiftright("gram", 21), 1: F.shiftright("gram", 42)}
    hits = None
    for (level,) in asked.select("level").distinct().collect():  # three at most
        rows = index.rows().select("block", "docs", shift[level].alias("value"))
        some = rows.join(asked.where(F.col("level") == level), "value").select("token", "block", "docs", "need", (F.col("level") < 3).alias("any"))
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        return index.spark.createDataFrame([], "token string, block long, number int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, names, found = int(rows["block"].iloc[0]), [], []
        for token, own in rows.groupby("token", sort=False):
            need, union = int(own["need"].iloc[0]), bool(own["any"].iloc[0])
            if not union and len(own) < need:
                continue
            number, held = np.unique(np.concatenate([np.cumsum(numbers(d)) for d in own["docs"]]), return_counts=True)
            number = (number if union else number[held == need])[:most]
            names.extend([token] * len(number))
            found.extend(number.tolist())
        return pd.DataFrame({"token": pd.Series(names, dtype=object), "block": block, "number": pd.Series(found, dtype="int32")})

    return hits.groupBy("block", F.pmod(F.xxhash64("token"), F.lit(spread)).alias("share")).applyInPandas(run, "token string, block long, number int")


def holds(low: Column, token: Column) -> Column:
    """Whether a lower-case text contains a token, whose underscores stand for any character."""
    return F.when(F.contains(token, F.lit("_")), F.like(low, F.concat(F.lit("%"), token, F.lit("%")))).otherwise(F.contains(low, token))


def _tested(index: Grams, first: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The candidates (key, part, block, number) whose texts hold one of the query's tokens: key and place."""
    n, size = first.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0))).first()
    sent, texts = first.join(asked, key), index.chunks()
    if n <= SENT and size <= SENT_BYTES:
        # As many parts as candidates at most: only their folders are listed and read.
        texts = texts.where(F.col("part").isin([r.part for r in first.select("part").distinct().collect()]))
        found = texts.join(F.broadcast(first), ["part", "block", "number"]).join(asked, key)
    else:
        found = texts.join(sent, ["part", "block", "number"])
    lows = F.transform(F.array("text", "path", "symbol"), lambda s: F.lower(F.coalesce(s, F.lit(""))))
    return found.where(let(lows, lambda each: F.exists("tokens", lambda t: F.exists(each, lambda low: holds(low, t))))).select(key, "block", "number", *PLACE)


def contain_any(index: Grams, queries: DataFrame, key: str, text: str, limit: int, at_first: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(key, path, start_line, end_line, rank): as ``search.contain_any`` over the indexed chunks, and the work that it took.

    at_first: candidates of each query that are tested in the first pass, twice the limit if not given.
    Work: chunks (of the index), passes, tested (distinct chunks that were read, summed over passes).
    """
    with_checkpoints(index.spark)
    asked = queries.where(F.col(key).isNotNull()).select(key, F.array_distinct(F.slice(tokenize(F.col(text)), 1, SOUGHT)).alias("tokens")).where(F.size("tokens") > 0)
    asked = asked.checkpoint()
    work, most, done = {"chunks": index.size(), "passes": 0, "tested": 0}, at_first or 2 * limit, None
    while True:
        each = asked.select(key, F.explode("tokens").alias("token"))
        found = candidates(index, each.select("token").distinct(), most).join(each, "token").select(key, "block", "number").distinct()
        placed = found.join(index.chunks().select("part", "block", "number", *PLACE), ["block", "number"])
        nearest = Window.partitionBy(key).orderBy(*PLACE, "block", "number")
        first = placed.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= most).select(key, "part", "block", "number").checkpoint()
        hits = _tested(index, first, asked, key).checkpoint()
        work["passes"] += 1
        work["tested"] += first.select("block", "number").distinct().count()
        short = first.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits")), key, "left")
        short = short.where((F.col("n") == most) & (F.coalesce("hits", F.lit(0)) < limit)).select(key)
        again = asked.join(short, key, "left_semi").checkpoint()
        own = hits.join(short, key, "left_anti")
        done = own if done is None else done.unionByName(own)
        if again.isEmpty():
            break
        asked, most = again, 8 * most
    best = Window.partitionBy(key).orderBy(*PLACE, "block", "number")
    return done.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(key, *PLACE, "rank"), work
