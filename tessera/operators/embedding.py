"""Hashed embeddings and similarities, as rows of non-zero dimensions or as arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pairs import in_blocks
from tessera.operators.search import Best, Hashing, rounded, tokens


def hashed(rows: DataFrame, key: str, text: Column, dims: int = 384) -> DataFrame:
    """(key, idx, v): signed sums of token weights by bucket, of unit length, 6 decimals.

    A narrow transformation; a task hashes each distinct token once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = Hashing(dims)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                made = hashing.vectors([tokens(t) for t in batch["text"]])
                row, idx = np.nonzero(made)
                yield pd.DataFrame({key: batch[key].to_numpy()[row], "idx": idx, "v": made[row, idx] / 1e6})

    return rows.select(key, text.alias("text")).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, idx int, v double")


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of the same width: products with zeros are those over the shorter length."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: min(len(v), width)] = v[:width]
    return out


def nearest_dense(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most: int = 2000) -> DataFrame:
    """(query_id, key, score, rank): the k rows of greatest dot product with each of a stated set of queries, but not a query itself.

    Queries are broadcast in blocks of about ``most``; a task multiplies matrices and keeps k rows of
    each query, so what is exchanged doesn't grow with the rows of a task. Null vectors take no part.
    """
    found, asked = None, queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, {key} {kind}, score double"
    for own in in_blocks(asked, key, most):
        width = max((len(r[1]) for r in own), default=1)
        sent = rows.sparkSession.sparkContext.broadcast(([r[0] for r in own], _matrix([r[1] for r in own], width)))

        def run(batches: Iterator[pd.DataFrame], sent=sent, width=width) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best, place = Best(len(ids), k), {x: j for j, x in enumerate(ids)}
            for whole in batches:
                for at in range(0, len(whole), 1000):
                    batch = whole.iloc[at : at + 1000]
                    keys = batch[key].tolist()
                    score = rounded(_matrix(batch[vector].tolist(), width) @ q.T) / 1e4
                    for row, x in enumerate(keys):
                        if x in place:
                            score[row, place[x]] = -np.inf
                    best.add(score, [(x,) for x in keys], lambda i, j: None)
            out = [(x, at[0], -score) for x, held in zip(ids, best.held) for score, at, _ in held if score < math.inf]
            yield pd.DataFrame(out, columns=["query_id", key, "score"])

        part = rows.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    found = rows.sparkSession.createDataFrame([], schema) if found is None else found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def validate(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector a provider must not return: of another length, or with a component that is no number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNull() | (F.size(vector) != dims) | bad)
