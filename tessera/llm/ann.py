"""Nearest neighbours by cosine in a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most SAMPLE vectors, those of the least hashes; every vector is
indexed. A priority queue holds the tree's nodes by distance to the query; leaves
are visited nearest first. How many is calibrated: visits widen until TARGET of
the sample's true neighbours lie in the leaves visited, and for each query until
these hold as many vectors as are asked for.

A query goes to the leaves that it visits, not to all vectors. Leaves of more than
GROUP vectors are split among tasks, and so are more than GROUP queries of a leaf. Nearness is the cosine of the original
vectors in double precision; ties go to the smaller id.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do null ids. Vectors that repeat are
neighbours of each other. If there are fewer candidates, all are returned; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the tree is fitted on at most, and those of them that calibrate it.
SAMPLE, PROBES = 20_000, 400
#: Share of true neighbours to find; children of a node; sampled vectors in a leaf at most; vectors in a task's group.
TARGET, BRANCH, LEAF, GROUP = 0.975, 8, 64, 20_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tree:
    """Nodes with their centres and children; leaves are numbered by ``leaf``."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    visits: int = 1
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector reaches by the nearest child, again and again."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centre[self.children[node]].T * -2 + (self.centre[self.children[node]] ** 2).sum(1)).argmin(1)
            todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node]) if (near == j).any()]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves from the best bin on."""
        distance = ((self.centre - q) ** 2).sum(1)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for c in self.children[node]:
                heapq.heappush(queue, (distance[c], c))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), int)
    for _ in range(rounds):
        near = (x @ centre.T * -2 + (centre**2).sum(1)).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return near


def fit(x: np.ndarray, nearest: int = 5, seed: int = 3) -> Tree:
    """A tree for unit vectors x, with the number of leaf visits that reaches TARGET."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, x.shape[1])), [], [])
    centres, leaves, todo = [], 0, [(-1, np.arange(len(x)))]
    while todo:
        parent, rows = todo.pop()
        node = len(centres)
        centres.append(x[rows].mean(0))
        tree.children.append([])
        tree.leaf.append(-1)
        if parent >= 0:
            tree.children[parent].append(node)
        near = _kmeans(x[rows], BRANCH, rng) if len(rows) > LEAF else None
        if near is None or (np.bincount(near, minlength=BRANCH) > 0).sum() < 2:  # few vectors, or copies of one
            tree.leaf[node] = leaves
            leaves += 1
        else:
            todo += [(node, rows[near == j]) for j in range(BRANCH) if (near == j).any()]
    tree.centre = np.array(centres)
    own = tree.assign(x)
    probes = rng.choice(len(x), min(PROBES, len(x)), replace=False)
    ranks = []
    for p in probes:
        score = x @ x[p]
        score[p] = -np.inf
        true = np.argsort(-score)[: min(nearest, len(x) - 1)]
        place = np.empty(leaves, int)
        place[list(tree.order(x[p]))] = np.arange(leaves)
        ranks += list(place[own[true]])
    ranks = np.sort(ranks)
    tree.visits = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else leaves
    return tree


def _sound(vector: str) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def search(df: DataFrame, queries: Column, nearest: int = 5, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for the rows where ``queries`` holds."""
    rows = df.where(_sound(vector) & F.col(vector_id).isNotNull()).select(F.col(vector_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims.n)
    # Tasks send what lies below a threshold of the hash, some SAMPLE vectors in all, whatever the table's size.
    share = min(1.0, 1.05 * SAMPLE / dims["count"])
    chosen = rows.select("v", F.xxhash64("id", "v").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).collect()
    tree = fit(unit(np.array([r.v for r in sorted(chosen, key=lambda r: (r.h, r.v))[:SAMPLE]])), nearest)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b.v.to_numpy())
                yield pd.DataFrame({"id": b.id, "v": list(x), "asks": b.asks, "leaf": tree.assign(unit(x))})

    indexed = rows.mapInPandas(index, "id long, v array<double>, asks boolean, leaf long").checkpoint()
    counts = np.zeros(max(tree.leaf) + 1, int)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf of the sample's tree
        counts[r.leaf] = r["count"]
    parts = np.maximum(1, -(-counts // GROUP))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = []
            for i, v in zip(b.id, b.v):
                held = 0
                for seen, leaf in enumerate(tree.order(unit(v[None])[0]), 1):
                    out += [(i, v, leaf, p) for p in range(parts[leaf] if counts[leaf] else 0)]
                    held += counts[leaf]
                    if seen >= tree.visits and held > nearest:
                        break
            yield pd.DataFrame(out, columns=["id", "v", "leaf", "part"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = indexed.where("asks").select("id", "v").repartition(tasks, "id").mapInPandas(visit, "id long, v array<double>, leaf long, part long")
    splits = F.array(*[F.lit(int(p)) for p in parts])
    held = indexed.select("id", "v", "leaf", F.pmod(F.xxhash64("id"), F.element_at(splits, (F.col("leaf") + 1).cast("int"))).cast("long").alias("part"))
    # However many queries visit a leaf, a group has a share of about GROUP of all of them at most.
    turns = max(1, -(-indexed.where("asks").count() // GROUP))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(turns)))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long")))) if turns > 1 else held.withColumn("turn", F.lit(0).cast("long"))

    def compare(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = own.id.to_numpy(), np.stack(own.v.to_numpy())
        x_norm, found = np.linalg.norm(x, axis=1), []
        for at in range(0, len(asks), 256):
            block = asks.iloc[at : at + 256]
            q = np.stack(block.v.to_numpy())
            score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * x_norm)
            score[block.id.to_numpy()[:, None] == ids] = -np.inf
            for i, s in zip(block.id, score):
                edge = np.partition(s, -nearest)[-nearest] if len(s) > nearest else -np.inf
                near = np.flatnonzero((s >= edge) & np.isfinite(s))
                near = near[np.lexsort((ids[near], -s[near]))[:nearest]]
                found.append(pd.DataFrame({"query_id": i, "vec_id": ids[near], "score": s[near]}))
        return pd.concat(found)

    near = asked.groupBy("leaf", "part", "turn").cogroup(held.groupBy("leaf", "part", "turn")).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
