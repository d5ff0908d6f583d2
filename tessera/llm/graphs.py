"""Connected components of an edge table, by the least id, and of small arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the component's least id.

    Each round gives every node the least root around it and then follows roots
    twice, so paths shrink fast. Rounds are cut by checkpoints; only a count
    reaches the driver.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")).checkpoint()
    while True:
        seen = both.join(roots.withColumnRenamed("id", "b").withColumnRenamed("root", "r"), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        near = roots.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        # What hangs on a root goes where the least of its members points.
        moved = near.groupBy(F.col("old").alias("o")).agg(F.min("root").alias("m"))
        step = near.join(moved, F.col("old") == F.col("o"), "left").select("id", "old", F.least("root", "m").alias("root"))
        step = step.join(step.select(F.col("id").alias("i"), F.col("root").alias("up")), F.col("root") == F.col("i"), "left")
        step = step.select("id", "old", F.least("root", F.coalesce("up", "root")).alias("root")).checkpoint()
        if not step.where("root <> old").limit(1).count():
            return step.select("id", "root")
        roots = step.select("id", "root")
