"""Recall against brute force, and exact results where there are few vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann
from tessera.session import with_checkpoints


def brute(ids, x, queries, k=5):
    x = x.astype(np.float64)
    out = {}
    for q in np.flatnonzero(queries):
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        other = np.flatnonzero(ids != ids[q])
        top = other[np.lexsort((ids[other], -s[other]))[:k]]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in top]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    with_checkpoints(spark)
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    want = brute(ids, x, ids % 50 == 0)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in g.values()} & {v for v, _ in want[q]}) for q, g in got.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, g in got.items():
        exact = x.astype(float) @ x[ids == q][0].astype(float)
        for rank in range(1, 5):
            assert (-g[rank][1], g[rank][0]) <= (-g[rank + 1][1], g[rank + 1][0])
        assert all(abs(exact[ids == v][0] - s) < 1e-5 for v, s in g.values())


def test_odd_vectors(spark):
    with_checkpoints(spark)
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_copies_of_one_vector(spark):
    with_checkpoints(spark)
    df = spark.range(300).selectExpr("id vec_id", "array(0.5f, 0.25f, 1f) embedding")
    got = ann.search(df, F.col("vec_id") % 50 == 0).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_recall_beyond_the_sample(spark, monkeypatch, kind):
    """The tree is fitted on a twelfth of the vectors; all are indexed and found."""
    with_checkpoints(spark)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24)) if kind == "uniform" else rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    want = brute(np.arange(6000), x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(6000) % 50 == 0)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_queries_and_vectors_of_a_leaf_are_split(spark, monkeypatch):
    """Leaves that many vectors and queries share, in groups of 40: the same neighbours as in one group."""
    with_checkpoints(spark)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[0], (500, rows[0][1])], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.search(df, F.col("vec_id") >= 0).collect()))
    monkeypatch.setattr(ann, "GROUP", 40)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") >= 0).collect())) == want and len(want) > 1400
