"""Centroids against plain loops over whole numbers, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids
from tests.oracle import assert_same

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)
    cents = [x for *_, x in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(cents)), key=lambda c: (far(x, cents[c]), c))
    for _ in range(rounds):
        groups = [[x for _, x in kept if near(x) == c] for c in range(len(cents))]
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, cents)]
    own = [(i, near(x), far(x, cents[near(x)])) for i, x in kept]
    inertia = [sum(d for _, c, d in own if c == j) for j in range(len(cents))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in own), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(60, 5, 6), (3, 5, 2), (40, 4, 0)])
def test_equals_loops(spark, n, k, rounds):
    """Repeated vectors and ids, null ids, negative components, unsound vectors, fewer vectors than centroids."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.4, 4)]) for i in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[1][1]), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [math.nan] * 4), (905, [math.inf] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = centroids.report(df, k=k, rounds=rounds, dims=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, rounds, 4)
    again = centroids.report(df.repartition(5), k=k, rounds=rounds, dims=4)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_dot_products_are_kept_up(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)], "") for i in range(50)], SCHEMA)
    state, cents = centroids.cluster(df, 3, 5, 4)
    for r in state.collect():
        assert r.dots == [int(np.dot(r.x, c)) for c in cents]


def test_huge_and_equal_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [2.0**18, 0.0, 0.0, 0.0], ""), (2, [-(2.0**17), 0.0, 0.0, 0.0], ""), (3, [2.0**17 - 1] * 4, ""), (4, [2.0**17 - 1] * 4, "")], SCHEMA)
    got = centroids.report(df, dims=4).collect()
    assert {(r.vec_id, r.cluster, r.distance, r.inertia) for r in got} == {(3, 0, 0, 0), (4, 0, 0, 0)}  # ties go to the smaller number
    assert centroids.report(df.limit(0), dims=4).count() == 0 and centroids.report(df.where("vec_id = 1"), dims=4).count() == 0


def test_matches_sql(spark, sf_dir):
    assert_same(centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), centroids.oracle(), sf_dir, least=50)


