"""The mix against targets found by brute force, and the splitting tree's law."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.session import with_checkpoints


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rate = (total - sum(full.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 3 * sizes[s]}
        if not over:
            return full | {s: rate * weight[s] for s in open_}
        full |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return full


def test_mix(spark, sf_dir):
    with_checkpoints(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(-1, None, "src0"), (-2, "a b\n c", None), (-3, "", None), (None, " x ", "tiny"), (None, " x ", "tiny")], docs.schema)
    docs = docs.unionByName(odd).withColumn("target", F.lit("clash"))
    rows = mixing.mix(docs).collect()
    assert rows == rows and len(rows) == docs.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    goal = brute_targets(sizes)
    taken: Counter = Counter()
    for r in rows:
        assert r.size == words(r.text) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        assert r.taken == r.size * len(r.copies) and len(r.copies) <= 3
        taken[r.source] += r.taken
    biggest = max(r.size for r in rows)
    for s in sizes:
        assert goal[s] - biggest <= taken[s] <= goal[s] + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.source or "", r.size, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mixed_rows(docs).count() == sum(len(r.copies) for r in rows)


def test_empty(spark):
    with_checkpoints(spark)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize(("good", "total", "draws"), [(3, 10, 4), (40, 50, 25), (1, 1, 0), (5, 5, 2), (0, 7, 3)])
def test_hypergeometric_law(spark, good, total, draws):
    n = 4000
    expr = mixing.hypergeometric("g", "t", "d", "u")
    df = spark.range(n).selectExpr(f"{good}L g", f"{total}L t", f"{draws}L d", f"(id + 0.5D) / {n} u").selectExpr(f"{expr} k")
    got = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for k in range(max(0, draws - total + good), min(good, draws) + 1):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(got.get(k, 0) / n - p) <= 2 / n


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), (None, 93)], "source string, blocks long")
    rows = mixing.tree(quotas, 3, 5).collect()
    whole = Counter()
    for r in rows:
        whole[r.source] += r.blocks
    assert whole == {"a": 1000, "b": 7, None: 93}
    per_shard = Counter()
    for r in rows:
        per_shard[r.shard] += r.blocks
    assert set(per_shard.values()) <= {137, 138} and len(per_shard) == 8
    ranges = sorted((r.first, r.first + r.blocks) for r in rows if r.source == "a")
    assert ranges[0][0] == 0 and ranges[-1][1] == 1000 and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
