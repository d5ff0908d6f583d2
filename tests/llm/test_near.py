"""Classes and links against all pairs by brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import graphs, near
from tessera.session import with_checkpoints


def brute(rows):
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    nodes = []
    for t, ids in by_text.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        nodes.append((min(ids), ids, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    links, root = defaultdict(int), {n[0]: n[0] for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for k, (_, _, s) in enumerate(nodes):
        for x in s:
            inverted[x].append(k)
    common: dict = defaultdict(int)
    for own in inverted.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(nodes[a][2]) + len(nodes[b][2]) - c):
            x, y = nodes[a][0], nodes[b][0]
            links[x] += 1
            links[y] += 1
            x, y = sorted((top(x), top(y)))
            root[y] = x
    return {i: (top(n), n, len(ids), links[n]) for n, ids, _ in nodes for i in ids}


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    rows = [(-1, None), (-2, ""), (-3, "a b"), (-4, "A b"), (-5, "b a"), (-6, "x " * 5000), (-6, "x " * 5000)]
    base = [word() for _ in range(120)]
    for k in range(700):  # a large group of near copies
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(120)] = word()
        rows.append((1000 + k, " ".join(t)))
    for k in range(60):
        rows.append((5000 + k, " ".join(word() for _ in range(40))))
        rows.append((6000 + k, rows[-1][1]))
    return rows


@pytest.mark.parametrize("data", ["made", "table"])
def test_join(spark, sf_dir, data, monkeypatch):
    with_checkpoints(spark)
    if data == "made":
        rows = texts()
    else:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([*rows, (None, "a b c d e f")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.text_id, r.copies, r.n_links) for r in near.join(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    bad = [(k, got[k], want[k]) for k in want if got[k] != want[k]]
    assert not bad, bad[:5]
    kept = near.representatives(df).collect()
    assert len(kept) == len({c for c, *_ in want.values()}) + 1


@pytest.mark.parametrize("turned", [False, True])
def test_ids_of_several_texts(spark, turned):
    """An id with two texts, each near another document's, ties all three together, in whatever order rows come."""
    with_checkpoints(spark)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, a + " more"), (3, b + " more"), (9, "alone " * 9), (5, a)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.class_id, r.text_id, r.copies, r.n_links) for r in near.join(df).collect()}
    assert got == {5: (2, 5, 2, 2), 2: (2, 2, 1, 1), 3: (2, 3, 1, 1), 9: (9, 9, 1, 0)}
    kept = near.representatives(df.withColumn("key", near.F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9] and kept[0].key == 1


def test_empty(spark):
    with_checkpoints(spark)
    assert near.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    with_checkpoints(spark)
    rng = np.random.default_rng(0)
    a, b = rng.permutation(200)[:150], rng.permutation(200)[:150]
    a, b = np.r_[a, np.arange(300, 399)], np.r_[b, np.arange(301, 400)]
    want = graphs.small_components(400, a, b)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    got = {r.id: r.root for r in graphs.components(df).collect()}
    assert all(want[i] == r for i, r in got.items()) and set(got) == {int(x) for x, y in zip(a, b) if x != y} | {int(y) for x, y in zip(a, b) if x != y}
