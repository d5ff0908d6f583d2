"""Elias-Fano sequences, and scores against a model computed with dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ngrams, quality


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.integers(0, 2**40))
def test_elias_fano(values, other):
    v = np.unique(np.array(values, np.uint64))
    e = ngrams.EliasFano.of(v)
    assert (e.get(np.arange(len(v))) == v).all()
    asked = np.array([*v[:3], other], np.uint64)
    lo, hi = np.zeros(len(asked), int), np.full(len(asked), len(v))
    want = [int(np.searchsorted(v, a)) if a in v else -1 for a in asked]
    assert list(e.find(asked, lo, hi)) == want
    big = ngrams.EliasFano.of(np.arange(0, 90000, 3))
    assert list(big.find(np.array([3, 4, 9], np.uint64), np.zeros(3, int), np.full(3, 3))) == [1, -1, -1]


def brute(rows):
    """rows of (doc_id, text, held_out): the same model without tries, shards or quantisation."""
    d1, d2, d3 = ngrams.DISCOUNTS
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [["<1>", "<2>", *re.findall(r"[^\x20\x09-\x0D]+", low(t)), "</>"] for _, t, _ in rows]
    c1, c2, c3, before = Counter(), Counter(), Counter(), Counter()
    for t, (_, _, held) in zip(texts, rows):
        if not held:
            c1.update(t[2:])
            for i in range(2, len(t)):
                c2[t[i - 1], t[i]] += 1
                before[t[i - 1]] += 1
                c3[t[i - 2], t[i - 1], t[i]] += 1
    n, v = sum(c1.values()), len(c1)
    next1, next2, pair = Counter(), Counter(), Counter()
    for a, _ in c2:
        next1[a] += 1
    for a, b, _ in c3:
        next2[a, b] += 1
    for (a, b, _), x in c3.items():
        pair[a, b] += x
    out = []
    for t, (i, _, held) in zip(texts, rows):
        base = score = 0.0
        for k in range(2, len(t)):
            c = c1[t[k]]
            base += math.log10((c + 1) / (n + v + 1))
            p = (max(c - d1, 0) + d1 * v / (v + 1)) / n
            b = t[k - 1]
            if before[b]:
                p = (max(c2[b, t[k]] - d2, 0) + d2 * next1[b] * p) / before[b]
            if x := pair[t[k - 2], b]:
                p = (max(c3[t[k - 2], b, t[k]] - d3, 0) + d3 * next2[t[k - 2], b] * p) / x
            score += math.log10(p)
        out.append((i, held, len(t) - 2, sum(c1[w] > 0 for w in t[2:]), n, base, score))
    return out


@pytest.mark.parametrize(("block", "piece"), [(12 << 20, 2_000_000), (100_000, 7_000)])
def test_scores(spark, sf_dir, monkeypatch, block, piece):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, " \n"), (-3, "x"), (-3, "x"), (None, "ÄB äb Zz zz"), (-5, "the of " * 9000)], docs.schema)
    docs = docs.unionByName(odd)
    rows = [(r.doc_id, r.text, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()]
    monkeypatch.setattr(ngrams, "BLOCK", block)
    real = ngrams._Block

    class Small(real):
        def __init__(self, own, shards):
            ngrams.PIECE = piece
            super().__init__(own, shards)

    monkeypatch.setattr(ngrams, "_Block", Small)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(map(tuple, ngrams.scores(docs, quality.remainder("doc_id", 7) == 2).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) <= 0.01 * abs(w[6]) + 0.003 * g[2]  # 8 bits for each probability
    held = [g for g in got if g[1]]
    assert abs(sum(g[6] for g in got) / sum(w[6] for w in want) - 1) < 0.001
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.scores(docs, quality.remainder("doc_id", 7) == 2).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=200), st.tuples(st.integers(0, 7), st.integers(0, 10), st.integers(0, 10)))
def test_trie_finds_what_it_holds(held, other):
    """Nodes by successor search within their parents' ranges, against dictionaries."""
    spread = lambda x: np.array(x, np.uint64) * np.uint64(400_000_007)
    u, v, w = (spread(x) for x in zip(*held))
    trie = ngrams.Trie.build(u, v << np.uint64(32) | w, np.ones(len(u), int))
    asked = [*sorted(set(held)), other]
    a, b, c = (spread(x) for x in zip(*asked))
    each = np.arange(len(asked))
    n1, n2, n3, children = trie.find(a, b, each, c, each)
    for x, i, j, k, n in zip(asked, n1, n2, n3, children):
        assert (i >= 0) == any(h[0] == x[0] for h in held) and (j >= 0) == any(h[:2] == x[:2] for h in held) and (k >= 0) == (x in held)
        assert n == len({h[1] for h in held if h[0] == x[0]})
        if k >= 0:
            count, pair = held.count(x), sum(h[:2] == x[:2] for h in held)
            assert abs(ngrams._TABLES[1][trie.prob[k]] - max(count - ngrams.DISCOUNTS[2], 0) / pair) < 0.006


def test_messages_grow_with_the_text():
    """A block asks and sends to the shards that own something of it, not to all."""
    rows = ngrams.pd.DataFrame({"doc_id": [1, 2], "text": ["a few words only", "a few more"], "held_out": [False, False]})
    p = ngrams._Block([ngrams._pack(rows)], 10_000).pieces[0]()
    p.deal(np.ones(len(p.vocabulary), int))
    assert len(p.asks()) <= len(p.vocabulary) and len(p.sends()) <= len(p.pair)
