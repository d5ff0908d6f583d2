"""Planted passages are found in place, clean texts are left alone, chains are the best ones."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import passages
from tessera.session import with_checkpoints


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    run = lambda n: [word() for _ in range(n)]
    docs, want = [], {}
    for p in range(25):
        passage = run(rng.randrange(52, 300))
        for k in range(rng.randrange(2, 5)):
            own = list(passage)
            for _ in range(len(own) // 25 if k else 0):
                i = rng.randrange(3, len(own) - 3)
                own[i : i + 1] = rng.choice([[word()], [], [own[i], word()]])
            before = run(rng.randrange(0, 80))
            docs.append((1000 + len(docs), " ".join([*before, *own, *run(rng.randrange(0, 80))])))
            want[docs[-1][0]] = (p, len(before), len(before) + len(own), k)
    for k in range(40):
        docs.append((5000 + k, " ".join([*"a common line of few words that many share".split(), *run(100)])))
    docs += [(6000, None), (6001, ""), (6002, "x " * 9000), (None, docs[0][1]), (docs[0][0], docs[0][1]), (6003, "A b")]
    return docs, want


def test_planted(spark):
    with_checkpoints(spark)
    docs, want = planted()
    df = spark.createDataFrame([(i, t, "x", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, ref long_x, n_chars long".replace("ref long_x", "ref_id string")).repartition(4)
    rows = passages.find(df).collect()
    rank = {r.doc_id: r.h for r in df.where("doc_id is not null").selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    least = {}
    for i, (p, *_) in want.items():
        least[p] = min(least.get(p, i), i, key=rank.get)
    found = {}
    for r in rows:
        p, lo, hi, _ = want[r.doc_id]
        assert want[r.ref_id][0] == p and rank[r.ref_id] < rank[r.doc_id]
        a, b = found.get(r.doc_id, (r.start_word, r.end_word))
        found[r.doc_id] = min(a, r.start_word), max(b, r.end_word)
    for i, (a, b) in found.items():
        _, lo, hi, _ = want[i]
        assert abs(a - lo) <= 20 and abs(b - hi) <= 20, (i, a, b, lo, hi)  # a word may be missing near an end
    assert found.keys() == {i for i, (p, *_) in want.items() if least[p] != i}
    left = {r.doc_id: r for r in passages.without(df).collect() if r.doc_id is not None}
    for i, t in docs:
        if i in found:
            p, lo, hi, _ = want[i]
            assert abs(len(left[i].text.split()) - (len(t.split()) - hi + lo)) <= 40
            assert left[i].n_chars == len(left[i].text)
        elif i is not None:
            assert left[i].text == t


def _key(r):
    return tuple(r[c] for c in ("doc_id", "start_word", "end_word", "ref_id", "ref_start", "ref_end", "passage", "digest"))


def brute(rows, rank):
    """The same passages from dictionaries over all documents at once: no units, buckets, blocks or joins. rank: of each id."""
    texts = sorted({(rank[i], i, t or "") for i, t in rows if i is not None})
    first, out = {}, []
    for n, (_, i, t) in enumerate(texts):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in t.split()]
        texts[n] = (i, t, w)
        for k in range(len(w) - passages.SEED + 1):
            first.setdefault(tuple(w[k : k + passages.SEED]), (n, k))
    for n, (i, t, w) in enumerate(texts):
        own = [(k, *first[tuple(w[k : k + passages.SEED])]) for k in range(len(w) - passages.SEED + 1)]
        own = [x for x in own if texts[x[1]][0] != i]
        place = [p for p, *_ in own]
        span = passages.MIN_WORDS - passages.SEED
        kept = [x for x in own if any(sum(s <= p <= s + span for p in place) >= passages.FEWEST for s in place if s <= x[0] <= s + span)]
        parts = []
        for ref in sorted({r for _, r, _ in kept}):
            other = texts[ref][2]
            number = {}
            ids = lambda x: np.array([number.setdefault(v, len(number)) for v in x])  # noqa: B023, E731
            for chain in passages.chains(*np.array([(p, q) for p, r, q in kept if r == ref]).T):
                lo, hi = max(0, chain[0][0] - passages.REACH), min(len(w), chain[-1][1] + passages.SEED + passages.REACH)
                a, b, c, d, share = passages.align(np.array(chain), ids(w[lo:hi]), lo, ids(other), 0)
                if b - a >= passages.PART and share >= passages.IDENTITY:
                    parts.append((a, b, texts[ref][0], c, d))
        groups = []
        for p in sorted(parts):
            if groups and p[0] <= max(q[1] for q in groups[-1]) + passages.JOIN:
                groups[-1].append(p)
            else:
                groups.append([p])
        for k, g in enumerate(groups):
            if max(q[1] for q in g) - min(q[0] for q in g) >= passages.MIN_WORDS:
                out += [(i, *p, k, hashlib.md5(t.encode()).hexdigest()) for p in g]
    return sorted(out)


@pytest.mark.parametrize(("batch", "unit", "bucket"), [(7, 1 << 22, 1 << 22), (50, 9_000, 1_000), (10_000, 60_000, 100_000)])
def test_same_rows_as_brute_force(spark, monkeypatch, batch, unit, bucket):
    """Whatever the batches, units and buckets; ids of several texts included, in whatever order."""
    with_checkpoints(spark)
    docs, _ = planted(9)
    docs += [(docs[8][0], docs[3][1]), (docs[8][0], "short"), (7000, docs[5][1] + " and more"), (7000, docs[40][1]), (-5, docs[12][1].upper())]
    df = spark.createDataFrame(docs[::-1] if batch == 50 else docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(passages, "UNIT", unit)
    monkeypatch.setattr(passages, "BUCKET", bucket)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sorted(map(_key, passages.find(df).collect()))
        left = passages.without(df.withColumn("spans", df.text)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rank = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _ in docs if i is not None], "i long").selectExpr("i", "xxhash64(i) as h").collect()}
    want = brute(docs, rank)
    assert len(want) > 50 and found == want
    assert {r.spans for r in left if r.doc_id == 7000} <= {docs[5][1] + " and more", docs[40][1]}


def test_empty(spark):
    with_checkpoints(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passages.find(df).count() == 0 and passages.without(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=7, unique=True))
def test_best_chain(points):
    pos, ref = (np.array(x) for x in zip(*points))
    score = lambda c: sum(e - s + passages.SEED for s, e, _ in c) - sum(passages.COST * ((y[0] - x[1]) + (y[2] - x[2] - x[1] + x[0])) for x, y in zip(c, c[1:]))
    every = [s for c in passages.chains(pos, ref) for s in c]
    best = 0
    for n in range(1, len(every) + 1):
        for c in combinations(sorted(every), n):
            if all(x[1] < y[0] and x[2] + x[1] - x[0] < y[2] and y[0] - x[1] <= 46 and y[2] - x[2] - x[1] + x[0] <= 46 for x, y in zip(c, c[1:])):
                best = max(best, score(c))
    assert max(map(score, passages.chains(pos, ref))) >= best - 1e-9 or len(every) > 1 and max(pos) - min(pos) > 46


def test_each_copy_within_a_document(spark):
    with_checkpoints(spark)
    rng = random.Random(5)
    run = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, line = run(60), run(12)
    held = [*passage[:24], *line, *passage[24:]]
    docs = [(1, " ".join([*run(20), *passage, *run(30), *held])), (2, " ".join([*run(30), *passage, *run(50), *passage, *run(20)])), (3, " ".join([*line, *run(40), *held, *run(9)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for batch in (10_000, 1):  # a tie within a batch, and one between batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = passages.find(df.coalesce(1)).collect()
            left = {r.doc_id: r.text.split() for r in passages.without(df.coalesce(1)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        two = sorted((r.start_word, r.end_word) for r in rows if r.doc_id == 2)
        assert two == [(30, 90), (140, 200)]
        assert len(left[2]) == 100 and len(left[1]) == 182


def _score(chain):
    return sum(e - s + passages.SEED for s, e, _ in chain) - sum(passages.COST * ((y[0] - x[1]) + (y[2] - x[2] - x[1] + x[0])) for x, y in zip(chain, chain[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 150), st.integers(0, 150)), min_size=1, max_size=7, unique=True))
def test_best_chain_within_the_gap(points):
    pos, ref = (np.array(x) for x in zip(*points))
    far, found = passages.GAP + passages.SEED, passages.chains(pos, ref)
    near = lambda x, y: x[1] < y[0] <= x[1] + far and x[2] + x[1] - x[0] < y[2] <= x[2] + x[1] - x[0] + far
    every = sorted(s for c in found for s in c)
    assert all(near(x, y) for c in found for x, y in zip(c, c[1:]))
    linked = [c for n in range(1, len(every) + 1) for c in combinations(every, n) if all(near(x, y) for x, y in zip(c, c[1:]))]
    assert abs(max(map(_score, found)) - max(map(_score, linked))) < 1e-9


def test_pieces_behind_a_long_match_are_chained():
    pieces, at, ref_at = [(k, k) for k in range(300)], 365, 365
    for _ in range(8):  # pieces of 10 words, a word more on one side between them
        pieces += [(at + k, ref_at + k) for k in range(5)]
        at, ref_at = at + 11, ref_at + 10
    found = passages.chains(*np.array(pieces).T)
    assert sorted(len(c) for c in found) == [1, 8]


def test_edited_down_to_identity(spark):
    with_checkpoints(spark)
    rng = random.Random(11)
    run = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    docs, want = [], {}
    for n in (60, 100, 200):
        for rate in (0.15, 0.2):
            for _ in range(8):
                own = run(n)
                docs.append((len(docs), " ".join([*run(30), *own, *run(30)])))
                k = round(n * rate)
                for i in range(k):  # evenly spaced: at 20 % no run of five words is left
                    own[int((i + 0.5) * n / k)] = run(1)[0]
                want[len(docs)] = n
                docs.append((len(docs), " ".join([*run(30), *own, *run(30)])))
    found = {}
    for r in passages.find(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    found = {i | 1: places for i, places in found.items()}  # either of the two may be the later one
    assert found.keys() == want.keys()
    assert all(len(found[i] & set(range(30, 30 + n))) >= 0.85 * n for i, n in want.items())


@pytest.mark.parametrize("unit", [passages.UNIT, 3_000])
def test_passage_whose_seeds_come_first_elsewhere(spark, monkeypatch, unit):
    """Each run of four words of a passage is in another, earlier document; the two last ones share the passage whole."""
    with_checkpoints(spark)
    rng = random.Random(8)
    run = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = run(60)
    ids = [r.id for r in spark.range(80).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    docs = [(i, " ".join([*run(30), *passage[k : k + 4], *run(30)])) for k, i in enumerate(ids[:57])]
    docs += [(i, " ".join([*run(25), *passage, *run(20)])) for i in ids[-2:]]
    monkeypatch.setattr(passages, "UNIT", unit)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = passages.find(df).collect()
    assert {r.doc_id for r in found} == {ids[-1]} and {r.ref_id for r in found} == {ids[-2]}
    assert (min(r.start_word for r in found), max(r.end_word for r in found)) == (25, 85)
    left = {r.doc_id: len(r.text.split()) for r in passages.without(df).collect()}
    assert left[ids[-1]] == 45 and left[ids[-2]] == 105 and all(left[i] == 64 for i in ids[:57])


@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 3))
def test_least_of_any_window(values, texts):
    run, text = np.array(values, np.uint64), np.sort(np.arange(len(values)) % texts)
    chosen = set(passages._least(run, text).tolist())
    w = passages.WINDOW
    windows = [range(i, i + w) for i in range(len(values) - w + 1) if text[i] == text[i + w - 1]]
    assert chosen == {i for x in windows for i in x if values[i] == min(values[j] for j in x)}
