"""The classifier: held-out accuracy, and a discriminant computed directly."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import quality
from tessera.session import with_checkpoints


def test_statistics_of_odd_texts():
    x = quality.statistics([None, "", "   ", "a", "a a a a", "b " * 60000, "é|ß\x01"])
    assert x.shape == (7, len(quality.NAMES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all() and x[4][2] > 0.8


def test_held_out_accuracy(spark):
    with_checkpoints(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.score for r in quality.scores(docs, labels, quality.remainder("doc_id", 5) != 0).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == docs.count()
    assert np.mean([(s >= 0.3) == bool(q) for q, s in held]) > 0.9


def test_score_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    mean, a = rng.normal(size=(2, 3)), rng.normal(size=(2, 3, 3))
    cov = a @ a.transpose(0, 2, 1) + np.eye(3)
    x = rng.normal(size=(5, 3))
    d = [-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(mean, cov)]
    got = quality.Discriminant(mean, np.linalg.cholesky(cov), 0.7).score(x)
    assert np.allclose(got, 1 / (1 + np.exp(-(d[1] - d[0] + 0.7))))


def test_without_two_classes_and_empty(spark):
    with_checkpoints(spark)
    docs = spark.createDataFrame([(1, "a b", 5.0), (2, None, 1.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert [r.score for r in quality.scores(docs, labels).collect()] == [1.0] * 3
    assert quality.scores(docs.limit(0), labels).count() == 0


def plain_statistics(text):
    """The same statistics, word by word and byte by byte."""
    raw = (text or "").encode()
    word = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in word]
    n, size = len(word), max(len(raw), 1)

    def kind(b):
        c = chr(b)
        if b >= 128:
            return "beyond"
        if b in (*range(9), *range(14, 32), 127):
            return "control"
        if c in "|<>{}[]\\/_=":
            return "table"
        if c.isdigit() or c.isalpha():
            return "digit" if c.isdigit() else "upper" if c.isupper() else "lower"
        return "stop" if c in ".,;:!?'\"-()" else "symbol" if b > 32 else "blank"

    of = Counter(map(kind, raw))
    share = lambda x: math.sqrt(of[x] / size)
    counts, lines = Counter(low), [x for x in raw.split(b"\n") if x.strip()]
    odd = sum(kind(w[-1]) in ("symbol", "table") or kind(w[0]) in ("symbol", "table") for w in word)
    return [
        math.log1p(n), math.log1p(len(counts)) - 0.85 * math.log1p(n), math.sqrt(sum(a == b for a, b in zip(low, low[1:])) / max(n, 1)), math.sqrt(max(counts.values(), default=0) / max(n, 1)),
        math.log1p(sum(map(len, word)) / max(n, 1)), share("symbol"), share("table"), share("digit"), share("upper"), math.sqrt(sum(b in b".!?" for b in raw) / size),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 1.0, math.log1p(n / max(len(lines), 1)), math.sqrt(odd / max(n, 1)), share("beyond"), share("control"),
        math.sqrt(1 - len(set(zip(low, low[1:]))) / (n - 1)) if n > 1 else 0,
    ]


def test_scores_equal_brute_force(spark, sf_dir):
    """Statistics, shrunk covariances and scores of whole tables, from loops and plain linear algebra."""
    with_checkpoints(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = quality.remainder("doc_id", 5) != 0
    got = {r.doc_id: r.score for r in quality.scores(docs, labels, learn).collect()}
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in x]
    rows = [np.array([x[i] for i, q in known if q == label]) for label in (0, 1)]
    size = [len(r) for r in rows]
    cov = [np.cov(r.T, bias=True) for r in rows]
    pooled = sum(c * n for c, n in zip(cov, size)) / sum(size)
    shrunk = []
    for c, n in zip(cov, size):
        s = 0.15 + 0.85 * len(pooled) / (len(pooled) + n)
        shrunk.append((1 - s) * c + s * pooled + np.diag(np.diag(pooled) * 1e-3 + 1e-6))
    for i, v in x.items():
        density = [-0.5 * (v - r.mean(0)) @ np.linalg.inv(s) @ (v - r.mean(0)) - 0.5 * np.linalg.slogdet(s)[1] for r, s in zip(rows, shrunk)]
        want = 1 / (1 + math.exp(min(700, max(-700, density[0] - density[1] + math.log(size[0] / size[1])))))
        assert abs(got[i] - want) < 1e-6, i
