"""Collocations against SQL and plain counting; hot words, ends of strides, shared hashes, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as co
from tests.oracle import assert_same


def brute(rows, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        longer = [p for p, a in counts.items() if len(p) == 3 and a >= co.LEAST]
        rows = []
        for p, a in counts.items():
            if len(p) < 2 or a < co.LEAST or any(p in (q[:2], q[1:]) and 100 * counts[q] >= 50 * a for q in longer):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(n=300, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "x-y", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append("New York City" if rng.random() < 0.1 else "of the" if rng.random() < 0.2 else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]))
        rows.append(("".join(out), rng.choice(["en", "en", "fr", None])))
    return rows + rows[:20] + [(None, "en"), ("", "de"), (" . , ", None), ("und " * 12, "und")]


def got(spark, rows, top):
    df = spark.createDataFrame([(i, t, l, 1) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string, n int")
    return sorted(map(tuple, co.mine(df, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("top", "small"), [(2000, False), (7, True)])
def test_equals_counting(spark, monkeypatch, top, small):
    """With small parts, blocks and strides as well, where most words are frequent and texts are cut often."""
    if small:
        for name, value in {"STRIDE": 64, "BLOCK": 50, "PART": 200, "MANY": 30}.items():
            monkeypatch.setattr(co, name, value)
    rows = texts()
    found = got(spark, rows, top)
    assert found == brute(rows, top) and len(found) > 20


def test_long_words_and_texts():
    """Strides keep words whole; a word beyond a stride has one hash wherever it stands."""
    data = b"ab  " * 10 + b"x" * (co.STRIDE + 5) + b" cd. " + b"y" * co.STRIDE + b"," + b"ef " * 200_000 + b"y" * co.STRIDE
    parts = list(co.strides(data))
    assert b"".join(parts) == data
    h = np.concatenate([co.Hasher("en", 1).words(p)[0] for p in parts])
    words = re.findall(rb"[^ .,]+", data)
    known = {}
    assert len(h) == len(words) and all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(known.values())) == len(known)
    breaks = [co.Hasher("en", 1).words(p) for p in parts]
    assert sum(b[4] for b in breaks) == data.count(b".") + data.count(b",")


def test_shared_hashes_are_found(spark, monkeypatch):
    """Words that share a hash under a seed make it start again with another."""
    counted, seeds, rows = co.word_counts, [], texts(40)

    def some(df, seed):
        seeds.append(seed)
        return counted(df, seed) if seed > 1 else counted(df, seed).withColumn("h", F.lit(1).cast("long"))

    monkeypatch.setattr(co, "word_counts", some)
    assert got(spark, rows, 50) == brute(rows, 50) and seeds[:2] == [1, 2]


def test_messages_hold_what_went_in():
    rng = np.random.default_rng(2)
    h, piece = rng.integers(1, 9, 500).astype(np.uint64) << np.uint64(50), np.sort(rng.integers(0, 90, 500))
    own, ids, count = co._sorted_entries(h, piece, True)
    back, n = co._unpacked(co._packed(own, ids, count))
    assert (back == own[ids]).all() and (n == count).all() and n.sum() == 500
    want = Counter(tuple(int(h[j]) if j < 500 and piece[j] == piece[i] else 0 for j in range(i, i + 3)) for i in range(500))
    assert {tuple(x): c for x, c in zip(back.T.tolist(), n.tolist())} == want


def test_matches_sql(spark, sf_dir):
    assert_same(co.mine(spark.read.parquet(f"{sf_dir}/documents.parquet")), co.ORACLE, sf_dir, least=100)


def test_empty_table(spark):
    assert co.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
