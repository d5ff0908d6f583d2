"""Order MinHash against plain loops, its sensitivity to order, and odd rows."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _xx(*values):
    """Spark's 64-bit hash of strings and longs; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, tuple) else "<q", *(v if isinstance(v, tuple) else (_signed(v),)))
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = (1 << 30) - 1
    top = lambda h: (h >> 1) & ~low
    seen, entries = {}, []
    for i, w in enumerate(words):
        h = top(_xx(*words[i : i + fp.K]))
        number = seen.get(h, 0)
        seen[h] = number + 1
        entries.append(((top(_xx(h, (number,))) if number else h), i))
    halves = {}
    for h, i in entries:
        halves[h >> 56] = min(halves.get(h >> 56, (1 << 63, 0)), (h, i))
    out = []
    for b in range(fp.BINS):
        two = sorted((halves[x] for x in (2 * b, 2 * b + 1) if x in halves), key=lambda e: e[1])
        out.append(f"{_xx(*(h for h, _ in two)) & 65535:04X}" if two else fp.EMPTY)
    return "".join(out)


def brute_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    near = lambda a, b: (lambda p: 1.0 if not p else sum(x == y for x, y in p) / len(p))([(x, y) for i in range(fp.BINS) for x, y in [(a[4 * i : 4 * i + 4], b[4 * i : 4 * i + 4])] if (x, y) != (fp.EMPTY, fp.EMPTY)])
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b = brute(text), brute(edited)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, brute(after))))
    return sorted(out, key=str)


ROWS = [
    (5, "the cat sat on the mat and the cat sat on the mat again, the cat"), (1, None), (2, ""), (3, "one"), (4, "  two\twords \n"), (9, "é😀 ü " * 40), (7, "a " * 500), (8, "x" * 50_000 + " tail"),
    (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "no id at all here"), (12, " \t\r\n"), (20, " ".join(f"w{i % 37}" for i in range(700))), (21, " ".join(f"w{i % 37}" for i in range(700))),
]


@pytest.mark.parametrize("docs_of_block", [2, 200])
def test_equals_loops(spark, monkeypatch, docs_of_block):
    """Blocks of two documents and one block: ties, nulls, repeats, long words, many copies of a k-mer, the last one before the first."""
    monkeypatch.setattr(fp, "BLOCK_DOCS", docs_of_block)
    df = spark.createDataFrame([(k, t, "clash") for k, t in ROWS], "doc_id long, text string, block string").repartition(3)
    got = fp.compare_with_edits(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_rows(ROWS)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(3, "some few words are here")], "doc_id long, text string")
    assert list(map(tuple, fp.compare_with_edits(df).collect())) == brute_rows([(3, "some few words are here")])
    assert fp.compare_with_edits(df.limit(0)).count() == 0


def test_order_and_repeats_count(spark):
    words = [f"w{i}" for i in range(300)]
    texts = {"same": words, "near": [*words[:290], *("x" * 10)], "turned": words[150:] + words[:150], "mixed": [w for i in range(10) for w in words[i::10]], "twice": words * 2}
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "name string, text string").withColumn("f", fp.fingerprint(F.col("text")))
    one = F.lit(df.where("name = 'same'").first().f)
    near = {r.name: r.n for r in df.select("name", fp.likeness(F.col("f"), one).alias("n")).collect()}
    assert near["same"] == 1.0 and near["near"] > 0.7 and near["mixed"] < 0.1
    assert near["turned"] < 0.9 and near["twice"] < 0.7  # the sets of k-mers are all but the same


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fp.compare_with_edits(docs).collect()), key=str) == brute_rows(rows)
