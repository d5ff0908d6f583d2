"""The index of trigrams: its codec, the same rows as the scan, passes and the share of chunks that is read, odd rows and tokens."""

import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, grams, search
from tessera.operators.postings import numbers
from tessera.session import table

SCHEMA = "path string, start_line int, end_line int, symbol string, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab_\né\U0001f600", max_size=12), min_size=1, max_size=6))
def test_codec(texts):
    gram, n, docs = grams.postings([grams.trigrams(t) for t in texts])
    got = {int(g): np.cumsum(numbers(d)).tolist() for g, d in zip(gram, docs)}
    want: dict[int, list[int]] = {grams.ALL: list(range(len(texts)))}
    for i, t in enumerate(texts):
        for g in sorted({t[a : a + 3] for a in range(len(t) - 2)}):
            want.setdefault(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]), []).append(i)
    assert got == want and n.tolist() == [len(want[int(g)]) for g in gram]


def test_strides(monkeypatch):
    text = "abcdefgh" * 40 + "xyz"
    want = grams.trigrams(text)
    monkeypatch.setattr(grams, "STRIDE", 5)
    assert grams.trigrams(text).tolist() == want.tolist() and len(want) == 8 + 3


def test_equals_the_scan_and_reads_less(spark, sf_dir, tmp_path):
    """Prose as chunks, sought by benchmark passages (frequent words) and by rare ones; rows that occur twice."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    chunks = chunking.line_windows(d.unionByName(d.limit(3))).withColumn("symbol", F.when(F.hash("path") % 3 == 0, F.concat(F.lit("class:Rare"), F.substring("path", 3, 2)))).select("path", "start_line", "end_line", "symbol", "text")
    asked = table(spark, sf_dir, "benchmark").limit(5).unionByName(spark.createDataFrame([(-1, "Rare1"), (-2, "zzzz qqqq"), (-3, ""), (-4, None), (None, "rare"), (-5, "d 7 xq"), (-6, "___")], "item_id long, text string"))
    index = grams.build(chunks, f"{tmp_path}/grams")
    got, work = grams.contain_any(index, asked, "item_id", "text", 6)
    want = search.contain_any(chunks, asked.where("item_id is not null"), "item_id", "text", 6).select("item_id", *grams.PLACE, "rank")
    assert _rows(got) == _rows(want) and len(_rows(got)) > 30
    assert work["chunks"] == index.size() == chunks.count()
    rare, work = grams.contain_any(index, asked.where("item_id in (-1, -2)"), "item_id", "text", 6)
    assert rare.count() == 6 and work["passes"] == 1 and work["tested"] <= 12 < work["chunks"] / 10


@pytest.mark.parametrize("sent", [grams.SENT, 0])
def test_candidates_that_only_look_alike(spark, tmp_path, monkeypatch, sent):
    """Chunks with all trigrams of a token but not the token: further passes go on to the last of 300."""
    monkeypatch.setattr(grams, "SENT", sent)
    rows = [(f"p{i:03}", 1, 2, None, "abcd bcde") for i in range(300)] + [("q", 1, 2, None, "x abcde"), ("q", 3, 4, "f:ABCDE", None)]
    index = grams.build(spark.createDataFrame(rows, SCHEMA).repartition(5), f"{tmp_path}/grams")
    got, work = grams.contain_any(index, spark.createDataFrame([(1, "abcde"), (2, "bcd")], "q int, t string"), "q", "t", 3, at_first=2)
    assert _rows(got) == [(1, "q", 1, 2, 1), (1, "q", 3, 4, 2), *((2, f"p{i:03}", 1, 2, i + 1) for i in range(3))]
    assert work["passes"] >= 4


def test_tokens_of_all_shapes(spark, tmp_path, monkeypatch):
    """Short tokens, underscores in any place, the ends of fields, and blocks of few rows, against plain regular expressions."""
    monkeypatch.setattr(grams, "ROWS", 4)
    texts = ["a_b", "axb", "ab", "id", "the id", "Id=4", "4", "foo.bar", "foo_bar", "fooXbar", "foobar", "", None, "xéid", "a", "__", "load_user_name", "load user", "LOADxUSER", "Kelvin", "b" * 70 + "c"]
    rows = [(f"{i:02}", 1, 1, None, t) for i, t in enumerate(texts)]
    index = grams.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/grams")
    assert index.rows().select("block").distinct().count() == 6
    tokens = ["a_b", "id", "4", "foo_bar", "__", "_id", "b_", "load_user", "kelvin", "ab", "b" * 70 + "c", "b" * 69 + "cc", "oo_ba", "a1"]
    got, _ = grams.contain_any(index, spark.createDataFrame([(t, t) for t in tokens], "q string, t string"), "q", "t", 50)
    found = {}
    for r in got.collect():
        found.setdefault(r.q, set()).add(r.path)
    for t in tokens:
        want = {p for p, _, _, _, x in rows if re.search(re.escape(t).replace("_", "."), (x or "").lower() + "", re.DOTALL) or re.search(re.escape(t).replace("_", "."), p)}
        assert found.get(t, set()) == want, t


def test_long_words_and_no_rows(spark, tmp_path):
    word = "".join(chr(97 + i * i % 26) for i in range(1_000_000))
    index = grams.build(spark.createDataFrame([("a", 1, 1, None, word), ("b", 1, 1, None, word[:-1] + "!")], SCHEMA), f"{tmp_path}/grams")
    began = time.perf_counter()
    got, work = grams.contain_any(index, spark.createDataFrame([(1, word)], "q int, t string"), "q", "t", 3)
    assert _rows(got) == [(1, "a", 1, 1, 1)] and work["tested"] == 2
    assert time.perf_counter() - began < 60
    none = grams.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    got, work = grams.contain_any(none, spark.createDataFrame([(1, "some")], "q int, t string"), "q", "t", 3)
    assert got.count() == 0 and work["tested"] == 0
