"""The stored index: its codec, searches against the scan, upkeep against a rebuild, versions, odd rows."""

import subprocess
import sys
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import lexical, postings, search
from tessera.session import table


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**35 - 1), max_size=50))
def test_varints(x):
    raw, begin = postings.varints(np.array(x, np.int64))
    assert postings.numbers(raw.tobytes()).tolist() == x and len(begin) == len(x)
    assert all(postings.numbers(raw[b:].tobytes())[0] == v for b, v in zip(begin, x))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _content(index):
    """All postings and lengths, whatever files they lie in."""
    rows = index.blocks().drop("bucket").collect()
    return sorted((r.term, r.n, r.first, r.last, r.most, r.shortest, bytes(r.docs), bytes(r.counts), bytes(r.places), r["keys"], r.lengths) for r in rows)


@pytest.mark.parametrize("prefix", [False, True])
def test_search_equals_the_scan(spark, tmp_path, sf_dir, prefix):
    """Prose, names with underscores (phrases), and a corpus of few good texts, where most blocks are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "def load_user(x): load_user load_users user"), (-2, "load user"), (-3, None), (-4, "load_user_name"), (None, "load_user")], docs.schema))
    asked = table(spark, sf_dir, "benchmark").limit(6).unionByName(spark.createDataFrame([(-1, "load_user"), (-2, "user 4"), (-3, ""), (-4, None)], "item_id long, text string"))
    index = postings.build(docs, "doc_id", "text", f"{tmp_path}/index", 2)
    rows, work = postings.bm25(index, asked, "item_id", "text", 5, prefix, most=1000 if prefix else 6)
    want = search.bm25(docs.where("doc_id is not null"), "doc_id", "text", asked, "item_id", "text", 5, prefix).select("item_id", "doc_id", "score", "rank")
    assert _rows(rows) == _rows(want) and rows.count() > 25
    assert work.where("read > held").count() == 0


def test_low_blocks_are_not_read(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "rare common common common").otherwise(F.concat(F.lit("common "), F.repeat(F.lit("other "), 30))).alias("text"))
    asked = spark.createDataFrame([(1, "common rare")], "item_id int, text string")
    index = postings.build(docs, "doc_id", "text", f"{tmp_path}/index", 1)
    rows, work = postings.bm25(index, asked, "item_id", "text", 3, False)
    assert [r.key for r in rows.orderBy("rank").collect()] == [7, 1007, 2007]
    read = work.first()
    assert read.held == 48 and read.read <= 7


def test_two_passes_equal_a_rebuild(spark, tmp_path, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id < 60")
    folder = f"{tmp_path}/index"
    one = postings.build(docs.where("doc_id % 5 <> 0"), "doc_id", "text", folder, 8)
    two = postings.update(one, docs.where("doc_id in (0, 1)").withColumn("text", F.concat("text", F.lit(" more words"))), "doc_id", "text", docs.where("doc_id = 2").select("doc_id"))
    before = {r.bucket: r.path for r in two.manifest().where("bucket >= 0").collect()}
    three = postings.update(two, docs.where("doc_id = 1"), "doc_id", "text", spark.createDataFrame([(0,), (999,)], "doc_id long"))
    after = {r.bucket: r.path for r in three.manifest().where("bucket >= 0").collect()}
    moved = {b for b in after if after[b] != before[b]}
    touched = {r.b for r in spark.createDataFrame([(0,), (1,)], "doc_id long").select(postings._bucket_of("doc_id", 8).alias("b")).collect()}
    assert moved == touched and len(after) > len(moved)
    whole = docs.where("doc_id % 5 <> 0 and doc_id <> 2")
    again = postings.build(whole, "doc_id", "text", f"{tmp_path}/again", 8)
    assert _content(three) == _content(again) and (three.n, three.length) == (again.n, again.length)
    assert _rows(postings.frequencies(three)) == _rows(lexical.document_frequency(whole, "doc_id", "text").select("term", "df"))
    # Readers of any version see that version; what later ones don't need goes.
    assert postings.load(spark, folder).version == three.version and _content(postings.load(spark, folder, 1)) == _content(one)
    with pytest.raises(FileExistsError):
        postings.update(two, docs.where("doc_id = 3"), "doc_id", "text")
    postings.vacuum(three)
    assert _content(postings.load(spark, folder)) == _content(again) and postings._versions(spark, folder) == [three.version]


def test_terms_that_stay_cancel_out(spark, tmp_path):
    index = postings.build(spark.createDataFrame([("a", "one two three")], "path string, text string"), "path", "text", f"{tmp_path}/index", 2)
    delta = postings.signed(index, spark.createDataFrame([("a", "one two four")], "path string, text string"), "path", "text")
    assert sorted((r.term, r.sign) for r in delta.collect()) == [("four", 1), ("three", -1)]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = postings.build(none, "doc_id", "text", f"{tmp_path}/index")
    rows, work = postings.bm25(index, spark.createDataFrame([(1, "word")], "item_id long, text string"), "item_id", "text", 3)
    assert rows.count() == 0 and postings.frequencies(index).count() == 0
    index = postings.update(index, spark.createDataFrame([(1, "word"), (1, "a word"), (2, None)], none.schema), "doc_id", "text")
    assert (index.n, index.length) == (2, 1)
    index = postings.update(index, none, "doc_id", "text", spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert (index.n, index.length) == (0, 0) and postings.frequencies(index).count() == 0


def test_texts_are_dealt_once(spark, tmp_path, monkeypatch):
    """A build exchanges texts and nothing else, and its plan has no postings of single rows."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('word', id % 7, ' other words') as text")
    seen = []
    write = postings._write
    monkeypatch.setattr(postings, "_write", lambda index, made: seen.append(made._jdf.queryExecution().executedPlan().toString()) or write(index, made))
    index = postings.build(docs, "doc_id", "text", f"{tmp_path}/index", 3)
    postings.update(index, docs.where("doc_id = 3").withColumn("text", F.lit("new")), "doc_id", "text")
    assert len(seen) == 2 and seen[0].count("Exchange hashpartitioning") == 1
    assert not any("MapInPandas" in plan or "HashAggregate(keys=[key" in plan for plan in seen)


def test_memory_of_a_bucket():
    """Some 7 MB of text are put in a bucket and changed there in less than 250 MB more, so without an object for each posting."""
    code = """
import random, resource
from tessera.operators import postings
rng = random.Random(1)
words = ["w%05d" % i for i in range(20000)]
texts = {i: " ".join(rng.choices(words, k=300)) for i in range(4000)}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = postings._changed(0, None, texts)
rows = postings._changed(0, rows, {i: texts[i] + " more" for i in range(0, 4000, 3)} | {1: None})
assert not len(postings._changed(0, rows, {2: texts[2], 9999: None}))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, rows.n[rows.term == ""].sum())
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=postings.__file__.rpartition("/tessera/")[0])
    assert run.returncode == 0, run.stderr
    grown, n = map(int, run.stdout.split())
    assert grown < 250 and n == 3999


def test_many_terms_of_a_prefix():
    """A query whose prefix has 60,000 terms reads their blocks in one go, not one by one."""
    texts = {i: " ".join(f"w{i}x{j}" for j in range(60)) + " common" for i in range(1000)}
    rows = postings._changed(0, None, texts)
    q = search.Asked.of([1], ["w common"], True)
    q.words, q.sets = ["common", "w"], [{"common", "w"}]
    bucket = postings._Bucket(rows, q)
    began = time.process_time()
    docs, scores = postings._best(bucket, ["common", "w"], {"common": 1e-6, "w": 1e-6}, 61.0, 5)
    assert docs.tolist() == [0, 1, 2, 3, 4] and bucket.df("w") == 1000 and time.process_time() - began < 1
