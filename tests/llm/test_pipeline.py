"""The pipeline's stages against the operators' own rules, on a small table."""

import hashlib
import re
import struct

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing, near, passages, quality
from tessera.llm.queries import VOCABULARY
from tessera.session import with_checkpoints
from tests.llm.test_near import brute


def test_stages(spark):
    with_checkpoints(spark)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    good = by_name["quality"](spark, docs, sf).checkpoint()
    score = {r.doc_id: r.score for r in quality.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in score.items() if s >= 0.3}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(r.doc_id) == 0 for r in good.collect()) <= 0.1 * sum(q == 0 for q in labels.values())
    single = by_name["near_copies"](spark, good, sf).checkpoint()
    classes = brute([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in single.collect()} == {c for c, *_ in classes.values()}
    cut = by_name["passages"](spark, single, sf).checkpoint()
    assert passages.find(cut.select("doc_id", "text")).count() == 0
    mixed = by_name["mix"](spark, cut, sf).checkpoint()
    times = {r.doc_id: len(r.copies) for r in mixing.mix(cut).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    for d in (good, single, cut, mixed):
        assert d.columns == columns
    library = Tokenizer.from_file(VOCABULARY)
    out = by_name["encode"](spark, mixed, sf)
    for r in out.limit(200).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "text", "n_tokens", "ids"} <= set(out.columns)
    assert len(corpus_pipeline.STAGES) == 5 and near and re and F


def _odd(spark):
    rows = [(1, "a b c d e f g " * 9, "x", 7, "s", "i"), (1, "another text of the same id", "x", None, "s", "i"), (2, None, None, 1, None, None), (None, "no id " * 20, "y", 2, "s", "i"), (3, "", "y", 3, "s", "i"), (4, "long " * 60_000, "z", 4, "s", "i"), (1, "a b c d e f g " * 9, "x", 7, "s", "i")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, spans string, ids string")


def test_odd_rows_and_clashing_names(spark, sf_dir):
    """Every stage takes nulls, empty and long texts, ids of two texts, repeats, and columns named like its own."""
    with_checkpoints(spark)
    docs = _odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).checkpoint()
        rows = out.collect()
        if name == "encode":
            assert [c for c in docs.columns if c != "ids"] == out.columns[:5] and len(rows) == docs.count()
            assert all(r.decoded_sha256 and r.ids_sha256 for r in rows)
        else:
            assert out.columns == docs.columns
            assert {(r.doc_id, r["size"], r.spans, r.ids) for r in rows} <= {(r.doc_id, r["size"], r.spans, r.ids) for r in docs.collect()}
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
