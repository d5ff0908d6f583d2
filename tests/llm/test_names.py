"""Stages give columns of any name back untouched; number of templates and length of payloads have no limit."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import licenses
from tessera.session import table

#: Names that stages use on their way, or have used.
CLASHING = ["__score", "__key", "__digest", "__spans", "__id", "__of", "__h", "__s", "__b", "__block", "__shard", "__cut", "__shards", "__rounds", "own_0_", "score", "size", "block", "copies", "place", "taken", "target", "key", "unit", "h"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_columns_come_back(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, sf_dir, "documents").where("doc_id < 80")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in CLASHING})
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.select("doc_id", *CLASHING).collect()
    assert len(rows) > 20 and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHING)


def test_any_number_of_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 3)
    templates = {f"t{i}": f"granted under rule number{i} of the house, to all who ask for it{i}" for i in range(8)}
    docs = spark.createDataFrame([(i, f"first words. {t} last words") for i, t in enumerate(templates.values())], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs, templates).collect() if r.containment == 1.0) == [(i, f"t{i}") for i in range(8)]


def test_memory_of_a_long_payload():
    """32 MB are coded, and read back by ranges, in less than 400 MB; coding them whole took 118 bytes a byte."""
    code = """
import resource
from tessera.llm import flac
p = b"the quick brown fox jumps over lazy dogs " * 800_000
s = flac.encode([p])[0]
for at in range(0, len(p), 1 << 20):
    assert flac.decode([s], at, 1 << 20)[0] == p[at : at + (1 << 20)]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rpartition("/")[0] or ".")
    assert run.returncode == 0 and int(run.stdout) < 400, run.stderr
