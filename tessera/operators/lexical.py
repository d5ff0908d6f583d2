"""Postings of an index, and in how many texts its terms occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import index_terms


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf), summed before the shuffle."""
    return rows.select(key, F.explode(index_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(rows: DataFrame, key: str, text: str) -> DataFrame:
    return postings(rows, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
