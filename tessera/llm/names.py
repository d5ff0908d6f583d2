"""Columns of any name through a stage that has names of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones renamed, so that none clashes, and columns that give the old names back."""
    names = [c if c.lower() in needed else f"own_{i}_" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
