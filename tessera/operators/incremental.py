"""Snapshots of files: what changed, what is gone, and the next snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, scanned: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, change): added, changed, unchanged or removed, by one full outer join on the key."""
    a, b = stored.select(key, F.col(digest).alias("__old"), F.lit(1).alias("__a")), scanned.select(key, F.col(digest).alias("__new"), F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert(stored: DataFrame, changed: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """stored with the rows of changed in place of those of their keys; with ``order``, the last of several rows of a key wins."""
    last = changed if order is None else changed.groupBy(key).agg(F.max_by(F.struct(*changed.columns), order).alias("r")).select("r.*")
    return stored.join(changed.select(key).distinct(), key, "left_anti").unionByName(last)


def removed(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(scanned.select(key), key, "left_anti")


def retained(children: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Child rows whose file still exists: a deletion's cascade."""
    return children.join(files.select(key), key, "left_semi")


@dataclass
class Pass:
    """What a pass over changed files makes: the next snapshot's tables and its counters."""

    files: DataFrame
    children: dict[str, DataFrame]
    counters: DataFrame


def index_pass(stored: DataFrame, children: dict[str, DataFrame], scanned: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], key: str = "path", digest: str = "hash") -> Pass:
    """Index what changed: stored and scanned are files (key, digest, ...), children the stored tables by name.

    build makes the child tables of changed files alone. Children of changed and of missing files go, those of
    all others stay; an edge belongs to the file of its evidence, so it needs no rule of its own. counters: one
    row of indexed, skipped and removed files and of the rows of each new child table.
    """
    changes = diff(stored, scanned, key, digest).checkpoint()
    fresh = scanned.join(changes.where("change in ('added', 'changed')").select(key), key, "left_semi")
    same = changes.where("change = 'unchanged'").select(key)
    made = build(fresh)
    tables = {name: retained(old, same, key).unionByName(made[name]) for name, old in children.items()}
    is_ = lambda *names: F.coalesce(F.sum(F.col("change").isin(*names).cast("long")), F.lit(0))
    counters = changes.agg(is_("added", "changed").alias("indexed"), is_("unchanged").alias("skipped"), is_("removed").alias("removed"))
    for name, rows in made.items():
        counters = counters.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(f"new_{name}"))))  # one row each
    return Pass(upsert(stored.join(scanned.select(key), key, "left_semi"), fresh, key), tables, counters)


def set_meta(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """A table of (key, value) with some values set."""
    return upsert(meta, meta.sparkSession.createDataFrame(list(values.items()), "key string, value string"), "key")


def status(tables: dict[str, DataFrame], meta: DataFrame) -> DataFrame:
    """One row: the rows of each table, and all of meta as a map."""
    out = meta.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("meta"))
    for name, rows in tables.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out


def stamped(files: DataFrame) -> DataFrame:
    """files with the time at which they are indexed."""
    return files.withColumn("indexed_at", F.current_timestamp())


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def publish(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """Write a snapshot's tables under a version of their own; readers follow the pointer, written last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current")
    return f"{folder}/{version}"


def current(spark, folder: str) -> str:
    return f"{folder}/{spark.read.parquet(f'{folder}/current').first().version}"


def check_compatible(meta: dict[str, str], provider: str, dims: int, n_chunks: int) -> None:
    """Refuse to mix vectors of different providers or lengths in one index."""
    if n_chunks and (meta.get("embedding_provider"), meta.get("embedding_dims")) != (provider, str(dims)):
        raise ValueError(f"the index holds vectors of {meta.get('embedding_provider')} ({meta.get('embedding_dims')}), not of {provider} ({dims})")
