"""Keyed change state as a stream: bursts and changes equal to plain ones, late and unordered events, a restart."""

from datetime import datetime, timedelta

import pytest

from tessera.streaming import changes

START = datetime(2024, 1, 1)
SCHEMA = "path string, ts timestamp, id long, reason string, digest string"


def brute(rows, gap, until):
    """Bursts of each path that are over at ``until``, and what each one changes."""
    out, known = [], {}
    for path in sorted({r[0] for r in rows}):
        own, bursts = sorted((r[1], str(r[2]), r[3], r[4]) for r in rows if r[0] == path), []
        for t, _, reason, digest in own:
            if bursts and t - bursts[-1][1] < timedelta(seconds=gap):
                bursts[-1] = [bursts[-1][0], t, bursts[-1][2] + 1, reason, digest]
            else:
                bursts.append([t, t, 1, reason, digest])
        for start, last, n, reason, digest in bursts:
            if last + timedelta(seconds=gap) > until:
                continue
            before = known.get(path)
            change = "removed" if digest is None and before is not None else "unchanged" if digest == before else "added" if before is None else "changed"
            known[path] = digest
            out.append((path, start, last + timedelta(seconds=gap), n, reason, digest, change))
    return sorted(out, key=str)


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(changes.STORE[0])
    spark.conf.set(*changes.STORE)
    yield spark
    spark.conf.set(changes.STORE[0], before)


def test_bursts_and_changes_with_a_restart(stateful, tmp_path):
    """Three deliveries, each by a query of its own over the same state; some events come late, but within the bound."""
    at = lambda s: START + timedelta(seconds=s)
    first = [("a", at(0), 1, "new", "h1"), ("a", at(5), 2, "edit", "h2"), ("b", at(3), 3, "new", "x"), ("b", at(60), 4, "edit", "x"), (None, at(4), 5, "new", "n")]
    second = [("a", at(12), 6, "edit", "h3"), ("a", at(100), 7, "delete", None), ("b", at(55), 8, "touch", "x"), ("c", at(101), 9, "new", "c1")]
    third = [("a", at(400), 10, "new", "h4"), ("c", at(300), 11, "edit", "c2"), ("d", at(1000), 12, "end", "d")]
    got: list = []
    for i, rows in enumerate((first, second, third)):
        stateful.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = stateful.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        told = changes.changes(stream, "path", "ts", 10, "60 seconds", "id", "reason", "digest")
        write = told.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state")
        write.trigger(availableNow=True).start().awaitTermination(120)
    every = [r for r in first + second + third if r[0] is not None]
    assert sorted(got, key=str) == brute(every, 10, at(1000 - 60))
    assert {r[-1] for r in got} == {"added", "changed", "unchanged", "removed"}
