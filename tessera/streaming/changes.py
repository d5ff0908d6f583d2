"""Changed files as a stream: keyed state of open bursts and of what is known, closed by timers.

Events of a path are put together as long as less than ``gap`` lies between neighbours,
in whatever order they come. A burst is told once the watermark has passed the gap behind
its last event: then no event can join it any more. Its last event says what the file is
now, and what the state knows of the path says what that is: added, changed, unchanged or
removed. State holds a path's open bursts, a few at most, and its last digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "start timestamp, `end` timestamp, n long, reason string, digest string, change string"


class Bursts(StatefulProcessor):
    """Open bursts of a path as rows (start, last, n, order, reason, digest), times in microseconds."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long, place string, reason string, digest string")
        self.known = handle.getValueState("known", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for batch in rows:
            held += [(int(t), int(t), 1, p, r, d) for t, p, r, d in zip(batch["at"], batch.place, batch.reason, batch.digest)]
        merged: list[tuple] = []
        for b in sorted(held, key=lambda b: b[:2]):
            if merged and b[0] - merged[-1][1] < self.gap:
                a = merged[-1]
                latest = b if (b[1], b[3]) >= (a[1], a[3]) else a
                merged[-1] = (a[0], max(a[1], b[1]), a[2] + b[2], *latest[3:])
            else:
                merged.append(b)
        self.open.put(merged)
        for b in merged:
            self.handle.registerTimer(self._due(b))
        return iter([])

    def _due(self, burst: tuple) -> int:
        return -(-(burst[1] + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        now = expiredTimerInfo.getExpiryTimeInMs()
        done = [b for b in held if self._due(b) <= now]
        if len(done) == len(held):
            self.open.clear()
        else:
            self.open.put([b for b in held if self._due(b) > now])
        out = []
        for start, last, n, _, reason, digest in sorted(done):
            before = self.known.get()[0] if self.known.exists() else None
            change = "removed" if digest is None and before is not None else "unchanged" if digest == before else "added" if before is None else "changed"
            if digest is None:
                self.known.clear()
            else:
                self.known.update((digest,))
            out.append((key[0], pd.Timestamp(start, unit="us"), pd.Timestamp(last + self.gap, unit="us"), n, reason, digest, change))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "start", "end", "n", "reason", "digest", "change"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, key: str, ts: str, gap_seconds: int, late: str, place: str, reason: str, digest: str) -> DataFrame:
    """(key, start, end, n, reason, digest, change) of each burst of a stream of events, once it is over.

    place orders events of the same time; digest is null where the file is gone. Events without a key or a time
    take no part; events later than ``late`` behind the latest are dropped, as the watermark has passed them.
    """
    own = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    own = own.select(key, ts, F.unix_micros(ts).alias("at"), F.col(place).cast("string").alias("place"), F.col(reason).alias("reason"), F.col(digest).alias("digest"))
    kind = events.schema[key].dataType.simpleString()
    return own.groupBy(key).transformWithStateInPandas(Bursts(key, gap_seconds * 1_000_000), f"{key} {kind}, {_OUT}", "Append", "EventTime")
