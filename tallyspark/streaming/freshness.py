"""Which answers are still fresh, as a stream: an entry a key, replaced by newer ones and gone after its time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIVES_MS = 60_000  # fixed value
FRESHNESS = "key string, revision string, checked timestamp, state string"


class Freshness(StatefulProcessor):
    """Of events (key, revision, at), the newest by event time is the key's entry.

    Says `fresh` when an entry comes, `merged` when an event is older than the entry (which stays) or repeats its revision (which
    lives on from the newer time), and `expired` when the watermark passes the end of its life. The state is one row a key, dropped at its
    expiry; a timer of the key tells when.
    """

    def __init__(self, lives_ms: int = LIVES_MS):
        self.lives_ms = lives_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "revision string, at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(at.value // 1_000_000), revision) for pdf in rows for at, revision in zip(pd.to_datetime(pdf["at"]), pdf["revision"], strict=True))
        held = self.entry.get() if self.entry.exists() else None
        revision, at_ms = held if held else (None, -1)
        out = []
        for when, found in events:
            if found != revision and when >= at_ms:
                out.append((found, when, "fresh"))
                revision, at_ms = found, when
            else:
                out.append((found, when, "merged"))
                at_ms = max(at_ms, when) if found == revision else at_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.entry.update((revision, at_ms))
        self.handle.registerTimer(at_ms + self.lives_ms)
        yield said(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            revision, at_ms = self.entry.get()
            self.entry.clear()
            yield said(key[0], [(revision, at_ms, "expired")])

    def close(self) -> None:
        pass


def said(key: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"key": [key] * len(rows), "revision": [r for r, _, _ in rows], "checked": pd.to_datetime([t for _, t, _ in rows], unit="ms"), "state": [s for _, _, s in rows]})


def freshness(events: DataFrame, delay: str = "10 seconds", lives_ms: int = LIVES_MS) -> DataFrame:
    """Rows (key, revision, checked, state) of a stream of (key, revision, at). Needs the RocksDB state store."""
    named = events.select("key", "revision", "at").filter("key is not null and at is not null").withWatermark("at", delay)
    return named.groupBy("key").transformWithStateInPandas(Freshness(lives_ms), FRESHNESS, "Append", "EventTime")
