"""Keyed state dealt over groups of keys.

A call to the state store, a timer and an output batch each cost as much as dozens of rows. Processors therefore get groups of many keys, whose
rows come as frames: a group pays them once, and its map state is read and written once per entry that a batch touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def event_columns(event_id: str = "event_id") -> list[Column]:
    """What ``in_order`` sorts by, without nulls, so that ids stay whole numbers in a frame; closing sentinels have no event."""
    return [F.unix_micros("ts").alias("ts_us"), F.coalesce(F.col(event_id).cast("bigint"), F.lit(0)).alias("event_id"), F.col(event_id).isNotNull().alias("is_event"), F.col("ts")]


def in_order(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """Rows of events in their order as ``(ts_us, event_id, *columns)``."""
    rows = []
    for frame in frames:
        frame = frame[frame["is_event"]]
        rows += zip(*[frame[c].tolist() for c in ("ts_us", "event_id", *columns)])
    return sorted(rows, key=lambda r: r[:2])


def as_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Whole numbers beside nulls stay whole."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


class Silence:
    """When the keys of a group have been silent for ``ttl_ms``: one timer a group, at the earliest of its keys.

    The timer is rounded up to a 64th of the time to live, so a key that lives on is passed by at most 64 times in it.
    """

    def __init__(self, handle, ttl_ms: int) -> None:
        self.handle, self.ttl_ms, self.tick = handle, ttl_ms, max(1, ttl_ms // 64)
        self.due = handle.getValueState("due", "ms BIGINT")

    def known(self) -> int | None:
        """When the group is due; none, if it has no state."""
        due = self.due.get()
        return due and int(due[0])

    def over(self, last_ms: int, now_ms: int) -> bool:
        return last_ms + self.ttl_ms <= now_ms

    def expect(self, last_ms: int, known: int | None = None) -> None:
        """Wake the group for a key that spoke last at ``last_ms``, unless it wakes earlier."""
        due = -(-(last_ms + self.ttl_ms) // self.tick) * self.tick
        if known is None or due < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def sweep(self, state, last_at: int, now_ms: int) -> dict:
        """Entries of a map state that are over, taken out of it; ``last_at`` is the place of the last event's time in an entry."""
        gone, first = {}, None
        for key, value in state.iterator():
            if self.over(value[last_at], now_ms):
                gone[key[0]] = value
            elif first is None or value[last_at] < first:
                first = value[last_at]
        if first is None:
            state.clear()
            self.due.clear()
            return gone
        for key in gone:
            state.removeKey((key,))
        self.expect(first)
        return gone
