"""Request lifecycles and named clocks as keyed stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import numeric_members
from ..operators.network import END_FACTS, RESPONSE_FACTS, traced
from .state import Silence, as_frame, event_columns, in_order

# Requests are dealt over so many groups; fixed, as the state of a running stream is kept by group.
GROUPS = 1024
# A request's page and id and the facts of its response and end pass through the state as JSON, so the state does not depend on their types and on which of them a stream has.
LEG = (
    "request STRING, leg BIGINT, ts_us BIGINT, event_id BIGINT, url STRING, state STRING, end_event_id BIGINT, end_us BIGINT, told STRING, response_event_id BIGINT, "
    "served_from_cache BOOLEAN, ended STRING"
)
LEG_STATE = (
    "leg BIGINT, is_open BOOLEAN, ts_us BIGINT, event_id BIGINT, url STRING, told STRING, response_event_id BIGINT, cached BOOLEAN, last_ms BIGINT"
)
LEG_COLUMNS = [c.split()[0] for c in LEG.split(", ")]
NO_LEG = (0, False, None, None, None, None, None, False, 0)


class LegTracker(StatefulProcessor):
    """State of a group of requests: per (page, request) the open leg, if any. Emits a leg when it closes, every
    event that belongs to no open leg as an orphan, and a leg still open ``ttl_ms`` after the
    last event of its request as pending; the request's state is dropped then.

    A batch costs a request one read and one write of its state, and the read only where its group has been seen before.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.silence = Silence(handle, self.ttl_ms)
        self.legs = handle.getMapState("legs", "request STRING", LEG_STATE)

    @staticmethod
    def _pending(request: str, state: tuple) -> list[tuple]:
        leg, is_open, ts, opened, url, told, responded, cached, _ = state
        return [(request, leg, ts, opened, url, "pending", None, None, told, responded, cached, None)] if is_open else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "request", "kind", "url", "traced", "redirect", "told", "ended")
        if not batch:  # a closing sentinel
            return
        known, watermark = self.silence.known(), timerValues.getCurrentWatermarkInMs()
        legs, out = {}, []
        for now, event, request, kind, address, traced_, redirect, facts, ended in batch:
            if request not in legs:
                stored = self.legs.getValue((request,)) if known is not None else None
                if stored is not None and self.silence.over(stored[-1], min(watermark, now // 1000)):
                    out += self._pending(request, stored)
                    stored = None
                legs[request] = stored or NO_LEG
            leg, is_open, ts, opened, url, told, responded, cached, _ = legs[request]
            closed = lambda state, end=(None, None), facts=told, ended=None: (
                request, leg, ts, opened, url, state, *end, facts, responded, cached, ended
            )
            if kind == "open":
                if is_open and redirect:
                    out.append(closed("redirected", (event, now), facts))
                elif is_open:  # given up by its page: it stays pending
                    out.append(closed("pending"))
                is_open = bool(traced_)
                if is_open:
                    leg, ts, opened, url, told, responded, cached = leg + 1, now, event, address, None, None, False
            elif not is_open:
                out.append((request, leg, now, event, None, "orphan", None, None, None, None, False, None))
            elif kind == "response":
                told, responded = facts, event
            elif kind == "cached":
                cached = True
            else:
                out.append(closed(kind, (event, now), told, ended))
                is_open = False
            legs[request] = (leg, is_open, ts, opened, url, told, responded, cached, now // 1000)
        for request, state in legs.items():
            self.legs.updateValue((request,), state)
        self.silence.expect(min(state[-1] for state in legs.values()), known)
        if out:
            yield as_frame(out, LEG_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = self.silence.sweep(self.legs, -1, timerValues.getCurrentWatermarkInMs())
        out = [row for request, state in gone.items() for row in self._pending(request, state)]
        if out:
            yield as_frame(out, LEG_COLUMNS)

    def close(self) -> None:
        pass


def track_legs(events: DataFrame, delay: str = "1 hour", ttl_ms: int = 86_400_000) -> DataFrame:
    """Legs and orphans of a browser event stream, dealt by page and request so that a busy
    page spreads over tasks, with every column of ``network.legs``. A request that has been silent for ``ttl_ms`` is over: its open leg
    comes out as pending, and its id starts anew if it appears again."""
    if "timing" in events.columns:
        events = events.withColumn("timing", numeric_members(F.try_variant_get("timing", "$", "map<string,variant>")))
    told = [c for c in (*RESPONSE_FACTS, "timing") if c in events.columns]
    ended = [c for c in END_FACTS if c in events.columns]
    packed = lambda names: F.to_json(F.struct(*names)) if names else F.lit(None).cast("string")
    keyed = events.withWatermark("ts", delay).select(
        F.expr(f"pmod(xxhash64(page_id, request_id), {GROUPS})").alias("share"), packed(["page_id", "request_id"]).alias("request"), *event_columns(),
        "kind", "url", traced(F.col("url")).alias("traced"), "redirect", packed(told).alias("told"), packed(ended).alias("ended"),
    )
    legs = keyed.groupBy("share").transformWithStateInPandas(
        statefulProcessor=LegTracker(ttl_ms), outputStructType=LEG, outputMode="Append", timeMode="EventTime"
    )

    def unpacked(column: str, names: list[str]) -> list:
        schema = events.select(*names).schema if names else None
        return [F.from_json(column, schema)[c].alias(c) for c in names]

    return legs.select(
        *unpacked("request", ["page_id", "request_id"]), "leg", F.timestamp_micros("ts_us").alias("ts"), "event_id", "url", "state",
        "end_event_id", F.timestamp_micros("end_us").alias("end_ts"),
        *unpacked("told", told), "response_event_id", "served_from_cache", *unpacked("ended", ended),
    )


CLOCK_OUTPUT = "page_id BIGINT, event_id BIGINT, deadline_ms BIGINT"


class DeadlineClock(StatefulProcessor):
    """One running clock per page; a newer start replaces it. Emits clocks that ran out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "event_id BIGINT, deadline_ms BIGINT")

    @staticmethod
    def _frame(rows):
        return pd.DataFrame(rows, columns=["page_id", "event_id", "deadline_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        running = self.clock.get()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for row in pd.concat(list(rows)).dropna(subset=["event_id"]).sort_values(["now_ms", "event_id"]).itertuples(index=False):
            if running is not None and running[1] <= row.now_ms:
                out.append((key[0], running[0], running[1]))
            running = (int(row.event_id), int(row.deadline_ms))
        if running is not None:
            self.clock.update(running)
            self.handle.registerTimer(running[1])
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            event, deadline = self.clock.get()
            self.clock.clear()
            yield self._frame([(key[0], event, deadline)])

    def close(self) -> None:
        pass


def expired_clocks(starts: DataFrame, delay: str) -> DataFrame:
    """Clocks (page_id, ts, event_id, limit_ms) that ran out before they were restarted; rows without an event are closing sentinels."""
    now = F.unix_millis("ts")
    keyed = starts.withWatermark("ts", delay).select("page_id", "ts", "event_id", now.alias("now_ms"), (now + F.col("limit_ms")).alias("deadline_ms"))
    return keyed.groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=DeadlineClock(), outputStructType=CLOCK_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
