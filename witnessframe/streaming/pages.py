"""What a page waits for, as keyed stream state: navigations, a quiet network, named clocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .state import Silence, as_frame, event_columns, in_order

# Pages and clocks are dealt over so many groups; fixed, as the state of a running stream is kept by group.
GROUPS = 1024
CLOSERS = ("finished", "failed")


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """A batch's rows in the order of events; closing sentinels have no event."""
    return sorted((r for r in rows if r.event_id is not None), key=lambda r: (r.ts, r.event_id))


class _Entries:
    """Entries of a map state that one batch touches: each is read and written once. ``empty`` tells that the state holds none, so none is asked for."""

    def __init__(self, state, empty: bool = False) -> None:
        self.state, self.empty, self.known, self.changed = state, empty, {}, set()

    def get(self, *key):
        if key not in self.known:
            self.known[key] = None if self.empty else self.state.getValue(key)
        return self.known[key]

    def put(self, value: tuple | None, *key) -> None:
        self.known[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue(key, self.known[key])
            elif not self.empty and self.state.containsKey(key):
                self.state.removeKey(key)


def _packed(*keys: str) -> Column:
    return F.to_json(F.struct(*keys))


def _unpacked(column: str, keys: StructType) -> list[Column]:
    return [F.from_json(column, keys)[k].alias(k) for k in keys.names]


def _typed(keys: DataFrame, columns: str) -> StructType:
    return StructType(keys.schema.fields + StructType.fromDDL(columns).fields)


# ---- navigations -------------------------------------------------------------------------

# A page passes through the state as JSON, so the state does not depend on its type.
NAVIGATION = "page STRING, what STRING, event_id BIGINT, loader STRING, done_event_id BIGINT, done_loader STRING"
NAVIGATION_COLUMNS = [c.split()[0] for c in NAVIGATION.split(", ")]
BEGINS = {"navigate": "navigation", "wait": "wait"}
BEGUN = "STRUCT<event_id: BIGINT, loader: STRING, start: STRING>"
NO_PAGE = (None, 0, None, None)


class Navigations(StatefulProcessor):
    """State of a group of pages: per page its current loader, the open navigation and the open wait, and which loaders have reached the event.

    A navigation or wait comes out when it is done, when a newer one takes its place, or open when the page has been silent for ``ttl_ms``.
    """

    def __init__(self, event: str, ttl_ms: int) -> None:
        self.event, self.ttl_ms = event, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.silence = Silence(handle, self.ttl_ms)
        self.pages = handle.getMapState("pages", "page STRING", f"loader STRING, last_ms BIGINT, navigation {BEGUN}, wait {BEGUN}")
        self.reached = handle.getMapState("reached", "page STRING, loader STRING", "yes BOOLEAN")

    def _ends(self, what: str, begun: tuple, page: str, kind: str, name: str, seen: str, current: str | None, reached: _Entries) -> bool:
        _, loader, start = begun
        hit = kind == "lifecycle" and name == self.event and seen is not None
        early = kind == "commit" and seen is not None and seen != start and reached.get(page, seen) is not None
        if what == "wait":
            return kind == "same_document" or (hit and seen == current and seen != start) or early
        newer = current is not None and current != start and loader is not None and current != loader
        return (hit and seen == loader) or (hit and newer and seen == current) or (early and loader is not None and seen != loader)

    @staticmethod
    def _open(page: str, state: tuple) -> list[tuple]:
        return [(page, what, *begun[:2], None, None) for what, begun in zip(BEGINS.values(), state[2:]) if begun is not None]

    def _forget(self, pages) -> None:
        for key in [k for k in self.reached.keys() if k[0] in pages] if pages else ():
            self.reached.removeKey(tuple(key))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "page", "kind", "loader", "name")
        if not batch:
            return
        known, watermark = self.silence.known(), timerValues.getCurrentWatermarkInMs()
        pages, gone, out = {}, set(), []
        for now, _, page, *_ in batch:
            if page not in pages:
                stored = self.pages.getValue((page,)) if known is not None else None
                if stored is not None and self.silence.over(stored[1], min(watermark, now // 1000)):
                    out += self._open(page, stored)
                    gone.add(page)
                    stored = None
                # Rows inside a state cannot be written back as they are.
                pages[page] = tuple(tuple(v) if isinstance(v, tuple) else v for v in stored or NO_PAGE)
        self._forget(gone)
        reached = _Entries(self.reached, known is None)
        for now, event, page, kind, loader, name in batch:
            current, _, *opened = pages[page]
            begun = dict(zip(BEGINS.values(), opened))
            for what, open_ in begun.items():
                if open_ is not None and self._ends(what, open_, page, kind, name, loader, current, reached):
                    out.append((page, what, open_[0], open_[1], event, None if kind == "same_document" else loader))
                    begun[what] = None
            if kind in BEGINS:
                what = BEGINS[kind]
                if begun[what] is not None:
                    out.append((page, what, *begun[what][:2], None, None))
                begun[what] = (event, loader, current)
            elif kind == "commit":
                current = loader
            elif kind == "lifecycle" and loader is not None:
                if name == self.event:
                    reached.put((True,), page, loader)
                elif name == "init":
                    reached.put(None, page, loader)
            pages[page] = (current, now // 1000, *begun.values())
        reached.write()
        for page, state in pages.items():
            self.pages.updateValue((page,), state)
        self.silence.expect(min(state[1] for state in pages.values()), known)
        if out:
            yield as_frame(out, NAVIGATION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = self.silence.sweep(self.pages, 1, timerValues.getCurrentWatermarkInMs())
        if self.silence.known() is None:
            self.reached.clear()
        else:
            self._forget(gone)
        out = [row for page, state in gone.items() for row in self._open(page, state)]
        if out:
            yield as_frame(out, NAVIGATION_COLUMNS)

    def close(self) -> None:
        pass


def navigations(events: DataFrame, event: str, delay: str, ttl_ms: int = 86_400_000) -> DataFrame:
    """Navigations and waits of a page event stream with what ended each, as ``network.completions`` and ``network.navigation_waits`` define it.

    events: page_id, ts, event_id, kind, loader, name. -> ``page_id, what, event_id, loader, done_event_id, done_loader``; loaders as text.
    """
    keyed = events.withWatermark("ts", delay).select(
        F.expr(f"pmod(xxhash64(page_id), {GROUPS})").alias("share"), _packed("page_id").alias("page"), *event_columns(), "kind", F.col("loader").cast("string").alias("loader"), "name"
    )
    found = keyed.groupBy("share").transformWithStateInPandas(
        statefulProcessor=Navigations(event, ttl_ms), outputStructType=NAVIGATION, outputMode="Append", timeMode="EventTime"
    )
    return found.select(*_unpacked("page", events.select("page_id").schema), *NAVIGATION_COLUMNS[1:])


# ---- quiet network -----------------------------------------------------------------------

IDLE = "event_id BIGINT, from_ts TIMESTAMP"
IDLE_ROW = Row("page_id", "event_id", "from_ts")


class QuietNetwork(StatefulProcessor):
    """State of one page: its requests in flight, how many they are, and the event after which none was.

    Every event re-arms the quiet timer. When it fires the page has been idle for as long as asked; idle stretches that end within a batch are seen at their end.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "request_id STRING", "yes BOOLEAN")
        self.quiet = handle.getValueState("quiet", "in_flight BIGINT, event_id BIGINT, ts TIMESTAMP, ts_us BIGINT, timer_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = _in_order(rows)
        if not batch:
            return
        in_flight, event, ts, ts_us, timer_ms = self.quiet.get() or (0, None, None, None, None)
        pending = _Entries(self.pending)
        for r in batch:
            if event is not None and r.ts_us - ts_us >= self.idle_ms * 1000:
                yield IDLE_ROW(*key, event, ts)
            live = pending.get(r.request_id) is not None
            if r.kind == "open" and not live:
                in_flight += 1
                pending.put((True,), r.request_id)
            elif r.kind in CLOSERS and live:
                in_flight -= 1
                pending.put(None, r.request_id)
            event, ts, ts_us = (None, None, None) if in_flight else (r.event_id, r.ts, r.ts_us)
        pending.write()
        if timer_ms is not None:
            self.handle.deleteTimer(timer_ms)
        timer_ms = None if event is None else -(-(ts_us + self.idle_ms * 1000) // 1000)
        if timer_ms is not None:
            self.handle.registerTimer(timer_ms)
        self.quiet.update((in_flight, event, ts, ts_us, timer_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        in_flight, event, ts, _, _ = self.quiet.get()
        if event is not None:
            yield IDLE_ROW(*key, event, ts)
        # Nothing is in flight, so nothing else is known about the page.
        self.quiet.clear()

    def close(self) -> None:
        pass


def network_idle(events: DataFrame, idle_ms: int, delay: str) -> DataFrame:
    """``page_id, event_id, from_ts`` of every stretch of ``idle_ms`` without a request in flight, as ``network.idle_gaps`` finds them.

    events: page_id, ts, event_id, kind, request_id. A stretch comes out as soon as it is long enough, not when it ends; one that never ends comes out too.
    """
    network = events.where(F.col("request_id").isNotNull() & F.col("kind").isin("open", *CLOSERS) | F.col("event_id").isNull())
    keyed = network.withWatermark("ts", delay).select("page_id", "ts", F.unix_micros("ts").alias("ts_us"), "event_id", "kind", "request_id")
    return keyed.groupBy("page_id").transformWithState(
        statefulProcessor=QuietNetwork(idle_ms), outputStructType=_typed(events.select("page_id"), IDLE), outputMode="Append", timeMode="EventTime"
    )


# ---- named clocks ------------------------------------------------------------------------

STEP = "of STRING, what STRING, event_id BIGINT, exhausted BOOLEAN, remaining_ms BIGINT, error STRING, clock_event_id BIGINT"
STEP_COLUMNS = [c.split()[0] for c in STEP.split(", ")]


class StepClock(StatefulProcessor):
    """Named clocks of a group of pages: which event started each last, and when it runs out.

    A step that names a clock comes out with the rest of its time; the clock itself comes out when it runs out before it is started again. It stays then, for
    steps to come are bound by it still, but apart from those that run: a group has one timer, at the earliest of these, and looks through them alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getMapState("running", "of STRING", "event_id BIGINT, deadline_ms BIGINT")
        self.told = handle.getMapState("told", "of STRING", "event_id BIGINT, deadline_ms BIGINT")
        self.due = handle.getValueState("due", "ms BIGINT, running BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(rows, "of", "clock", "starts", "limit_ms", "timeout_ms")
        if not batch:
            return
        due = self.due.get()
        running, told = _Entries(self.running, due is None or not due[1]), _Entries(self.told, due is None)
        out = []
        for now_us, event, of, name, starts, limit_ms, timeout_ms in batch:
            now, timeout_ms = now_us // 1000, None if timeout_ms is None else int(timeout_ms)
            exhausted, remaining, error = False, timeout_ms, None
            live = running.get(of)
            clock = live or told.get(of)
            if clock is not None:
                rest = clock[1] - now
                exhausted = rest <= 0
                remaining = None if exhausted else rest if timeout_ms is None else min(rest, timeout_ms)
            elif not starts:
                remaining, error = None, f"clock {name} was never started"
            out.append((of, "step", event, exhausted, remaining, error, None if clock is None else clock[0]))
            if starts:
                if live is not None and live[1] <= now:
                    out.append((of, "expired", live[0], True, None, None, live[0]))
                running.put((event, now + int(limit_ms)), of)
                if live is None and clock is not None:
                    told.put(None, of)
        running.write()
        told.write()
        if running.changed:
            first = min(running.known[k][1] for k in running.changed)
            before = due[0] if due is not None and due[1] else None
            if before is None or first < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(first)
                self.due.update((first, True))
        yield as_frame(out, STEP_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, first = timerValues.getCurrentWatermarkInMs(), [], None
        for (of,), (event, deadline) in self.running.iterator():
            if deadline <= now:
                out.append((of, event, deadline))
            elif first is None or deadline < first:
                first = deadline
        if first is None:
            self.running.clear()
        for of, event, deadline in out:
            if first is not None:
                self.running.removeKey((of,))
            self.told.updateValue((of,), (event, deadline))
        if first is not None:
            self.handle.registerTimer(first)
        self.due.update((first, first is not None))
        if out:
            yield as_frame([(of, "expired", event, True, None, None, event) for of, event, _ in out], STEP_COLUMNS)

    def close(self) -> None:
        pass


def step_clocks(events: DataFrame, started: Column, limit_ms: Column, timeout_ms: Column, clock: Column, delay: str) -> DataFrame:
    """Remaining time of each step under the clock it names, as ``runs.deadlines`` computes it, and clocks that ran out.

    events: page_id, ts, event_id. -> ``page_id, clock, what, event_id, exhausted, remaining_ms, error, clock_event_id`` with ``what`` step or expired.
    State is dealt by page and clock, as clocks do not know of each other: a busy page spreads over tasks. Steps that name no clock need no
    state and pass by it.
    """
    timed = events.withWatermark("ts", delay).withColumns({"clock": clock, "starts": started, "limit_ms": limit_ms.cast("bigint"), "timeout_ms": timeout_ms.cast("bigint")})
    named = timed.where("clock is not null or event_id is null").select(
        F.expr(f"pmod(xxhash64(page_id, clock), {GROUPS})").alias("share"), _packed("page_id", "clock").alias("of"), *event_columns(), "clock", "starts",
        F.col("limit_ms").cast("string").alias("limit_ms"), F.col("timeout_ms").cast("string").alias("timeout_ms"),
    )
    bound = named.groupBy("share").transformWithStateInPandas(
        statefulProcessor=StepClock(), outputStructType=STEP, outputMode="Append", timeMode="EventTime"
    ).select(*_unpacked("of", timed.select("page_id", "clock").schema), *STEP_COLUMNS[1:])
    free = timed.where("clock is null and event_id is not null").select(
        "page_id", "clock", F.lit("step").alias("what"), "event_id", F.lit(False).alias("exhausted"), F.col("timeout_ms").alias("remaining_ms"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("bigint").alias("clock_event_id"),
    )
    return bound.unionByName(free)
