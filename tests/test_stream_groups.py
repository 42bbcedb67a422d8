"""Stream state dealt over groups: what a group costs, and that its keys do not mix."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from witnessframe.streaming import lifecycle, outcomes, pages
from witnessframe.streaming.run import STATE_STORE, closable, run_to_end

DAY = datetime.datetime(2024, 1, 1)


class Calls:
    """A state handle in memory that counts its calls, as each goes to the state store and back."""

    def __init__(self):
        self.count, self.timers, self.states = 0, set(), {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Map(self))

    getValueState = getMapState

    def registerTimer(self, ms):
        self.count += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.count += 1
        self.timers.remove(ms)


class Map:
    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def _called(self, result=None):
        self.calls.count += 1
        return result

    def exists(self):
        return self._called(bool(self.rows))

    def getValue(self, key):
        return self._called(self.rows.get(key))

    def get(self):
        return self.getValue(())

    def containsKey(self, key):
        return self._called(key in self.rows)

    def updateValue(self, key, value):
        self._called(self.rows.update({key: value}))

    def update(self, value):
        self.updateValue((), value)

    def removeKey(self, key):
        self._called(self.rows.pop(key))

    def clear(self):
        self._called(self.rows.clear())

    def iterator(self):
        return iter(self._called(list(self.rows.items())))

    def keys(self):
        return iter(self._called(list(self.rows)))


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fed(processor, key, rows, columns, watermark=0):
    frame = pd.DataFrame([(r[0] * 1000, *r[1:]) for r in rows], columns=["ts_us", "event_id", *columns], dtype=object)
    frame["is_event"] = True
    return [tuple(r) for out in processor.handleInputRows(key, iter([frame]), Watermark(watermark)) for r in out.itertuples(index=False)]


def streamed(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return closable(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def test_outcomes_of_a_group_share_their_calls():
    handle, processor = Calls(), outcomes.OutcomeAttempts()
    processor.init(handle)
    rows = [(n, n, f"u{n}", n % outcomes.SLOTS, False, "d", None) for n in range(2000)]
    columns = ["outcome_key", "slot", "late", "digest", "refused"]
    for attempt in (1, 2, 3, 4):
        out = fed(processor, (10, 0), rows, columns)
        assert {r[2] for r in out} == {attempt} and len(out) == 2000
    assert {r[3] for r in out} == {"attempt 4 of 3"}
    # One call an outcome and batch would be 8,000.
    assert handle.count <= 4 * (2 * outcomes.SLOTS + 2) and handle.timers == {11 * outcomes.HOUR_MS}


def test_outcomes_across_batches(spark, tmp_path):
    big = 2**60 + 1  # an id that a double does not hold
    at = lambda minute: DAY + datetime.timedelta(minutes=minute)
    batches = [
        [("a", at(1), big, "x", None, at(60)), ("b", at(2), 2, None, 500, at(90)), ("c", at(3), 3, "x", 200, at(4))],
        [("a", at(20), 4, "x", 200, at(60)), ("a", at(21), 5, "y", 200, at(60)), ("c", at(22), 6, "x", 200, at(4))],
        [("a", at(30), 7, "x", 200, at(60)), ("b", at(90), 8, "", 200, at(90)), ("b", at(89), 9, "", 204, at(90))],
    ]
    stream, close = streamed(spark, str(tmp_path / "in"), "outcome_key string, ts timestamp, event_id long, body string, status int, deadline timestamp", batches)
    out = run_to_end(outcomes.judged_attempts(stream, "1 hour"), "attempts", close)
    late = "sent after the deadline"
    assert sorted(map(tuple, out.select("event_id", "outcome_key", "attempt", "reason").collect())) == [
        (2, "b", 1, "answered 500"), (3, "c", 1, None), (4, "a", 2, None), (5, "a", 3, "other bytes than first sent"), (6, "c", None, late),
        (7, "a", 4, "attempt 4 of 3"), (8, "b", None, late), (9, "b", 2, None), (big, "a", 1, None),
    ]
    assert out.where(F.col("event_id").isNull()).count() == 0


REQUEST = ["request", "kind", "url", "traced", "redirect", "told", "ended"]


def said(ms, event_id, request, kind="open"):
    return (ms, event_id, request, kind, "http://a/", True, False, None, None)


def test_requests_of_a_group_share_a_timer():
    handle, processor = Calls(), lifecycle.LegTracker(6400)
    processor.init(handle)
    assert fed(processor, (0,), [said(1000 + n, n, f"r{n}") for n in range(100)], REQUEST) == []
    # A write each, the time the group is due read and written, one timer.
    assert handle.count <= 100 + 3 and handle.timers == {7400}
    # Late by an earlier request, the group wakes earlier.
    assert fed(processor, (0,), [said(10, 200, "early")], REQUEST) == [] and handle.timers == {6500}
    handle.timers.clear()
    out = [tuple(r) for f in processor.handleExpiredTimer((0,), Watermark(7409), None) for r in f.itertuples(index=False)]
    assert sorted(r[3] for r in out) == [*range(10), 200] and {r[5] for r in out} == {"pending"}
    assert handle.timers == {7500} and len(handle.states["legs"].rows) == 90
    # Over by the watermark and by its own next event, though the group was not swept yet: it starts anew.
    out = fed(processor, (0,), [said(9000, 300, "r10"), said(7410, 301, "r11", "finished")], REQUEST, watermark=7411)
    assert sorted((r[0], r[1], r[3], r[5], r[6]) for r in out) == [("r10", 1, 10, "pending", None), ("r11", 1, 11, "finished", 301)]
    # Not over: the watermark has not passed it.
    assert fed(processor, (0,), [said(9000, 302, "r12", "finished")], REQUEST, watermark=7411)[0][5] == "finished"
    handle.timers.clear()
    list(processor.handleExpiredTimer((0,), Watermark(10**6), None))
    assert not handle.timers and not any(s.rows for s in handle.states.values())


def test_legs_without_page_or_request(spark, tmp_path):
    big = 2**60 + 1
    at = lambda minute: DAY + datetime.timedelta(minutes=minute)
    schema = "page_id long, request_id string, ts timestamp, event_id long, kind string, url string, redirect boolean, status int"
    batches = [
        [(None, "r", at(0), big, "open", "http://a/", False, None), (1, None, at(1), 2, "open", "http://a/", False, None), (1, "", at(2), 3, "open", "http://a/", False, None)],
        [(None, "r", at(3), 4, "response", None, None, 200), (1, None, at(4), 5, "finished", None, None, None), (None, None, at(5), 6, "failed", None, None, None)],
    ]
    stream, close = streamed(spark, str(tmp_path / "in"), schema, batches)
    out = run_to_end(lifecycle.track_legs(stream, "1 hour"), "legs", close)
    rows = out.select("event_id", "page_id", "request_id", "state", "end_event_id", "status", "ts").collect()
    assert sorted(map(tuple, rows)) == [
        (2, 1, None, "finished", 5, None, at(1)), (3, 1, "", "pending", None, None, at(2)), (6, None, None, "orphan", None, None, at(5)), (big, None, "r", "pending", None, 200, at(0)),
    ]


def expired(processor, watermark):
    return [tuple(r) for f in processor.handleExpiredTimer((0,), Watermark(watermark), None) for r in f.itertuples(index=False)]


def test_clocks_of_a_group_share_a_timer():
    handle, processor = Calls(), pages.StepClock()
    processor.init(handle)
    columns = ["of", "clock", "starts", "limit_ms", "timeout_ms"]
    out = fed(processor, (0,), [(n, n, f"c{n}", "c", True, "1000", None) for n in range(100)], columns)
    # A write each, the time the group is due read and written, one timer.
    assert len(out) == 100 and handle.count <= 100 + 3 and handle.timers == {1000}
    handle.timers.clear()
    assert sorted(r[2] for r in expired(processor, 1009)) == list(range(10)) and handle.timers == {1010}
    # One that has run out binds a step still and is not told again when started; one that runs out by its next start is told then.
    out = fed(processor, (0,), [(1010, 200, "c0", "c", False, None, "7"), (1011, 201, "c0", "c", True, "50", None), (1200, 202, "c99", "c", True, "5", "3"), (1201, 203, "c99", "c", False, None, "9"),
                                (1201, 204, "no", "never", False, None, "9")], columns)
    assert out == [
        ("c0", "step", 200, True, None, None, 0), ("c0", "step", 201, True, None, None, 0), ("c99", "step", 202, True, None, None, 99), ("c99", "expired", 99, True, None, None, 99),
        ("c99", "step", 203, False, 4, None, 202), ("no", "step", 204, False, None, "clock never was never started", None),
    ]
    handle.timers.clear()
    # Clock 10 to 98, and those started anew; none twice.
    assert sorted(r[2] for r in expired(processor, 10**6)) == [*range(10, 99), 201, 202] and not handle.timers
    handle.count = 0
    assert expired(processor, 10**6 + 1) == [] and handle.count <= 3


def test_pages_of_a_group_share_a_timer():
    handle, processor = Calls(), pages.Navigations("load", 6400)
    processor.init(handle)
    columns = ["page", "kind", "loader", "name"]
    assert fed(processor, (0,), [(1000 + n, n, f"p{n}", "navigate", "L", None) for n in range(100)], columns) == []
    assert handle.count <= 100 + 3 and handle.timers == {7400}
    # Each page has loaders of its own.
    assert fed(processor, (0,), [(1200, 200, "p1", "lifecycle", "M", "load"), (1201, 201, "p2", "commit", "M", None)], columns) == []
    assert fed(processor, (0,), [(1202, 202, "p1", "commit", "M", None), (1203, 203, "p3", "lifecycle", "L", "load")], columns) == [
        ("p1", "navigation", 1, "L", 202, "M"), ("p3", "navigation", 3, "L", 203, "L"),
    ]
    handle.timers.clear()
    out = expired(processor, 7409)
    # Pages 1, 2 and 3 have spoken since.
    assert sorted(r[2] for r in out) == [0, 4, 5, 6, 7, 8, 9] and all(r[4] is None for r in out) and handle.timers == {7500}
    # Page 1 is over by the watermark and by its next event, though the group was not swept yet: what it had reached is forgotten.
    out = fed(processor, (0,), [(7700, 300, "p1", "navigate", "N", None), (7701, 301, "p1", "commit", "M", None), (7702, 302, "p2", "same_document", None, None)], columns, watermark=7650)
    assert out == [("p2", "navigation", 2, "L", None, None)]
    assert [k for k in handle.states["reached"].rows] == [("p3", "L")]
    handle.timers.clear()
    assert {r[2] for r in expired(processor, 10**6)} == {300, *range(10, 100)}
    assert not handle.timers and not any(s.rows for s in handle.states.values())


def test_pages_without_an_id(spark, tmp_path):
    big = 2**60 + 1
    at = lambda minute: DAY + datetime.timedelta(minutes=minute)
    schema = "page_id long, ts timestamp, event_id long, kind string, loader long, name string"
    batches = [[(None, at(0), big, "navigate", 7, None), (3, at(1), 2, "navigate", 7, None)], [(None, at(2), 3, "lifecycle", 7, "load"), (3, at(3), 4, "lifecycle", 8, "load")]]
    stream, close = streamed(spark, str(tmp_path / "in"), schema, batches)
    out = run_to_end(pages.navigations(stream, "load", "1 hour"), "pages", close)
    assert sorted(map(tuple, out.select("event_id", "page_id", "loader", "done_event_id").collect())) == [(2, 3, "7", None), (big, None, "7", 3)]
