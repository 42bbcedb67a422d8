"""Streams over several small files must equal the batch operators."""

from pyspark.sql import functions as F

from witnessframe.catalog.network import LEG_COLUMNS, browser_events
from witnessframe.operators import network
from witnessframe.sources.sinks import outcome_writer
from witnessframe.streaming import lifecycle
from witnessframe.streaming.run import STATE_STORE, closable, run_batches, run_to_end

FOLDER = "/root/testdata/sf0.001"


def test_legs_across_batches(spark, tmp_path):
    events = browser_events(spark, FOLDER, 3).drop("timing")
    path = str(tmp_path / "events")
    bounds = [r[0] for r in events.selectExpr("percentile_approx(event_id, array(0.3, 0.6)) as p").select(F.explode("p")).collect()]
    parts = [events.where(F.col("event_id") <= bounds[0]), events.where(F.col("event_id").between(bounds[0] + 1, bounds[1])), events.where(F.col("event_id") > bounds[1])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream, close = closable(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = run_to_end(lifecycle.track_legs(stream, ttl_ms=10**12), "legs", close)
    closed = sorted(map(tuple, out.where("state <> 'orphan'").select(*LEG_COLUMNS).collect()), key=str)
    batch = sorted(map(tuple, network.legs(events).select(*LEG_COLUMNS).collect()), key=str)
    assert closed == batch and closed
    lost = sorted(r.event_id for r in out.where("state = 'orphan'").collect())
    assert lost == sorted(r.event_id for r in network.orphans(events).collect())


def test_outcome_delivered_twice_is_stored_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("ok", '{"payload":1}'), ("failed", '{"function_error":"Unhandled"}'), ("ok", '{"payload":1}')]
    df = spark.createDataFrame(rows, "outcome_key string, body string")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    writer = outcome_writer(path, "outcome_key STRING, body STRING")
    read = lambda: sorted((r.outcome_key, r.body) for r in spark.read.parquet(path).collect())
    run_batches(stream, writer, "first")
    once = read()
    run_batches(stream, writer, "lost reply")  # the same batch again, as after a lost acknowledgement
    assert once == read() == [("failed", '{"function_error":"Unhandled"}'), ("ok", '{"payload":1}')]
    # the same keys in a later batch change nothing
    writer(df, 7)
    assert once == read()


def test_two_apps_keep_what_the_other_stored(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "outcome_key STRING, body STRING"
    rows = lambda *keys: spark.createDataFrame([(k, k.upper()) for k in keys], schema)
    one, two = outcome_writer(path, schema, "one"), outcome_writer(path, schema, "two")
    one(rows("a", "b"), 0)
    two(rows("b", "c"), 0)
    one(rows("a", "b"), 0)
    two(rows(), 1)
    assert sorted((r.outcome_key, r.app) for r in spark.read.parquet(path).collect()) == [("a", "one"), ("b", "one"), ("c", "two")]


def test_silent_request_is_given_up_and_starts_anew(spark, tmp_path):
    schema = "page_id long, request_id string, ts timestamp, event_id long, kind string, url string, redirect boolean, status int"
    minute = lambda m: __import__("datetime").datetime(2024, 1, 1, m // 60, m % 60)
    batches = [[(1, "r", minute(0), 1, "open", "http://a/", False, 0)], [(2, "x", minute(600), 2, "open", "data:x", False, 0)], [(2, "x", minute(650), 4, "open", "data:x", False, 0)], [(1, "r", minute(700), 3, "open", "http://a/", False, 0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream, close = closable(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out = run_to_end(lifecycle.track_legs(stream, "1 minute", 60 * 60_000), "ttl", close)
    assert sorted((r.event_id, r.leg, r.state) for r in out.collect()) == [(1, 1, "pending"), (3, 1, "pending")]


def test_two_writers_at_once_leave_one_row_a_key(spark, tmp_path):
    """Both find the key absent and both store it; the log says who was first, also after a replay and for a batch that never committed."""
    from witnessframe.sources import sinks

    path, schema = str(tmp_path / "out"), "outcome_key STRING, body STRING"
    rows = lambda app, *keys: spark.createDataFrame([(k, f"{k} of {app}") for k in keys], schema)
    one, two = outcome_writer(path, schema, "one"), outcome_writer(path, schema, "two")
    commit = sinks.commit
    waiting = []
    try:
        # Writer one has stored its rows but not committed when writer two comes and goes.
        sinks.commit = lambda spark, where, app, batch: waiting.append((where, app, batch))
        one(rows("one", "a", "b"), 0)
        sinks.commit = commit
        stored = sinks.stored
        sinks.stored = lambda spark, where, of: spark.createDataFrame([], of)  # two looked before one had written
        two(rows("two", "b", "c"), 0)
        sinks.stored = stored
    finally:
        sinks.commit, sinks.stored = commit, stored
    read = lambda: sorted((r.outcome_key, r.body) for r in sinks.read_store(spark, path, schema, "outcome_key").collect())
    assert spark.read.parquet(path).where("outcome_key = 'b'").count() == 2
    assert read() == [("b", "b of two"), ("c", "c of two")]
    assert commit(spark, *waiting[0]) == 1 == commit(spark, *waiting[0])
    assert read() == [("a", "a of one"), ("b", "b of two"), ("c", "c of two")]
    two(rows("two", "b", "c"), 0)
    assert read() == [("a", "a of one"), ("b", "b of two"), ("c", "c of two")]
    assert [tuple(r) for r in sinks.committed(spark, path).orderBy("place").collect()] == [("two", 0, 0), ("one", 0, 1)]
