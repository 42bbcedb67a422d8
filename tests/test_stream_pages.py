"""What pages wait for, over several small batches, against the batch operators."""

from pyspark.sql import functions as F

from witnessframe.catalog.network import browser_events, page_events
from witnessframe.catalog.runs import clocked
from witnessframe.operators import network, runs
from witnessframe.streaming import lifecycle, pages
from witnessframe.streaming.run import STATE_STORE, closable, run_to_end

FOLDER = "/root/testdata/sf0.001"
LONG = 10**12


def streamed(spark, events, path, batches=3):
    """``events`` as a stream of files in the order of event ids."""
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // batches + 1
    for n in range(batches):
        events.where(F.col("event_id").between(low + n * step, low + (n + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return closable(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_navigations_and_waits(spark, tmp_path):
    for begin, what, batch in (("navigate", "navigation", network.completions), ("wait", "wait", network.navigation_waits)):
        events = page_events(spark, FOLDER, begin)
        stream, close = streamed(spark, events, str(tmp_path / begin))
        out = run_to_end(pages.navigations(stream, "load", "1 day", LONG), begin, close).where(F.col("what") == what)
        expected = batch(events, "load")
        assert rows(out, "page_id", "event_id", "done_event_id") == rows(expected, "page_id", "event_id", "done_event_id")
        mine = "loader" if begin == "navigate" else "done_loader"
        assert rows(out, "event_id", mine) == rows(expected, "event_id", F.col("loader").cast("string"))


def test_network_idle(spark, tmp_path):
    events = browser_events(spark, FOLDER, 3).select("page_id", "ts", "event_id", "kind", "request_id", "url")
    for idle_ms in (600_000, 14_400_000):
        stream, close = streamed(spark, events, str(tmp_path / f"idle{idle_ms}"))
        out = run_to_end(pages.network_idle(stream, idle_ms, "1 second"), "idle", close)
        assert rows(out, "page_id", "event_id", "from_ts") == rows(network.idle_gaps(events, idle_ms), "page_id", "event_id", "from_ts")


def test_step_clocks(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "page_id")
    stream, close = streamed(spark, events, str(tmp_path / "steps"))
    out = run_to_end(pages.step_clocks(stream, *clocked(), "1 day"), "steps", close)
    started, limit, timeout, name = clocked()
    expected = runs.deadlines(events, ["page_id"], ["ts", "event_id"], None, started, limit, timeout, F.unix_millis("ts"), name)
    columns = ["event_id", "exhausted", "remaining_ms", "error"]
    assert rows(out.where("what = 'step'"), *columns) == rows(expected, *columns)
    expired = {r.event_id for r in out.where("what = 'expired'").collect()}
    used = {r.clock_event_id for r in out.where("what = 'step' and exhausted").collect()}
    assert used <= expired and len(expired) == out.where("what = 'expired'").count() > 0


def test_whole_record_of_a_leg(spark, tmp_path):
    events = browser_events(spark, FOLDER, 3)
    plain = events.withColumn("timing", F.col("timing").cast("string"))
    stream, close = streamed(spark, plain, str(tmp_path / "legs"))
    out = run_to_end(lifecycle.track_legs(stream.withColumn("timing", F.try_parse_json("timing")), ttl_ms=LONG), "legs", close).where("state <> 'orphan'")
    expected = network.legs(events)
    assert set(out.columns) == set(expected.columns)
    told = [c if c != "timing" else F.to_json("timing") for c in expected.columns]
    assert rows(out, *told) == rows(expected, *told)
