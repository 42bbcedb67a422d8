"""Ordered passes with counted cuts: sizes of chunks, plans, null keys, and what is computed through them."""

import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from witnessframe.operators import network as N
from witnessframe.operators import runs as R
from witnessframe.plans import ordered
from witnessframe.plans.ordered import cuts, order_statistics, running
from witnessframe.plans.skew import join_unique

VALUES = {
    "sums": {"s": "v"}, "totals": {"t": "v"}, "least": {"lo": "w"}, "most": {"hi": "w"}, "max_before": {"m": "w"}, "previous": {"p": "w"}, "following": {"f": "w"},
}


@pytest.fixture(scope="module")
def busy(spark):
    """60 % of one day's events are of one page; one key is null; the order has ties in its first column."""
    rng = random.Random(11)
    data = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        data.append((key, rng.randrange(2000), i, rng.randrange(-3, 4), None if rng.random() < 0.3 else rng.randrange(9)))
    return spark.createDataFrame(data, "k string, at bigint, id bigint, v int, w int").repartition(7)


def both(df, target):
    given = {kind: {n: F.col(c) for n, c in named.items()} for kind, named in VALUES.items()}
    mine = running(df, ["k"], ["at", "id"], cuts(df, ["k"], ["at", "id"], target), **given)
    whole = Window.partitionBy("k")
    by = whole.orderBy("at", "id")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "*", F.sum("v").over(upto).alias("s"), F.sum("v").over(whole).alias("t"), F.min("w").over(whole).alias("lo"), F.max("w").over(whole).alias("hi"),
        F.max("w").over(before).alias("m"), F.lag("w").over(by).alias("p"), F.lead("w").over(by).alias("f"),
    )
    return mine, plain


@pytest.mark.parametrize("target", [60, 500, 1_000_000])
def test_counted_cuts_equal_plain_windows(busy, target):
    mine, plain = both(busy, target)
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))
    assert mine.where("k is null").count() == busy.where("k is null").count() > 0


def test_no_chunk_exceeds_the_target(busy):
    found = cuts(busy, ["k"], ["at", "id"], 300)
    sizes = found.marked(busy).groupBy("k", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 300
    chunks = [r for r in sizes if r.k == "hot"]
    assert len(chunks) > 12
    spans = {r._chunk: (r.lo, r.hi) for r in found.marked(busy).where("k = 'hot'").groupBy("_chunk").agg(F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi")).collect()}
    ordered_spans = [spans[c] for c in sorted(spans, key=int)]
    assert all(tuple(a[1]) < tuple(b[0]) for a, b in zip(ordered_spans, ordered_spans[1:]))


def test_many_cuts_in_groups(busy, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP", 3)
    mine, plain = both(busy, 60)
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_ties_cannot_be_parted(spark):
    df = spark.createDataFrame([("k", 1, i) for i in range(500)], "k string, at int, v int")
    out = running(df, ["k"], ["at"], cuts(df, ["k"], ["at"], 10), totals={"t": F.lit(1)})
    assert out.where("t = 500").count() == 500


def test_one_scan_and_one_exchange_of_rows(spark, busy, tmp_path):
    busy.withColumn("j", F.parse_json(F.lit('{"a": 1}'))).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for target, most in ((300, 3), (10**9, 1)):
        out = running(df, ["k"], ["at", "id"], cuts(df, ["k"], ["at", "id"], target), sums={"s": F.col("v")}, previous={"p": F.col("w")})
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1, plan
        # Rows meet once; the second exchange is of one row a chunk, the third its broadcast or sorted form.
        shuffles = [line for line in plan.splitlines() if "+- Exchange " in line]
        assert len([x for x in shuffles if "_chunk" in x and "_key" in x and "REPARTITION" in x]) == (1 if target == 300 else 0), plan
        assert len(shuffles) <= most, plan
        assert ("ReusedExchange" in plan) == (target == 300), plan


def test_network_over_a_busy_page(spark):
    """The same results whether the busy page is cut or not, null pages included."""
    rng = random.Random(3)
    kinds = ["open", "open", "response", "finished", "failed", "commit", "navigate", "wait", "lifecycle", "same_document", "render"]
    data = []
    for i in range(3000):
        page = "busy" if rng.random() < 0.6 else rng.choice(["p", "q", None])
        kind = rng.choice(kinds)
        loader = rng.choice(["l1", "l2", "l3", None]) if kind in ("commit", "navigate", "wait", "lifecycle") else None
        data.append((page, rng.randrange(400), i, kind, f"r{rng.randrange(40)}", "https://x/", rng.random() < 0.5, 200, loader, rng.choice(["load", "init"])))
    schema = "page_id string, s bigint, event_id bigint, kind string, request_id string, url string, redirect boolean, status int, loader string, name string"
    events = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("s"))
    cut, whole = cuts(events, ["page_id"], N.ORDER, 100), cuts(events, ["page_id"], N.ORDER, 10**9)
    assert cut.bounds is not None and whole.bounds is None
    computed = {
        "legs": lambda c: N.legs(events, c), "trace": lambda c: N.bounded_trace(N.legs(events, c), 20, c)[0], "flight": lambda c: N.in_flight(events, c),
        "gaps": lambda c: N.idle_gaps(events, 2000, c), "stale": lambda c: N.stale_gaps(events, 3000, c), "phases": lambda c: N.phase_durations(events, c),
        "commits": lambda c: N.since_commit(events, c), "islands": lambda c: N.islands(events, ["page_id"], N.ORDER, "kind", c),
        "done": lambda c: N.completions(events, "load", c), "waits": lambda c: N.navigation_waits(events, "load", c),
    }
    for name, of in computed.items():
        mine, plain = sorted(map(str, of(cut).collect())), sorted(map(str, of(whole).collect()))
        assert mine == plain and mine, name
    assert N.phase_durations(events).count() == events.count()
    assert N.completions(events, "load").where("page_id is null").count() == events.where("page_id is null and kind = 'navigate'").count() > 0


def test_means_of_any_size(spark):
    cases = {
        "tiny": [1e-12, 3e-12], "huge": [3e15, 5e15], "both": [1e-12, 3e15, -3e15, 7.25], "most": [1e308, 1e308, -1e308], "least": [5e-324, 1.5e-323],
        "whole": [0.1] * 10, "zero": [0.0, -0.0], "one": [-2.5], "cancel": [1e16, 1.0, -1e16], "odd": [1.0, math.inf], "none": [1.0, math.nan],
    }
    df = spark.createDataFrame([(k, v) for k, values in cases.items() for v in values], "k string, v double")
    found = {r.k: r.mean_value for r in order_statistics(df, ["k"], "v").collect()}
    for name, values in cases.items():
        if name in ("odd", "none"):
            assert repr(found[name]) == repr(sum(values))
        else:
            assert found[name] == pytest.approx(float(statistics.mean(map(__import__("fractions").Fraction, values))), rel=3e-16, abs=0), name


def test_null_keys_stay(spark):
    left = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for salt in (1, 100):
        out = join_unique(left, right, ["k"], "n", ["v"], rows_per_salt=salt)
        assert sorted((r.v, r.n) for r in out.collect()) == [(1, 2), (2, 2), (3, 1)]
    steps = "run_id string, idx int, id string, op string, optional boolean, if_ok string, if_failed string, if_html_incomplete string, raw_ok boolean, started boolean, html_complete boolean, timeout_ms int"
    rows = [(run, 0, "s", "goto", False, None, None, None, True, False, False, 5) for run in ("a", None)] + [(None, 1, "t", "bad", False, "s", None, None, True, False, False, 5)]
    df = spark.createDataFrame(rows, steps)
    assert {r.run_id: len(r.results) for r in R.run_outcomes(df).collect()} == {"a": 1, None: 2}
    checked = R.step_errors(df, ["goto"])
    assert checked.count() == 3
    valid, rejects = R.split_rejects(checked)
    assert [r.run_id for r in valid.collect()] == ["a"] and [r.run_id for r in rejects.collect()] == [None]
