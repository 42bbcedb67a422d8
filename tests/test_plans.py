"""Ordered, ranking and skew plans with chunks and salts small enough to matter."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from witnessframe.operators.contest import best_observed, gate, paired_ratios, ranking, ratio_summary, timed_iterations, weighted_objective
from witnessframe.plans.ordered import order_statistics, ranks, running
from witnessframe.plans.skew import join_unique


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(-3, 4), None if rng.random() < 0.3 else rng.randrange(9)) for i in range(600)]
    return spark.createDataFrame(data, "k string, at bigint, v int, w int").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_equals_plain_windows(rows, size):
    out = running(
        rows, ["k"], ["at"], F.floor(F.col("at") / size), sums={"s": F.col("v")}, totals={"t": F.col("v")}, least={"lo": F.col("w")},
        most={"hi": F.col("w")}, max_before={"m": F.col("w")}, previous={"p": F.col("w")}, following={"f": F.col("w")},
    )
    whole = Window.partitionBy("k")
    by = whole.orderBy("at")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select(
        "*", F.sum("v").over(upto).alias("s"), F.sum("v").over(whole).alias("t"), F.min("w").over(whole).alias("lo"), F.max("w").over(whole).alias("hi"),
        F.max("w").over(before).alias("m"), F.lag("w").over(by).alias("p"), F.lead("w").over(by).alias("f"),
    )
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_join_unique_salts_heavy_keys(rows):
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    salted = join_unique(rows, sizes, ["k"], "n", ["at"], rows_per_salt=20)
    assert sorted(map(str, salted.select("k", "at", "total").collect())) == sorted(map(str, rows.join(sizes, "k").select("k", "at", "total").collect()))


def test_order_statistics(spark, rows):
    values = {}
    for r in rows.collect():
        values.setdefault(r.k, []).append(r.v)
    for r in order_statistics(rows, ["k"], "v").collect():
        mine = sorted(values[r.k])
        assert (r.n, r.min_value, r.max_value) == (len(mine), mine[0], mine[-1])
        assert r.median_value == statistics.median(mine) and r.upper_median_value == mine[len(mine) // 2]
        assert r.mean_value == pytest.approx(statistics.mean(mine))
    even = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0)], "k string, v double")
    row = order_statistics(even, ["k"], "v").first()
    assert (row.median_value, row.upper_median_value) == (2.5, 3.0)


def test_ranks_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", -5.0)], "n string, v double").withColumn("g", F.lit(1))
    assert {r.n: r["rank"] for r in ranks(df, ["g"], "v").collect()} == {"d": 1, "a": 2, "b": 2, "c": 4}


def test_zero_timing_has_no_ratio(spark):
    data = [("f", 1, "ref", "total", 0, 2.0), ("f", 1, "x", "total", 0, 0.0), ("f", 1, "ref", "total", 1, 3.0), ("f", 1, "x", "total", 1, 1.5)]
    samples = spark.createDataFrame(data, "fixture string, session int, spec string, phase string, pair int, ms double")
    row = ratio_summary(paired_ratios(samples, "ref")).first()
    assert (row.pairs, row.measurable, row.wins, row.median_value) == (2, 1, 1, 2.0)


def test_time_box_keeps_the_iteration_that_crosses_it(spark):
    runs = spark.createDataFrame([("c", i, 100.0) for i in range(10)], "c string, i int, ms double")
    kept = timed_iterations(runs, ["c"], ["i"], "ms", F.floor(F.col("i") / 2))
    assert sorted(r.i for r in kept.collect()) == [3, 4, 5]


def test_published_ranking(spark):
    # Fastest complete iterations per contestant, and the gate counts.
    best = [
        ("rust", 28.4329, 54.1052), ("rust-pgo", 29.1665, 55.1846), ("go", 27.587, 69.9947), ("go-simd", 38.3208, 79.3819),
        ("wuffs", 50.2377, 74.6428), ("zig", 84.0779, 148.7379), ("nim", 90.0786, 228.21), ("pillow", 154.7484, 115.0667),
    ]
    samples = spark.createDataFrame(
        [(f, "s", s, "total", 0, ms) for s, typical, big in best for f, ms in (("typical", typical), ("big", big))],
        "fixture string, session string, spec string, phase string, pair int, ms double",
    )
    counts = [("rust", 0, 0), ("rust-pgo", 0, 0), ("go", 0, 0), ("go-simd", 0, 0), ("wuffs", 44641, 1), ("zig", 44641, 1), ("nim", 44641, 1), ("pillow", 244195, 2)]
    differences = spark.createDataFrame([(s, "typical", 15927560, d, m) for s, d, m in counts], "spec string, fixture string, pixels bigint, differing bigint, max_delta int")
    objective = weighted_objective(best_observed(samples), {"typical": 0.8, "big": 0.2})
    out = {r.spec: (r.place, round(r.weighted_ms, 2)) for r in ranking(objective, gate(differences)).collect()}
    assert out["rust"] == (1, 33.57) and out["rust-pgo"] == (2, 34.37) and out["go"] == (3, 36.07) and out["nim"] == (7, 117.70)
    assert out["pillow"] == (None, 146.81)


def test_every_heavy_key_is_salted(spark):
    """More heavy keys than any fixed number of them, all joined whole."""
    left = spark.range(30_000).select((F.col("id") % 1500).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_unique(left, right, ["k"], "n", ["id"], rows_per_salt=5)
    assert out.groupBy("k").count().where("count <> 20").isEmpty() and out.count() == 30_000


def test_mean_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    values = [(rng.choice("ab"), round(rng.random() * 1e5, 4)) for _ in range(5000)]
    means = set()
    for parts in (1, 3, 16):
        df = spark.createDataFrame(values, "k string, v double").repartition(parts)
        means.add(tuple(sorted((r.k, r.mean_value) for r in order_statistics(df, ["k"], "v").collect())))
    assert len(means) == 1
