"""Benchmark statistics: samples (fixture, session, spec, phase, pair, ms) to rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio
from ..plans.ordered import Cuts, cuts, order_statistics, ranks, running
from ..session import durable


def timed_iterations(runs: DataFrame, keys: list[str], order: list[str], ms: str, chunk: Cuts | Column | None = None, *, warmups: int = 3, box: float = 250.0) -> DataFrame:
    """Drop the first ``warmups`` iterations, then keep complete ones up to and including
    the first that ends ``box`` or more after the first kept start."""
    chunk = cuts(runs, keys, order) if chunk is None else chunk
    numbered = running(runs, keys, order, chunk, sums={"_n": F.lit(1).cast("bigint")})
    timed = running(numbered.where(F.col("_n") > warmups), keys, order, chunk, sums={"_end": F.col(ms)})
    return timed.where(F.col("_end") - F.col(ms) < box).drop("_n", "_end")


def best_observed(samples: DataFrame) -> DataFrame:
    return samples.groupBy("fixture", "spec", "phase").agg(F.min("ms").alias("best_ms"))


def paired_ratios(samples: DataFrame, reference: str) -> DataFrame:
    """Each sample against the reference's sample of the same session, pair and phase."""
    slot = ["fixture", "session", "pair", "phase"]
    base = samples.where(F.col("spec") == reference).select(*slot, F.col("ms").alias("reference_ms"))
    others = samples.where(F.col("spec") != reference)
    return others.join(base, slot).withColumn("ratio", ratio(F.col("reference_ms"), F.col("ms")))


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """Per fixture, spec and phase: order statistics of the measurable ratios and wins over 1."""
    keys = ["fixture", "spec", "phase"]
    counts = ratios.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.count("ratio").alias("measurable"), F.count_if(F.col("ratio") > 1).alias("wins")
    )
    return counts.join(order_statistics(ratios, keys, "ratio").drop("n", "upper_median_value"), keys, "left")


def gate(differences: DataFrame, most_percent: float = 1.0, most_delta: int = 1) -> DataFrame:
    """A spec is eligible when every fixture differs on few enough pixels by little enough."""
    ok = (F.col("differing") * 100.0 / F.col("pixels") <= most_percent) & (F.col("max_delta") <= most_delta)
    return differences.groupBy("spec").agg(F.bool_and(ok).alias("eligible"))


def weighted_objective(best: DataFrame, weights: Mapping[str, float], phase: str = "total") -> DataFrame:
    """Weighted sum of the best total per fixture; null where a fixture is missing."""
    terms = [F.max(F.when(F.col("fixture") == f, F.col("best_ms"))) * F.lit(w) for f, w in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return best.where(F.col("phase") == phase).groupBy("spec").agg(total.alias("weighted_ms"))


def ranking(objective: DataFrame, eligible: DataFrame) -> DataFrame:
    """Rank by weighted time; specs failing the gate are listed without a rank."""
    # One row per contestant, used several times below.
    field = durable(objective.join(eligible, "spec", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False))))
    placed = ranks(field.where("eligible and weighted_ms is not null"), ["eligible"], "weighted_ms", "place")
    left_out = field.where("not eligible or weighted_ms is null").withColumn("place", F.lit(None).cast("int"))
    return placed.select("spec", "weighted_ms", "eligible", "place").unionByName(left_out.select("spec", "weighted_ms", "eligible", "place"))


def config_matrix(samples: DataFrame) -> DataFrame:
    """Count, min, median, upper median and max per fixture, variant, configuration and phase."""
    return order_statistics(samples, ["fixture", "variant", "cfg", "phase"], "ms")


def config_totals(samples: DataFrame) -> DataFrame:
    """The matrix with subtotals; ``level`` tells which keys a row still holds."""
    return samples.rollup("fixture", "variant", "cfg", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.grouping_id().cast("bigint").alias("level")
    )


def before_after(timings: DataFrame, keys: list[str]) -> DataFrame:
    """Saved time and speed-up factor from rows tagged ``before`` and ``after``."""
    wide = timings.groupBy(*keys).agg(
        F.min(F.when(F.col("version") == "before", F.col("ms"))).alias("before_ms"),
        F.min(F.when(F.col("version") == "after", F.col("ms"))).alias("after_ms"),
    )
    return wide.where("before_ms is not null and after_ms is not null").withColumn(
        "saved_ms", F.col("before_ms") - F.col("after_ms")
    ).withColumn("factor", ratio(F.col("before_ms"), F.col("after_ms")))


def contest_field(*entries: DataFrame) -> DataFrame:
    """All specs entered for a fixture with how often; more than once is an error row."""
    every = entries[0]
    for more in entries[1:]:
        every = every.union(more)
    counted = every.groupBy("fixture", "spec").agg(F.count(F.lit(1)).alias("entered"))
    return counted.withColumn("error", F.when(F.col("entered") > 1, "contestant specs must be unique"))


def stage_shares(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each stage in its run. Stages are pre-summed, so totals join one row per run."""
    summed = stages.groupBy(*keys, "stage").agg(F.sum("ms").alias("ms"))
    whole = summed.groupBy(*keys).agg(F.sum("ms").alias("total_ms"))
    return summed.join(whole, keys).withColumn("share", F.col("ms") / F.nullif(F.col("total_ms"), F.lit(0.0)))
