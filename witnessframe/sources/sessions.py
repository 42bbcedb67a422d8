"""Benchmark session files: one multi-line JSON document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_SCHEMA = (
    "fixture STRING, pairs INT, reference STRING, sample_statistic STRING, headline_statistic STRING, "
    "absolute_ms MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>, "
    "correctness MAP<STRING, STRUCT<pixels: BIGINT, differing: BIGINT, pct: DOUBLE, maxAbsDelta: INT>>"
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(SESSION_SCHEMA).json(path)
    return files.withColumn("session", F.regexp_extract(F.input_file_name(), "([^/]+?)(?:[.][A-Za-z]+)?$", 1))


def samples(sessions: DataFrame) -> DataFrame:
    """(fixture, session, spec, phase, pair, ms), one row per timing."""
    by_spec = sessions.select("fixture", "session", F.explode("absolute_ms").alias("spec", "phases"))
    by_phase = by_spec.select("fixture", "session", "spec", F.explode("phases").alias("phase", "values"))
    return by_phase.select("fixture", "session", "spec", "phase", F.posexplode("values").alias("pair", "ms"))


def differences(sessions: DataFrame) -> DataFrame:
    each = sessions.select("fixture", F.explode("correctness").alias("spec", "c"))
    return each.select("fixture", "spec", "c.pixels", "c.differing", F.col("c.maxAbsDelta").alias("max_delta"))
