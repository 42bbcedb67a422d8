"""Run-result documents: one JSON envelope per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id BIGINT, ok BOOLEAN, final_url STRING, "
    "steps ARRAY<STRUCT<id: STRING, op: STRING, ok: BOOLEAN, skipped: BOOLEAN, error: STRING, value: STRING, elapsed_ms: BIGINT>>, "
    "console_errors ARRAY<STRING>, failed_requests ARRAY<STRUCT<url: STRING, error: STRING>>, "
    "http_errors ARRAY<STRUCT<url: STRING, status: INT>>, timings STRUCT<total_ms: BIGINT>"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def parse_runs(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(F.from_json(column, RUN_SCHEMA).alias("r")).select("r.*")


def runs(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_id", "ok", "final_url", F.col("timings.total_ms").alias("total_ms"))


def steps(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_id", F.posexplode_outer("steps").alias("idx", "s")).select("run_id", "idx", "s.*")


def console_errors(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_id", F.posexplode("console_errors").alias("at", "text"))


def failed_requests(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_id", F.posexplode("failed_requests").alias("at", "r")).select("run_id", "at", "r.*")


def http_errors(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_id", F.posexplode("http_errors").alias("at", "r")).select("run_id", "at", "r.*")
