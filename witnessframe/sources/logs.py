"""Tagged log lines and profiler traces as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_duration

SEPARATOR = "-----------+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def tagged(lines: DataFrame, tag: str, schema: str) -> DataFrame:
    """Lines ``TAG {json}`` of one tag with the JSON members as columns."""
    body = F.regexp_extract("line", f"^{tag} (\\{{.*)$", 1)
    found = lines.where(F.startswith("line", F.lit(f"{tag} {{")))
    rest = [c for c in lines.columns if c != "line"]
    return found.select(*rest, F.from_json(body, schema).alias("j")).select(*rest, "j.*")


def phases(lines: DataFrame) -> DataFrame:
    """Lines ``[phase] name +Nms detail``."""
    pattern = "^\\[phase\\] (\\S+) \\+([0-9]+)ms(?: (.*))?$"
    rest = [c for c in lines.columns if c != "line"]
    return lines.where(F.col("line").rlike(pattern)).select(
        *rest, F.regexp_extract("line", pattern, 1).alias("phase"), F.regexp_extract("line", pattern, 2).cast("bigint").alias("ms"),
        F.regexp_extract("line", pattern, 3).alias("detail"),
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One record per sample: the files are split at their separator lines."""
    return stacks(spark.read.option("lineSep", SEPARATOR).text(path))


def stacks(records: DataFrame, column: str = "value") -> DataFrame:
    """(frames_leaf_first, ms) of trace records; a record without a timed first frame is a header."""
    lines = F.filter(F.transform(F.split(column, "\n"), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: (s != "") & ~s.rlike("^-+$"))
    first = "^([0-9][0-9.]*(?:ms|us|s))\\s+(\\S.*)$"
    rest = [c for c in records.columns if c != column]
    found = records.select(*rest, lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", lambda s: s.rlike(first)), F.lit(True)))
    head = F.get("lines", (F.col("at") - 1).cast("int"))
    timed = found.where("at > 0").select(
        *rest, parse_duration(F.regexp_extract(head, first, 1)).alias("ms"),
        F.concat(F.array(F.regexp_extract(head, first, 2)), F.slice("lines", (F.col("at") + 1).cast("int"), F.size("lines"))).alias("frames_leaf_first"),
    )
    return timed.where("ms is not null")
