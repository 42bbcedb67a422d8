"""Driver tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import prepare


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One table; ``spread`` deals a scan with fewer splits than cores over all cores.

    Text work costs far more than moving its input once; a scan that already has enough
    splits is left alone.
    """
    prepare(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
            return df.repartition(cores)
    return df
