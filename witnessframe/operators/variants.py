"""Nested JSON parameters as dotted path rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def flatten_params(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row (keys, path, value) per scalar leaf of the JSON column ``text``.

    Object members join with ``.``, list items are ``.member.N`` from 1, nulls are
    dropped. Documents may nest to any depth: each round opens one level of what is still nested
    and stores the rest, so the input is read once and a round holds only deeper parts.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    found = None
    while True:
        kind = F.schema_of_variant("v")
        level = durable(level.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY")).where("v is not null"))
        leaves = level.where(~F.col("nested") & ~F.is_variant_null("v")).select(*keys, "path", F.variant_get("v", "$", "string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = level.where("nested").drop("nested").withColumnRenamed("v", "outer_v")
        if inner.isEmpty():
            return found
        child = F.when(F.col("key").isNotNull(), F.concat_ws(".", F.nullif(F.col("path"), F.lit("")), F.col("key"))).otherwise(
            F.concat(F.col("path"), F.lit(".member."), (F.col("pos") + 1).cast("string"))
        )
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer_v").outer()))
        level = opened.select(*keys, child.alias("path"), F.col("value").alias("v"))
