"""XML service replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_replies(df: DataFrame, column: str, schema: str) -> DataFrame:
    """XML text as columns; repeated children become arrays, leaves strings, prefixes are dropped."""
    rest = [c for c in df.columns if c != column]
    parsed = F.from_xml(column, schema, {"ignoreNamespace": "true", "mode": "FAILFAST"})
    return df.select(*rest, parsed.alias("x")).select(*rest, "x.*")
