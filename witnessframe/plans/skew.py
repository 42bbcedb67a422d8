"""Joins whose probe side may hold most rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: Sequence[str],
    *,
    how: str = "inner",
    rows_per_salt: int = 200_000,
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key, ``weight`` = rows of that key in left).

    ``right`` is an aggregate of the left rows: it is stored once, so that finding the
    heavy keys does not compute it again. Without any it is a plain join. Otherwise the left
    rows of every key above ``rows_per_salt`` are dealt over salts by the ``spread`` columns and its right
    row is repeated once per salt; every other key joins as usual. Heavy keys are counted,
    and reach the left rows by broadcast only while they are few. Nulls are values of a key like any others.
    """
    # A struct of nulls equals another.
    right = durable(right).withColumn("_of", F.struct(*keys)).drop(*keys)
    left = left.withColumn("_of", F.struct(*keys))
    salts = F.greatest(F.ceil(F.col(weight) / rows_per_salt), F.lit(1)).cast("int")
    heavy = right.where(F.col(weight) > rows_per_salt).select("_of", salts.alias("_salts"))
    n = heavy.count()
    if not n:
        return left.join(right, "_of", how).drop("_of")
    dealt = left.join(small_side(heavy, n), "_of", "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_salts")).cast("int")
        ),
    ).drop("_salts")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    return dealt.join(repeated, ["_of", "_salt"], how).drop("_of", "_salt")


# A broadcast side is counted first and goes by shuffle beyond these sizes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """``df`` as the build side of a join: broadcast when its counted rows and bytes are
    small, else a sort-merge join (so the other side is never broadcast by mistake)."""
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("merge")
