"""Shards by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# The multiplier of the method's 64-bit generator; its increment is 1.
MULTIPLIER = 2862933555777941757
LOW, MID = (1 << 22) - 1, (1 << 20) - 1
CHUNKS = 1024
COPIES_AT_ONCE = 65_536


def _limbs(value: int) -> tuple[int, int, int]:
    return value & LOW, value >> 22 & LOW, value >> 44


def _step(state: Column) -> tuple[Column, Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64 in limbs of 22, 22 and 20 bits, so that no product overflows."""
    m0, m1, m2 = (F.lit(m).cast("bigint") for m in _limbs(MULTIPLIER))
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    p0 = k0 * m0 + 1
    p1 = k0 * m1 + k1 * m0 + F.shiftright(p0, 22)
    p2 = k0 * m2 + k1 * m1 + k2 * m0 + F.shiftright(p1, 22)
    return p0.bitwiseAND(F.lit(LOW)), p1.bitwiseAND(F.lit(LOW)), p2.bitwiseAND(F.lit(MID))


def jump(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key among ``shards``: the last jump target below the count.

    The targets do not depend on the count, so one more shard takes keys only into itself.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        key.bitwiseAND(F.lit(LOW)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(LOW)).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
    )

    def leap(state: Column, _: Column) -> Column:
        k0, k1, k2 = _step(state)
        top = F.shiftleft(k2, 11) + F.shiftright(k1, 11)  # the upper 31 bits
        target = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1).cast("double"))).cast("bigint")
        moved = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), state["j"].alias("b"), target.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, leap, lambda state: state["b"].cast("int"))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with a ``shard`` column (replacing one of that name); a map, nothing moves. A null doc_id counts as 0."""
    return docs.withColumn("shard", jump(F.col("doc_id"), shards))


def shard_slots(docs: DataFrame, shards: int) -> DataFrame:
    """Shard, gapless slot within it, and the shard with one more shard, per row of ``docs(doc_id, text, ...)``.

    -> ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The law is ``key``.

    Slots follow a hash chunk, then doc_id, check sum and size. Only (shard, chunk) groups are
    ordered, a 1,024th of a shard each, and the offsets of the chunks come from their counts
    (shards * 1,024 rows at most, so they are broadcast). Chunks mix in the check sum, so rows
    that share a doc_id or lack one spread; equal rows are counted before they are ordered and
    written out again after it. A null text has size 1 and check sum 0, a null doc_id the
    key 0. Extra columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    check = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    low = key.bitwiseAND(F.lit(LOW)) * F.lit(MULTIPLIER & LOW).cast("bigint") + 1
    rows = (
        docs.select("doc_id", size.alias("size"), check.alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"shard": jump(F.col("doc_id"), shards), "grown_shard": jump(F.col("doc_id"), shards + 1)})
        .withColumn("chunk", F.pmod(F.shiftright(low.bitwiseAND(F.lit(LOW)), 12) + F.col("text_crc32"), F.lit(CHUNKS)).cast("int"))
    )
    rows = durable(rows)
    sums = rows.groupBy("shard", "chunk").agg(F.sum("copies").alias("held"))
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "chunk", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "chunk"])
        .withColumn("first", F.col("offset") + F.col("before"))
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("bigint"))))
    )
    last = F.least(F.col("lot") + COPIES_AT_ONCE, F.col("copies")) - 1
    return placed.withColumn("copy", F.explode(F.sequence("lot", last))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard"
    )


def oracle(shards: int) -> str:
    """The same rows in SQL, with 128-bit arithmetic for the generator and a table-driven check sum."""
    wrap = "18446744073709551616::hugeint"

    def leaps(name: str, count: int) -> list[str]:
        chain = [f"{name}0 as (select *, -1::bigint as b, 0::bigint as j, (coalesce(doc_id, 0)::hugeint + {wrap}) % {wrap} as k from sized)"]
        target = "floor((j + 1)::double * (2147483648.0::double / ((n // 8589934592::hugeint)::bigint + 1)::double))::bigint"
        for i in range(1, count + 1):
            moved = f"case when j < {count} then j else b end as b, case when j < {count} then {target} else j end as j, case when j < {count} then n else k end as k"
            drawn = f"select *, (k * {MULTIPLIER}::hugeint + 1) % {wrap} as n from {name}{i - 1}"
            chain.append(f"{name}{i} as (select * exclude (n) replace ({moved}) from ({drawn}))")
        return chain

    chain = ",\n".join(leaps("s", shards) + leaps("g", shards + 1))
    return f"""
with tab as (
  select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))
), sized as (
  select row_number() over () as u, doc_id, coalesce(octet_length(encode(text)), 0)::bigint + 1 as size,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) as text_crc32
  from documents, tab
), {chain},
both_ as (
  select s{shards}.*, g{shards + 1}.b as grown, (((s{shards}.doc_id & {LOW}) * {MULTIPLIER & LOW} + 1) & {LOW}) >> 12 as low from s{shards} join g{shards + 1} using (u)
)
select doc_id, size, text_crc32, 'key' as law, b::int as shard,
  row_number() over (partition by b order by (low + text_crc32) % {CHUNKS}, doc_id, text_crc32, size) - 1 as slot, grown::int as grown_shard
from both_"""
