"""Ordered computations per key that survive a key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here keys are counted first. If each fits a
task, that window is what runs. Otherwise the order of the heavy keys is cut into chunks at sampled places, all rows meet in
one exchange by (key, chunk), each chunk is scanned on its own, and one summary row per chunk, taken from the same
exchange, carries state from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import let
from ..session import durable
from .skew import join_unique, small_side

TARGET_ROWS = 1_000_000  # rows of a key that one task scans
MOST_CHUNKS = 1 << 16  # of all heavy keys; beyond, chunks get larger, so the places of the cuts stay small enough to broadcast
SAMPLES = 16  # sampled rows per chunk
GROUP = 256  # cuts per group: a row is compared with the groups' first cuts, and then within one group


@dataclass(frozen=True)
class Cuts:
    """Where the order of the heavy keys is cut; ``bounds`` is null when no key is heavy."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounds: DataFrame | None

    def marked(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_chunk``, which never falls along the order of a key; null where the key is not cut."""
        at = F.struct(*self.order)
        upto = lambda groups: F.size(F.filter(groups, lambda g: g[0] <= at))
        inside = lambda groups, n: F.size(F.filter(F.get(groups, n - 1), lambda c: c <= at))
        place = let(upto(F.col("_groups")), lambda n: F.when(n == 0, 0).otherwise((n - 1) * GROUP + inside(F.col("_groups"), n)))
        joined = df.withColumn("_of", F.struct(*self.keys)).join(F.broadcast(self.bounds), "_of", "left")
        return joined.withColumn("_chunk", F.when(F.col("_groups").isNotNull(), place)).drop("_of", "_groups")


def cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: int | None = None) -> Cuts:
    """Cut the keys of ``df`` that hold more than ``target`` rows, so that no chunk holds more.

    One pass counts rows per key. Only if there is a heavy one, a second pass takes rows by a hash of key and order, about ``SAMPLES`` per
    third of the target, and every ``SAMPLES``-th of a key in order is a cut. A chunk then holds a third of the target on average, and more than the
    target once in about 10^8 chunks; only rows of equal order cannot be parted. The choice does not depend on partitions or reruns. A
    null key is a key. Computations over the same rows, or some of them, by more keys can share the cuts.
    """
    keys, order, target = list(keys), list(order), target or TARGET_ROWS
    key = F.struct(*keys).alias("_of")
    heavy = durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target).select(key, "_n"))
    n, total = heavy.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n:
        return Cuts(tuple(keys), tuple(order), None)
    every = max(1, max(target, -(-3 * total // MOST_CHUNKS)) // (3 * SAMPLES))
    own = df.select(key, F.struct(*order).alias("_at")).join(small_side(heavy.select("_of"), n), "_of", "left_semi")
    sampled = own.where(F.pmod(F.xxhash64("_of", "_at"), F.lit(every)) == 0).groupBy("_of").agg(F.sort_array(F.collect_list("_at")).alias("_s"))
    taken = F.array_distinct(F.filter("_s", lambda _, i: i % SAMPLES == SAMPLES - 1))
    groups = F.transform(F.sequence(F.lit(1), F.size("_c"), F.lit(GROUP)), lambda i: F.slice("_c", i, GROUP))
    bounds = sampled.select("_of", taken.alias("_c")).where(F.size("_c") > 0).select("_of", groups.alias("_groups"))
    return Cuts(tuple(keys), tuple(order), durable(bounds))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | Cuts | None = None,
    *,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    least: Mapping[str, Column] | None = None,
    most: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``.

    sums        running sum up to and including the row
    totals      sum over the whole key; least, most: smallest and largest over the whole key
    max_before  largest non-null value strictly before the row
    previous    value on the row just before, following: just after

    ``chunk`` is what ``cuts`` gives for these rows; without it keys are counted here, which runs ``df`` once more. A column may be given
    instead that never decreases along ``order`` within a key: then every key is cut by it. A null key is a key of its own.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    least, most = dict(least or {}), dict(most or {})
    max_before, previous, following = dict(max_before or {}), dict(previous or {}), dict(following or {})
    keys, order = list(keys), list(order)
    if chunk is None:
        chunk = cuts(df, keys, order)

    def within(*by: str) -> tuple[dict[str, Column], dict[str, Column]]:
        """(results over whole keys, results along the order) where ``by`` parts the rows."""
        whole = Window.partitionBy(*by)
        inside = whole.orderBy(*order)
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        entire = {n: F.sum(v).over(whole) for n, v in totals.items()}
        entire |= {n: F.min(v).over(whole) for n, v in least.items()} | {n: F.max(v).over(whole) for n, v in most.items()}
        along = {n: F.sum(v).over(upto) for n, v in sums.items()} | {n: F.max(v).over(before) for n, v in max_before.items()}
        along |= {n: F.lag(F.struct(v.alias("v"))).over(inside) for n, v in previous.items()}
        along |= {n: F.lead(F.struct(v.alias("v"))).over(inside) for n, v in following.items()}
        return entire, along

    names = [*sums, *totals, *least, *most, *max_before, *previous, *following]
    neighbours = {*previous, *following}
    if isinstance(chunk, Cuts) and chunk.bounds is None:
        entire, along = within(*keys)
        found = df.select("*", *[c.alias(f"_l_{n}") for n, c in (entire | along).items()])
        return found.select(*df.columns, *[(F.col(f"_l_{n}")["v"] if n in neighbours else F.col(f"_l_{n}")).alias(n) for n in names])

    # A struct of nulls equals another, so rows without a key join as any others.
    rows = chunk.marked(df) if isinstance(chunk, Cuts) else df.withColumn("_chunk", chunk)
    rows = rows.withColumn("_key", F.struct(*keys)).repartition("_key", "_chunk")
    position = F.struct(*order)
    summary = [F.sum(v).alias(f"_{n}") for n, v in (sums | totals).items()]
    summary += [F.min(v).alias(f"_{n}") for n, v in least.items()] + [F.max(v).alias(f"_{n}") for n, v in (most | max_before).items()]
    summary += [F.max_by(F.struct(v.alias("v")), position).alias(f"_{n}") for n, v in previous.items()]
    summary += [F.min_by(F.struct(v.alias("v")), position).alias(f"_{n}") for n, v in following.items()]
    # All columns are read here too: so both uses have the same exchange, and it is made once.
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    other = [F.col(c).isNull() for c in df.columns if c not in plain]
    summary += [F.max(F.xxhash64(*plain, *other)).alias("_seen"), F.max("_chunk").alias("_cut")]
    chunks = rows.groupBy("_key", "_chunk").agg(*summary).where("_cut is not null and _seen is not null")

    whole = Window.partitionBy("_key")
    by_chunk = whole.orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    over = {n: F.sum(f"_{n}").over(earlier) for n in sums} | {n: F.max(f"_{n}").over(earlier) for n in max_before}
    over |= {n: F.sum(f"_{n}").over(whole) for n in totals} | {n: F.min(f"_{n}").over(whole) for n in least} | {n: F.max(f"_{n}").over(whole) for n in most}
    over |= {n: F.lag(f"_{n}").over(by_chunk) for n in previous} | {n: F.lead(f"_{n}").over(by_chunk) for n in following}
    carry = chunks.select("_key", "_chunk", *[c.alias(f"_c_{n}") for n, c in over.items()])
    if isinstance(chunk, Cuts):
        carry = F.broadcast(carry)  # a row for each of about MOST_CHUNKS chunks at most

    entire, along = within("_key", "_chunk")
    local = [c.alias(f"_l_{n}") for n, c in (entire | along).items()]
    joined = rows.select("*", *local).join(carry, ["_key", "_chunk"], "left")
    out = []
    for n in names:
        mine, before = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if n in sums:
            value = F.coalesce(mine + before, mine, before)
        elif n in neighbours:
            value = F.coalesce(mine, before)["v"]
        elif n in max_before:
            value = F.greatest(mine, before)
        else:  # over the whole key, which is one chunk where it is not cut
            value = F.when(F.col("_chunk").isNotNull(), before).otherwise(mine)
        out.append(value.alias(n))
    return joined.select(*df.columns, *out)


def magnitude(value: Column, steps: int = 1000) -> Column:
    """Monotone bucket of a number, so numeric orders can be chunked without statistics."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * steps)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with multiplicity, cumulative count and key total."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    return running(
        counts, keys, [value], magnitude(F.col(value)),
        sums={"cumulative": F.col("copies")}, totals={"n": F.col("copies")},
    )


def _at(rank: Column, value: str) -> Column:
    inside = (F.col("cumulative") - F.col("copies") < rank) & (rank <= F.col("cumulative"))
    return F.max(F.when(inside, F.col(value)))


# A double is a whole number of at most 62 bits times a power of two that its bucket of eight exponents shares.
BUCKET_EXPONENTS = 8
BUCKET_BITS = 53


def _shifted(value: Column, exponent: Column) -> Column:
    """``value * 2 ** exponent``, in two steps, as the power alone may be out of range."""
    half = F.floor(exponent / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _sum_of_buckets(parts: Column) -> Column:
    """Sum of (bucket, whole) in the order of buckets, largest first, with the rounding of each step kept beside it."""
    terms = F.transform(F.reverse(F.array_sort(parts)), lambda p: _shifted(p["whole"].cast("double"), p["bucket"] * BUCKET_EXPONENTS - BUCKET_BITS))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        s, total = acc["s"], acc["s"] + x
        lost = F.when(F.abs(s) >= F.abs(x), (s - total) + x).otherwise((x - total) + s)
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(terms, start, add, lambda acc: F.when(F.abs(acc["s"]) == float("inf"), acc["s"]).otherwise(acc["s"] + acc["c"]))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact count, min, max, mean, median and upper median per key.

    For the mean, values of any size are summed as whole numbers per bucket of exponents, at most 262 of them, and the buckets in a fixed order, so it
    does not depend on the order of rows and is off by the last rounding only. Equal values collapse before the ordered pass, and the pass is chunked by
    magnitude, so neither a hot key nor a hot value ends up in one task.
    """
    keys = list(keys)
    ranked = value_ranks(df.where(F.col(value).isNotNull()), keys, value)
    half = F.floor(F.col("n") / 2).cast("bigint")
    low = F.floor((F.col("n") + 1) / 2).cast("bigint")
    number = F.col(value).cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    bucket = F.when(finite & (number != 0), F.floor(F.log2(F.abs(number)) / BUCKET_EXPONENTS)).otherwise(0).cast("int")
    scaled = F.when(finite, _shifted(number, BUCKET_BITS - BUCKET_EXPONENTS * F.col("_bucket"))).otherwise(0).cast("bigint")
    copies = F.col("copies").cast("decimal(18,0)")
    parts = ranked.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(
        F.max("n").cast("bigint").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.sum(scaled.cast("decimal(19,0)") * copies).alias("_whole"), F.sum(F.when(~finite, number)).alias("_odd"),
        _at(low, value).alias("_low"), _at(half + 1, value).alias("_up"),
    )
    whole = _sum_of_buckets(F.collect_list(F.struct(F.col("_bucket").alias("bucket"), F.col("_whole").alias("whole"))))
    return parts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        (F.coalesce(F.sum("_odd"), whole) / F.max("n")).alias("mean_value"),
        ((F.max("_low") + F.max("_up")) / 2).alias("median_value"),
        F.max("_up").alias("upper_median_value"),
    )


def ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """SQL ``rank()`` of ``value`` within ``keys`` without one window over the key."""
    positions = value_ranks(df, keys, value).select(
        *keys, value, "copies", (F.col("cumulative") - F.col("copies") + 1).cast("int").alias(name)
    )
    return join_unique(df, positions, [*keys, value], "copies", df.columns).drop("copies")
