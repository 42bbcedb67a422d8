"""Mix sources to target weights: whole passes, then a subset of exactly the budget that remains."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import words
from .minhash import fresh_name

MOST_PASSES = 3
HASH_CHUNKS = 4096
SEED = 7
# The exact search covers this many words, or the longest document where that is more.
SEARCH_WORDS = 1 << 16


def shares(sources: pd.DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> pd.DataFrame:
    """Targets per source: the total by weight, none above three times its size, the excess shared again.

    ``sources(source, source_size)``; weights repeat along the sources by code point, null last.
    """
    known = sorted(sources.index, key=lambda i: (sources.at[i, "source"] is None, (sources.at[i, "source"] or "").encode("utf-32-be")))
    size = {i: int(sources.at[i, "source_size"]) for i in known}
    weight = {i: weights[n % len(weights)] for n, i in enumerate(known)}
    target: dict = {}
    budget, open_ = float(sum(size.values())), list(known)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if budget * weight[i] / total > MOST_PASSES * size[i]]
        if not over:
            target.update({i: budget * weight[i] / total for i in open_})
            break
        for i in over:
            target[i] = float(MOST_PASSES * size[i])
        budget -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return sources.assign(target=[target[i] for i in sources.index])


def fit(length: np.ndarray, held: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or as near below as can be.

    A budget above twice the search window is first spent on every length by its share of the documents, up to
    about a window. The rest is found by bounded
    knapsack: a bit set of reachable sums in which every sum remembers the item that first
    reached it, items being powers of two of the copies that are left of a length.
    """
    total = int((length * held).sum())
    if budget <= 0 or not total:
        return np.zeros(len(length), np.int64)
    if budget >= total:
        return held.copy()
    window = max(SEARCH_WORDS, int(length.max()))
    order = np.argsort(-length, kind="stable")
    taken, left = np.zeros(len(length), np.int64), budget
    if budget > 2 * window:
        taken = np.array([int(h) * budget // total for h in held.tolist()], np.int64)
        left = budget - int((taken * length).sum())
        for i in order:
            more = min(int(held[i] - taken[i]), max(0, left - window) // int(length[i]))
            taken[i] += more
            left -= more * int(length[i])
        # One document of each length, and then more of the long ones, go back into the search.
        for i in order[::-1]:
            if taken[i] and left + int(length[i]) <= 2 * window:
                taken[i] -= 1
                left += int(length[i])
        for i in order:
            back = min(int(taken[i]), max(0, window - left) // int(length[i]))
            taken[i] -= back
            left += back * int(length[i])
    items = []
    for i in order:
        free, part = min(int(held[i] - taken[i]), left // int(length[i]) if length[i] else 0), 1
        while free > 0:
            items.append((i, min(part, free)))
            free -= part
            part *= 2
    reach, full = 1, (1 << (left + 1)) - 1
    first = np.full(left + 1, -1, np.int64)
    for n, (i, copies) in enumerate(items):
        if reach >> left & 1:
            break
        new = (reach << (int(length[i]) * copies)) & full & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = n
            reach |= new
    at = reach.bit_length() - 1
    while at:
        i, copies = items[first[at]]
        taken[i] += copies
        at -= int(length[i]) * copies
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Passes and extra documents per length of one source."""
    length, held = group["size"].to_numpy(np.int64), group["held"].to_numpy(np.int64)
    source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    wanted = int(np.floor(target + 0.5))
    passes = min(MOST_PASSES, wanted // source_size) if source_size else 0
    rest = min(wanted - passes * source_size, source_size if passes < MOST_PASSES else 0)
    some = length > 0
    extra = np.zeros(len(length), np.int64)
    extra[some] = fit(length[some], held[some], rest)
    return pd.DataFrame({"source": group["source"], "size": length, "source_size": source_size, "target": target, "passes": passes, "extra": extra})


def _words(size: str, keep_text: bool = False):
    """Rows with the number of their text's words in the column ``size``."""

    def work(batches):
        for batch in batches:
            for row, stop, data, bounds in words.slices(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(row, stop - row)
                counted = pa.array(np.diff(words.split(data, bounds).first), pa.int64())
                kept = [n for n in batch.schema.names if keep_text or n != "text"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [counted], [*kept, size])

    return work


def _chance(seed: int) -> Column:
    """What orders the rows of one length: a hash of doc_id and text, so rows without doc_id spread too."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))


def _quotas(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows without their texts, how many of each source, size and chunk are taken beside the whole passes)."""
    keyed = words.small_batches(docs).select("doc_id", "source", "text", _chance(seed).alias("rank"))
    sized = keyed.mapInArrow(_words("size"), "doc_id long, source string, rank long, size long")
    sized = durable(sized.withColumn("chunk", F.pmod("rank", F.lit(HASH_CHUNKS)).cast("int")))
    counts = durable(sized.groupBy("source", "size", "chunk").agg(F.count(F.lit(1)).alias("held")))
    lengths = counts.groupBy("source", "size").agg(F.sum("held").alias("held"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("held")).alias("source_size"))
    # One row per source meets in one task: the mixture's own configuration.
    targets = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda all_: shares(all_[["source", "source_size"]].astype({"source": object})), "source string, source_size long, target double")
    of = durable(targets).withColumnRenamed("source", "of")
    plans = lengths.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plans = plans.groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, passes long, extra long")
    plans = durable(plans)
    p = plans.select(F.col("source").alias("ps"), F.col("size").alias("pl"), "source_size", "target", "passes", "extra")
    c = counts.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pl"))).drop("ps", "pl")
    earlier = Window.partitionBy("source", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("quota", F.col("extra") - F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    return sized, c.select(F.col("source").alias("cs"), F.col("size").alias("cl"), F.col("chunk").alias("cc"), "source_size", "target", "passes", "held", "quota")


def _choose(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, rank, chunk, ...)`` with what their source gets and the ``copies`` taken of each."""
    same = F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cl")) & (F.col("chunk") == F.col("cc"))
    rows = rows.join(quotas, same).drop("cs", "cl", "cc")
    border = (F.col("quota") > 0) & (F.col("quota") < F.col("held"))
    place = F.row_number().over(Window.partitionBy("source", "size", "chunk").orderBy("rank", "doc_id"))
    inside = rows.where(border).withColumn("extra", (place <= F.col("quota")).cast("bigint"))
    outside = rows.where(~border).withColumn("extra", (F.col("quota") > 0).cast("bigint"))
    return inside.unionByName(outside).withColumn("copies", F.col("passes") + F.col("extra"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    ``docs(doc_id, text, source, ...)`` -> ``doc_id, size, source, source_size, target, copies, taken``.
    Size is the number of words; targets as in ``shares``. A source is taken in whole passes
    as far as its target goes; the rest is a subset whose lengths fit the budget
    (``fit``), chosen per length by a seeded hash of doc_id and text.

    Lengths are counted before anything meets, so a source's plan reads one row per distinct
    length. The seeded choice within (source, length) goes over 4,096 hash chunks: counts
    decide which chunks are taken whole, and only rows of the one chunk at the border are ordered, so a
    source or length that holds most rows stays spread. A null or blank text has size 0 and
    is taken in each whole pass; a null source is a source of its own; rows with equal doc_id, or
    null, rank side by side and which of two equal rows is taken makes no difference. Extra
    columns are ignored. Reruns agree.
    """
    sized, quotas = _quotas(docs, seed)
    return _choose(sized, quotas).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, in the same columns.

    Every row is chosen on its own, as ``mix`` chooses it, so rows that share a doc_id or have none
    do not take more than their source's target. Texts move once, to the counts of their length; columns of any name are kept.
    """
    _, quotas = _quotas(docs, seed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    size, rank = fresh_name("_size", docs.columns), fresh_name("_rank", docs.columns)
    counted = words.small_batches(docs).withColumn(rank, _chance(seed)).mapInArrow(_words(size, keep_text=True), f"{schema}, `{rank}` long, `{size}` long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = counted.select(row.alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col(rank).alias("rank"), F.col(size).alias("size"))
    chosen = _choose(keyed.withColumn("chunk", F.pmod("rank", F.lit(HASH_CHUNKS)).cast("int")), quotas).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return chosen.select("row", copy).select("row.*")
