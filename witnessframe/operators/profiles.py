"""Folded stacks, call trees, flame offsets, log blocks and process trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import let
from ..plans.ordered import magnitude, running
from ..plans.skew import join_unique
from ..session import durable

# Drawing width of a flame chart and the narrowest frame drawn.
FLAME_WIDTH = 1384
NARROWEST = 0.4
ANSI_CODES = ("\x1b[91m", "\x1b[0m")


def folded(stacks: DataFrame, frames: str = "frames_leaf_first", value: str = "ms") -> DataFrame:
    """Summed value per root-first stack."""
    return stacks.groupBy(F.array_join(F.reverse(frames), ";").alias("stack")).agg(F.sum(value).alias("ms"))


def heaviest_first(folds: DataFrame) -> DataFrame:
    return folds.orderBy(F.desc("ms"), "stack")


def _prefixes(stack: str) -> Column:
    """Every prefix of a root-first stack, the whole one included."""
    return let(F.split(stack, ";"), lambda frames: F.transform(
        F.sequence(F.lit(1), F.size(frames)), lambda i: F.array_join(F.slice(frames, F.lit(1), i), ";")
    ))


def subtree_totals(folds: DataFrame) -> DataFrame:
    """Value of every stack prefix, that is of every node of the call tree."""
    return folds.select(F.explode(_prefixes("stack")).alias("node"), "ms").groupBy("node").agg(F.sum("ms").alias("ms"))


def flame_offsets(nodes: DataFrame) -> DataFrame:
    """Start and width share of every node: siblings lie side by side, larger first, ties by name.

    A node starts after all larger siblings and the equal ones named before it; adding
    that offset over its ancestors gives its start. Equal siblings are ranked apart from
    distinct values, so many siblings of one value spread over tasks too.
    """
    parts = durable(nodes).withColumn("parent", F.regexp_replace("node", ";?[^;]*$", "")).withColumn("name", F.regexp_extract("node", "([^;]*)$", 1))
    values = parts.groupBy("parent", "ms").agg(F.count(F.lit(1)).alias("_n")).withColumn("_down", -F.col("ms"))
    larger = running(values, ["parent"], ["_down"], magnitude(F.col("_down")), sums={"_upto": F.col("ms") * F.col("_n")})
    base = larger.select("parent", "ms", (F.col("_upto") - F.col("ms") * F.col("_n")).alias("_base"), "_n")
    equal = running(parts, ["parent", "ms"], ["name"], sums={"_rank": F.lit(1).cast("bigint")})
    # Nodes are distinct stack prefixes, far fewer than samples; fixed here as they are used four times below.
    placed = durable(join_unique(equal, base, ["parent", "ms"], "_n", ["name"]).select(
        "node", "ms", (F.col("_base") + F.col("ms") * (F.col("_rank") - 1)).alias("offset")
    ))
    paths = placed.select(F.col("node").alias("leaf"), F.explode(_prefixes("node")).alias("node"))
    weight = paths.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    offsets = placed.select("node", "offset").join(weight, "node")
    starts = join_unique(paths, offsets, ["node"], "_n", ["leaf"]).groupBy("leaf").agg(F.sum("offset").alias("start"))
    return placed.select("node", "ms").join(starts.withColumnRenamed("leaf", "node"), "node")


def drawn_frames(offsets: DataFrame) -> DataFrame:
    """Percent of all samples per frame; frames narrower than a fraction of a pixel are not drawn."""
    total = offsets.where(~F.col("node").contains(";")).agg(F.sum("ms")).first()[0]  # one number
    width = F.col("ms") / F.lit(total or 1) * FLAME_WIDTH
    return offsets.where(width >= NARROWEST).select("node", "ms", "start", (F.lit(100.0) * F.col("ms") / F.lit(total or 1)).alias("pct"))


def marked_block(lines: DataFrame, name: str) -> DataFrame:
    """Lines of the last block between ``==== name BEGIN`` and ``==== name END`` of each file.

    Line ends go first, then colour codes; a block without an end runs to the end of its file.
    """
    text = F.rtrim("line", F.lit("\r\n"))
    for code in ANSI_CODES:
        text = F.replace(text, F.lit(code), F.lit(""))
    clean = lines.withColumn("line", text)
    begin, end = F.col("line") == f"==== {name} BEGIN", F.col("line") == f"==== {name} END"
    last = clean.groupBy("file").agg(F.max(F.when(begin, F.col("line_no"))).alias("_begin"), F.count(F.lit(1)).alias("_n")).where("_begin is not null")
    body = join_unique(clean, last, ["file"], "_n", ["line_no"]).where("line_no > _begin").drop("_n", "_begin")
    stops = body.groupBy("file").agg(F.min(F.when(end, F.col("line_no"))).alias("_end"), F.count(F.lit(1)).alias("_n"))
    kept = join_unique(body, stops, ["file"], "_n", ["line_no"]).where(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    return kept.select("file", "line_no", "line")


def tree_totals(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``value`` summed over every node and all its descendants.

    nodes: id, parent (null at a root), value. Each round doubles how far a node's sum
    reaches, so a tree of depth d takes log2(d) rounds and no (ancestor, descendant)
    pair is ever listed. A cycle never runs out of ancestors and raises.
    """
    state = nodes.select("id", F.col("parent").alias("up"), F.col("value").alias("total"))
    for _ in range(most_rounds):
        state = durable(state)
        if state.where("up is not null").isEmpty():
            return state.select("id", "total")
        sums = state.where("up is not null").groupBy("up").agg(F.sum("total").alias("below"), F.count(F.lit(1)).alias("_n"))
        jumps = sums.select("up", "_n").join(state.select(F.col("id").alias("up"), F.col("up").alias("next")), "up")
        grown = state.join(sums.select(F.col("up").alias("id"), "below"), "id", "left")
        state = join_unique(grown, jumps, ["up"], "_n", ["id"], how="left").select(
            "id", F.col("next").alias("up"), (F.col("total") + F.coalesce("below", F.lit(0))).alias("total")
        )
    raise ValueError("parents form a cycle")


def matched_logs(shots: DataFrame, reads: DataFrame, written: DataFrame) -> DataFrame:
    """Shot lines with the read and write lines of the same object URL, if any."""
    return shots.join(reads, "url", "left").join(written, "url", "left")


def top_by(df: DataFrame, column: str, key: Column | str, k: int) -> DataFrame:
    return df.orderBy(F.desc(column), key).limit(k)
