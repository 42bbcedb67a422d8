"""Merkle manifest of a table: persistent trees in aligned blocks, a path-copied version for every changed leaf."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import small_side
from ..session import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10  # levels of a block, so a block has at most 1,024 nodes at its foot
BLOCK_BYTES = 4096  # of a block's path to the root, to size a broadcast
TAMPERED = 7


def field(value: Column) -> Column:
    """Length-prefixed bytes of a value, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, some of them ``changed``."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]).cast("binary"), 256)


# ---- trees in one block ------------------------------------------------------------------
# A node is (digest, left, right); the right one of a lone node is None. Nodes are never changed.

def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def joined(left: tuple, right: tuple | None) -> tuple:
    return digest(left[0], right[0] if right else ""), left, right


def grown(leaves: Sequence[str], levels: int) -> tuple:
    """The root over ``leaves`` after ``levels`` levels; the last node of a level may have no partner."""
    nodes: list[tuple] = [(d, None, None) for d in leaves]
    for _ in range(levels):
        nodes = [joined(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
    return nodes[0]


def replaced(root: tuple, levels: int, place: int, leaf_digest: str) -> tuple[tuple, list[str]]:
    """(version of the tree with another leaf, steps to its siblings from the foot up).

    Only the ancestors of the leaf are made anew, all other nodes are shared with ``root``. A step is ``<`` or
    ``>`` with the digest of the sibling on that side, or empty for a lone node.
    """
    path, node = [], root
    for level in reversed(range(levels)):
        right = place >> level & 1
        path.append((node, right))
        node = node[1 + right]
    version: tuple = (leaf_digest, None, None)
    steps = []
    for old, right in reversed(path):
        sibling = old[1] if right else old[2]
        steps.append(("<" if right else ">") + sibling[0] if sibling else "")
        version = joined(old[1], version) if right else joined(version, old[2])
    return version, steps


def _planted(rows: pd.DataFrame, column: str, height: int) -> tuple[pd.DataFrame, int, tuple]:
    """A block's rows in order, the levels it has, and its tree."""
    rows = rows.sort_values("position", ignore_index=True)
    levels = min(height, (int(rows["held"].iloc[0]) - 1).bit_length())
    return rows, levels, grown(rows[column].tolist(), levels)


def _leaf_versions(height: int):
    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows, levels, root = _planted(rows, "leaf", height)
        roots, siblings = [], []
        for place, (own, changed) in enumerate(zip(rows["leaf"], rows["changed"])):
            version, steps = replaced(root, levels, place, changed or own)
            roots.append(version[0])
            siblings.append(bytes.fromhex("".join(s[1:] for s in steps)))
        return rows[["tree", "block", "held", "doc_id", "leaf"]].assign(version=roots, siblings=siblings, top=root[0])

    return of_block


def _node_paths(height: int):
    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows, levels, root = _planted(rows, "digest", height)
        steps = [replaced(root, levels, place, own)[1] for place, own in enumerate(rows["digest"])]
        return rows[["tree", "block", "position", "held"]].assign(steps=steps, top=root[0])

    return of_block


# ---- trees over blocks -------------------------------------------------------------------

def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their ``position`` in the order of their tree, from 0, and ``held``, the tree's rows.

    Rows are dealt by ranges of (tree, order) and stored sorted. A row's number within its partition, and the
    counts of each (tree, partition), give its place, so a tree that holds most rows is never in one task.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = durable(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(runs.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("held")))
    n = runs.count()
    return placed.join(small_side(runs, n, n * 64), ["tree", "_part"]).withColumn("position", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _in_blocks(rows: DataFrame, height: int):
    return rows.withColumn("block", F.shiftright("position", height)).groupBy("tree", "block")


def _tops(blocks: DataFrame, height: int) -> DataFrame:
    """The nodes that ``blocks`` end in, numbered as the next tree's foot."""
    above = F.shiftright(F.max("held") + (1 << height) - 1, height)
    return durable(blocks.groupBy("tree", F.col("block").alias("position")).agg(F.max("top").alias("digest"), above.alias("held")))


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """``tree, position, digest, steps, root`` for nodes(tree, position, digest, held): block by block, until each tree has one node."""
    blocks = _in_blocks(nodes.select("tree", "position", "digest", "held"), height)
    paths = durable(blocks.applyInPandas(_node_paths(height), "tree string, block long, position long, held long, steps array<string>, top string"))
    tops = _tops(paths, height)
    if tops.where("held > 1").isEmpty():
        done = paths.select("tree", "position", "steps", F.col("top").alias("root"))
    else:
        above = _climb(tops, height).select("tree", F.col("position").alias("block"), F.col("steps").alias("more"), "root")
        done = paths.join(above, ["tree", "block"]).select("tree", "position", F.concat("steps", "more").alias("steps"), "root")
    return durable(nodes.select("tree", "position", "digest").join(done, ["tree", "position"]))


def _fold(start: Column, steps: str) -> Column:
    """``start`` carried up by ``steps``: each makes one new ancestor and shares the sibling."""
    sibling = lambda s: F.substring(s, 2, 64)
    parts = lambda acc, s: F.when(F.startswith(s, F.lit("<")), F.concat(sibling(s), acc)).otherwise(F.concat(acc, sibling(s)))
    return F.aggregate(steps, start, lambda acc, s: F.sha2(parts(acc, s).cast("binary"), 256))


def versions(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A tree per ``tree``, one over their roots, and for every leaf the root of its own version.

    ``leaves(tree, doc_id, leaf, changed)`` -> ``tree, doc_id, leaf, subroot, root, siblings, folded_root``. ``changed`` is another digest
    for the leaf, or null; ``siblings`` holds 32 bytes per sibling up to the root; ``folded_root`` is the root when only this leaf is changed.

    Leaves of a tree, by doc_id and digest, are cut into aligned blocks of 2 ** height, 1,024 as a rule. In a block, each leaf makes a version by copying its ancestors only. The
    blocks' roots are the foot of the next tree, again in blocks, and so on; a version that left the root of its block changed
    goes on by the steps of that block, the others share the block's own way up.
    """
    # Ids go through pandas as text: beside a null it would make numbers floats.
    placed = _numbered(leaves, ["doc_id", "leaf"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    feet = durable(_in_blocks(placed, height).applyInPandas(
        _leaf_versions(height), "tree string, block long, held long, doc_id string, leaf string, version string, siblings binary, top string"
    ))
    blocks = _climb(_tops(feet, height), height)
    subroots = durable(blocks.groupBy("tree").agg(F.max("root").alias("digest")))
    over = durable(_numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"]))
    ends = _climb(over, height).select("position", F.col("steps").alias("more"), F.col("root").alias("whole"))
    over = over.join(ends, "position").select(F.col("of").alias("tree"), "more", "whole")
    ways = blocks.join(over, "tree").select(
        "tree", F.col("position").alias("block"), "digest", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("steps", "more").alias("steps")
    )
    ways = durable(ways.withColumn("shared", _fold(F.col("digest"), "steps")).withColumn("above", F.unhex(F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), ""))).drop("digest"))
    n = ways.count()
    rows = feet.join(small_side(ways, n, n * BLOCK_BYTES), ["tree", "block"])
    folded = F.when(F.col("version") == F.col("top"), F.col("shared")).otherwise(_fold(F.col("version"), "steps"))
    return rows.select("tree", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.concat("siblings", "above").alias("siblings"), folded.alias("folded_root"))


def manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs(doc_id, source, lang, n_chars, text, ...)``: a tree per lang, one over the langs, and a tampering test of every leaf.

    -> ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. The row of every seventh doc_id, by CRC-32, is
    tampered with: n_chars grows by one. Its ``folded_root`` is the root of the version with the tampered leaf, that of any other row is carried up from
    its own leaf, and ``verified`` tells whether it is the root.

    A null lang is the first tree; null doc_ids come first in theirs, are tampered with by no rule, and ties, repeated
    rows too, follow the leaf's digest. A null n_chars stays null, so that leaf still verifies. Texts of any length count whole. A single row is its own root and its
    proof is the digest of nothing. An empty table gives an empty table, extra columns are ignored whatever their names.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tampered = leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = durable(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), F.when(chosen, tampered).alias("changed")))
    return versions(leaves).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _climb_sql(name: str, foot: str) -> str:
    return f"""{name} as (
  select tree, 0 as level, pos, digest, held from {foot}
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (held + 1) // 2 from {name} where held > 1 group by tree, level, pos // 2, held
)"""


def _steps_sql(name: str, foot: str, nodes: str) -> str:
    return f"""{name} as (
  select f.tree, f.pos, coalesce(list(case when s.pos is null then '' when s.pos < n.pos then '<' || s.digest else '>' || s.digest end order by n.level) filter (n.held > 1), []) as steps,
    max(n.digest) filter (n.held = 1) as root
  from {foot} f join {nodes} n on n.tree = f.tree and n.pos = f.pos >> n.level
    left join {nodes} s on s.tree = n.tree and s.level = n.level and s.pos = xor(n.pos, 1)
  group by f.tree, f.pos
)"""


def _leaf_sql(n_chars: str) -> str:
    text = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
    return "sha256(" + " || ".join(text.format(f"({v})::varchar") for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
with recursive tab as (
  select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))
), leaves as (
  select coalesce('=' || lang, '') as tree, doc_id, {_leaf_sql("n_chars")} as digest, case when xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % {TAMPERED} = 0
    then {_leaf_sql("n_chars + 1")} end as changed
  from documents, tab
), foot as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by tree) as held from leaves
), {_climb_sql("nodes", "foot")}, {_steps_sql("paths", "foot", "nodes")},
subroots as (
  select '' as tree, tree as of_, any_value(root) as digest, row_number() over (order by tree) - 1 as pos, count(*) over () as held from paths group by tree
), {_climb_sql("upper_nodes", "subroots")}, {_steps_sql("ways", "subroots", "upper_nodes")},
whole as (
  select f.doc_id, f.digest as leaf, f.changed, p.root as subroot, w.root, p.steps || w.steps as steps
  from foot f join paths p using (tree, pos) join subroots s on s.of_ = f.tree join ways w on w.pos = s.pos
), folded as (
  select *, list_reduce(list_prepend(coalesce(changed, leaf), steps), lambda a, s: sha256(case when s[1] = '<' then s[2:] || a else a || s[2:] end)) as folded_root from whole
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folded"""
