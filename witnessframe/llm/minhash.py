"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import small_side
from ..session import durable
from . import words
from .components import components
from .words import mix

WIDTH = 5
PLACES = 64
BAND_ROWS = 4
BLOCK = 512
KEY_BYTES = 64  # of a doc_id and a digest, to size a broadcast
_U = np.uint64
_FREE = _U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of consecutive texts and the offsets of each text's set."""
    found = words.split(data, bounds)
    values, text = words.windows(words.hashes(found), found.first, width)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.searchsorted(text[fresh], np.arange(len(bounds)))


def signatures(values: np.ndarray, first: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of every set, one row each.

    Element e draws at level j a number r in [0, 1) and the next entry k of its own random
    permutation of the places, and place k keeps the least j + r of any element. A level-j
    value is below every later one, so all elements of a set go level by level, and a set is
    finished at the first level that leaves no place open: most stop after a few levels, and
    only unfinished sets keep a permutation. Numbers are held as j in the top byte, r below.
    """
    count = np.diff(first)
    table = np.full((len(count), places), _FREE)
    flat = table.reshape(-1)
    owner, live = np.repeat(np.arange(len(count)), count), values
    ranks = None
    for level in range(places):
        drawn = mix(live + _U((level * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        pick = (level + ((mix(drawn) >> _U(32)) * _U(places - level) >> _U(32)).astype(np.int64)).astype(np.int64)
        if ranks is None:
            place = pick
        else:
            row = np.arange(len(live))
            place = ranks[row, pick].astype(np.int64)
            ranks[row, pick] = ranks[row, level]
            ranks[row, level] = place
        np.minimum.at(flat, owner * places + place, (_U(level) << _U(56)) | (drawn >> _U(8)))
        open_set = (table == _FREE).any(axis=1)
        keep = open_set[owner]
        if not keep.any():
            break
        if ranks is None:
            ranks = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (int(keep.sum()), 1))
            row, place = np.arange(len(ranks)), place[keep]
            ranks[row, place] = 0
            ranks[row, 0] = place
        elif not keep.all():
            ranks = ranks[keep]
        owner, live = owner[keep], live[keep]
    return table


def _digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sixteen bytes per set that are equal for equal sets."""
    out = np.zeros((len(first) - 1, 2), ">u8")
    some = np.diff(first) > 0
    if some.any():
        at = first[:-1][some]
        out[some, 0] = np.add.reduceat(mix(values ^ _U(0xA0761D6478BD642F)), at)
        out[some, 1] = np.add.reduceat(mix(values ^ _U(0xE7037ED1A0B428DB)), at)
    return out


def _bands(table: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` places."""
    n, places = table.shape
    shaped = table.reshape(n, places // rows, rows)
    key = np.broadcast_to(np.arange(places // rows, dtype=_U), shaped.shape[:2]) * _U(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = mix(key ^ shaped[:, :, i])
    return key.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def text_digest() -> Column:
    """Sixteen bytes that tell texts under one doc_id apart; null for a null text."""
    return F.unhex(F.md5(F.col("text")))


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column in ``taken`` has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def same_document(docs: DataFrame, own: str, keys: DataFrame, doc_id: str, digest: str) -> Column:
    """Whether a row, whose text's digest is in ``own``, is the document that a row of ``keys`` names."""
    return docs["doc_id"].eqNullSafe(keys[doc_id]) & docs[own].eqNullSafe(keys[digest])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, digests = batch.column(0), batch.column(1), batch.column(2)
        for row, stop, data, bounds in words.slices(texts):
            values, first = shingle_sets(data, bounds)
            keys = _bands(signatures(values, first), BAND_ROWS)
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, stop - row), digests.slice(row, stop - row), pa.array(np.diff(first)), _binary(_digests(values, first)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                ["doc_id", "digest", "n_shingles", "cls", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, bounds in words.slices(batch.column(0)):
            values, first = shingle_sets(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [_binary(_digests(values, first)), pa.array(np.diff(first)), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values.view(np.int64)))],
                ["cls", "n", "items"],
            )


def _block_links(least_percent: int):
    """Links between the two halves of a block pair (or within one block), as a spanning forest.

    Intersections of all pairs come from one product of 0/1 matrices per slice of shared
    shingles. Only links that join different components are returned, so a block pair
    returns fewer rows than it holds sets.
    """

    def links(frame):
        import pandas as pd

        frame = frame.drop_duplicates(["half", "cls"])
        names = frame["cls"].tolist()
        sizes = frame["n"].to_numpy(np.int64)
        group = frame["label"].tolist()
        half = frame["half"].to_numpy()
        both = bool(frame["x"].iloc[0] != frame["y"].iloc[0])
        if both and len(np.unique(half)) < 2:
            return pd.DataFrame(columns=["a", "b"])
        left = np.flatnonzero(half == 0) if both else np.arange(len(frame))
        right = np.flatnonzero(half == 1) if both else left
        items = np.concatenate([np.asarray(x, np.int64) for x in frame["items"]])
        owner = np.repeat(np.arange(len(frame)), sizes)
        _, item, seen = np.unique(items, return_inverse=True, return_counts=True)
        shared = seen > 1
        column = np.cumsum(shared) - 1
        use = shared[item]
        owner, item = owner[use], column[item[use]]
        common = np.zeros((len(left), len(right)), np.float32)
        side_l, side_r = np.full(len(frame), -1), np.full(len(frame), -1)
        side_l[left], side_r[right] = np.arange(len(left)), np.arange(len(right))
        step = 4096
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        for low in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(item, [low, low + step])
            x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
            o, i = owner[a:b], item[a:b] - low
            inl, inr = side_l[o] >= 0, side_r[o] >= 0
            x[side_l[o[inl]], i[inl]] = 1
            y[side_r[o[inr]], i[inr]] = 1
            common += x @ y.T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        hit_l, hit_r = np.nonzero(100 * common.astype(np.float64) >= least_percent * union)
        root = {g: g for g in group}

        def top(g):
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        out = []
        for i, j in zip(left[hit_l], right[hit_r]):
            p, q = top(group[i]), top(group[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def near_duplicates(docs: DataFrame, *, least_percent: int = 85) -> DataFrame:
    """Components of documents linked by 100 * intersection >= least_percent * union of 5-word shingle sets.

    ``docs(doc_id, text, ...)`` -> ``doc_id, n_shingles, component_id, kept`` per row.

    1. One pass gives each text its set size, a digest of the set and 16 band keys of a
       64-place SuperMinHash signature; nothing of the text moves. Equal sets are one class.
    2. In each bucket the least class is paired with every other one (a star, never all
       pairs), and the pairs are confirmed on full sets. At a similarity of 0.85 a pair
       misses all 16 bands with probability below 10^-5.
    3. In buckets whose classes still lie in different components, blocks of about 512 classes meet
       pairwise and exact intersections find every link that is left. Blocks of the bucket's largest
       component do not meet each other, so a large group of copies costs its outsiders times its size.
    4. Components of all links; the least doc_id of a component is its id.

    A null or empty text has an empty set and links with nothing. Rows with the same doc_id
    and text fall into one class and are all ``kept`` or not together; a null doc_id is never
    the component id while a known one is reachable. Further columns are ignored.
    """
    rows = _judged(docs, F.lit(None).cast("binary"), least_percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, digest: Column, least_percent: int) -> DataFrame:
    """``doc_id, digest, n_shingles, label, component_id`` per row; ``label`` is the component's own name, null for an empty set."""
    docs, text = words.small_batches(docs), F.col("text")
    prints = durable(
        docs.select("doc_id", text, digest.alias("digest")).mapInArrow(_prints, "doc_id long, digest binary, n_shingles long, cls binary, bands array<long>")
    )
    classes = durable(prints.where("n_shingles > 0").groupBy("cls", F.col("n_shingles").alias("n"), "bands").agg(F.min("doc_id").alias("doc_id")))
    members = classes.select(F.explode("bands").alias("band"), "cls", "n")
    buckets = members.groupBy("band").agg(F.min(F.struct("cls", "n")).alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    bucketed = durable(members.join(buckets, "band"))
    fits = 100 * F.least("n", F.col("hub.n")) >= least_percent * F.greatest("n", F.col("hub.n"))
    pairs = durable(bucketed.where((F.col("cls") != F.col("hub.cls")) & fits).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct())

    wanted = bucketed.select("cls").distinct().join(classes.select("cls", "doc_id"), "cls").select("doc_id").distinct()
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    sets = durable(texts.mapInArrow(_sets, "cls binary, n long, items array<long>").dropDuplicates(["cls"]))
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b")), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    links = durable(both.where(100 * common >= least_percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"))
    labels = components(links)

    placed = bucketed.select("band", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", F.coalesce("label", "cls").alias("label"))
    placed = durable(placed)
    parts = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("held"))
    largest = F.max(F.struct("held", "label"))
    torn = parts.groupBy("band").agg(largest.alias("main"), F.sum("held").alias("held"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and held > 2")
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    large = F.col("held") > BLOCK
    torn = torn.select(
        "band", F.when(large, F.col("main.label")).alias("main"), F.when(large, number(F.col("main.held"))).otherwise(0).alias("mains"),
        F.when(large, number(F.col("held") - F.col("main.held"))).otherwise(1).alias("rests"),
    )
    in_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    spread = F.xxhash64("cls")
    block = F.when(in_main, F.pmod(spread, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spread, F.col("rests"))).cast("int")
    open_rows = placed.join(torn, "band").withColumn("block", block)
    # A small bucket is one block; of a large one, the blocks of its largest component need not meet each other.
    meets = F.transform(
        F.sequence(F.when(in_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("rests") - 1),
        lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y"), F.when(F.col("block") <= k, 0).otherwise(1).alias("half")),
    )
    dealt = open_rows.select("band", "cls", "label", F.explode(meets).alias("m")).select("band", "cls", "label", "m.*").join(sets, "cls")
    more = dealt.groupBy("band", "x", "y").applyInPandas(_block_links(least_percent), "a binary, b binary")
    final = components(links.union(more))

    owned = classes.select("cls", "doc_id").join(final.withColumnRenamed("node", "cls"), "cls").select("cls", "label", "doc_id")
    least = owned.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = owned.join(least, "label").select("cls", "label", "component_id")
    alone = classes.select("cls", F.col("doc_id").alias("own"))
    answer = alone.join(named, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    joined = prints.select("doc_id", "digest", "n_shingles", "cls").join(answer, "cls", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "digest", "n_shingles", "label", component.alias("component_id"))


def one_of_each(docs: DataFrame, *, least_percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component of near-duplicates.

    A document is a doc_id with a text, known by its digest; each row without doc_id is a document of its own. Of a
    component the least doc_id stays, then the least digest; a null doc_id only if there is no other. Texts without words are
    near nothing. Rows that repeat doc_id and text are one document, of which one row stays.
    The documents to drop go to the rows when their counted number is small, else both meet by shuffle.
    """
    judged = _judged(docs, text_digest(), least_percent).groupBy("doc_id", "digest", "label", (F.col("n_shingles") > 0).alias("some"))
    judged = durable(judged.agg(F.count(F.lit(1)).alias("held")))
    some = judged.where("some").select(F.col("doc_id").alias("judged"), F.col("digest").alias("of"), "label")
    best = some.groupBy("label").agg(F.min(F.struct(F.col("judged").isNull().alias("unnamed"), "judged", "of")).alias("best"))
    best = best.select(F.col("best.judged").alias("b_id"), F.col("best.of").alias("b_of"))
    drop = durable(some.join(best, some["judged"].eqNullSafe(best["b_id"]) & (some["of"] == best["b_of"]), "left_anti").select("judged", "of"))
    n = drop.count()
    own = fresh_name("_digest", docs.columns)
    marked = docs.withColumn(own, text_digest())
    left = marked.join(small_side(drop, n, n * KEY_BYTES), same_document(marked, own, drop, "judged", "of"), "left_anti")
    twice = judged.where("held > 1 and (some or doc_id is not null)").select(F.col("doc_id").alias("judged"), F.col("digest").alias("of"))
    n = twice.count()
    if not n:
        return left.drop(own)
    twice, same = small_side(twice, n, n * KEY_BYTES), same_document(left, own, twice, "judged", "of")
    again = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", own])  # one text per key and task is moved
    return left.join(twice, same, "left_anti").unionByName(again).drop(own)
