"""Pairs of bit signatures within any distance: multi-index hashing over the bits that tell signatures apart."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..session import durable

BLOCK = 1 << 14  # signatures of a bucket that one task compares all with all
LOT = 1 << 15  # about so many rows go to one call of Python
LEVELS = 3  # how often a bucket is cut finer
MOST_FLIPS = 2
WIDEST = 24  # bits of a band that is probed with flips
INDEX, PROBE, BOTH = 0, 1, 2
MOST_MET = 0.5  # bands in which pairs of a bucket meet more often than this share of them save nothing
FEW_BLOCKS = 16  # as many blocks of a bucket keep the tasks busy; only then do blocks grow, up to GROWN times
GROWN = 8
TILE = 32, 8192  # signatures compared in one step
SIEVE = 128  # bits that are compared first, those that differ most
FEW_ROWS = 256  # in buckets below, all words are compared at once
PART = 1 << 16  # about so many pairs leave a call of Python at a time
_ONE = np.uint64(1)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally many longs as a matrix of words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def _seen(column: pa.Array) -> np.ndarray:
    """A list column of one bucket, whose lists are equally long, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _bits(words: np.ndarray) -> np.ndarray:
    """One byte per bit, the lowest bit of the first word first."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def plan(bits: list[int], n: int, distance: int, block: int = BLOCK) -> tuple[list[list[int]], int]:
    """(bands, flips) for a bucket of ``n`` signatures, whose differing ``bits`` come most informative first.

    Of d differing bits, bands of any disjoint bits have one with at most floor(d / bands) of them. With f flips, d // (f + 1) + 1 bands
    suffice. The fewest flips are taken that leave bands wide enough to part n signatures into small buckets, while to deal a signature, which
    costs as much as to compare it with a block, stays below comparing it with the whole bucket; without any such, no bands.
    """
    wanted = min(math.ceil(math.log2(max(2.0, n / block))) + 2, len(bits))
    for flips in range(MOST_FLIPS + 1):
        bands = distance // (flips + 1) + 1
        width = len(bits) // bands
        width = min(width, WIDEST) if flips else width
        dealt = bands * sum(math.comb(width, k) for k in range(flips + 1))
        if 0 < width >= wanted and dealt * block <= n:
            # Dealt in turns, so every band has its share of the best bits.
            return [bits[b : width * bands : bands] for b in range(bands)], flips
    return [], 0


def met(bands: list[list[int]], flips: int, differs: dict[int, float]) -> float:
    """Expected share of a bucket's pairs that meet in its bands, a pair in several bands counted in each; ``differs``: how often two signatures differ in a bit."""
    total = 0.0
    for band in bands:
        at_most = [1.0] + [0.0] * flips  # of exactly so many differing bits
        for bit in band:
            q = differs[bit]
            at_most = [(1 - q) * p + (q * at_most[k - 1] if k else 0.0) for k, p in enumerate(at_most)]
        total += sum(at_most)
    return total * (2 if flips else 1)


def _keys(matrix: np.ndarray, band: list[int], seed: int) -> np.ndarray:
    """64-bit values of a band: its bits where they fit, else a hash of them."""
    chosen = matrix[:, band].astype(np.uint64)
    if len(band) <= 48:
        return (chosen << np.arange(len(band), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    weights = np.random.default_rng(seed).integers(1, 1 << 62, len(band), dtype=np.uint64) * np.uint64(2) + _ONE
    mixed = (chosen * weights).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(31))


def _ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set bits per bucket and place, as partial sums of each batch."""
    for batch in batches:
        buckets, words = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1))
        matrix = _bits(words)
        for bucket in np.unique(buckets):
            mine = matrix[buckets == bucket]
            ones = mine.sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(ones), pa.int64()), pa.array(np.arange(len(ones)), pa.int32()), pa.array(ones), pa.array([len(mine)] * len(ones), pa.int64())], ["bucket", "bit", "ones", "rows"]
            )


def _plans(distance: int, block: int):
    """Each large bucket with its bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = []
            for n, ranked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bands, flips = plan([r["bit"] for r in ranked], n, distance, block)
                # Signatures that are much alike meet in most bands, several times over; they are compared in blocks at once.
                saves = met(bands, flips, {r["bit"]: (1 - (r["bias"] / n) ** 2) / 2 for r in ranked}) <= MOST_MET
                plans.append((bands, flips) if saves else ([], 0))
            bands = pa.array([p[0] for p in plans], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands, pa.array([p[1] for p in plans], pa.int32())], ["bucket", "_n", "bands", "flips"])

    return work


def _finer():
    """Rows of large buckets, to the buckets of their bands; ``parent`` is the size of the bucket they come from.

    ``seen`` gets the row's values in the bands before: two rows that agree in one of these meet there too.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            for bucket in np.unique(buckets):
                part = batch.filter(pa.array(buckets == bucket))
                n, bands, flips = (part.column(c)[0].as_py() for c in ("n", "bands", "flips"))
                matrix, sides = _bits(_rows(part.column("words"))), part.column("side").to_numpy(zero_copy_only=False)
                before = _seen(part.column("seen"))
                for b, band in enumerate(bands):
                    own = _keys(matrix, band, b)
                    if not flips:
                        yield _dealt(part, bucket, b, own, sides, n, before)
                        before = np.column_stack([before, own.view(np.int64)])
                        continue
                    index, probe = np.flatnonzero(sides != PROBE), np.flatnonzero(sides != INDEX)
                    yield _dealt(part.take(pa.array(index)), bucket, b, own[index], np.full(len(index), INDEX), n, before[index])
                    probes = part.take(pa.array(probe))
                    for flipped in _flips(len(band), flips):
                        yield _dealt(probes, bucket, b, own[probe] ^ flipped, np.full(len(probe), PROBE), n, before[probe])

    def _dealt(rows: pa.RecordBatch, bucket: int, band: int, keys: np.ndarray, sides: np.ndarray, n: int, before: np.ndarray) -> pa.RecordBatch:
        seen = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * before.shape[1], pa.int32()), pa.array(before.ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), bucket)), pa.array(np.full(len(keys), band, np.int32)), pa.array(keys.view(np.int64)), rows.column("image"), rows.column("copies"),
             rows.column("words"), seen, pa.array(sides.astype(np.int32)), pa.array(np.full(len(keys), n))],
            ["of", "band", "value", "image", "copies", "words", "seen", "side", "parent"],
        )

    return work


def _flips(width: int, most: int) -> list[np.uint64]:
    """Masks of at most ``most`` bits among ``width``."""
    single = [_ONE << np.uint64(i) for i in range(width)]
    masks = [np.uint64(0)]
    if most >= 1:
        masks += single
    if most >= 2:
        masks += [a | b for i, a in enumerate(single) for b in single[:i]]
    return masks


def _products(start: int, end: int, crossed: bool, side: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """What to compare with what in the rows of a (bucket, block), so that every pair is met once if no side is looked up in the other; ``ordered``: only with rows further on."""
    if end - start < 2:
        return
    one_sided = bool(np.any(side != BOTH))
    index, probe = side != PROBE, side != INDEX
    if not crossed:
        yield start + np.flatnonzero(index), start + np.flatnonzero(probe), not one_sided
        return
    yield start + np.flatnonzero(index & (half == 0)), start + np.flatnonzero(probe & (half == 1)), False
    if one_sided:
        yield start + np.flatnonzero(index & (half == 1)), start + np.flatnonzero(probe & (half == 0)), False


def _sieve(words: np.ndarray) -> np.ndarray:
    """The bits of a bucket that differ most, as few words, one row per word."""
    bits = _bits(words)
    ones = bits.sum(axis=0, dtype=np.int64)
    even = np.argsort(np.abs(2 * ones - len(words)), kind="stable")[:SIEVE]
    packed = np.packbits(bits[:, even], axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).T)


def _set(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, looked for eight at a time, as few are."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    at, k = np.nonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[at] * 8 + k, whole + np.flatnonzero(flags[whole:])])


def _near(left: np.ndarray, right: np.ndarray, ordered: bool, few: np.ndarray, words: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``left`` and ``right`` within the distance, and how far they are; ``few``: some of their bits, which leave out most pairs."""
    lefts, rights = few.take(left, axis=1), few.take(right, axis=1)
    cells, kind = TILE[0] * TILE[1], np.uint8 if len(few) < 4 else np.uint16
    space = np.empty(cells, np.uint64), np.empty(cells, np.uint8), np.empty(cells, kind), np.empty(cells, np.bool_)
    most = kind(min(distance, np.iinfo(kind).max))
    for low in range(0, len(left), TILE[0]):
        for from_ in range(low if ordered else 0, len(right), TILE[1]):
            a, b = lefts[:, low : low + TILE[0], None], rights[:, None, from_ : from_ + TILE[1]]
            shape = a.shape[1], b.shape[2]
            apart, ones, total, close = (x[: shape[0] * shape[1]].reshape(shape) for x in space)
            total.fill(0)
            for k in range(len(few)):
                np.bitwise_xor(a[k], b[k], out=apart)
                np.bitwise_count(apart, out=ones)
                total += ones
            i, j = np.divmod(_set(np.less_equal(total, most, out=close).reshape(-1)), shape[1])
            if not len(i):
                continue
            i, j = left[i + low], right[j + from_]
            if ordered:
                i, j = i[i < j], j[i < j]
            far = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32)
            kept = far <= distance
            yield i[kept], j[kept], far[kept]


FOUND = pa.schema([("image_a", pa.int64()), ("image_b", pa.int64()), ("distance", pa.int32()), ("copies_a", pa.int64()), ("copies_b", pa.int64())])


def _compare(distance: int):
    """Pairs within ``distance`` inside each (bucket, block) of a lot of rows, but for those that meet in a band before.

    In a bucket of signatures much alike they are as many as the square of its rows, so they leave in parts while the others are looked for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        group = np.stack([table.column(c).to_numpy() for c in ("bucket", "x", "y")], axis=1)
        order = np.lexsort(group.T[::-1])
        table, group = table.take(pa.array(order)).combine_chunks(), group[order]
        images, copies, words = table.column("image").to_numpy(), table.column("copies").to_numpy(), _rows(table.column("words"))
        side, half, seen = table.column("side").to_numpy(), table.column("half").to_numpy(), table.column("seen").combine_chunks()
        ends = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
        found, pairs = [], 0
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(group)]):
            if end - start < 2:
                continue
            mine, before = words[start:end], _seen(seen[start:end])
            few = _sieve(mine) if end - start >= FEW_ROWS else np.ascontiguousarray(mine.T)
            for left, right, ordered in _products(0, end - start, group[start, 1] != group[start, 2], side[start:end], half[start:end]):
                for i, j, far in _near(left, right, ordered, few, mine, distance):
                    kept = (images[start + i] != images[start + j]) & ~np.any(before[i] == before[j], axis=1)
                    i, j = start + i[kept], start + j[kept]
                    if not len(i):
                        continue
                    swap = images[i] > images[j]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    found.append((images[i], images[j], far[kept], copies[i], copies[j]))
                    pairs += len(i)
                    if pairs >= PART:
                        yield _found(found)
                        found, pairs = [], 0
        if found:
            yield _found(found)

    return work


def _found(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), FOUND)], schema=FOUND)


PAIRS = "image_a long, image_b long, distance int, copies_a long, copies_b long"


def _exact(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """All pairs within the distance inside the buckets of ``rows(bucket, n, image, copies, words, seen, side)``.

    A bucket of more than ``block`` rows is cut into blocks by a hash of the image, and every two of its blocks meet, so a row is dealt to as many places
    as there are blocks: large buckets have larger blocks. Small buckets share a call of Python.
    """
    blocks = F.greatest(F.least(F.ceil(F.col("n") / block), F.greatest(F.ceil(F.col("n") / (block * GROWN)), F.lit(FEW_BLOCKS))), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks)
    # A lot is little data and much work, so a number of partitions is named that is not lowered by their bytes.
    lots = max((rows.agg(F.sum("blocks")).first()[0] or 0) // LOT, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    own = F.pmod(F.xxhash64("image"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y"), (F.col("own") > k).cast("int").alias("half")))
    dealt = rows.withColumn("own", own).withColumn("m", F.explode(meets)).select("bucket", "m.x", "m.y", "m.half", "image", "copies", "words", "seen", "side")
    lot = F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(lots))
    return dealt.withColumn("lot", lot).repartition(lots, "lot").groupBy("lot").applyInArrow(_compare(distance), PAIRS)


def near_pairs(signatures: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Pairs of ``signatures(image, words)``, distinct arrays of equally many longs, that differ in at most ``distance`` bits.

    -> ``image_a < image_b, distance``, and with a column ``copies`` its values ``copies_a`` and ``copies_b``. All start in one bucket. A bucket of at most ``block`` signatures is compared as a whole, in numpy,
    the bits that differ most before all others. A larger one is cut:
    its bits are counted, those that never differ are left out, and the others are dealt, most even ones first, over enough bands that
    two signatures within the distance agree in one of them but for a few bits (``plan``); one side of a pair
    is looked up with these bits flipped. Bands that would not at least halve the pairs to compare (``met``) are not used. Each band's value is a bucket of the next level, where the bits are counted anew. A bucket that
    keeps over half of its parent's rows, or is still large after LEVELS levels, is compared in blocks, so no pair is lost whatever the signatures are like.
    A pair that meets in several bands comes out of the first.
    """
    if distance < 0:
        raise ValueError("a distance is not negative")
    counted = "copies" in signatures.columns
    copies = F.col("copies").cast("long") if counted else F.lit(1).cast("bigint")
    start = signatures.where("image is not null").select(F.lit(0).cast("bigint").alias("bucket"), F.col("image").cast("long").alias("image"), copies.alias("copies"), "words")
    start = durable(start.withColumns({"seen": F.expr("cast(array() as array<bigint>)"), "side": F.lit(BOTH), "parent": F.lit(None).cast("bigint")}))
    held = start.withColumn("n", F.lit(start.count()).cast("bigint"))
    spread = 2 * signatures.sparkSession.sparkContext.defaultParallelism
    columns = ["bucket", "n", "image", "copies", "words", "seen", "side"]
    found, flipped = [], False
    for depth in range(LEVELS + 1):
        stays = (F.col("n") <= block) | F.coalesce(F.col("n") * 2 > F.col("parent"), F.lit(False)) | F.lit(depth == LEVELS)
        found.append(held.where(stays).select(columns))
        large = held.where(~stays)
        if large.isEmpty():
            break
        # Few bytes, which would else come in few partitions.
        large = large.select(columns).repartition(spread, "image")
        ones = large.select("bucket", "words").mapInArrow(_ones, "bucket long, bit int, ones long, rows long")
        counts = ones.groupBy("bucket", "bit").agg(F.sum("ones").alias("ones"), F.sum("rows").alias("rows")).where("ones > 0 and ones < rows")
        ranked = F.sort_array(F.collect_list(F.struct(F.abs(2 * F.col("ones") - F.col("rows")).alias("bias"), "bit")))
        # As many entries as a signature has bits. Distinct signatures differ in some bit, so every large bucket has a row.
        bits = counts.groupBy("bucket").agg(F.max("rows").alias("_n"), ranked.alias("bits"))
        plans = durable(bits.mapInArrow(_plans(distance, block), "bucket long, _n long, bands array<array<int>>, flips int"))
        large = durable(join_unique(large, plans, ["bucket"], "_n", ["image"]).drop("_n"))
        able = F.size("bands") > 0
        found.append(large.where(~able).select(columns))
        kinds = plans.agg(F.count_if(able), F.max("flips")).first()
        if not kinds[0]:
            break
        flipped = flipped or kinds[1] > 0
        finer = large.where(able).repartition(spread, "image").mapInArrow(_finer(), "of long, band int, value long, image long, copies long, words array<long>, seen array<long>, side int, parent long")
        level = durable(finer.select(F.xxhash64("of", "band", "value").alias("bucket"), "image", "copies", "words", "seen", "side", "parent"))
        sides = [F.count_if(F.col("side") != PROBE).alias("_left"), F.count_if(F.col("side") != INDEX).alias("_right")]
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), *sides)
        sizes = sizes.where("_left > 0 and _right > 0 and n > 1").drop("_left", "_right")
        held = durable(join_unique(level.drop("parent"), sizes, ["bucket"], "n", ["image"]))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    pairs = _exact(rows, distance, block)
    pairs = pairs if counted else pairs.drop("copies_a", "copies_b")
    # Looked up with flips, a pair may still meet several times.
    return pairs.distinct() if flipped else pairs
