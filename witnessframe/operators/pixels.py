"""Pixel facts. pixels: image_id, width, height, x, y, b, g, r, one row per pixel.

No step gathers an image: facts are aggregates by cell, band or grid box, and resampling
scatters each source pixel to the few outputs it touches and sums them by position.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.luma import axis_taps, luma_8p8, luma_f, luma_milli, span_high, span_low, stretch_8p8, stretch_float, stretch_int
from ..functions.values import let, sample_step
from ..plans.skew import join_unique
from ..session import durable
from .hamming import near_pairs

# Sampling budget, band and cell thresholds of the paint checks.
SAMPLE_BUDGET = 1_500_000
CELL_RULES = {"min_colors": 10, "min_colored": 0.12, "min_saturation": 24.0, "min_variance": 40.0}
REGION_CELL = 32
TILE_ROWS = 8192
BAND_ROWS = 256


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a.cast("bigint"), b if isinstance(b, Column) else F.lit(b))


def luma(df: DataFrame) -> DataFrame:
    return df.withColumn("luma", luma_f(F.col("r"), F.col("g"), F.col("b")))


def sampled(pixels: DataFrame, budget: int = SAMPLE_BUDGET) -> DataFrame:
    """Strided sample of every frame; ``step`` is kept because cells thin by it too."""
    stepped = pixels.withColumn("step", sample_step(F.col("width"), F.col("height"), budget))
    return stepped.where((F.col("x") % F.col("step") == 0) & (F.col("y") % F.col("step") == 0))


def paint_statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Luma mean and variance, share of the fullest 8-level band, bands over a thousandth, verdict."""
    bands = luma(samples).groupBy(*keys, F.shiftright(F.floor("luma").cast("int"), 3).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("luma").alias("s"), F.sum(F.col("luma") * F.col("luma")).alias("q")
    )
    # 32 bands at most, so the counts of one key fit a short array.
    whole = bands.groupBy(*keys).agg(
        F.sum("n").alias("pixels"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("n").alias("top"), F.collect_list("n").alias("counts")
    )
    mean = F.col("s") / F.col("pixels")
    variance = F.greatest(F.col("q") / F.col("pixels") - mean * mean, F.lit(0.0))
    dominant = F.col("top") / F.col("pixels")
    distinct = F.size(F.filter("counts", lambda n: n.cast("double") > F.lit(0.001) * F.col("pixels")))
    return whole.select(
        *keys, "pixels", mean.alias("luma_mean"), variance.alias("luma_variance"), dominant.alias("dominant_luma_frac"),
        distinct.alias("distinct_luma_bands"), ((variance >= 8.0) & (distinct >= 4) & (dominant < 0.98)).alias("painted"),
    )


def photo_cells(pixels: DataFrame, keys: list[str], cell: int, step: Column, left: Column, top: Column, **rules: float) -> DataFrame:
    """Cells of ``cell`` pixels from (left, top) with their photo verdict.

    Thinning starts at each cell's own corner. A cell is photo-like when it has enough
    distinct 3-3-3-bit colors, enough colored pixels and enough luma variance.
    """
    rule = {**CELL_RULES, **rules}
    dx, dy = F.col("x") - left, F.col("y") - top
    thinned = pixels.where(((dx % cell) % step == 0) & ((dy % cell) % step == 0))
    color = F.shiftright("r", 5) * 64 + F.shiftright("g", 5) * 8 + F.shiftright("b", 5)
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    cells = luma(thinned).groupBy(*keys, _div(dy, cell).cast("int").alias("cell_y"), _div(dx, cell).cast("int").alias("cell_x")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(color).alias("colors"), F.count_if(spread > rule["min_saturation"]).alias("colored"),
        F.sum("luma").alias("s"), F.sum(F.col("luma") * F.col("luma")).alias("q"),
    )
    mean = F.col("s") / F.col("n")
    verdict = (
        (F.col("colors") >= rule["min_colors"]) & (F.col("colored") / F.col("n") >= rule["min_colored"])
        & (F.col("q") / F.col("n") - mean * mean >= rule["min_variance"])
    )
    return cells.select(*keys, "cell_y", "cell_x", "colors", verdict.alias("photo"))


def photo_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Photo cells, cells and the row-major mask of a frame (area / cell² entries)."""
    ordered = F.array_sort(F.collect_list(F.struct("cell_y", "cell_x", "photo")))
    return cells.groupBy(*keys).agg(
        F.count_if("photo").alias("photo_like_cells"), F.count(F.lit(1)).alias("grid_cells"), F.transform(ordered, lambda c: c["photo"]).alias("mask")
    )


def widened(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Fractional rectangle widened to the pixels it touches."""
    x0, y0 = F.floor(x), F.floor(y)
    return F.struct(
        x0.cast("bigint").alias("x"), y0.cast("bigint").alias("y"), (F.ceil(x + width) - x0).cast("bigint").alias("width"),
        (F.ceil(y + height) - y0).cast("bigint").alias("height"),
    )


def clamped_regions(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions as [x0, x1) x [y0, y1) inside their image; ``error`` where nothing is left."""

    def inside(c: Column, top: str) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.col(top)).cast("int")

    placed = regions.join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    boxes = placed.select(
        "image_id", "name", inside(F.floor("x"), "_w").alias("x0"), inside(F.floor("y"), "_h").alias("y0"),
        inside(F.ceil(F.col("x") + F.col("width")), "_w").alias("x1"), inside(F.ceil(F.col("y") + F.col("height")), "_h").alias("y1"),
    )
    empty = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    return boxes.withColumn("error", F.when(empty, "region has no painted box"))


def cropped(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of every non-empty region. Both sides meet by image and band of rows, so a
    tall image spreads over many tasks."""
    spread = boxes.where("error is null").drop("error").withColumn(
        "_band", F.explode(F.sequence(_div(F.col("y0"), BAND_ROWS), _div(F.col("y1") - 1, BAND_ROWS)))
    )
    banded = pixels.withColumn("_band", _div(F.col("y"), BAND_ROWS))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return banded.join(spread, ["image_id", "_band"]).where(inside).drop("_band")


def region_statistics(crops: DataFrame, budget: int = SAMPLE_BUDGET, cell: int = REGION_CELL, **rules: float) -> DataFrame:
    """Paint statistics and photo cells per region; sampling starts at the region's corner."""
    keys = ["image_id", "name"]
    step = sample_step(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), budget)
    stepped = crops.withColumn("step", step)
    taken = stepped.where(((F.col("x") - F.col("x0")) % F.col("step") == 0) & ((F.col("y") - F.col("y0")) % F.col("step") == 0))
    cells = photo_cells(stepped, keys, cell, F.greatest("step", F.lit(2)), F.col("x0"), F.col("y0"), **rules)
    photos = cells.groupBy(*keys).agg(F.count_if("photo").alias("photo_like_cells"))
    return paint_statistics(taken, keys).join(photos, keys)


# ---- signatures ----


def _word(bits: Column, start: int) -> Column:
    """64 booleans from ``start`` as a signed 64-bit word, first bit lowest."""
    pieces = F.transform(F.slice(bits, start + 1, 64), lambda bit, i: F.when(bit, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _hex(word: Column) -> Column:
    return F.lpad(F.lower(F.hex(word)), 16, "0")


def _in_order_mean(values: Column, count: int) -> Column:
    """Mean summed in array order, so equal cells compare equal to it reproducibly."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.lit(float(count))


def gallery_words(pixels: DataFrame) -> DataFrame:
    """512-bit signature as eight words: 256 left-to-right differences of a 17x16 grid of
    box means, then 256 comparisons of a 16x16 grid with its mean.

    Low images reuse rows in several bands and narrow ones leave columns empty (mean 0).
    """
    h, w, y = F.col("height").cast("bigint"), F.col("width").cast("bigint"), F.col("y").cast("bigint")
    candidates = F.sequence(F.greatest(_div(y * 16, h) - 1, F.lit(0)), F.least(_div((y + 1) * 16, h) + 1, F.lit(15)))
    low = lambda row: _div(row * h, 16)
    touches = lambda row: (low(row) <= y) & (y < F.least(F.greatest(_div((row + 1) * h, 16), low(row) + 1), h))
    rows = pixels.select(
        "image_id", "width", luma_milli(F.col("r"), F.col("g"), F.col("b")).cast("bigint").alias("v"), F.col("x").cast("bigint").alias("x"),
        F.explode(F.filter(candidates, touches)).alias("row"),
    )
    grids = F.array(*[
        F.struct(F.lit(kind).alias("kind"), (F.col("row") * n + _div((F.col("x") + 1) * n - 1, w)).cast("int").alias("cell"))
        for kind, n in (("d", 17), ("a", 16))
    ])
    boxes = rows.select("image_id", "v", F.explode(grids).alias("g")).groupBy("image_id", "g.kind", "g.cell").agg(
        (F.sum("v").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean")
    )
    # 17 * 16 + 16 * 16 boxes per image whatever its size.
    maps = boxes.groupBy("image_id").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("cell", "mean")))).alias(k) for k in ("d", "a")
    ])
    dense = maps.select("image_id", _dense("d", 17 * 16).alias("d"), _dense("a", 16 * 16).alias("a"))

    def falls(i):
        at = _div(i, 16).cast("int") * 17 + i % 16
        return F.get("d", at) > F.get("d", at + 1)

    bits = dense.select(
        "image_id", F.transform(F.sequence(F.lit(0), F.lit(255)), falls).alias("d"), let(_in_order_mean(F.col("a"), 256), lambda m: F.transform("a", lambda v: v > m)).alias("a")
    )
    return bits.select("image_id", F.array(*[_word(F.col(k), 64 * i) for k in ("d", "a") for i in range(4)]).alias("words"))


def _dense(column: str, size: int) -> Column:
    every = F.sequence(F.lit(0), F.lit(size - 1))
    return let(F.col(column), lambda boxes: F.transform(every, lambda i: F.coalesce(F.try_element_at(boxes, i), F.lit(0.0))))


def gallery_hash(pixels: DataFrame) -> DataFrame:
    return gallery_words(pixels).select("image_id", F.array_join(F.transform("words", _hex), "").alias("gallery_hash"))


def marker_hashes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """25 signatures per region, one per shift of up to two pixels: 64 differences and 64
    darkness bits of a 9x8 point grid; points outside the image read as white.

    Regions meet whole image rows (complete frames are expected), so a region joins 40
    rows instead of 1,800 points.
    """
    axis = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    taps = boxes.where("error is null").withColumn("dy", axis(-2, 2)).withColumn("row", axis(0, 7)).withColumn(
        "y", (F.col("y0") + _div((F.col("row") * 2 + 1) * (F.col("y1") - F.col("y0")), 16) + F.col("dy")).cast("int")
    )
    # Only the image rows that some region reads are gathered.
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "luma"))), lambda p: p["luma"])
    wanted = pixels.join(taps.select("image_id", "y").distinct(), ["image_id", "y"], "left_semi")
    lines = luma(wanted).groupBy("image_id", "y").agg(line.alias("px"))
    wide = F.col("x1") - F.col("x0")
    points = F.transform(
        F.sequence(F.lit(-2), F.lit(2)),
        lambda dx: F.transform(
            F.sequence(F.lit(0), F.lit(8)),
            lambda col: F.coalesce(F.get("px", (F.col("x0") + _div((col * 2 + 1) * wide, 18) + dx).cast("int")), F.lit(255.0)),
        ),
    )
    seen = taps.join(lines, ["image_id", "y"], "left").select("image_id", "name", "dy", "row", points.alias("points"))
    # 8 rows of 5 x 9 points per region and dy by construction.
    rows = seen.groupBy("image_id", "name", "dy").agg(F.array_sort(F.collect_list(F.struct("row", "points"))).alias("rows"))
    shifts = rows.select("image_id", "name", "dy", "rows", axis(-2, 2).alias("dx"))
    grids = shifts.select(
        "image_id", "name", "dy", "dx", F.flatten(F.transform("rows", lambda r: F.get(r["points"], F.col("dx") + 2))).alias("v")
    )
    at = lambda i: _div(i, 8).cast("int") * 9 + i % 8
    every = F.sequence(F.lit(0), F.lit(63))
    bits = grids.select(
        "image_id", "name", "dy", "dx", F.transform(every, lambda i: F.get("v", at(i)) > F.get("v", at(i) + 1)).alias("d"),
        let(_in_order_mean(F.col("v"), 72), lambda m: F.transform(every, lambda i: F.get("v", at(i)) < m)).alias("k"),
    )
    return bits.select("image_id", "name", "dy", "dx", F.concat(_hex(_word(F.col("d"), 0)), _hex(_word(F.col("k"), 0))).alias("marker_hash"))


def near_words(signatures: DataFrame, word: str) -> DataFrame:
    """Pairs of distinct 64-bit signature words at most two bits apart, with their copies.

    Identical captures collapse first. Words within two bits share a neighbour at one bit,
    and at most 65 distinct words have the same neighbour, so no group can grow.
    """
    known = durable(signatures.groupBy(word).agg(F.count(F.lit(1)).alias("copies"), F.min("image_id").alias("first_image")))
    one = F.lit(1).cast("bigint")
    around = F.array(F.col(word), *[F.col(word).bitwiseXOR(F.shiftleft(one, i)) for i in range(64)])
    ball = known.select(word, F.explode(around).alias("near"))
    left, right = ball.select(F.col(word).alias("word_a"), "near"), ball.select(F.col(word).alias("word_b"), "near")
    pairs = left.join(right, "near").where("word_a < word_b").select("word_a", "word_b").distinct()
    side = lambda s: known.select(F.col(word).alias(f"word_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("first_image").alias(f"image_{s}"))
    return pairs.join(side("a"), "word_a").join(side("b"), "word_b").withColumn(
        "distance", F.bit_count(F.col("word_a").bitwiseXOR(F.col("word_b")))
    )


def near_signatures(signatures: DataFrame, distance: int = 7) -> DataFrame:
    """Pairs of distinct signatures (``words``: eight longs, 512 bits) at most ``distance`` bits apart, with their copies.

    Identical captures collapse first; ``hamming.near_pairs`` finds the pairs at any distance.
    """
    known = durable(signatures.groupBy("words").agg(F.count(F.lit(1)).alias("copies"), F.min("image_id").alias("image")))
    return near_pairs(known, distance)


# ---- gray planes ----


def _with_range(pixels: DataFrame, value: str) -> DataFrame:
    """Add the image's smallest and largest ``value``; a huge image is dealt over salts."""
    bounds = pixels.groupBy("image_id").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("_n"))
    return join_unique(pixels, bounds, ["image_id"], "_n", ["x", "y"]).drop("_n")


def gray_plane(pixels: DataFrame) -> DataFrame:
    """Contrast-stretched gray plane from 8.8 luma; a constant image is black."""
    v = pixels.select("image_id", "width", "height", "x", "y", luma_8p8(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    return _with_range(v, "l").select("image_id", "width", "height", "x", "y", stretch_8p8(F.col("l"), F.col("low"), F.col("high")).alias("v"))


def stretch_audit(pixels: DataFrame) -> DataFrame:
    """Per image: where the float stretch of milli luma differs from the exact one, and exact ties."""
    m = pixels.select("image_id", "x", "y", luma_milli(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    ranged = _with_range(m, "l")
    exact = stretch_int(F.col("l"), F.col("low"), F.col("high"))
    floating = stretch_float(F.col("l").cast("double"), F.col("low").cast("double"), F.col("high").cast("double"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1)).cast("bigint")
    tie = ((F.col("l") - F.col("low")).cast("bigint") * 510 + span) % (span * 2) == 0
    return ranged.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(exact != floating).alias("differing"), F.count_if(tie).alias("ties"),
        F.count_if((exact != floating) & tie).alias("differing_ties"),
    )


def upscaled(plane: DataFrame, scale: int) -> DataFrame:
    """Bilinear upscale by a whole factor with 16-bit weights, rounded half up once."""
    if scale <= 1:
        return plane
    value = F.shiftright(F.col("t") + (1 << 31), 32).cast("int").alias("v")
    return interpolated(plane, scale).select("image_id", "width", "height", "x", "y", value)


def stretched_after_upscale(pixels: DataFrame, scale: int) -> DataFrame:
    """Interpolate milli luma first and stretch to the source's range in floating point afterwards.

    At most one level from stretching first; plane_difference is the check.
    """
    m = pixels.select("image_id", "width", "height", "x", "y", luma_milli(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    one = F.lit(float(1 << 32))
    bounds = m.groupBy("image_id").agg(
        (F.min("v") * one).alias("low"), (F.max("v") * one).alias("high"), (F.count(F.lit(1)) * (scale * scale)).alias("_n")
    )
    wide = interpolated(m, scale).withColumn("l", F.col("t").cast("double"))
    ranged = join_unique(wide, bounds, ["image_id"], "_n", ["x", "y"])
    return ranged.select("image_id", "width", "height", "x", "y", stretch_float(F.col("l"), F.col("low"), F.col("high")).alias("v"))


def _lines(plane: DataFrame) -> DataFrame:
    """Image rows of complete frames: values in x order as ``px``."""
    ordered = F.array_sort(F.collect_list(F.struct("x", F.col("v").cast("int").alias("v"))))
    return plane.groupBy("image_id", "width", "height", "y").agg(F.transform(ordered, lambda p: p["v"]).alias("px"))


def interpolated(plane: DataFrame, scale: int) -> DataFrame:
    """Weighted sums ``t`` (value times 2**32) of a bilinear upscale of complete frames.

    Pixels meet once, as image rows. An output row is a weighted sum of at most two of those, which is
    where rows move again; its columns then come from taps inside the row.
    """
    near = F.sequence(F.greatest((F.col("y") - 1) * scale, F.lit(0)), F.least((F.col("y") + 2) * scale, F.col("height") * scale) - 1)
    spread = _lines(plane).withColumn("oy", F.explode(near)).withColumn("_t", axis_taps(F.col("oy"), F.col("height"), scale))
    first = F.when(F.col("_t.i0") == F.col("y"), 65536 - F.col("_t.w")).otherwise(F.lit(0))
    second = F.when(F.col("_t.i1") == F.col("y"), F.col("_t.w")).otherwise(F.lit(0))
    weighed = spread.withColumn("wy", (first + second).cast("bigint")).where("wy > 0")
    parts = weighed.groupBy("image_id", "width", "height", "oy").agg(F.collect_list(F.struct("wy", "px")).alias("parts"))

    def upright(p: Column) -> Column:
        one, two = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        alone = F.transform(one["px"], lambda v: v * one["wy"])
        return F.when(F.size(p) == 1, alone).otherwise(F.zip_with(one["px"], two["px"], lambda a, b: a * one["wy"] + b * two["wy"]))

    def across(line: Column) -> Column:
        def tap(ox: Column) -> Column:
            return let(axis_taps(ox, F.col("width"), scale), lambda t: F.get(line, t["i0"].cast("int")) * (65536 - t["w"]) + F.get(line, t["i1"].cast("int")) * t["w"])

        return F.transform(F.sequence(F.lit(0), F.col("width") * scale - 1), tap)

    rows = parts.select("image_id", "width", "height", "oy", F.posexplode(let(upright(F.col("parts")), across)).alias("x", "t"))
    return rows.select(
        "image_id", (F.col("width") * scale).alias("width"), (F.col("height") * scale).alias("height"), F.col("x").cast("int").alias("x"), F.col("oy").cast("int").alias("y"),
        F.col("t").cast("bigint").alias("t"),
    )


def downscaled(plane: DataFrame, scale: float) -> DataFrame:
    """Area-average downscale of complete frames; output spans may overlap where the sizes do not divide.

    Each image row is summed to the output's columns first, so what meets by output pixel is a partial sum per row.
    """
    size = lambda c: F.greatest(F.floor(F.col(c) * F.lit(float(scale)) + F.lit(0.5)), F.lit(1)).cast("bigint")
    lines = _lines(plane).withColumn("ow", size("width")).withColumn("oh", size("height"))

    def box(ox: Column) -> Column:
        low, high = (f(ox, F.col("width"), F.col("ow")) for f in (span_low, span_high))
        inside = let(F.slice("px", low.cast("int") + 1, (high - low).cast("int")), lambda part: F.struct(
            F.aggregate(part, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("s"), F.size(part).cast("bigint").alias("n")
        ))
        return F.struct(ox.alias("ox"), inside.alias("b"))

    summed = lines.withColumn("boxes", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("ow") - 1), box))
    middle = _div(F.col("y").cast("bigint") * F.col("oh"), F.col("height").cast("bigint"))
    spread = summed.withColumn("oy", F.explode(F.sequence(F.greatest(middle - 1, F.lit(0)), F.least(middle + 1, F.col("oh") - 1))))
    low, high = (f(F.col("oy"), F.col("height"), F.col("oh")) for f in (span_low, span_high))
    hit = spread.where((F.col("y") >= low) & (F.col("y") < high)).select("image_id", "ow", "oh", "oy", F.explode("boxes").alias("box"))
    boxes = hit.groupBy("image_id", "ow", "oh", F.col("box.ox").alias("ox"), "oy").agg(F.sum("box.b.s").alias("s"), F.sum("box.b.n").alias("n"))
    return boxes.select(
        "image_id", F.col("ow").cast("int").alias("width"), F.col("oh").cast("int").alias("height"), F.col("ox").cast("int").alias("x"),
        F.col("oy").cast("int").alias("y"), _div(F.col("s") + _div(F.col("n"), 2), F.col("n")).cast("int").alias("v"),
    )


def plane_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of two planes side by side; ``delta`` is null where one has no pixel."""
    left, right = (p.select("image_id", "x", "y", F.col("v").alias(n)) for p, n in ((a, "a"), (b, "b")))
    return left.join(right, ["image_id", "x", "y"], "full_outer").withColumn("delta", F.abs(F.col("a") - F.col("b")))


def difference_summary(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels, differing pixels, percent and largest delta; unmatched pixels are an error."""
    out = diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("delta") > 0).alias("differing"), F.coalesce(F.max("delta"), F.lit(0)).alias("max_delta"),
        F.count_if(F.col("delta").isNull()).alias("unmatched"),
    )
    return out.withColumn("pct", F.col("differing") * 100.0 / F.col("pixels")).withColumn(
        "error", F.when(F.col("unmatched") > 0, "dimension mismatch")
    )


def delta_histogram(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per delta 1..8 and their percent of all; empty deltas are left out."""
    counts = diff.groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return counts.where(F.col("delta").between(1, 8)).join(whole, keys).withColumn("pct", F.col("n") * 100.0 / F.col("_all")).drop("_all")


def stitched(tiles: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Vertical tiles of one document placed below each other."""
    return tiles.withColumn("y", F.col("y") + F.col("tile") * rows).drop("tile")


def scanlines(plane: DataFrame) -> DataFrame:
    """One row per image row, values in x order (an image row is at most one frame wide)."""
    ordered = F.array_sort(F.collect_list(F.struct("x", F.col("v").cast("smallint").alias("v"))))
    return plane.groupBy("image_id", "width", "height", "y").agg(F.transform(ordered, lambda p: p["v"]).alias("px"))


def map_scanlines(lines: DataFrame, kernel) -> DataFrame:
    """Apply ``kernel((rows, width) array) -> array of that shape`` to the rows of images, all rows of one width in an Arrow batch at once."""

    def batches(frames):
        for frame in frames:
            sizes = frame["px"].map(len).to_numpy()
            out = np.empty(len(frame), object)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                out[at] = list(kernel(np.stack(frame["px"].iloc[at].to_numpy())))
            yield frame.assign(px=out)

    return lines.mapInPandas(batches, lines.schema)
