"""Pixel facts over embeddings: each 64-value vector is an 8x8 image."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import luma as P
from ..operators import contest
from ..operators import pixels as X
from ..session import durable, shared_folder
from ..sources import images
from ..tables import table
from .registry import register


def pixels(spark, folder):
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    k = F.greatest(F.least(F.floor((F.col("v").cast("double") + 1) * F.lit(127.5)), F.lit(255)), F.lit(0)).cast("int")
    return v.withColumn("k", k).select(
        "image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"),
        ((F.col("k") * 3 + 101) % 256).alias("b"), ((F.col("k") * 7 + 31) % 256).alias("g"), F.col("k").alias("r"),
    )


def tall(spark, folder):
    """Four vectors stitched into one 8x32 image."""
    tiles = pixels(spark, folder).withColumn("tile", (F.col("image_id") % 4).cast("int")).withColumn("image_id", F.floor(F.col("image_id") / 4))
    return X.stitched(tiles.withColumn("height", F.lit(32)), rows=8)


SQL_PX = """k as (select vec_id as image_id, cast(i - 1 as int) as pos, cast(greatest(least(floor((e::double + 1) * 127.5::double), 255), 0) as int) as k
    from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings)),
  p0 as (select image_id, 8 as width, 8 as height, pos % 8 as x, cast(pos // 8 as int) as y, (k * 3 + 101) % 256 as b, (k * 7 + 31) % 256 as g, k as r from k)"""
SQL_P = SQL_PX + ", p as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b as luma, 299 * r + 587 * g + 114 * b as milli, 77 * r + 150 * g + 29 * b as l8 from p0)"
SQL_TALL = SQL_PX + """, p as (select image_id // 4 as image_id, width, 32 as height, x, cast(y + 8 * (image_id % 4) as int) as y, b, g, r,
    0.299::double * r + 0.587::double * g + 0.114::double * b as luma, 299 * r + 587 * g + 114 * b as milli, 77 * r + 150 * g + 29 * b as l8 from p0)"""


@register("pixel_luma", f"with {SQL_P} select image_id, x, y, round(luma, 6) as luma_f, milli as luma_milli, l8 as luma_8p8, b * r // 255 as premultiplied from p")
def pixel_luma(spark, folder):
    c = [F.col(n) for n in ("r", "g", "b")]
    return pixels(spark, folder).select(
        "image_id", "x", "y", F.round(P.luma_f(*c), 6).alias("luma_f"), P.luma_milli(*c).alias("luma_milli"), P.luma_8p8(*c).alias("luma_8p8"),
        P.alpha_premultiply(F.col("b"), F.col("r")).alias("premultiplied"),
    )


@register("tile_stitch", f"with {SQL_TALL} select image_id, x, y, r, height from p")
def tile_stitch(spark, folder):
    return tall(spark, folder).select("image_id", "x", "y", "r", "height")


@register("pixel_sample", f"with {SQL_TALL} select image_id, x, y, r, 3 as step from p where x % 3 = 0 and y % 3 = 0")
def pixel_sample(spark, folder):
    return X.sampled(tall(spark, folder), 20).select("image_id", "x", "y", "r", "step")


SQL_PAINT = """bands as (select {keys}, cast(floor(luma) as int) >> 3 as band, count(*) as n, sum(luma) as s, sum(luma * luma) as q from {src} group by all),
  paint as (select {keys}, cast(sum(n) as bigint) as pixels, sum(s) / sum(n) as mean, greatest(sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 0) as var,
    max(n)::double / sum(n) as dom, cast(len(list_filter(list(n), lambda c: c > 0.001)) as int) as distinct_bands from bands group by all)"""
SQL_PAINT_OUT = """pixels, round(mean, 9) as luma_mean, round(var, 3) as luma_variance, round(dom, 6) as dominant_luma_frac,
    distinct_bands as distinct_luma_bands, var >= 8 and distinct_bands >= 4 and dom < 0.98 as painted"""


def rounded(df):
    return df.withColumns({"luma_mean": F.round("luma_mean", 9), "luma_variance": F.round("luma_variance", 3), "dominant_luma_frac": F.round("dominant_luma_frac", 6)})


@register("paint_statistics", f"with {SQL_P}, {SQL_PAINT.format(keys='image_id', src='p')} select image_id, {SQL_PAINT_OUT} from paint")
def paint_statistics(spark, folder):
    return rounded(X.paint_statistics(X.sampled(pixels(spark, folder)), ["image_id"]))


@register(
    "paint_statistics_sampled",
    f"with {SQL_TALL}, t as (select * from p where x % 3 = 0 and y % 3 = 0), {SQL_PAINT.format(keys='image_id', src='t')} select image_id, {SQL_PAINT_OUT} from paint",
)
def paint_statistics_sampled(spark, folder):
    return rounded(X.paint_statistics(X.sampled(tall(spark, folder), 20), ["image_id"]))


CELL = {"min_colors": 3, "min_colored": 0.5, "min_saturation": 100.0, "min_variance": 40.0}
SQL_CELL = """count(distinct (r >> 5) * 64 + (g >> 5) * 8 + (b >> 5)) >= 3 and (count(*) filter (where greatest(r, g, b) - least(r, g, b) > 100))::double / count(*) >= 0.5
    and sum(luma * luma) / count(*) - (sum(luma) / count(*)) * (sum(luma) / count(*)) >= 40"""
SQL_CELLS = f"""cells as (select image_id, cast(y // 4 as int) as cell_y, cast(x // 4 as int) as cell_x, {SQL_CELL} as photo from p where (x % 4) % 2 = 0 and (y % 4) % 2 = 0 group by 1, 2, 3)"""


def cells(spark, folder):
    return X.photo_cells(tall(spark, folder), ["image_id"], 4, F.lit(2), F.lit(0), F.lit(0), **CELL)


@register("photo_cells", f"with {SQL_TALL}, {SQL_CELLS} select image_id, cell_y, cell_x, photo from cells")
def photo_cells(spark, folder):
    return cells(spark, folder).drop("colors")


@register(
    "photo_grid",
    f"with {SQL_TALL}, {SQL_CELLS} select image_id, count(*) filter (where photo) as photo_like_cells, count(*) as grid_cells, list(photo order by cell_y, cell_x) as mask from cells group by 1",
)
def photo_grid(spark, folder):
    return X.photo_grid(cells(spark, folder), ["image_id"])


def boxes(spark, folder):
    vectors = table(spark, folder, "embeddings")
    images_table = vectors.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    number = lambda v: F.lit(float(v))
    box = lambda name, x, y, w, h: F.struct(F.lit(name).alias("name"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    regions = F.explode(F.array(
        box("part", F.col("label") * number(0.7), number(1.3), number(4.5), number(3.2)), box("outside", number(9), number(0), number(3), number(3)),
        box("all", number(-1), number(-1), number(20), number(20)),
    )).alias("r")
    return X.clamped_regions(vectors.select(F.col("vec_id").alias("image_id"), regions).select("image_id", "r.*"), images_table)


SQL_BOXES = """b0 as (select vec_id as image_id, 'part' as name, label * 0.7::double as x, 1.3::double as y, 4.5::double as w, 3.2::double as h from embeddings
    union all select vec_id, 'outside', 9, 0, 3, 3 from embeddings union all select vec_id, 'all', -1, -1, 20, 20 from embeddings),
  boxes as (select image_id, name, cast(least(greatest(floor(x), 0), 8) as int) as x0, cast(least(greatest(floor(y), 0), 8) as int) as y0,
    cast(least(greatest(ceil(x + w), 0), 8) as int) as x1, cast(least(greatest(ceil(y + h), 0), 8) as int) as y1 from b0),
  crop as (select p.*, name, x0, y0, x1, y1, list_min(list_filter(range(1, 20), lambda s: ((x1 - x0) // s) * ((y1 - y0) // s) <= 12)) as step
    from p join boxes using (image_id) where x >= x0 and x < x1 and y >= y0 and y < y1)"""


@register(
    "region_boxes",
    f"with {SQL_P}, {SQL_BOXES} select image_id, name, x0, y0, x1, y1, case when x1 <= x0 or y1 <= y0 then 'region has no painted box' end as error from boxes",
)
def region_boxes(spark, folder):
    return boxes(spark, folder)


@register("region_crop", f"with {SQL_P}, {SQL_BOXES} select image_id, name, x, y, r from crop")
def region_crop(spark, folder):
    return X.cropped(pixels(spark, folder), boxes(spark, folder)).select("image_id", "name", "x", "y", "r")


@register(
    "region_statistics",
    f"""with {SQL_P}, {SQL_BOXES}, taken as (select * from crop where (x - x0) % step = 0 and (y - y0) % step = 0), {SQL_PAINT.format(keys='image_id, name', src='taken')},
        cells as (select image_id, name, (y - y0) // 4 as cy, (x - x0) // 4 as cx, {SQL_CELL} as photo from crop
          where ((x - x0) % 4) % greatest(step, 2) = 0 and ((y - y0) % 4) % greatest(step, 2) = 0 group by 1, 2, 3, 4),
        photos as (select image_id, name, count(*) filter (where photo) as photo_like_cells from cells group by 1, 2)
        select image_id, name, {SQL_PAINT_OUT}, photo_like_cells from paint join photos using (image_id, name)""",
)
def region_statistics(spark, folder):
    crops = X.cropped(pixels(spark, folder), boxes(spark, folder))
    return rounded(X.region_statistics(crops, 12, 4, **CELL))


@register(
    "rect_widening",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, cast(floor(l_extendedprice) as bigint) as x, cast(floor(l_discount) as bigint) as y,
        cast(ceil(l_extendedprice + l_quantity / 3) - floor(l_extendedprice) as bigint) as width, cast(ceil(l_discount + l_tax * 40) - floor(l_discount) as bigint) as height from lineitem""",
)
def rect_widening(spark, folder):
    rect = X.widened(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity") / 3, F.col("l_tax") * 40)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", rect.alias("q")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "q.x", "q.y", "q.width", "q.height"
    )


def sql_gallery(word: str) -> str:
    return f"""rows as (select p.image_id, r.row, p.x, p.width, p.milli from p join (select unnest(range(16)) as row) r
      on p.y >= r.row * p.height // 16 and p.y < least(greatest((r.row + 1) * p.height // 16, r.row * p.height // 16 + 1), p.height)),
    dm as (select image_id, row * 17 + ((x + 1) * 17 - 1) // width as cell, sum(milli)::double / count(*) as m from rows group by 1, 2),
    am as (select image_id, row * 16 + ((x + 1) * 16 - 1) // width as cell, sum(milli)::double / count(*) as m from rows group by 1, 2),
    ids as (select distinct image_id from p),
    dd as (select image_id, list(coalesce(m, 0) order by cell) as d from (select image_id, unnest(range(272)) as cell from ids) left join dm using (image_id, cell) group by 1),
    aa as (select image_id, list(coalesce(m, 0) order by cell) as a from (select image_id, unnest(range(256)) as cell from ids) left join am using (image_id, cell) group by 1),
    w as (select image_id, d, a, list_reduce(a, lambda s, v: s + v) / 256 as m from dd join aa using (image_id)),
    bits as (select image_id, list_transform(range(256), lambda i: d[(i // 16) * 17 + i % 16 + 1] > d[(i // 16) * 17 + i % 16 + 2]) || list_transform(a, lambda v: v > m) as bits from w),
    words as (select image_id, list_transform(range(8), lambda q: list_sum(list_transform(range(64), lambda i: case when bits[q * 64 + i + 1] then (1::ubigint << i::ubigint) else 0::ubigint end))::ubigint) as words from bits)
    select image_id, {word} from words"""


SQL_HASH = "list_reduce(list_transform(words, lambda v: lpad(lower(to_hex(v)), 16, '0')), lambda s, t: s || t) as gallery_hash"


@register("gallery_hash", f"with {SQL_P}, {sql_gallery(SQL_HASH)}")
def gallery_hash(spark, folder):
    return X.gallery_hash(pixels(spark, folder))


@register("gallery_hash_tall", f"with {SQL_TALL}, {sql_gallery(SQL_HASH)}")
def gallery_hash_tall(spark, folder):
    return X.gallery_hash(tall(spark, folder))


@register(
    "marker_hashes",
    f"""with {SQL_P}, {SQL_BOXES}, pts as (select image_id, name, dy, dx, row * 9 + col as slot, x0 + ((col * 2 + 1) * (x1 - x0)) // 18 + dx as x, y0 + ((row * 2 + 1) * (y1 - y0)) // 16 + dy as y
          from boxes, (select unnest(range(-2, 3)) as dy), (select unnest(range(-2, 3)) as dx), (select unnest(range(8)) as row), (select unnest(range(9)) as col) where x1 > x0 and y1 > y0),
        v as (select pts.image_id, name, dy, dx, list(coalesce(luma, 255) order by slot) as v from pts left join p on p.image_id = pts.image_id and p.x = pts.x and p.y = pts.y group by 1, 2, 3, 4),
        m as (select *, list_reduce(v, lambda a, b: a + b) / 72 as m from v)
        select image_id, name, cast(dy as int) as dy, cast(dx as int) as dx,
          lpad(lower(to_hex(list_sum(list_transform(range(64), lambda i: case when v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] then (1::ubigint << i::ubigint) else 0::ubigint end))::ubigint)), 16, '0') ||
          lpad(lower(to_hex(list_sum(list_transform(range(64), lambda i: case when v[(i // 8) * 9 + i % 8 + 1] < m then (1::ubigint << i::ubigint) else 0::ubigint end))::ubigint)), 16, '0') as marker_hash from m""",
)
def marker_hashes(spark, folder):
    return X.marker_hashes(pixels(spark, folder), boxes(spark, folder))


@register(
    "near_captures",
    f"""with {SQL_P}, {sql_gallery('words[5] as w').replace('select image_id, words[5] as w from words', ', known as (select w, count(*) as copies, min(image_id) as first from (select image_id, words[5] as w from words) group by 1)')}
        select lower(to_hex(a.w)) as word_a, lower(to_hex(b.w)) as word_b, a.copies as copies_a, b.copies as copies_b, a.first as image_a, b.first as image_b, cast(bit_count(xor(a.w, b.w)) as int) as distance
        from known a join known b on (case when a.w >= 9223372036854775808 then a.w::hugeint - 18446744073709551616 else a.w::hugeint end) < (case when b.w >= 9223372036854775808 then b.w::hugeint - 18446744073709551616 else b.w::hugeint end) and bit_count(xor(a.w, b.w)) <= 2""",
)
def near_captures(spark, folder):
    # The first word of the brightness half: pixels decide its bits one by one.
    words = X.gallery_words(pixels(spark, folder)).select("image_id", F.get("words", F.lit(4)).alias("word"))
    pairs = X.near_words(words, "word")
    return pairs.withColumn("word_a", F.lower(F.hex("word_a"))).withColumn("word_b", F.lower(F.hex("word_b")))


def recaptures(spark, folder):
    """Whole signatures, each with a second capture that differs in up to nine bits spread over the words, and every fifth with an exact copy."""
    # Stored, as the optimizer would make each signature again for every place that reads it.
    words = durable(X.gallery_words(pixels(spark, folder)))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("image_id") % 61).cast("int"))
    flips = (F.col("image_id") % 10).cast("int")
    changed = F.transform("words", lambda w, i: F.when(i < flips, w.bitwiseXOR(bit)).otherwise(w))
    twice = F.transform(changed, lambda w, i: F.when((i == 0) & (flips == 9), w.bitwiseXOR(F.shiftleft(bit, 1))).otherwise(w))
    one = lambda more, w: F.struct((F.col("image_id") + more).alias("image_id"), w.alias("words"))
    copy = F.when(F.col("image_id") % 5 == 0, one(2_000_000, F.col("words")))
    # The new id comes after the words: within one select, a lambda would read it in place of the old one.
    each = words.withColumn("twice", twice).select(F.explode(F.array(one(0, F.col("words")), one(1_000_000, F.col("twice")), copy)).alias("c"))
    return each.where("c is not null").select("c.image_id", "c.words")


def sql_near(distance: int) -> str:
    return f"""with {SQL_P}, {sql_gallery('words as w').replace('select image_id, words as w from words', ', s as (select image_id, words as w from words)')},
        bit as (select image_id, w, 1::ubigint << (image_id % 61)::int as b, image_id % 10 as flips from s),
        c as (select image_id, w from s
          union all select image_id + 1000000, list_transform(list_zip(w, range(8)), lambda z: case when z[1] is null then null
              when z[2] < flips then xor(xor(z[1], b), case when z[2] = 0 and flips = 9 then b << 1 else 0::ubigint end) else z[1] end) from bit
          union all select image_id + 2000000, w from s where image_id % 5 = 0),
        known as (select w, count(*) as copies, min(image_id) as image from c group by 1)
        select a.image as image_a, b.image as image_b, list_sum(list_transform(list_zip(a.w, b.w), lambda z: bit_count(xor(z[1], z[2]))))::int as distance, a.copies as copies_a, b.copies as copies_b
        from known a join known b on a.image < b.image and list_sum(list_transform(list_zip(a.w, b.w), lambda z: bit_count(xor(z[1], z[2])))) <= {distance}"""


@register("near_captures_whole", sql_near(7))
def near_captures_whole(spark, folder):
    return X.near_signatures(recaptures(spark, folder))


@register("near_captures_wide", sql_near(16))
def near_captures_wide(spark, folder):
    """Captures that a changed banner or clock sets apart by more than the seven bits of eight equal words."""
    return X.near_signatures(recaptures(spark, folder), 16)


SQL_GRAY = """mm as (select image_id, min(l8) as lo, max(l8) as hi from p group by 1),
  gray as (select p.image_id, width, height, x, y, case when lo = 0 and hi = 65280 then (l8 + 128) >> 8
    else least((510 * (l8 - lo)::bigint + greatest(hi - lo, 1)) // (2 * greatest(hi - lo, 1)), 255) end as v from p join mm using (image_id))"""


@register("gray_plane", f"with {SQL_P}, {SQL_GRAY} select image_id, x, y, cast(v as int) as v from gray")
def gray_plane(spark, folder):
    return X.gray_plane(pixels(spark, folder)).select("image_id", "x", "y", "v")


SQL_AUDIT = """mm as (select image_id, min(milli) as lo, max(milli) as hi from p group by 1),
  s as (select p.image_id, x, y, cast(least((510 * (milli - lo)::bigint + greatest(hi - lo, 1)) // (2 * greatest(hi - lo, 1)), 255) as int) as a,
    cast(floor((milli - lo)::double / (case when hi - lo < 0.000001 then 1 else hi - lo end)::double * 255.0::double + 0.5::double) as int) as b,
    (510 * (milli - lo)::bigint + greatest(hi - lo, 1)) % (2 * greatest(hi - lo, 1)) = 0 as tie from p join mm using (image_id))"""


@register(
    "stretch_audit",
    f"""with {SQL_P}, {SQL_AUDIT} select image_id, count(*) as pixels, count(*) filter (where a <> b) as differing, count(*) filter (where tie) as ties,
        count(*) filter (where a <> b and tie) as differing_ties from s group by 1""",
)
def stretch_audit(spark, folder):
    return X.stretch_audit(pixels(spark, folder))


SQL_TAPS = """ax as (select o, case when f < 0 then 0 when f > n - 1 then n - 1 else f end as i0, case when f + 1 < 0 then 0 when f + 1 > n - 1 then n - 1 else f + 1 end as i1,
    (((2 * o + 1 - {s}) - f * 2 * {s}) * 65536 + {s}) // (2 * {s}) as w from (select o, n, cast(floor((2 * o + 1 - {s})::double / (2 * {s})) as bigint) as f from (select unnest(range({n} * {s})) as o, {n} as n)))"""


def sql_up(s: int, axis: str = "ax") -> str:
    return f"""up as (select a.image_id, x.o as x, y.o as y, cast(((a.v::bigint * (65536 - x.w) + b.v::bigint * x.w) * (65536 - y.w) + (c.v::bigint * (65536 - x.w) + d.v::bigint * x.w) * y.w + 2147483648) >> 32 as int) as v
      from ax x, ax y, gray a, gray b, gray c, gray d where a.x = x.i0 and a.y = y.i0 and b.image_id = a.image_id and b.x = x.i1 and b.y = y.i0
      and c.image_id = a.image_id and c.x = x.i0 and c.y = y.i1 and d.image_id = a.image_id and d.x = x.i1 and d.y = y.i1)"""


@register("upscale_2x", f"with {SQL_P}, {SQL_GRAY}, {SQL_TAPS.format(s=2, n=8)}, {sql_up(2)} select image_id, cast(x as int) as x, cast(y as int) as y, v from up")
def upscale_2x(spark, folder):
    return X.upscaled(X.gray_plane(pixels(spark, folder)), 2).select("image_id", "x", "y", "v")


@register("upscale_3x", f"with {SQL_P}, {SQL_GRAY}, {SQL_TAPS.format(s=3, n=8)}, {sql_up(3)} select image_id, cast(x as int) as x, cast(y as int) as y, v from up")
def upscale_3x(spark, folder):
    return X.upscaled(X.gray_plane(pixels(spark, folder)), 3).select("image_id", "x", "y", "v")


def sql_milli_up(s: int) -> str:
    return f"""mu as (select a.image_id, x.o as x, y.o as y, ((a.milli::bigint * (65536 - x.w) + b.milli::bigint * x.w) * (65536 - y.w) + (c.milli::bigint * (65536 - x.w) + d.milli::bigint * x.w) * y.w)::double as l
      from ax x, ax y, p a, p b, p c, p d where a.x = x.i0 and a.y = y.i0 and b.image_id = a.image_id and b.x = x.i1 and b.y = y.i0
      and c.image_id = a.image_id and c.x = x.i0 and c.y = y.i1 and d.image_id = a.image_id and d.x = x.i1 and d.y = y.i1),
      mr as (select image_id, min(milli)::double * 4294967296 as lo, max(milli)::double * 4294967296 as hi from p group by 1),
      late as (select mu.image_id, x, y, cast(floor((l - lo) / (case when hi - lo < 0.000001 then 1 else hi - lo end) * 255.0::double + 0.5::double) as int) as v from mu join mr using (image_id))"""


@register(
    "stretch_order",
    f"""with {SQL_P}, {SQL_GRAY}, {SQL_TAPS.format(s=2, n=8)}, {sql_up(2)}, {sql_milli_up(2)}
        select image_id, count(*) as pixels, count(*) filter (where up.v <> late.v) as differing, max(abs(up.v - late.v)) as max_delta from up join late using (image_id, x, y) group by 1""",
)
def stretch_order(spark, folder):
    px = pixels(spark, folder)
    first, last = X.upscaled(X.gray_plane(px), 2), X.stretched_after_upscale(px, 2)
    return X.difference_summary(X.plane_difference(first, last), ["image_id"]).select("image_id", "pixels", "differing", "max_delta")


def sql_down(s: float) -> str:
    on = int(8 * s + 0.5)
    return f"""ax as (select o, o * 8 // {on} as lo, greatest(least(((o + 1) * 8 + {on} - 1) // {on}, 8), o * 8 // {on} + 1) as hi from (select unnest(range({on})) as o)),
      down as (select image_id, cast(x.o as int) as x, cast(y.o as int) as y, cast((sum(v) + count(*) // 2) // count(*) as int) as v from gray join ax x on gray.x >= x.lo and gray.x < x.hi join ax y on gray.y >= y.lo and gray.y < y.hi group by 1, 2, 3)"""


@register("downscale_half", f"with {SQL_P}, {SQL_GRAY}, {sql_down(0.5)} select image_id, x, y, v from down")
def downscale_half(spark, folder):
    return X.downscaled(X.gray_plane(pixels(spark, folder)), 0.5).select("image_id", "x", "y", "v")


@register("downscale_overlapping", f"with {SQL_P}, {SQL_GRAY}, {sql_down(0.6)} select image_id, x, y, v from down")
def downscale_overlapping(spark, folder):
    return X.downscaled(X.gray_plane(pixels(spark, folder)), 0.6).select("image_id", "x", "y", "v")


def milli_plane(spark, folder):
    return pixels(spark, folder).select("image_id", "x", "y", P.luma_milli(F.col("r"), F.col("g"), F.col("b")).alias("l"))


def two_planes(spark, folder):
    """Gray plane from 8.8 luma and the float stretch of double luma: close, not equal."""
    px = pixels(spark, folder)
    ranged = X._with_range(px.select("image_id", "x", "y", P.luma_f(F.col("r"), F.col("g"), F.col("b")).alias("l")), "l")
    floating = ranged.select("image_id", "x", "y", P.stretch_float(F.col("l"), F.col("low"), F.col("high")).alias("v"))
    return X.plane_difference(X.gray_plane(px), floating)


SQL_TWO = SQL_P + ", " + SQL_GRAY + """, fm as (select image_id, min(luma) as lo, max(luma) as hi from p group by 1),
  fl as (select p.image_id, x, y, cast(floor((luma - lo) / (case when hi - lo < 0.000001 then 1 else hi - lo end) * 255.0::double + 0.5::double) as int) as v from p join fm using (image_id)),
  diff as (select gray.image_id, x, y, abs(gray.v - fl.v) as delta from gray full join fl using (image_id, x, y))"""


@register(
    "pixel_difference",
    f"""with {SQL_TWO} select image_id, count(*) as pixels, count(*) filter (where delta > 0) as differing, cast(max(delta) as int) as max_delta,
        0::bigint as unmatched, round(count(*) filter (where delta > 0) * 100.0::double / count(*), 6) as pct, null::varchar as error from diff group by 1""",
)
def pixel_difference(spark, folder):
    return X.difference_summary(two_planes(spark, folder), ["image_id"]).withColumn("pct", F.round("pct", 6))


@register(
    "pixel_delta_histogram",
    f"""with {SQL_TWO}, l as (select label, delta from diff join embeddings on vec_id = image_id) select label, cast(delta as int) as delta, count(*) as n,
        round(count(*) * 100.0::double / (select count(*) from l x where x.label = l.label), 6) as pct from l where delta between 1 and 8 group by 1, 2""",
)
def pixel_delta_histogram(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return X.delta_histogram(two_planes(spark, folder).join(labels, "image_id"), ["label"]).withColumn("pct", F.round("pct", 6))


@register(
    "pixel_quality_gate",
    f"""with {SQL_TWO}, f as (select label as spec, image_id as fixture, count(*) as pixels, count(*) filter (where delta > 0) as differing, max(delta) as max_delta
          from diff join embeddings on vec_id = image_id group by 1, 2)
        select spec, bool_and(differing * 100.0::double / pixels <= 10.0 and max_delta <= 1) as eligible from f group by 1""",
)
def pixel_quality_gate(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("spec"))
    summary = X.difference_summary(two_planes(spark, folder).join(labels, "image_id"), ["spec", "image_id"])
    return contest.gate(summary, most_percent=10.0)


@register(
    "scanline_kernel",
    f"with {SQL_P}, {SQL_GRAY} select image_id, y, cast(sum((255 - v) * (x + 1)) as bigint) as checksum from gray group by 1, 2",
)
def scanline_kernel(spark, folder):
    lines = X.map_scanlines(X.scanlines(X.gray_plane(pixels(spark, folder))), lambda px: 255 - px)
    checksum = F.aggregate(F.transform("px", lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return lines.select("image_id", "y", checksum.alias("checksum"))


@register("image_sink_rows", f"with {SQL_P}, {SQL_GRAY} select image_id, y, string_agg(lower(printf('%02x', cast(v as int))), '' order by x) as row_hex from gray group by 1, 2")
def image_sink_rows(spark, folder):
    """Planes stored one binary row per image row, read back."""
    stored = images.write_planes(X.gray_plane(pixels(spark, folder)))
    return stored.select("image_id", "y", F.lower(F.hex("row")).alias("row_hex"))


@register("source_images", f"with {SQL_PX} select image_id // 128 as image_id, x, cast(y + 8 * (image_id % 128) as int) as y, b, g, r from p0")
def source_images(spark, folder):
    """PNG files of 128 vectors each, written and scanned back to pixels."""
    place = F.col("y") + 8 * (F.col("image_id") % 128).cast("int")
    last = F.lit(128 * 8)
    stitched = pixels(spark, folder).select(F.floor(F.col("image_id") / 128).alias("image_id"), "width", last.alias("height"), "x", place.alias("y"), "b", "g", "r")
    path = os.path.join(shared_folder(spark), f"pngs-{uuid.uuid4().hex}")
    durable(images.write_pngs(stitched, path))
    back = images.pixel_rows(images.read_images(spark, path))
    inside = stitched.select("image_id", F.col("y")).distinct()
    found = back.withColumn("image_id", F.regexp_extract("origin", "([0-9]+)[.]png$", 1).cast("bigint")).join(inside, ["image_id", "y"], "left_semi")
    return found.select("image_id", "x", "y", *[F.col(c).cast("int").alias(c) for c in ("b", "g", "r")])


@register("source_pgm", f"with {SQL_P}, {SQL_GRAY} select image_id, x, y, cast(v as int) as v from gray")
def source_pgm(spark, folder):
    """PGM bytes built from the gray planes and scanned back to pixels."""
    rows = X.gray_plane(pixels(spark, folder)).select("image_id", "width", "height", "x", "y", "v")
    # one whole file per image is what a PGM is
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "")
    files = rows.groupBy("image_id", "width", "height").agg(body.alias("body"))
    header = F.concat(F.lit("P5\n# plane\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    content = F.concat(F.encode(header, "UTF-8"), F.unhex("body"))
    return images.pgm_pixels(files.select("image_id", content.alias("content"))).select("image_id", "x", "y", "v")


@register(
    "source_png_catalogue",
    """select vec_id as image_id, cast(label * 100 + 1 as bigint) as width, cast(vec_id + 1 as bigint) as height, 8 as bit_depth, cast((vec_id % 4) * 2 as int) as color_type,
        vec_id % 4 in (1, 3) as fast_path from embeddings""",
)
def source_png_catalogue(spark, folder):
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    head = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), hexed(F.col("label") * 100 + 1, 8), hexed(F.col("vec_id") + 1, 8), F.lit("08"),
        hexed((F.col("vec_id") % 4) * 2, 2), F.lit("000000"),
    )
    files = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), F.unhex(head).alias("content"))
    return images.png_catalogue(files).select("image_id", "width", "height", "bit_depth", "color_type", "fast_path")
