"""Pixel arithmetic. The three luma definitions are different on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma_f(r: Column, g: Column, b: Column) -> Column:
    """Double luma, summed left to right."""
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def luma_milli(r: Column, g: Column, b: Column) -> Column:
    return (r.cast("int") * 299 + g.cast("int") * 587 + b.cast("int") * 114).cast("int")


def luma_8p8(r: Column, g: Column, b: Column) -> Column:
    return (r.cast("int") * 77 + g.cast("int") * 150 + b.cast("int") * 29).cast("int")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def alpha_premultiply(channel: Column, alpha: Column) -> Column:
    return _div(channel.cast("int") * alpha.cast("int"), 255).cast("int")


def stretch_int(v: Column, low: Column, high: Column) -> Column:
    """Exact-integer contrast stretch with round half up; a constant image is black."""
    span = F.greatest(high - low, F.lit(1)).cast("bigint")
    return F.least(_div((v - low).cast("bigint") * 510 + span, span * 2), F.lit(255)).cast("int")


def stretch_8p8(v: Column, low: Column, high: Column) -> Column:
    """A full-range 8.8 plane is only rounded down to bytes, any other is stretched."""
    return F.when((low == 0) & (high == 65280), F.shiftright(v + 128, 8)).otherwise(stretch_int(v, low, high)).cast("int")


def stretch_float(v: Column, low: Column, high: Column) -> Column:
    span = high - low
    span = F.when(span < 1e-6, F.lit(1.0)).otherwise(span)
    return F.floor((v - low) / span * F.lit(255.0) + F.lit(0.5)).cast("int")


def axis_taps(o: Column, n: Column, scale: int) -> Column:
    """Bilinear taps of output position ``o``: struct(i0, i1, w) with 16-bit weight."""
    num = o.cast("bigint") * 2 + (1 - scale)
    den = 2 * scale
    f = F.floor(num / F.lit(float(den))).cast("bigint")
    r = num - f * den
    top = n.cast("bigint") - 1
    return F.struct(
        F.least(F.greatest(f, F.lit(0)), top).alias("i0"),
        F.least(F.greatest(f + 1, F.lit(0)), top).alias("i1"),
        _div(r * 65536 + scale, den).cast("bigint").alias("w"),
    )


def span_low(o: Column, n: Column, on: Column) -> Column:
    return _div(o.cast("bigint") * n.cast("bigint"), on.cast("bigint"))


def span_high(o: Column, n: Column, on: Column) -> Column:
    n, on = n.cast("bigint"), on.cast("bigint")
    up = _div((o.cast("bigint") + 1) * n + on - 1, on)
    return F.greatest(F.least(up, n), span_low(o, n, on) + 1)
