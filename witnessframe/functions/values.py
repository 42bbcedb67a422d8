"""Value rules of the JSON-based records: JavaScript conversions, defaults, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = "(?i)^[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    The optimizer merges projections and may move an expression into a lambda, where it
    would be evaluated for every element; a lambda variable cannot be moved.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_string(number: Column) -> Column:
    """``String(x)`` of a double: whole numbers without ``.0``, no exponent, all digits."""
    x = number.cast("double")

    def moved(text: Column) -> Column:
        # The shortest digits are those of the scientific form; only their point moves.
        shown = F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", 1)
        part = F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", 2)
        power = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        digits = F.concat(shown, F.nvl2(F.nullif(part, F.lit("0")), part, F.lit("")))
        return let(F.struct(digits.alias("digits"), (F.length(shown) + power).alias("at")), lambda n: placed(n["digits"], n["at"]))

    def placed(digits: Column, at: Column) -> Column:
        return (
            F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
            .when(at >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), at - F.length(digits))))
            .otherwise(F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.length(digits))))
        )

    unsigned = let(F.abs(x).cast("string"), moved)
    plain = F.concat(F.when(x < 0, "-").otherwise(""), unsigned)
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when((x == F.rint(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string"))
        .when((x == F.rint(x)) & (F.abs(x) < 1e21), x.try_cast("decimal(22,0)").cast("string"))
        # In this range a double's text has no exponent.
        .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string"))
        .otherwise(plain)
    )


def js_number(text: Column) -> Column:
    """``Number(s)`` of a string: blank is 0, non-numeric NaN; null is 0."""
    t = F.regexp_replace(text, r"^(?U)[\s\x{feff}]+|[\s\x{feff}]+$", "")
    return (
        F.when(text.isNull() | (t == ""), F.lit(0.0))
        .when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))
        .otherwise(F.lit(float("nan")))
    )


def truthy_number(x: Column) -> Column:
    return x.isNotNull() & (x != 0) & ~F.isnan(x)


def truthy_text(s: Column) -> Column:
    return s.isNotNull() & (s != "")


def variant_kind(v: Column) -> Column:
    """``number``, ``text``, ``flag``, ``null``, ``list`` or ``object`` of a VARIANT; null for a missing one."""
    kind = lambda shown: (
        F.when(shown.isNull(), F.lit(None).cast("string")).when(shown == "VOID", "null").when(shown == "BOOLEAN", "flag").when(shown == "STRING", "text")
        .when(shown.startswith("ARRAY"), "list").when(shown.startswith("OBJECT"), "object").otherwise("number")
    )
    return let(F.schema_of_variant(v), kind)


def variant_truthy(v: Column) -> Column:
    """Truthiness by the type of a VARIANT, not by its text: "0" and "false" are true."""
    kind = variant_kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(kind == "flag", F.try_variant_get(v, "$", "boolean")).when(kind == "text", F.try_variant_get(v, "$", "string") != "")
        .when(kind == "number", (number != 0) & ~F.isnan(number)).otherwise(kind.isin("list", "object")),
        F.lit(False),
    )


def variant_number(v: Column) -> Column:
    """``Number(x)`` of a VARIANT: a missing value, a list or an object is NaN, null is 0."""
    kind = variant_kind(v)
    return (
        F.when(kind == "null", F.lit(0.0)).when(kind == "flag", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(kind == "text", js_number(F.try_variant_get(v, "$", "string"))).when(kind == "number", F.try_variant_get(v, "$", "double"))
        .otherwise(F.lit(float("nan")))
    )


def variant_text(v: Column) -> Column:
    """``String(x)`` of a VARIANT."""
    number = js_string(F.try_variant_get(v, "$", "double"))
    return F.when(variant_kind(v) == "number", number).otherwise(F.try_variant_get(v, "$", "string"))


def first_truthy_number(*xs: Column) -> Column:
    """``a || b`` over numbers; nothing truthy gives null."""
    return F.coalesce(*[F.when(truthy_number(x), x) for x in xs])


def first_truthy_text(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def json_text(value: Column) -> Column:
    """JSON literal of a scalar; a missing one is ``undefined``."""
    wrapped = F.to_json(F.array(value))
    return F.when(value.isNull(), "undefined").otherwise(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def clamp_number(x: Column, default: float, low: float, high: float) -> Column:
    """Falsy takes the default, NaN gives null (rejected), then clamp and truncate."""
    n = F.when(truthy_number(x) | F.isnan(x), x).otherwise(F.lit(float(default)))
    return F.when(~F.isnan(n), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), n)).cast("bigint"))


def ratio(reference: Column, candidate: Column) -> Column:
    """Reference over candidate; null when timer quantization left either at zero."""
    return F.when((reference > 0) & (candidate > 0), reference / candidate)


def pass_defaults(psm: Column, lang: Column, dpi: Column, scale: Column, pixel_budget: Column) -> Column:
    """Unset (zero or blank) pass fields take their defaults."""

    def fallback(c, default):
        return F.coalesce(F.nullif(c, F.lit("" if isinstance(default, str) else 0).cast(
            "string" if isinstance(default, str) else "double" if isinstance(default, float) else "bigint")), F.lit(default))

    return F.struct(
        fallback(psm.cast("bigint"), 3).cast("int").alias("psm"),
        fallback(lang, "eng").alias("lang"),
        fallback(dpi.cast("bigint"), 300).cast("int").alias("dpi"),
        fallback(scale.cast("double"), 1.0).alias("scale"),
        fallback(pixel_budget.cast("bigint"), 20_000_000).cast("bigint").alias("pixel_budget"),
    )


def valid_scale(scale: Column) -> Column:
    """Any factor in (0, 1], or a whole 2..4."""
    return F.coalesce((scale > 0) & (scale <= 4) & ((scale <= 1) | (scale == F.floor(scale))), F.lit(False))


def factor_within_budget(width: Column, height: Column, most: int, budget: Column | int) -> Column:
    """Largest factor up to ``most`` whose output stays inside the pixel budget, at least 1."""
    area = width.cast("bigint") * height.cast("bigint")
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fits = [F.when(area * (k * k) <= limit, F.lit(k)) for k in range(max(most, 1), 1, -1)]
    return F.coalesce(*fits, F.lit(1))


def sample_step(width: Column, height: Column, most: int = 1_500_000) -> Column:
    """Smallest s with (width div s) * (height div s) <= most.

    sqrt(area / most) bounds the answer from above once rounded up by one.
    """
    w, h = width.cast("bigint"), height.cast("bigint")
    last = F.ceil(F.sqrt(w * h / F.lit(float(most)))).cast("int") + 1

    def beyond(s, k):  # the product never grows with s, so the last s beyond the budget is found bit by bit
        t = s + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.floor(w / t) * F.floor(h / t) > most, t).otherwise(s)

    found = F.aggregate(F.sequence(F.floor(F.log2(last)).cast("int"), F.lit(0), F.lit(-1)), F.lit(0), beyond) + 1
    # Most frames need no thinning, so the search is only made beyond that.
    return F.when(w * h <= most, F.lit(1)).otherwise(found)


def numeric_members(m: Column) -> Column:
    """Only the members of a VARIANT map that are numbers, as doubles; text that looks like one is none."""
    number = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    kept = F.map_filter(m, lambda k, v: F.coalesce(number(v), F.lit(False)))
    return F.transform_values(kept, lambda k, v: F.variant_get(v, "$", "double"))


def redact(m: Column) -> Column:
    """Names stay, every value becomes its digest."""
    return F.transform_values(m, lambda k, v: F.concat(F.lit("sha256:"), F.sha2(v, 256)))
