"""Text rules: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
WHITESPACE = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"

# URL bytes that stay literal although the JVM encoder escapes them.
URI_LITERALS = (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("+", "%20"))

# HTTP reason phrases.
STATUS_TEXT = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content",
    301: "Moved Permanently", 302: "Found", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable",
}


def norm_text(c: Column) -> Column:
    """Lower case with every Unicode whitespace run as one space and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, WHITESPACE, " ")))


def blank(c: Column) -> Column:
    """Nothing but whitespace; decided at the first other character."""
    return ~F.coalesce(c.rlike("[^" + WHITESPACE[1:-1]), F.lit(False))


def tokens(c: Column) -> Column:
    """Whitespace tokens of the normalized text; blank text has none."""
    return F.filter(F.split(norm_text(c), " "), lambda t: t != "")


def metadata_value(c: Column, limit: int) -> Column:
    """Printable ASCII only: others become ``?``, an astral character two, then clamp."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    doubled = F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "??")
    return F.left(F.regexp_replace(doubled, "[^\\x20-\\x7E]", "?"), F.lit(limit))


def safe_segment(c: Column) -> Column:
    dashed = F.regexp_replace(metadata_value(c, 160), "[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("evidence"))


def js_slice(c: Column, units: int) -> Column:
    """First ``units`` UTF-16 code units, never half of a pair."""
    astral = "[\\x{10000}-\\x{10FFFF}]"
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"))

    def step(acc, ch):
        used = acc["used"] + F.when(ch.rlike(astral), 2).otherwise(1)
        return F.struct(used.alias("used"), F.when(used <= units, F.concat(acc["out"], ch)).otherwise(acc["out"]).alias("out"))

    # Code points are at most two units each, so the head is all that can be kept.
    head = F.left(c, F.lit(units))
    return F.when(head.rlike(astral), F.aggregate(F.split(head, ""), start, step, lambda a: a["out"])).otherwise(head)


def manifest_line(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit("="), F.translate(F.coalesce(value, F.lit("")), "\r\n", "  "), F.lit("\n"))


def encode_uri_component(c: Column) -> Column:
    out = F.url_encode(c)
    for coded, literal in reversed(URI_LITERALS):
        out = F.replace(out, F.lit(coded), F.lit(literal))
    return out


def public_url(bucket: Column, key: Column, version: Column, region: str) -> Column:
    """Versioned object URL; each path segment is encoded on its own."""
    path = F.array_join(F.transform(F.split(key, "/"), encode_uri_component), "/")
    base = F.concat(F.lit("https://"), bucket, F.lit(f".s3.{region}.amazonaws.com/"), path)
    return F.when(F.coalesce(version, F.lit("")) == "", base).otherwise(
        F.concat(base, F.lit("?versionId="), encode_uri_component(version))
    )


def body_ext(content_type: Column) -> Column:
    ct = F.lower(content_type)
    return (
        F.when(ct.startswith("text/html"), "html")
        .when(ct.startswith("application/json") | (ct.startswith("application/") & ct.contains("+json")), "json")
        .when(ct.startswith("application/xml") | ct.startswith("text/xml") | ct.contains("+xml"), "xml")
        .when(ct.startswith("text/plain"), "txt")
        .when(ct.startswith("text/css"), "css")
        .when(ct.startswith("application/javascript") | ct.startswith("text/javascript"), "js")
        .otherwise("bin")
    )


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def epoch_to_iso(seconds: Column) -> Column:
    return iso_ms(F.timestamp_millis(F.round(seconds * 1000).cast("bigint")))


def dated_member(name: Column, number: Column, text: Column) -> Column:
    """A reply member as shown: epoch seconds under a name that ends in Date, DateTime or date become a time, the rest stays ``text``."""
    return F.when(name.rlike("(Date|DateTime|date)$") & number.isNotNull(), epoch_to_iso(number)).otherwise(text)


def markdown_literal(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "([\\\\`*_\\[\\]<>&|~])", "\\\\$1")


def identity(*fields: Column) -> Column:
    """Digest of the compact JSON array of the identifying fields."""
    return F.sha2(F.to_json(F.array(*fields)), 256)


def content_key(content: Column, prefix: str = "sha1", ext: str = "png") -> Column:
    digest = F.sha1(content)
    return F.concat(F.lit(f"{prefix}/"), F.left(digest, F.lit(2)), F.lit("/"), digest, F.lit(f".{ext}"))


def status_text(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_TEXT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit(""))


def safe_name(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9._-]{1,200}$") & ~c.contains("\n"), F.lit(False))


def steps_text(steps: Column) -> Column:
    """Ordered interactions as one line; ``steps`` is an array of
    struct(kind, selector, value, ms, width, height)."""

    def one(s):
        return (
            F.when(s["kind"] == "wait", F.concat(F.lit("wait_ms:"), s["ms"].cast("string")))
            .when(s["kind"] == "click", F.concat(F.lit("click:"), s["selector"]))
            .when(s["kind"].isin("fill", "select"), F.concat(s["kind"], F.lit(":"), s["selector"], F.lit("="), s["value"]))
            .when(s["kind"] == "resize", F.concat(F.lit("resize:"), s["width"].cast("string"), F.lit("x"), s["height"].cast("string")))
        )

    return F.coalesce(F.nullif(F.array_join(F.transform(steps, one), "|"), F.lit("")), F.lit("none"))


def fixed2(x: Column) -> Column:
    """Two decimals of a non-negative double, rounding its exact binary value half to even.

    The JVM formatter rounds the shortest decimal text instead, which differs at ties.
    """
    whole = F.floor(x).cast("bigint")
    scaled = (x - whole) * F.lit(float(2**53))
    bits = F.floor(scaled).cast("bigint")
    q = F.call_function("div", bits * 100, F.lit(2**53))
    rest = bits * 100 - q * (2**53)
    up = (rest > 2**52) | ((rest == 2**52) & ((scaled > bits) | (q % 2 == 1)))
    cents = whole * 100 + q + up.cast("bigint")
    return F.concat(F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def screens_tall(height: Column, viewport: Column) -> Column:
    tall = height.cast("double") / F.nullif(viewport.cast("double"), F.lit(0.0))
    return F.when((height > 0) & (viewport > 0), fixed2(tall)).otherwise("-1")


def console_text(args: Column) -> Column:
    """Console arguments joined by spaces; ``args`` is an array of struct(object_id,
    subtype, type, class_name, description, unserializable, value)."""

    return js_slice(F.array_join(F.transform(args, console_argument), " "), 2000)


def console_argument(a: Column) -> Column:
    kind = F.coalesce(a["subtype"], a["type"], F.lit(""))
    shown = F.concat(F.lit("["), kind, F.lit(" "), F.coalesce(a["class_name"], F.lit("undefined")), F.lit("]"))
    error = (a["subtype"] == "error") & (F.coalesce(a["description"], F.lit("")) != "")
    return (
        F.when(a["object_id"].isNotNull(), F.when(error, F.substring_index(a["description"], "\n", 1)).otherwise(shown))
        .when(a["unserializable"].isNotNull(), F.rtrim(a["unserializable"], F.lit("n")))
        .otherwise(F.coalesce(a["value"], F.lit("")))
    )


def exception_message(exception: Column, text: Column, frames: Column) -> Column:
    """Message of exception details: their own ``text`` without an exception object, a thrown primitive as a
    console argument, else what ``exception_text`` makes of the error."""
    error = F.coalesce((exception["type"] == "object") & (exception["subtype"] == "error"), F.lit(False))
    return (
        F.when(exception.isNull(), js_slice(F.coalesce(text, F.lit("")), 2000))
        .when(~error & exception["object_id"].isNull(), js_slice(console_argument(exception), 2000))
        .otherwise(exception_text(exception["class_name"], exception["description"], frames))
    )


def exception_text(class_name: Column, description: Column, frames: Column) -> Column:
    """Exception message: its stack frames and the leading ``Name: `` are removed."""
    name = F.coalesce(class_name, F.lit(""))
    lines = F.split(F.coalesce(description, F.lit("")), "\n    at ")
    dropped = F.least(frames, F.size(lines) - 1)
    body = F.array_join(F.slice(lines, F.lit(1), F.size(lines) - dropped), "\n")
    prefix = F.concat(name, F.lit(": "))
    bare = F.when((name != "") & body.startswith(prefix), F.substring(body, F.length(prefix) + 1, F.length(body))).otherwise(body)
    filled = F.when(bare != "", bare).when(name == "", "Error").otherwise(name)
    return js_slice(filled, 2000)


def image_alt(evidence_type: Column, final_url: Column, requested_url: Column, viewport: Column, sha256: Column) -> Column:
    """Alt text from signed fields only: what kind of evidence, of which page and viewport, and the digest's first 12 digits."""
    filled = lambda c: F.nullif(c, F.lit(""))
    parts = [
        F.coalesce(filled(evidence_type), F.lit("evidence")), F.coalesce(filled(final_url), filled(requested_url)), filled(viewport),
        F.concat(F.lit("sha256 "), F.left(F.coalesce(sha256, F.lit("")), F.lit(12))),
    ]
    return F.regexp_replace(F.concat_ws(" \u2014 ", *parts), "[\\[\\]]", "")


def evidence_text(category: Column, intent: Column, target: Column, attested: Column, url: Column,
                  statement_url: Column, canonicalization: Column, key_id: Column, issuer: str,
                  image_alt: Column | None = None, marker: Column | None = None, content_type: Column | None = None) -> Column:
    """Fixed markdown block of one evidence object; an alt text shows the object as an image, given ``content_type`` only where that is one."""
    blank = F.lit("")
    lines = [F.lit(f"-----BEGIN {issuer} SIGNED ATTESTATION-----"), blank]
    if image_alt is not None:
        shown = F.concat(F.lit("!["), F.regexp_replace(image_alt, "[\\[\\]]", ""), F.lit("]("), url, F.lit(")"))
        is_image = F.lit(True) if content_type is None else F.coalesce(content_type.startswith("image/"), F.lit(False))
        # concat_ws leaves out both where they are null.
        lines += [F.when(is_image, shown), F.when(is_image, blank)]
    lines += [
        F.concat(F.lit("**"), category, F.lit(": "), intent, F.lit("**")), blank,
        F.concat(F.lit("Target: "), target), blank,
        F.concat(F.lit("Attested: "), attested), blank,
        F.concat(F.lit("Evidence: <"), url, F.lit(">")), blank,
        F.concat(F.lit("Statement: <"), statement_url, F.lit(">")), blank,
        F.concat(canonicalization, F.lit(" · Key-ID: "), key_id), blank,
    ]
    if marker is not None:
        lines += [marker, blank]
    lines.append(F.lit(f"-----END {issuer} SIGNED ATTESTATION-----"))
    return F.concat_ws("\n", *lines)


def cookie_fingerprint(cookies: Column) -> Column:
    """Digest of cookie names and attributes, never values; ``cookies`` is an array of
    struct(name, domain, path, secure, httpOnly, sameSite)."""
    blank = F.lit("")

    def shape(c):
        return F.to_json(F.struct(
            c["name"].alias("name"), F.coalesce(c["domain"], blank).alias("domain"),
            F.coalesce(c["path"], blank).alias("path"), F.coalesce(c["secure"], F.lit(False)).alias("secure"),
            F.coalesce(c["httpOnly"], F.lit(False)).alias("httpOnly"), F.coalesce(c["sameSite"], blank).alias("sameSite"),
        ))

    ordered = F.array_sort(F.transform(cookies, lambda c: F.struct(F.lower(shape(c)).alias("k"), shape(c).alias("s"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda p: p["s"]), ","), F.lit("]")), 256)


def parse_duration(c: Column) -> Column:
    """``12ms``, ``1.5s``, ``30us`` as milliseconds."""
    number = F.try_element_at(F.regexp_extract_all(c, F.lit("^([0-9.]+)(?:ms|us|s)$"), 1), F.lit(1)).try_cast("double")
    return F.when(c.endswith("ms"), number).when(c.endswith("us"), number * F.lit(0.001)).when(c.endswith("s"), number * 1000)
