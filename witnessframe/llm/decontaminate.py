"""Benchmark passages in documents, also with their numbers, names and units changed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import small_side
from ..session import durable
from .minhash import KEY_BYTES, fresh_name, same_document, text_digest

WIDTH = 5
ITEM_BYTES = 2048  # a generous mean for an item's words, to size a broadcast
ENOUGH_WORDS = 13
ENOUGH_SHARE = 0.8
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
# Typed placeholders, one private-use character each.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|t|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|"
    "kilometers?|kilometres?|miles?|feet|ft|inch(?:es)?|pounds?|lbs?|ounces?|oz|grams?|kilograms?|liters?|litres?|"
    "dollars?|euros?|cents?|percent|degrees?|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|a|j|kj|n|pa|mol"
)


def template(text: Column) -> Column:
    """``text`` with numbers, units after numbers, and capitalised words inside a sentence replaced; white space stays."""
    numbers = F.regexp_replace(text, r"[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    units = F.regexp_replace(numbers, rf"({NUMBER} ?)(?i:{UNITS})(?![\p{{L}}])", f"$1{UNIT}")
    return F.lower(F.regexp_replace(units, r"(?<=[\p{L},;] )\p{Lu}[\p{L}'’-]+", NAME))


def tokens(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not again in each lambda call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(text: Column) -> Column:
    """``at, typed, plain`` of every window: its place and the hashes of its template words and of its lower-cased words."""

    def over(h: Column) -> Column:
        window = lambda kind, i: F.xxhash64(F.slice(h[kind], i + 1, WIDTH)).alias(kind)
        at = F.sequence(F.lit(0), F.size(h["plain"]) - WIDTH)
        return F.when(F.size(h["plain"]) >= WIDTH, F.transform(at, lambda i: F.struct(i.alias("at"), window("typed", i), window("plain", i))))

    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    return _once(F.struct(hashes(tokens(template(text))).alias("typed"), hashes(tokens(F.lower(text))).alias("plain")), over)


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items that occur in documents, as they are or re-parameterised.

    ``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> ``doc_id, item_id, item_words,
    matched_words, slots, changed_slots``, one row per document and item found in it.

    Texts are brought to templates with typed placeholders, and to plain lower-cased words. Hashes of all 5-word windows
    of the items, of both kinds, meet every window of the documents in one hash join (the index is broadcast only if its
    counted size allows), so any run of five template words with two literal ones among them, and any run of five equal
    words in any case, is met, at whatever place it starts. Each meeting fixes an alignment of the whole item. A word
    matches if the lower-cased words agree or, where a template window was met, if the templates agree; an alignment
    counts if every item value in a slot of both, within a run of five matched words, always stands for the same document value.
    Conflicting slot words at the edges of such runs or beyond are not counted, so text after a partial copy does not undo
    it. An item is found if its matched words reach 13 or 80 % of it, whichever is less.

    Items of fewer than 5 words cannot be found; a null text has no words; a null doc_id or
    item_id is a value of its own. Repeated rows give one result row; of several texts under one doc_id, each is searched
    on its own and the largest values are returned. Extra columns are ignored.
    """
    numbers = [F.max("matched_words").alias("matched_words"), F.max("slots").alias("slots"), F.min("changed_slots").alias("changed_slots")]
    return _found(docs, benchmark).groupBy("doc_id", "item_id", "item_words").agg(*numbers)


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` with the digest of the text in which the item is found."""
    docs = docs.select("doc_id", "text", text_digest().alias("digest"))
    text = F.col("text")
    items = benchmark.where(text.isNotNull()).select(
        "item_id", tokens(template(text)).alias("want"), tokens(text).alias("values"), tokens(F.lower(text)).alias("low"), _windows(text).alias("windows")
    )
    items = durable(items.withColumn("item", F.xxhash64("item_id", "values")).dropDuplicates(["item", "item_id"]))
    index = items.select("item", "want", F.inline("windows"))
    literal = F.size(F.filter(F.slice("want", F.col("at") + 1, WIDTH), lambda w: w.rlike(r"\p{L}")))
    plain = index.select("item", "at", F.col("plain").alias("hash"), F.lit(False).alias("typed"))
    index = index.where(literal >= 2).select("item", "at", F.col("typed").alias("hash"), F.lit(True).alias("typed")).unionByName(plain)
    index = durable(index.groupBy("item", "at", "hash").agg(F.max("typed").alias("typed")))
    kinds_of_window = F.when(F.col("typed") == F.col("plain"), F.array("plain")).otherwise(F.array("typed", "plain"))
    met = (
        docs.select("doc_id", "digest", F.inline(_windows(text))).select("doc_id", "digest", F.col("at").alias("nth"), F.explode(kinds_of_window).alias("hash"))
        .join(small_side(index, index.count()), "hash")
        .groupBy("doc_id", "digest", "item", (F.col("nth") - F.col("at")).alias("offset")).agg(F.max("typed").alias("typed"))
    )
    met = durable(met)
    held = met.count()
    texts = docs.select(F.col("doc_id").alias("d"), F.col("digest").alias("d_digest"), "text")
    kinds = items.count()
    pairs = texts.join(small_side(met, held), texts["d"].eqNullSafe(met["doc_id"]) & (texts["d_digest"] == met["digest"])).join(small_side(items, kinds, kinds * ITEM_BYTES), "item")
    pairs = pairs.select("doc_id", "digest", "item_id", "offset", "typed", "want", "values", "low", "text")

    def aligned(both: Column) -> Column:
        got, raw, plain = both["got"], both["raw"], both["plain"]
        same_template = lambda k: F.get(got, F.col("offset") + k) == F.get(F.col("want"), k)
        same_word = lambda k: F.get(plain, F.col("offset") + k) == F.get(F.col("low"), k)
        hits = F.filter(F.sequence(F.lit(0), F.size("want") - 1), lambda k: same_word(k) | (F.col("typed") & same_template(k)))

        def with_slots(hit: Column) -> Column:
            slots = F.filter(hit, lambda k: F.get(F.col("want"), k).rlike(f"[{NUMBER}{UNIT}{NAME}]"))
            run = lambda s: F.size(F.array_intersect(hit, F.sequence(s, s + (WIDTH - 1)))) == WIDTH
            inside = lambda k: F.array_contains(hit, k - 1) & F.array_contains(hit, k + 1) & F.exists(F.sequence(k - (WIDTH - 1), k), run)
            value = lambda k: F.struct(
                k.alias("at"), _bare(F.get(F.col("values"), k)).alias("from"), _bare(F.get(raw, F.col("offset") + k)).alias("to"),
                inside(k).alias("inside"), same_word(k).alias("same"),
            )
            return F.struct(hit.alias("hit"), F.transform(F.filter(slots, same_template), value).alias("values"), F.size(slots).alias("slots"))

        def without_conflicts(x: Column) -> Column:
            # Values within a run of five matched words bind the others; those at its edges or beyond may be the text after a copy.
            bound = F.filter(x["values"], lambda v: v["inside"])
            clash = lambda v, others: F.exists(others, lambda o: (o["from"] == v["from"]) & (o["to"] != v["to"]))
            dropped = F.filter(x["values"], lambda v: ~v["inside"] & ~v["same"] & clash(v, x["values"]) & (clash(v, bound) | ~F.exists(bound, lambda o: o["from"] == v["from"])))
            kept = F.filter(x["values"], lambda v: v["inside"] | ~F.array_contains(F.transform(dropped, lambda d: d["at"]), v["at"]))
            pairs = lambda vs: F.array_distinct(F.transform(vs, lambda v: F.struct(v["from"].alias("from"), v["to"].alias("to"))))
            return F.struct(
                F.array_except(x["hit"], F.transform(dropped, lambda d: d["at"])).alias("hit"), pairs(kept).alias("values"), pairs(bound).alias("bound"),
                (x["slots"] - F.size(dropped)).alias("slots"),
            )

        return _once(_once(hits, with_slots), without_conflicts)

    both = F.struct(tokens(template(F.col("text"))).alias("got"), tokens(F.col("text")).alias("raw"), tokens(F.lower("text")).alias("plain"))
    laid = pairs.select("doc_id", "digest", "item_id", F.size("want").alias("item_words"), _once(both, aligned).alias("x"))
    laid = laid.select(
        "doc_id", "digest", "item_id", "item_words", "x.hit", F.col("x.slots").alias("slots"),
        (F.size("x.bound") == F.size(F.array_distinct(F.transform("x.bound", lambda v: v["from"])))).alias("consistent"),
        F.size(F.filter("x.values", lambda v: v["from"] != v["to"])).alias("changed"),
    ).where("consistent and size(hit) >= 5")
    words = laid.select("doc_id", "digest", "item_id", "item_words", "slots", "changed", F.explode("hit").alias("word"))
    words = words.groupBy("doc_id", "digest", "item_id", "item_words", "word").agg(F.max("slots").alias("slots"), F.min("changed").alias("changed"))
    found = words.groupBy("doc_id", "digest", "item_id", "item_words").agg(
        F.count(F.lit(1)).alias("matched_words"), F.max("slots").cast("bigint").alias("slots"), F.min("changed").cast("bigint").alias("changed_slots")
    )
    enough = F.least(F.lit(ENOUGH_WORDS), F.ceil(F.col("item_words") * ENOUGH_SHARE))
    return found.where(F.col("matched_words") >= enough).select("doc_id", "digest", "item_id", F.col("item_words").cast("bigint").alias("item_words"), "matched_words", "slots", "changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found."""
    found = durable(_found(docs, benchmark).select(F.col("doc_id").alias("leaked"), F.col("digest").alias("of")).distinct())
    n = found.count()
    own = fresh_name("_digest", docs.columns)
    marked = docs.withColumn(own, text_digest())
    return marked.join(small_side(found, n, n * KEY_BYTES), same_document(marked, own, found, "leaked", "of"), "left_anti").drop(own)
