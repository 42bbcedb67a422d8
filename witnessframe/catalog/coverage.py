"""Text coverage over the conversations table (a conversation is a capture, a turn a pass)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import coverage as C
from ..tables import table
from .registry import register
from .scalars import WS


def reads(spark, folder):
    c = table(spark, folder, "conversations", spread=True)
    wave = F.when(F.col("turn") < 3, "passes").otherwise("fallback")
    return c.select(F.col("conv_id").alias("shot_id"), F.col("turn").alias("seq"), wave.alias("wave"), "text")


def plain_keywords(spark, folder):
    toks = F.slice(tokens(F.col("text")), 1, 2)
    return reads(spark, folder).select("shot_id", F.col("seq").alias("kw_pos"), F.array_join(toks, " ").alias("keyword"))


def border_keywords(spark, folder, before: int, after: int, cut: int = 0):
    """Last ``before`` tokens of a turn and first ``after`` tokens of the next one."""
    r = reads(spark, folder).select("shot_id", "seq", tokens(F.col("text")).alias("toks"))
    tail = r.select("shot_id", "seq", F.array_join(F.slice("toks", F.greatest(F.size("toks") - before + 1, F.lit(1)), F.lit(before)), " ").alias("tail"))
    head = r.select("shot_id", (F.col("seq") - 1).alias("seq"), F.array_join(F.slice("toks", 1, after), " ").alias("head"))
    text = F.concat_ws(" ", F.substring("tail", F.lit(1 + cut), F.length("tail")), "head")
    return tail.join(head, ["shot_id", "seq"]).select("shot_id", F.col("seq").alias("kw_pos"), text.alias("keyword"))


def shots(spark, folder, floor: float):
    return reads(spark, folder).select("shot_id").distinct().withColumn("min_fraction", F.lit(floor))


SQL_READS = f"""r as (select conv_id as shot_id, turn as seq, case when turn < 3 then 'passes' else 'fallback' end as wave, text,
    list_filter(string_split(lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))), ' '), lambda t: t <> '') as toks from conversations),
  cum as (select shot_id, seq, wave, text, lower(trim(regexp_replace(string_agg(text || chr(10), '') over (partition by shot_id order by seq
    rows unbounded preceding), '{WS}', ' ', 'g'))) as seen from r)"""
SQL_PLAIN = "kw as (select shot_id, seq as kw_pos, array_to_string(toks[1:2], ' ') as keyword from r)"


def sql_border(before: int, after: int, cut: int = 0) -> str:
    return f"""kw as (select a.shot_id, a.seq as kw_pos, substr(array_to_string(a.toks[-{before}:], ' '), {1 + cut}) || ' ' ||
        array_to_string(b.toks[1:{after}], ' ') as keyword from r a join r b on a.shot_id = b.shot_id and b.seq = a.seq + 1)"""


SQL_SCORED = """f as (select cum.shot_id, cum.seq, cum.wave, cum.text,
    (select count(*) from kw where kw.shot_id = cum.shot_id and trim(kw.keyword) <> '') as n_keywords,
    (select count(*) from kw where kw.shot_id = cum.shot_id and trim(kw.keyword) <> '' and contains(cum.seen, kw.keyword)) as matched from cum)"""


def sql_read(floor: float) -> str:
    return f"""w as (select shot_id, min(case when n_keywords > 0 and matched / n_keywords::double >= {floor} then seq end) as won_seq from f group by 1),
      kept as (select f.*, w.won_seq from f join w using (shot_id)
        where case when won_seq is not null then seq <= won_seq else n_keywords > 0 or wave = 'passes' end)"""


SQL_OUTCOME = """select shot_id, max(won_seq) as won_seq, arg_max(wave, seq) as last_wave, max(n_keywords) as n_keywords,
    case when max(n_keywords) > 0 then max(matched) end as matched,
    round(max(matched) / nullif(max(n_keywords), 0)::double, 6) as fraction,
    case when max(n_keywords) > 0 then max(won_seq) is not null end as met, count(*) as passes_read,
    cast(sum(strlen(text) + 1) as bigint) as text_bytes from kept group by 1"""


@register("coverage_first_pass", f"with {SQL_READS}, {SQL_PLAIN}, {SQL_SCORED}, {sql_read(0.8)} {SQL_OUTCOME}")
def first_pass(spark, folder):
    out = C.outcomes(reads(spark, folder), plain_keywords(spark, folder), shots(spark, folder, 0.8))
    return out.withColumn("fraction", F.round("fraction", 6))


@register("coverage_border_outcome", f"with {SQL_READS}, {sql_border(1, 1)}, {SQL_SCORED}, {sql_read(0.5)} {SQL_OUTCOME}")
def border_outcome(spark, folder):
    out = C.outcomes(reads(spark, folder), border_keywords(spark, folder, 1, 1), shots(spark, folder, 0.5))
    return out.withColumn("fraction", F.round("fraction", 6))


@register(
    "coverage_pass_fractions",
    f"with {SQL_READS}, {sql_border(1, 1)}, {SQL_SCORED} select shot_id, seq, n_keywords, matched from f",
)
def pass_fractions(spark, folder):
    return C.pass_fractions(reads(spark, folder), border_keywords(spark, folder, 1, 1)).select("shot_id", "seq", "n_keywords", "matched")


SQL_FIRST = "select kw.shot_id, kw_pos, keyword, (select min(seq) from cum where cum.shot_id = kw.shot_id and contains(cum.seen, kw.keyword)) as first_seq from kw where trim(keyword) <> ''"


@register("coverage_keyword_rows", f"with {SQL_READS}, {SQL_PLAIN} {SQL_FIRST}")
def keyword_rows(spark, folder):
    return C.keyword_hits(reads(spark, folder), plain_keywords(spark, folder))


@register("coverage_long_phrases", f"with {SQL_READS}, {sql_border(3, 4, 1)} {SQL_FIRST}")
def long_phrases(spark, folder):
    return C.keyword_hits(reads(spark, folder), border_keywords(spark, folder, 3, 4, 1))


@register(
    "coverage_inner_words",
    f"with {SQL_READS}, kw as (select shot_id, seq as kw_pos, substr(toks[-1], 2, 3) as keyword from r) {SQL_FIRST}",
)
def inner_words(spark, folder):
    last = F.element_at(tokens(F.col("text")), -1)
    keywords = reads(spark, folder).select("shot_id", F.col("seq").alias("kw_pos"), F.substring(last, 2, 3).alias("keyword"))
    return C.keyword_hits(reads(spark, folder), keywords)


@register(
    "coverage_passes_read",
    f"with {SQL_READS}, {sql_border(1, 1)}, {SQL_SCORED}, {sql_read(0.5)} select shot_id, seq, wave, won_seq, matched from kept",
)
def passes_read(spark, folder):
    kept = C.passes_read(reads(spark, folder), border_keywords(spark, folder, 1, 1), shots(spark, folder, 0.5))
    return kept.select("shot_id", "seq", "wave", "won_seq", "matched")


def reading(image, one):
    """A caller's reader in Arrow batches: the text that pass ``one`` reads from a frame, here a JSON object of texts by pass."""

    def read(frames: pd.Series, passes: pd.Series) -> pd.Series:
        return pd.Series([json.loads(frame).get(str(n)) for frame, n in zip(frames, passes)], dtype=object)

    return F.pandas_udf(read, "string")(image, one)


@register("coverage_reader", f"with {SQL_READS}, {sql_border(1, 1)}, {SQL_SCORED}, {sql_read(0.5)} select shot_id, seq, wave from kept")
def reader(spark, folder):
    """Passes that a reader performs when it is called pass by pass, and only while a shot still needs it."""
    r = reads(spark, folder)
    texts = F.map_from_entries(F.collect_list(F.struct(F.col("seq").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("value"))))
    frames = r.groupBy("shot_id").agg(F.to_json(texts).alias("image"))  # a conversation is one frame
    planned = r.select("shot_id", "seq", "wave", F.col("seq").alias("pass"))
    return C.read_until_met(planned, frames, reading, border_keywords(spark, folder, 1, 1), shots(spark, folder, 0.5)).select("shot_id", "seq", "wave")


@register(
    "coverage_pass_totals",
    f"""with {SQL_READS}, {sql_border(1, 1)}, {SQL_SCORED}, {sql_read(0.5)} select shot_id, count(*) as passes_read, cast(sum(length(text) % 7) as bigint) as resample_ms,
        cast(sum(length(text) % 101) as bigint) as ocr_ms, cast(sum(length(text)) as bigint) as pixels, cast(sum(strlen(text) + 1) as bigint) as text_bytes from kept group by 1""",
)
def pass_totals(spark, folder):
    kept = C.passes_read(reads(spark, folder), border_keywords(spark, folder, 1, 1), shots(spark, folder, 0.5))
    size = F.length("text").cast("bigint")
    return C.pass_totals(kept.withColumns({"resample_ms": size % 7, "ocr_ms": size % 101, "pixels": size}))


@register(
    "coverage_no_keywords",
    "select conv_id as shot_id, count(*) as passes_read, cast(sum(strlen(text) + 1) as bigint) as text_bytes from conversations where turn < 3 group by 1",
)
def no_keywords(spark, folder):
    blank = reads(spark, folder).select("shot_id", F.col("seq").alias("kw_pos"), F.lit("  ").alias("keyword"))
    return C.outcomes(reads(spark, folder), blank, shots(spark, folder, 0.8)).select("shot_id", "passes_read", "text_bytes")


@register(
    "coverage_wave_union",
    """with w as (select o_orderkey as shot_id, 'passes' as wave, unnest(range(1 + o_orderkey % 2)) as index, 0 as before, o_custkey % 4 as psm from orders
          union all select o_orderkey, 'fallback', unnest(range(o_orderkey % 3)), 1 + o_orderkey % 2, o_custkey % 5 from orders)
        select shot_id, wave, cast(index as int) as index, cast(before + index as int) as seq, cast(case when psm + index = 0 then 3 else psm + index end as int) as psm,
          'eng' as lang, 20000000::bigint as pixel_budget from w""",
)
def wave_union(spark, folder):
    none = F.lit(None)

    def wave(count, psm):
        one = lambda i: F.struct(
            (psm + i).alias("psm"), none.cast("string").alias("lang"), none.cast("int").alias("dpi"), none.cast("double").alias("scale"), none.cast("bigint").alias("pixel_budget")
        )
        plan = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int")), one)
        return F.when(count > 0, plan).otherwise(F.slice(plan, 1, 0))

    key = F.col("o_orderkey")
    planned = table(spark, folder, "orders").select(
        key.alias("shot_id"), wave(1 + key % 2, F.col("o_custkey") % 4).alias("passes"), wave(key % 3, F.col("o_custkey") % 5).alias("fallback")
    )
    return C.wave_reads(planned).select("shot_id", "wave", "index", "seq", "pass.psm", "pass.lang", "pass.pixel_budget")


@register(
    "coverage_containment",
    f"""select d.doc_id, b.item_id from documents d join benchmark b
        on contains(lower(trim(regexp_replace(d.text, '{WS}', ' ', 'g'))), lower(trim(regexp_replace(b.text, '{WS}', ' ', 'g'))))""",
)
def containment(spark, folder):
    return C.containment(table(spark, folder, "documents", spread=True), table(spark, folder, "benchmark"))


SQL_WORDS = """list_transform(list_filter(list_transform(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}$,.]+'),
    lambda w: regexp_replace(w, '^[,.]+|[,.]+$', '', 'g')), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')), lambda w: lower(w))"""


@register("words_by_language", f"select lang, word, count(*) as n from (select lang, unnest({SQL_WORDS}) as word from documents) group by 1, 2")
def words_by_language(spark, folder):
    return C.word_counts(table(spark, folder, "documents", spread=True), ["lang"], "text")


SQL_BAGS = f"""w as (select conv_id, role, word, count(*) as n from (select conv_id, role, unnest({SQL_WORDS}) as word from conversations) group by 1, 2, 3),
    d as (select conv_id, word, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from (select * from w where role = 'user') a
      full outer join (select * from w where role = 'assistant') b using (conv_id, word))"""


def bags(spark, folder):
    counts = C.word_counts(table(spark, folder, "conversations", spread=True), ["conv_id", "role"], "text")
    return [counts.where(F.col("role") == r).drop("role") for r in ("user", "assistant")]


@register(
    "word_bag_summary",
    f"""with {SQL_BAGS} select conv_id, cast(sum(least(n_a, n_b)) as bigint) as common_words, cast(sum(greatest(n_a - n_b, 0)) as bigint) as only_a_words,
        cast(sum(greatest(n_b - n_a, 0)) as bigint) as only_b_words from d group by 1""",
)
def word_bag_summary(spark, folder):
    return C.bag_summary(*bags(spark, folder), ["conv_id"])


@register(
    "word_bag_sample",
    f"""with {SQL_BAGS} select conv_id, word, place from (select conv_id, word, cast(row_number() over (partition by conv_id order by word collate "binary") as int) as place
        from d where n_a > n_b) where place <= 60""".replace(' collate "binary"', ""),
)
def word_bag_sample(spark, folder):
    surplus = C.bag_difference(*bags(spark, folder), ["conv_id"]).where("only_a > 0")
    # The rank filter is pushed below the shuffle: each map task sends at most 60 rows per key.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("word"))
    return surplus.select("conv_id", "word", place.alias("place")).where("place <= 60")


@register(
    "word_bag_set_operations",
    f"""with {SQL_BAGS} select conv_id, 'both' as side, cast(sum(least(n_a, n_b)) as bigint) as n from d group by 1 having sum(least(n_a, n_b)) > 0
        union all select conv_id, 'only_a', cast(sum(greatest(n_a - n_b, 0)) as bigint) from d group by 1 having sum(greatest(n_a - n_b, 0)) > 0""",
)
def word_bag_set_operations(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "role", F.explode(C.words(F.col("text"))).alias("word"))
    a, b = [c.where(F.col("role") == r).drop("role") for r in ("user", "assistant")]
    counted = lambda df, side: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return counted(a.intersectAll(b), "both").unionByName(counted(a.exceptAll(b), "only_a"))


@register(
    "heaviest_reads",
    "select event_id, user_id, value from events order by value desc, event_id limit 25",
)
def heaviest_reads(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(25)
