"""Run outcomes over conversations, events, lineitem and pages."""

from __future__ import annotations

from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import values as V
from ..operators import markup as M
from ..operators import runs as R
from ..sources import results
from ..tables import table
from .registry import register

OPERATIONS = ["url", "click", "content", "screenshot"]


@register(
    "html_complete",
    """with t as (select page_id, lower(trim(html)) as h from pages), p as (select page_id, h, instr(h, '<body') as b,
          case when contains(h, '</body>') then length(h) - instr(reverse(h), '>ydob/<') - 5 else 0 end as bz, instr(h, '<html') as a,
          case when contains(h, '</html>') then length(h) - instr(reverse(h), '>lmth/<') - 5 else 0 end as az,
          case when contains(h, '<') then length(h) - instr(reverse(h), '<') + 1 else 0 end as lt,
          case when contains(h, '>') then length(h) - instr(reverse(h), '>') + 1 else 0 end as gt from t)
        select page_id, a > 0 and b > 0 and az > 0 and bz > 0 and b <= bz and a <= az and not (lt > 0 and gt < lt) as complete from p""",
)
def html_complete(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.html_complete(F.col("html")).alias("complete"))


SQL_DECODE = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"


@register(
    "html_values",
    f"""select page_id, links, paragraphs, {SQL_DECODE.format('lang')} as lang, {SQL_DECODE.format('title')} as title, {SQL_DECODE.format('first_link')} as first_link from (
      select page_id, cast(len(regexp_extract_all(html, '(?i)<a[\\s>/]')) as int) as links, cast(len(regexp_extract_all(html, '(?i)<p[\\s>/]')) as int) as paragraphs,
        regexp_extract_all(html, '(?i)<html\\s(?:[^>]*\\s)?lang="([^"]*)"', 1)[1] as lang,
        regexp_replace(regexp_extract_all(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)[1], '<[^>]*>', '', 'g') as title,
        regexp_extract_all(html, '(?i)<a\\s(?:[^>]*\\s)?href="([^"]*)"', 1)[1] as first_link from pages)""",
)
def html_values(spark, folder):
    h = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id", R.tag_count(h, "a").alias("links"), R.tag_count(h, "p").alias("paragraphs"), R.tag_attribute(h, "html", "lang").alias("lang"),
        R.tag_text(h, "title").alias("title"), R.tag_attribute(h, "a", "href").alias("first_link"),
    )


# Fixed values of the markup language, as the standard library has them: references by name, and numbers that stand for other characters or none.
def _signs(values) -> str:
    return ", ".join(f"({key!r}, {' || '.join(f'chr({ord(c)})' for c in sign)})" for key, sign in values)


SQL_NAMED, SQL_NUMBERED = _signs(html5.items()), _signs(_invalid_charrefs.items())
SQL_NEVER = ", ".join(map(str, sorted(_invalid_codepoints)))
# Every piece after an ampersand begins with a number, with or without a semicolon, or with the longest name that is known, or it is plain text.
SQL_DECODED = rf"""named(name, sign) as (values {SQL_NAMED}), numbered(n, sign) as (values {SQL_NUMBERED}),
        piece as (select page_id, what, unnest(string_split(value, '&')) as t, generate_subscripts(string_split(value, '&'), 1) as i from raw where value is not null),
        word as (select page_id, what, i, max(length(name)) as size from piece join named on i > 1 and starts_with(t, name) group by all),
        number as (select page_id, what, i, length(code) as size, coalesce(case when lower(code[2]) = 'x' then try_cast('0x' || rtrim(code[3:], ';') as bigint) else try_cast(rtrim(code[2:], ';') as bigint) end, 1114112) as n
          from (select *, regexp_extract(t, '^#([0-9]+|[xX][0-9a-fA-F]+);?') as code from piece where i > 1) where code <> ''),
        shown as (select page_id, what, p.i, case when p.i = 1 then t when c.n is not null then t[c.size + 1:] when w.size is not null then t[w.size + 1:] else '&' || t end as rest,
            case when c.n is not null then case when d.sign is not null then d.sign when c.n between 55296 and 57343 or c.n > 1114111 then chr(65533) when c.n in ({SQL_NEVER}) then '' else chr(c.n::int) end
              when w.size is not null then s.sign else '' end as sign
          from piece p left join number c using (page_id, what, i) left join numbered d on d.n = c.n left join word w using (page_id, what, i) left join named s on s.name = t[:w.size]),
        decoded as (select page_id, what, string_agg(sign || rest, '' order by i) as value from shown group by all)"""
# Each run of what Python takes for white space is one space, and tags, marked so that no reference spans them, are nothing.
SQL_ONE_LINE = r"trim(regexp_replace(replace({}, chr(1), ''), '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@register(
    "html_selector_values",
    rf"""with p as (select page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as article,
          regexp_replace(regexp_extract_all(html, '(?s)<footer>(.*?)</footer>', 1)[1], '<[^>]*>', chr(1), 'g') as footer,
          regexp_replace(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)[1], '<[^>]*>', chr(1), 'g') as title from pages),
        raw as (select page_id, 'title' as what, title as value from p union all select page_id, 'footer', footer from p
          union all select page_id, 'first_link', regexp_extract_all(nav, '<ul><li><a href="([^"]*)"', 1)[1] from p
          union all select page_id, 'lang', regexp_extract_all(html, '<html lang="([^"]*)"', 1)[1] from p), {SQL_DECODED}
        select p.page_id, cast(len(regexp_extract_all(nav, '<a href=')) as int) as links, cast(len(regexp_extract_all(article, '<p>')) as int) as paragraphs,
          h.value as first_link, l.value as lang, {SQL_ONE_LINE.format('t.value')} as title, {SQL_ONE_LINE.format('f.value')} as footer,
          cast(len(regexp_extract_all(html, '<(div|p|span) class="ad')) as int) as boxes from p
          left join decoded t on t.page_id = p.page_id and t.what = 'title' left join decoded f on f.page_id = p.page_id and f.what = 'footer'
          left join decoded h on h.page_id = p.page_id and h.what = 'first_link' left join decoded l on l.page_id = p.page_id and l.what = 'lang'""",
)
def html_selector_values(spark, folder):
    return M.selector_values(table(spark, folder, "pages").select("page_id", "html"), {
        "links": ("count", "nav li > a[href]"), "paragraphs": ("count", "article p"), "first_link": ("attribute", "nav > ul > li > a", "href"),
        "lang": ("attribute", "html", "lang"), "title": ("text", "head > title"), "footer": ("text", "body > footer"), "boxes": ("count", ".ad"),
    })


# A double as to_json writes it: plain from a thousandth up to ten millions, else one digit before the point and an exponent.
SQL_JSON_NUMBER = """case when value is null then 'undefined' when isnan(value) then '"NaN"' when isinf(value) then case when value > 0 then '"Infinity"' else '"-Infinity"' end
          when value = 0 or (abs(value) >= 0.001 and abs(value) < 10000000) then cast(value as varchar)
          else regexp_replace(regexp_replace(
            list_filter(list_transform(range(17), lambda p: format('{:.' || p || 'e}', value)), lambda s: cast(s as double) = value)[1], 'e[+]?(-?)0*([0-9])', 'E\\1\\2'), '^(-?[0-9])E', '\\1.0E') end"""


@register(
    "expectation_check",
    f"""with t as (select event_id, event_type, value, props, {SQL_JSON_NUMBER} as vs from events)
        select event_id, case event_type
          when 'view' then case when not coalesce(not isnan(value) and value >= 5.5, false) then 'expected >= 5.5, got ' || vs
            when not (value <= 20) then 'expected <= 20, got ' || vs end
          when 'click' then case when not coalesce(contains(props, '6'), false) then 'expected to contain "6"' end
          when 'error' then case when coalesce(value <> 0 and not isnan(value), false) then 'expected truthy=false, got ' || vs end
          when 'purchase' then case when vs <> '10.5' then 'expected 10.5, got ' || vs end end as failure from t""",
)
def expectation_check(spark, folder):
    spec = ("event_type string, equals string, gte double, lte double, contains string, truthy boolean")
    expected = spark.createDataFrame(
        [("view", None, 5.5, 20.0, None, None), ("click", None, None, None, "6", None), ("error", None, None, None, None, False), ("purchase", "10.5", None, None, None, None)], spec
    )
    joined = table(spark, folder, "events").join(F.broadcast(expected), "event_type", "left")
    text = F.when(F.col("event_type") == "click", F.col("props"))
    failure = R.expectation_failure(
        V.json_text(F.col("value")), F.col("value"), text, V.truthy_number(F.col("value")),
        F.col("equals"), F.col("gte"), F.col("lte"), F.col("contains"), F.col("truthy"),
    )
    return joined.select("event_id", failure.alias("failure"))


@register(
    "request_validation",
    """with t as (select *, l_quantity / 10 as scale, l_discount * 15 as mf, l_linenumber % 2 = 0 as rule, l_suppkey % 3 as fb from lineitem)
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, cast(len(list_filter([
          case when l_linenumber - 1 <= 0 then 'a' end, case when not (scale > 0 and scale <= 4 and (scale <= 1 or scale = floor(scale))) then 'b' end,
          case when rule and not (mf between 0 and 1) then 'c' end, case when fb > 0 and not rule then 'd' end], lambda e: e is not null)) as int) as n_errors,
          case when l_linenumber - 1 <= 0 then 'ocr.passes must be a non-empty array of passes'
            when not (scale > 0 and scale <= 4 and (scale <= 1 or scale = floor(scale))) then 'scale ' ||
              case when scale = floor(scale) then cast(cast(scale as bigint) as varchar) else cast(scale as varchar) end || ' must be in (0, 1] or a whole factor 2..4'
            when rule and not (mf between 0 and 1) then 'ocr.stop_when.min_fraction must be a number in [0, 1]'
            when fb > 0 and not rule then 'ocr.fallback needs ocr.stop_when: without keywords it could never run' end as first_error from t""",
)
def request_validation(spark, folder):
    errors = R.spec_errors(F.col("l_linenumber") - 1, F.col("l_quantity") / 10, F.col("l_discount") * 15, F.col("l_suppkey") % 3, F.col("l_linenumber") % 2 == 0)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.size(errors).alias("n_errors"), F.get(errors, F.lit(0)).alias("first_error"),
    )


@register(
    "request_pass_errors",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, case l_linenumber
          when 1 then case when l_quantity % 2 <> 0 then 'ocr.passes.psm must be an integer' end
          when 2 then case when l_quantity > 25 then 'ocr.passes.dpi must be a non-negative number' end
          when 3 then case when l_quantity > 25 then 'ocr.passes.lang must be a string' end
          when 4 then 'ocr.passes must be an object'
          when 5 then case when not (l_quantity / 10 <= 1 or (l_quantity / 10 <= 4 and l_quantity % 10 = 0)) then 'ocr.passes.upscale: scale ' ||
            case when l_quantity % 10 = 0 then cast(cast(l_quantity // 10 as int) as varchar) else cast(l_quantity / 10 as varchar) end || ' must be in (0, 1] or a whole factor 2..4' end
          when 6 then 'ocr.passes.pixel_budget must be a non-negative number' end as error from lineitem""",
)
def request_pass_errors(spark, folder):
    q = F.col("l_quantity")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    doc = (
        F.when(F.col("l_linenumber") == 1, text('{"psm":', q / 2, ',"lang":null}'))
        .when(F.col("l_linenumber") == 2, text('{"dpi":', F.lit(25) - q, "}"))
        .when(F.col("l_linenumber") == 3, F.when(q > 25, text('{"lang":', q, ',"psm":-1}')).otherwise('{"lang":"deu"}'))
        .when(F.col("l_linenumber") == 4, text('"', q, '"'))
        .when(F.col("l_linenumber") == 5, text('{"upscale":', q / 10, "}"))
        .when(F.col("l_linenumber") == 6, text('{"pixel_budget":"', q, '"}'))
        .otherwise('{"psm":6,"lang":"deu","upscale":0,"pixel_budget":1000}')
    )
    error = V.let(F.try_parse_json(doc), lambda v: R.pass_error(v, "ocr.passes"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", error.alias("error"))


def planned_steps(spark, folder):
    turn = F.col("turn")
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), turn.alias("idx"), F.when(turn % 3 != 1, name(turn % 6)).alias("id"),
        F.element_at(F.array(*[F.lit(o) for o in [*OPERATIONS, "hover"]]), (F.length("text") % 5 + 1).cast("int")).alias("op"),
        F.when(turn == 2, name(F.length("text") % 4)).alias("if_ok"), F.when(turn == 3, F.lit("s3")).alias("if_failed"),
        F.when(turn == 4, F.lit("s9")).alias("if_html_incomplete"), (F.length("text") * 200).cast("bigint").alias("timeout_ms"),
    )


SQL_PLANNED = """p as (select conv_id as run_id, turn as idx, (['url', 'click', 'content', 'screenshot', 'hover'])[length(text) % 5 + 1] as op,
    case when turn % 3 <> 1 then 's' || (turn % 6) end as raw_id, case when turn = 2 then 's' || (length(text) % 4) end as if_ok,
    case when turn = 3 then 's3' end as if_failed, case when turn = 4 then 's9' end as if_html_incomplete, length(text) * 200 as timeout_ms from conversations),
  n as (select *, coalesce(raw_id, idx || ':' || op) as id from p),
  e as (select n.run_id, n.idx, case
    when (select count(*) from n c where c.run_id = n.run_id) > 200 then 'too many'
    when op = 'hover' then 'steps[' || idx || '].op "hover" is not one of url,click,content,screenshot'
    when exists (select 1 from n o where o.run_id = n.run_id and o.id = n.id and o.idx < n.idx) then 'steps[' || idx || '].id ' || id || ' is duplicated'
    when if_ok is not null and not exists (select 1 from n o where o.run_id = n.run_id and o.id = n.if_ok and o.idx <= n.idx) then 'steps[' || idx || '].if_ok names ' || if_ok || ', which is not an EARLIER step id'
    when if_failed is not null and not exists (select 1 from n o where o.run_id = n.run_id and o.id = n.if_failed and o.idx <= n.idx) then 'steps[' || idx || '].if_failed names ' || if_failed || ', which is not an EARLIER step id'
    when if_html_incomplete is not null and not exists (select 1 from n o where o.run_id = n.run_id and o.id = n.if_html_incomplete and o.idx <= n.idx) then 'steps[' || idx || '].if_html_incomplete names ' || if_html_incomplete || ', which is not an EARLIER step id'
    when not timeout_ms between 0 and 120000 then 'steps[' || idx || '].timeout_ms must be 0..120000' end as error from n)"""


@register("step_validation", f"with {SQL_PLANNED} select run_id, idx, error from e")
def step_validation(spark, folder):
    return R.step_errors(planned_steps(spark, folder), OPERATIONS).select("run_id", "idx", "error")


@register("step_rejects", f"with {SQL_PLANNED} select run_id, arg_min(error, idx) as error from e where error is not null group by 1")
def step_rejects(spark, folder):
    return R.split_rejects(R.step_errors(planned_steps(spark, folder), OPERATIONS))[1]


def gated_steps(spark, folder):
    turn, size = F.col("turn"), F.length("text")
    gate = lambda at, names: F.when(turn == at, names)
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), turn.alias("idx"), F.concat(F.lit("s"), turn.cast("string")).alias("id"),
        F.when(turn.isin(1, 4), "screenshot").otherwise("content").alias("op"), (size % 3 == 0).alias("optional"),
        F.when(turn == 2, "s0").when(turn == 5, "s4").alias("if_ok"), F.when(turn == 3, "s1").when(turn == 6, "s2").alias("if_failed"),
        gate(7, F.lit("s5")).alias("if_html_incomplete"), (size % 5 != 0).alias("raw_ok"), (size % 7 != 0).alias("started"), (size % 2 == 0).alias("html_complete"),
    )


SQL_GATED = """recursive s as (select conv_id as run_id, turn as idx, 's' || turn as id, turn in (1, 4) as image, length(text) % 3 = 0 as optional,
    case turn when 2 then 's0' when 5 then 's4' end as if_ok, case turn when 3 then 's1' when 6 then 's2' end as if_failed,
    case turn when 7 then 's5' end as if_html, length(text) % 5 <> 0 as raw_ok, length(text) % 7 <> 0 as started, length(text) % 2 = 0 as html from conversations),
  walk as (
    select distinct run_id, -1::bigint as idx, false as stopped, true as all_ok, []::struct(id varchar, skipped boolean, ok boolean, pending boolean, optional boolean, final boolean, html boolean)[] as res from s
    union all
    select run_id, idx, stopped or halt, all_ok and not halt, list_append(res, {'id': id, 'skipped': skip, 'ok': case when skip then false when image and started then true else raw_ok end,
        'pending': not skip and image and started, 'optional': optional, 'final': raw_ok, 'html': not skip and html})
    from (select *, not skip and not (image and started) and not raw_ok and not optional as halt from (
      select *, stopped
        or (if_ok is not null and coalesce(len(list_filter(res, lambda r: r.id = if_ok and not r.skipped and r.ok)), 0) = 0)
        or (if_failed is not null and coalesce(len(list_filter(res, lambda r: r.id = if_failed and not r.skipped and not r.ok)), 0) = 0)
        or (if_html is not null and coalesce(len(list_filter(res, lambda r: r.id = if_html and r.html)), 0) > 0) as skip from (
      select w.run_id, s.idx, s.id, image, s.optional, if_ok, if_failed, if_html, raw_ok, started, s.html,
        w.stopped or coalesce(len(list_filter(w.res, lambda r: r.pending and r.id in (coalesce(if_ok, ''), coalesce(if_failed, ''), coalesce(if_html, '')) and not r.final and not r.optional)), 0) > 0 as stopped,
        w.all_ok and coalesce(len(list_filter(w.res, lambda r: r.pending and r.id in (coalesce(if_ok, ''), coalesce(if_failed, ''), coalesce(if_html, '')) and not r.final and not r.optional)), 0) = 0 as all_ok,
        list_transform(w.res, lambda r: case when r.pending and r.id in (coalesce(if_ok, ''), coalesce(if_failed, ''), coalesce(if_html, ''))
          then {'id': r.id, 'skipped': r.skipped, 'ok': r.final, 'pending': false, 'optional': r.optional, 'final': r.final, 'html': r.html} else r end) as res
      from walk w join s on s.run_id = w.run_id and s.idx = w.idx + 1)))),
  fin as (select run_id, all_ok and len(list_filter(res, lambda r: r.pending and not r.final and not r.optional)) = 0 as all_ok, res from walk w
    where idx = (select max(idx) from s where s.run_id = w.run_id))"""


@register("run_outcomes", f"with {SQL_GATED} select run_id, all_ok, cast(len(res) as int) as n_steps, cast(len(list_filter(res, lambda r: r.skipped)) as int) as n_skipped from fin")
def run_outcomes(spark, folder):
    return R.run_outcomes(gated_steps(spark, folder)).select(
        "run_id", "all_ok", F.size("results").alias("n_steps"), F.size(F.filter("results", lambda r: r["skipped"])).alias("n_skipped")
    )


@register(
    "run_rejections",
    """select conv_id as run_id, count(*) <= 4 and bool_and(false) as all_ok, 'steps accepts at most 4; got ' || count(*) as error from conversations group by 1 having count(*) > 4""",
)
def run_rejections(spark, folder):
    return R.run_outcomes(gated_steps(spark, folder), 4).where("error is not null and size(results) = 0").select("run_id", "all_ok", "error")


@register(
    "run_step_results",
    f"""with {SQL_GATED} select run_id, all_ok, r.id as id, r.skipped as skipped, case when not r.skipped then case when r.pending then r.final else r.ok end end as ok
        from (select run_id, all_ok, unnest(res) as r from fin)""",
)
def run_step_results(spark, folder):
    return R.step_results(R.run_outcomes(gated_steps(spark, folder))).drop("idx")


SQL_DEADLINES = """with e as (select event_id, user_id, event_type, epoch_us(ts) // 1000 as now, cast(value * 2000000 as bigint) as lim,
          last_value(case when event_type = 'signup' then epoch_us(ts) // 1000 + cast(floor(value * 2000000) as bigint) end ignore nulls) over
            (partition by user_id, event_id % 9 order by ts, event_id rows between unbounded preceding and 1 preceding) as deadline,
          event_id % 9 <> 0 and event_type <> 'signup' as bound from events),
        r as (select *, case when event_id % 9 <> 0 then deadline - now end as rest from e)
        select event_id, coalesce(rest <= 0, false) as exhausted, case when rest > 0 then least(rest, 3600000) when rest is null and not (bound and deadline is null) then 3600000 end as remaining_ms,
          case when bound and deadline is null then 'clock c' || event_id % 9 || ' was never started' end as error from r"""


def clocked():
    """Arguments that make events steps under clocks: which event starts its clock, limits, timeouts, the clock's name."""
    name = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string")))
    return F.col("event_type") == "signup", F.floor(F.col("value") * 2_000_000).cast("bigint"), F.lit(3_600_000).cast("bigint"), name


@register("step_deadlines", SQL_DEADLINES)
def step_deadlines(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    started, limit, timeout, name = clocked()
    out = R.deadlines(e, ["user_id"], ["ts", "event_id"], None, started, limit, timeout, F.unix_millis("ts"), name)
    return out.select("event_id", "exhausted", "remaining_ms", "error")


@register(
    "interception_rules",
    """with t as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':[0-9]+$', '') as host from pages)
        select page_id, case when regexp_matches(url, '[?&]ref=') then 'abort' when regexp_matches(url, '/fr/') then 'fulfill:0'
          when regexp_matches(url, 'net/') then 'fulfill:1' when host = 'm.ththre.example.org' then 'headers:0' else 'continue' end as action,
          case when (contains(url, 'page=') or contains(url, '#')) and page_id % 2 = 0 then 'abort' else 'continue' end as blocked from t""",
)
def interception_rules(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", R.interception(url, U.host(url), ["[?&]ref="], ["/fr/", "net/"], ["m.ththre.example.org"]).alias("action"),
        R.blocked(url, F.col("page_id") % 2 == 1, ["page=", "#"]).alias("blocked"),
    )


@register(
    "interception_table",
    """with t as (select page_id, page_id % 6 as run_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':[0-9]+$', '') as host from pages),
        j as (select *, case when run_id in (1, 2) and regexp_matches(url, '[?&]ref=') then 'fail' when run_id in (0, 1) and regexp_matches(url, '/fr/|net/') then 'fulfill' else 'continue' end as action
          from t left join region on r_regionkey = run_id)
        select run_id, page_id as request_id, action, case when action = 'fulfill' then case when regexp_matches(url, '/fr/') then 404 else 200 end end as status,
          case when action = 'fulfill' then case when regexp_matches(url, '/fr/') then 'text/plain' else 'application/octet-stream' end end as content_type,
          case when action = 'fulfill' then case when regexp_matches(url, '/fr/') then length(r_name) else 0 end end as content_length,
          case when action = 'fulfill' then case when regexp_matches(url, '/fr/') then 'Not Found' else 'OK' end end as phrase,
          case when action = 'continue' and r_name is not null and host like '%.example.org' and starts_with(host, 'm.') then 'accept=*/*,via=' || r_name || ',x-run=' || r_regionkey end as headers from j""",
)
def interception_table(spark, folder):
    """Rules that each region brings for its own run; one run has none."""
    r = table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("run_id"), "r_name")
    hosts = table(spark, folder, "pages").select((F.col("page_id") % 6).alias("run_id"), U.host(F.col("url")).alias("pattern")).distinct()
    hosts = hosts.where(F.col("pattern").startswith("m.") & F.col("pattern").endswith(".example.org"))
    none, no_map = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")

    def rule(df, position, kind, pattern, status=0, content_type=none, body=none, headers=no_map):
        return df.select("run_id", F.lit(position).alias("position"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(status).alias("status"),
                         content_type.alias("content_type"), body.alias("body"), headers.alias("headers"))

    laid = F.create_map(F.lit("x-run"), F.col("run_id").cast("string"), F.lit("via"), F.col("r_name"))
    rules = (
        rule(r.where("run_id in (1, 2)"), 0, "abort", F.lit("[?&]ref="))
        .unionByName(rule(r.where("run_id in (0, 1)"), 1, "fulfill", F.lit("/fr/"), 404, F.lit("text/plain"), F.col("r_name")))
        .unionByName(rule(r.where("run_id in (0, 1)"), 2, "fulfill", F.lit("net/")))
        .unionByName(rule(r.join(hosts, "run_id"), 3, "headers", F.col("pattern"), headers=laid))
    )
    url = F.col("url")
    requests = table(spark, folder, "pages").select(
        (F.col("page_id") % 6).alias("run_id"), F.col("page_id").alias("request_id"), "url", U.host(url).alias("host"),
        F.create_map(F.lit("Accept"), F.lit("*/*"), F.lit("Via"), F.lit("own")).alias("headers"),
    )
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return R.intercepted(requests, rules).withColumn("headers", shown)


def envelopes(spark, folder):
    """Run envelopes as JSON text, one per conversation turn."""
    c = table(spark, folder, "conversations")
    doc = F.to_json(F.struct(
        (F.col("conv_id") * 100 + F.col("turn")).alias("run_id"), (F.col("role") == "user").alias("ok"), F.col("text").alias("final_url"),
        F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.cast("string").alias("id"), line.alias("value"), F.length(line).cast("bigint").alias("elapsed_ms"))).alias("steps"),
        F.split("role", "s").alias("console_errors"), F.struct(F.length("text").cast("bigint").alias("total_ms")).alias("timings"),
    ))
    return results.parse_runs(c.select(doc.alias("line")), "line")


@register(
    "source_run_steps",
    """select conv_id * 100 + turn as run_id, cast(i - 1 as int) as idx, cast(i - 1 as varchar) as id, line as value, length(line) as elapsed_ms from (
        select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from conversations)""",
)
def source_run_steps(spark, folder):
    return results.steps(envelopes(spark, folder)).select("run_id", "idx", "id", "value", "elapsed_ms")


@register(
    "source_run_tables",
    """select conv_id * 100 + turn as run_id, role = 'user' as ok, text as final_url, length(text) as total_ms, cast(len(string_split(role, 's')) as bigint) as n_console from conversations""",
)
def source_run_tables(spark, folder):
    e = envelopes(spark, folder)
    console = results.console_errors(e).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_console"))
    return results.runs(e).join(console, "run_id")
