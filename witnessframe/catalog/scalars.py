"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions import values as V
from ..operators import ledger, variants
from ..tables import table
from .registry import register

WS = X.WHITESPACE
ASTRAL = "[\\x{10000}-\\x{10FFFF}]"
SQL_NORM = f"lower(trim(regexp_replace(text, '{WS}', ' ', 'g')))"
SQL_META = f"regexp_replace(regexp_replace(text, '{ASTRAL}', '??', 'g'), '[^\\x20-\\x7E]', '?', 'g')"


def sql_uri(c: str) -> str:
    for coded, literal in (("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = f"replace({c}, '{coded}', '{literal}')"
    return c


@register("fn_norm_text", f"select doc_id, {SQL_NORM} as norm from documents")
def norm_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@register(
    "fn_metadata_clamp",
    f"""select doc_id, left({SQL_META}, 512) as metadata,
        coalesce(nullif(trim(regexp_replace(left({SQL_META}, 160), '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'evidence') as segment
        from documents""",
)
def metadata_clamp(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.metadata_value(F.col("text"), 512).alias("metadata"), X.safe_segment(F.col("text")).alias("segment")
    )


@register(
    "fn_js_slice",
    f"""select doc_id, left(text, list_max(list_filter(range(0, 81),
          lambda k: k + length(regexp_replace(left(text, k), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) <= 80))) as head
        from documents""",
)
def js_slice(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.js_slice(F.col("text"), 80).alias("head"))


@register(
    "fn_manifest_line",
    "select doc_id, 'observed.' || lang || '=' || translate(text, chr(13) || chr(10), '  ') || chr(10) as line from documents",
)
def manifest_line(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.manifest_line(F.concat(F.lit("observed."), F.col("lang")), F.col("text")).alias("line")
    )


@register(
    "fn_public_url",
    f"""select page_id, 'https://pages.s3.eu-west-9.amazonaws.com/' ||
          array_to_string(list_transform(string_split(url, '/'), lambda s: {sql_uri('url_encode(s)')}), '/')
          || '?versionId=' || {sql_uri("url_encode(page_id || ' v')")} as public_url from pages""",
)
def public_url(spark, folder):
    version = F.concat(F.col("page_id").cast("string"), F.lit(" v"))
    return table(spark, folder, "pages").select(
        "page_id", X.public_url(F.lit("pages"), F.col("url"), version, "eu-west-9").alias("public_url")
    )


@register("fn_encode_uri", f"select doc_id, {sql_uri('url_encode(text)')} as encoded from documents")
def encode_uri(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.encode_uri_component(F.col("text")).alias("encoded"))


CONTENT_TYPES = [
    "text/html; charset=utf-8", "application/json", "application/ld+json", "image/svg+xml", "text/xml", "text/plain",
    "TEXT/CSS", "text/javascript", "application/javascript", "image/png",
]


@register(
    "fn_body_ext",
    f"""with t as (select doc_id, lower(({CONTENT_TYPES})[doc_id % 10 + 1]) as ct from documents)
        select doc_id, case when starts_with(ct, 'text/html') then 'html'
          when starts_with(ct, 'application/json') or (starts_with(ct, 'application/') and contains(ct, '+json')) then 'json'
          when starts_with(ct, 'application/xml') or starts_with(ct, 'text/xml') or contains(ct, '+xml') then 'xml'
          when starts_with(ct, 'text/plain') then 'txt' when starts_with(ct, 'text/css') then 'css'
          when starts_with(ct, 'application/javascript') or starts_with(ct, 'text/javascript') then 'js' else 'bin' end as ext
        from t""",
)
def body_ext(spark, folder):
    kinds = F.array(*[F.lit(c) for c in CONTENT_TYPES])
    chosen = F.element_at(kinds, (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", X.body_ext(chosen).alias("ext"))


@register(
    "fn_time_text",
    """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp,
        strftime(make_timestamp(cast(round(value * 1000) as bigint) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as epoch_iso from events""",
)
def time_text(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", X.iso_ms(F.col("ts")).alias("iso"), X.compact_stamp(F.col("ts")).alias("stamp"),
        X.epoch_to_iso(F.col("value")).alias("epoch_iso"),
    )


@register(
    "fn_dated_members",
    """select event_id, name, case when name in ('startDate', 'endDateTime', 'candidate') then strftime(make_timestamp(cast(round(value * 1000) as bigint) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')
        else event_type end as shown from events, (select unnest(['startDate', 'endDateTime', 'candidate', 'Dated', 'DATE']) as name)""",
)
def dated_members(spark, folder):
    names = F.explode(F.array(*map(F.lit, ["startDate", "endDateTime", "candidate", "Dated", "DATE"])))
    e = table(spark, folder, "events").select("event_id", "value", "event_type", names.alias("name"))
    return e.select("event_id", "name", X.dated_member(F.col("name"), F.col("value"), F.col("event_type")).alias("shown"))


@register(
    "fn_js_values",
    """select event_id,
        case when value = trunc(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end as value_text,
        coalesce(try_cast(trim(regexp_replace(props, '[^0-9]', ' ', 'g')) as double), 'nan'::double) as k_number,
        case when try_cast(props as double) is null then 'nan'::double else cast(props as double) end as props_number,
        (event_id % 3 <> 0) as id_truthy, coalesce(nullif(event_id % 3, 0), nullif(event_id % 5, 0)) as first_truthy,
        '"' || replace(props, '"', chr(92) || '"') || '"' as props_json
        from events""",
)
def js_values(spark, folder):
    e = table(spark, folder, "events")
    third, fifth = F.col("event_id") % 3, F.col("event_id") % 5
    return e.select(
        "event_id", V.js_string(F.col("value")).alias("value_text"),
        V.js_number(F.regexp_replace("props", "[^0-9]", " ")).alias("k_number"),
        V.js_number(F.col("props")).alias("props_number"), V.truthy_number(third).alias("id_truthy"),
        V.first_truthy_number(third, fifth).alias("first_truthy"), V.json_text(F.col("props")).alias("props_json"),
    )


@register(
    "fn_markdown_literal",
    r"select doc_id, regexp_replace(text, '([\\`*_\[\]<>&|~])', '\\\1', 'g') as literal from documents",
)
def markdown_literal(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.markdown_literal(F.col("text")).alias("literal"))


@register(
    "fn_identity",
    """select doc_id, sha256('["compact-v1","' || source || '","' || lang || '/' || doc_id || '","' || n_chars || '"]') as identity,
        'sha1/' || left(sha1(text), 2) || '/' || sha1(text) || '.png' as content_key from documents""",
)
def identity(spark, folder):
    key = F.concat_ws("/", F.col("lang"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(
        "doc_id", X.identity(F.lit("compact-v1"), F.col("source"), key, F.col("n_chars").cast("string")).alias("identity"),
        X.content_key(F.col("text")).alias("content_key"),
    )


@register(
    "fn_cookie_fingerprint",
    """with c as (select c_custkey,
          '{"name":"' || c_name || '","domain":"","path":"/","secure":true,"httpOnly":false,"sameSite":"Lax"}' as a,
          '{"name":"' || c_mktsegment || '","domain":"d' || c_nationkey || '","path":"","secure":false,"httpOnly":true,"sameSite":""}' as b
        from customer)
        select c_custkey, sha256('[' || case when lower(a) < lower(b) then a || ',' || b else b || ',' || a end || ']') as fingerprint from c""",
)
def cookie_fingerprint(spark, folder):
    none = F.lit(None).cast("string")

    def cookie(name, domain, path, secure, http_only, same_site):
        return F.struct(name.alias("name"), domain.alias("domain"), path.alias("path"), F.lit(secure).alias("secure"),
                        F.lit(http_only).alias("httpOnly"), same_site.alias("sameSite"))

    domain = F.concat(F.lit("d"), F.col("c_nationkey").cast("string"))
    jar = F.array(cookie(F.col("c_name"), none, F.lit("/"), True, False, F.lit("Lax")),
                  cookie(F.col("c_mktsegment"), domain, none, False, True, none))
    return table(spark, folder, "customer").select("c_custkey", X.cookie_fingerprint(jar).alias("fingerprint"))


@register(
    "fn_pass_rules",
    """with t as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount,
          l_linenumber % 3 as psm, l_quantity / 10 as scale from lineitem)
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount,
          cast(case when psm = 0 then 3 else psm end as int) as psm,
          case when scale = 0 then 1.0 else scale end as scale,
          (scale > 0 and scale <= 4 and (scale <= 1 or scale = floor(scale))) as scale_ok,
          cast(case when l_partkey * l_suppkey * 9 <= 100000 then 3 when l_partkey * l_suppkey * 4 <= 100000 then 2 else 1 end as int) as factor,
          (select min(s) from (select unnest(range(1, 2000)) as s) where (l_partkey // s) * (l_suppkey // s) <= 500)::int as step
        from t""",
)
def pass_rules(spark, folder):
    scale = F.col("l_quantity") / 10
    line = table(spark, folder, "lineitem")
    filled = V.pass_defaults(F.col("l_linenumber") % 3, F.lit(""), F.lit(0), scale, F.lit(0))
    return line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        filled["psm"].alias("psm"), filled["scale"].alias("scale"), V.valid_scale(scale).alias("scale_ok"),
        V.factor_within_budget(F.col("l_partkey"), F.col("l_suppkey"), 3, 100_000).alias("factor"),
        V.sample_step(F.col("l_partkey"), F.col("l_suppkey"), 500).alias("step"),
    )


@register(
    "fn_steps_text",
    """select o_orderkey, case when o_orderkey % 4 = 0 then 'none' else
          'wait_ms:' || o_custkey || '|fill:' || o_orderpriority || '=' || o_orderstatus || '|resize:' || (o_orderkey % 7) || 'x' || (o_orderkey % 5)
          || '|click:' || o_orderstatus end as steps from orders""",
)
def steps_text(spark, folder):
    no_text, no_int = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def step(kind, selector=no_text, value=no_text, ms=no_int, width=no_int, height=no_int):
        return F.struct(F.lit(kind).alias("kind"), selector.alias("selector"), value.alias("value"), ms.alias("ms"),
                        width.alias("width"), height.alias("height"))

    plan = F.array(
        step("wait", ms=F.col("o_custkey")), step("fill", F.col("o_orderpriority"), F.col("o_orderstatus")),
        step("resize", width=F.col("o_orderkey") % 7, height=F.col("o_orderkey") % 5), step("click", F.col("o_orderstatus")),
    )
    steps = F.when(F.col("o_orderkey") % 4 == 0, F.slice(plan, 1, 0)).otherwise(plan)
    return table(spark, folder, "orders").select("o_orderkey", X.steps_text(steps).alias("steps"))


@register(
    "fn_screens_tall",
    """select o_orderkey, case when o_custkey > 0 and o_orderkey % 40 > 0
        then printf('%.2f', o_custkey::double / (o_orderkey % 40)::double) else '-1' end as screens from orders""",
)
def screens_tall(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", X.screens_tall(F.col("o_custkey"), F.col("o_orderkey") % 40).alias("screens")
    )


@register(
    "fn_flatten_params",
    """select event_id, 'props.k' as path, regexp_extract(props, '([0-9]+)', 1) as value from events
        union all select event_id, 'list.member.1', event_type from events
        union all select event_id, 'list.member.2.user', cast(user_id as varchar) from events
        union all select event_id, 'deep' || repeat('.a', 12), 'x' from events where event_id % 50 = 0""",
)
def flatten_params(spark, folder):
    doc = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"none":null,"list":["'), F.col("event_type"),
                   F.lit('",{"user":'), F.col("user_id").cast("string"), F.lit("},null]"),
                   F.when(F.col("event_id") % 50 == 0, ',"deep":' + '{"a":' * 12 + '"x"' + "}" * 12).otherwise(""), F.lit("}"))
    events = table(spark, folder, "events").select("event_id", doc.alias("doc"))
    return variants.flatten_params(events, ["event_id"], "doc")


@register(
    "fn_console_text",
    """select event_id,
        '[' || event_type || ' Thing] ' || 'E: ' || user_id || ' 9' || coalesce(' ' || nullif(props, ''), ' ') as console,
        case when event_id % 2 = 0 then 'boom ' || event_id else 'boom ' || event_id || chr(10) || 'f' end as exception
        from events""",
)
def console_text(spark, folder):
    none = F.lit(None).cast("string")

    def arg(object_id=none, subtype=none, kind=none, class_name=none, description=none, unserializable=none, value=none):
        return F.struct(object_id.alias("object_id"), subtype.alias("subtype"), kind.alias("type"), class_name.alias("class_name"),
                        description.alias("description"), unserializable.alias("unserializable"), value.alias("value"))

    user = F.col("user_id").cast("string")
    args = F.array(
        arg(F.lit("1"), kind=F.col("event_type"), class_name=F.lit("Thing")),
        arg(F.lit("2"), F.lit("error"), description=F.concat(F.lit("E: "), user, F.lit("\n    at g"))),
        arg(unserializable=F.lit("9n")), arg(value=F.col("props")),
    )
    message = F.concat(F.lit("RangeError: boom "), F.col("event_id").cast("string"), F.lit("\n    at f"))
    shown = X.exception_text(F.lit("RangeError"), message, (F.col("event_id") % 2 == 0).cast("int"))
    return table(spark, folder, "events").select("event_id", X.console_text(args).alias("console"), shown.alias("exception"))


@register(
    "fn_exception_message",
    """select event_id, case event_id % 4 when 0 then event_type when 1 then props when 2 then 'boom ' || event_id else '[object Thing]' end as message from events""",
)
def exception_message(spark, folder):
    none, case = F.lit(None).cast("string"), F.col("event_id") % 4

    def details(kind=none, subtype=none, object_id=none, class_name=none, description=none, value=none):
        return F.struct(object_id.alias("object_id"), subtype.alias("subtype"), kind.alias("type"), class_name.alias("class_name"),
                        description.alias("description"), none.alias("unserializable"), value.alias("value"))

    boom = F.concat(F.lit("RangeError: boom "), F.col("event_id").cast("string"), F.lit("\n    at f"))
    thrown = (
        F.when(case == 1, details(F.lit("string"), value=F.col("props")))
        .when(case == 2, details(F.lit("object"), F.lit("error"), F.lit("7"), F.lit("RangeError"), boom))
        .when(case == 3, details(F.lit("object"), object_id=F.lit("8"), class_name=F.lit("Thing"), description=F.lit("[object Thing]")))
    )
    return table(spark, folder, "events").select("event_id", X.exception_message(thrown, F.col("event_type"), F.lit(1)).alias("message"))


@register(
    "fn_status_text",
    """select event_id, case 200 + event_id % 304 when 200 then 'OK' when 201 then 'Created' when 202 then 'Accepted'
        when 204 then 'No Content' when 301 then 'Moved Permanently' when 302 then 'Found' when 304 then 'Not Modified'
        when 307 then 'Temporary Redirect' when 308 then 'Permanent Redirect' when 400 then 'Bad Request' when 401 then 'Unauthorized'
        when 403 then 'Forbidden' when 404 then 'Not Found' when 410 then 'Gone' when 500 then 'Internal Server Error'
        when 502 then 'Bad Gateway' when 503 then 'Service Unavailable' else '' end as phrase from events""",
)
def status_text(spark, folder):
    return table(spark, folder, "events").select("event_id", X.status_text(200 + F.col("event_id") % 304).alias("phrase"))


@register(
    "fn_safe_name",
    """select p_partkey, regexp_matches(p_name, '^[A-Za-z0-9._-]{1,200}$') as name_ok,
        regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z0-9._-]{1,200}$') as joined_ok from part""",
)
def safe_name(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", X.safe_name(F.col("p_name")).alias("name_ok"), X.safe_name(F.translate("p_name", " ", "_")).alias("joined_ok")
    )


@register(
    "fn_timing_facts",
    """select o_orderkey, 'capture.timing.dns-ms' as fact, cast(o_custkey as varchar) as value from orders
        union all select o_orderkey, 'capture.timing.tcp-ms', '-1' from orders
        union all select o_orderkey, 'capture.timing.protocol', o_orderpriority from orders
        union all select o_orderkey, 'capture.timing.' || k, '-1' from orders, (select unnest(['redirect-ms', 'tls-ms', 'request-ms',
          'response-ms', 'dom-interactive-ms', 'dom-complete-ms', 'redirect-count', 'transfer-bytes', 'encoded-body-bytes', 'decoded-body-bytes']) as k)""",
)
def timing_facts(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.create_map(F.lit("dns"), F.col("o_custkey").cast("string"), F.lit("protocol"), F.col("o_orderpriority")).alias("timing")
    )
    return orders.select("o_orderkey", F.explode(ledger.timing_facts(F.col("timing"))).alias("fact", "value"))


@register(
    "fn_parse_duration",
    """with t as (select event_id, value || (['ms', 's', 'us', 'm'])[event_id % 4 + 1] as d from events)
        select event_id, round(case when d like '%ms' then cast(left(d, length(d) - 2) as double)
          when d like '%us' then cast(left(d, length(d) - 2) as double) * 0.001
          when d like '%s' then cast(left(d, length(d) - 1) as double) * 1000 end, 6) as ms from t""",
)
def parse_duration(spark, folder):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ms", "s", "us", "m")]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.col("value").cast("string"), unit)
    return table(spark, folder, "events").select("event_id", F.round(X.parse_duration(text), 6).alias("ms"))


@register(
    "url_projection",
    """with t as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme,
          lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as authority from pages)
        select page_id, url, scheme || '://' || authority as origin, regexp_replace(authority, ':[0-9]+$', '') as host,
          regexp_matches(url, 'page=[0-9]+') as paged from t""",
)
def url_projection(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", "url", U.origin(url).alias("origin"), U.host(url).alias("host"), url.rlike("page=[0-9]+").alias("paged")
    )
