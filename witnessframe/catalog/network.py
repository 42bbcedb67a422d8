"""Network lifecycles over the events table (a user is a page, props.k a request id)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..operators import network as N
from ..tables import table
from .registry import register

# Which event type stands for which browser event.
KINDS = {"view": "open", "click": "response", "signup": "cached", "purchase": "finished", "error": "failed"}


def browser_events(spark, folder, requests: int = 100, e=None):
    """Browser events of the events table, or of ``e``, a stream of it."""
    e = table(spark, folder, "events") if e is None else e
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % requests
    return e.select(
        F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.element_at(names, F.col("event_type")).alias("kind"),
        k.cast("string").alias("request_id"), F.concat(F.when(F.col("event_id") % 7 == 0, "data:u").otherwise("https://u"), F.col("user_id").cast("string"), F.lit("/")).alias("url"),
        F.concat(F.lit("h"), (F.col("event_id") % 4).cast("string")).alias("protocol"), (F.col("event_id") * 3).alias("encoded_data_length"), (F.col("event_id") % 5 == 0).alias("canceled"),
        F.parse_json(F.concat(F.lit('{"dns":'), F.col("event_id").cast("string"), F.lit(',"note":"7"}'))).alias("timing"),
        (F.col("event_id") % 3 != 0).alias("redirect"), (200 + F.floor("value")).cast("int").alias("status"), "value", "event_type",
    )


def sql_legs(requests: int = 100) -> str:
    return f"""e as (select user_id as page_id, event_id, ts, cast(regexp_extract(props, '([0-9]+)', 1) as int) % {requests} as request_id, event_id % 3 <> 0 as redirect, event_id % 7 <> 0 as http,
        cast(200 + floor(value) as int) as status, value, event_type, case event_type when 'view' then 'open' when 'click' then 'response' when 'signup' then 'cached' when 'purchase' then 'finished' else 'failed' end as kind from events),
      n as (select *, cast(sum(case when kind = 'open' and http then 1 else 0 end) over w as bigint) as leg from e window w as (partition by page_id, request_id order by ts, event_id rows unbounded preceding)),
      c as (select *, min(case when kind in ('finished', 'failed') or (kind = 'open' and not http) then event_id end) over (partition by page_id, request_id, leg) as closed_at from n),
      o as (select page_id, request_id, leg, event_id, redirect, closed_at, lead(event_id) over r as next_id, lead(redirect) over r as next_redirect
        from c where kind = 'open' and http window r as (partition by page_id, request_id order by leg)),
      q as (select o.page_id, o.request_id, o.leg, o.event_id, o.closed_at, case when k.kind in ('finished', 'failed') then k.kind when k.kind = 'open' then case when k.redirect then 'redirected' else 'pending' end
          when next_redirect then 'redirected' else 'pending' end as state, coalesce(o.closed_at, next_id) as last_id from o left join c k on k.event_id = o.closed_at),
      legs as (select o.page_id, cast(o.request_id as varchar) as request_id, o.leg, o.event_id, o.state, case when o.state <> 'pending' then o.last_id end as end_event_id,
        case when o.state = 'redirected' then any_value(z.status) else arg_max(c.status, c.event_id) filter (where c.kind = 'response' and (o.closed_at is null or c.event_id < o.closed_at)) end as status,
        case when o.state = 'redirected' then 'h' || o.last_id % 4 else 'h' || arg_max(c.event_id, c.event_id) filter (where c.kind = 'response' and (o.closed_at is null or c.event_id < o.closed_at)) % 4 end as protocol,
        cast(case when o.state = 'redirected' then o.last_id else max(c.event_id) filter (where c.kind = 'response' and (o.closed_at is null or c.event_id < o.closed_at)) end as double) as dns_ms,
        case when o.state in ('finished', 'failed') then o.last_id * 3 end as encoded_data_length, case when o.state in ('finished', 'failed') then o.last_id % 5 = 0 end as canceled,
        max(c.event_id) filter (where c.kind = 'response' and (o.closed_at is null or c.event_id < o.closed_at)) as response_event_id,
        coalesce(bool_or(c.kind = 'cached' and (o.closed_at is null or c.event_id < o.closed_at)), false) as served_from_cache
        from q o join c on c.page_id = o.page_id and c.request_id = o.request_id and c.leg = o.leg left join e z on z.event_id = o.last_id group by 1, 2, 3, 4, 5, o.closed_at, o.last_id)"""


LEG_COLUMNS = ["page_id", "request_id", "leg", "event_id", "state", "end_event_id", "status", "response_event_id", "served_from_cache"]
FACT_COLUMNS = [*LEG_COLUMNS, "protocol", "dns_ms", "encoded_data_length", "canceled"]


def with_facts(legs):
    """Legs with one timing member as a column."""
    return legs.withColumn("dns_ms", F.try_element_at("timing", F.lit("dns"))).where("timing is null or size(timing) = 1")


@register("network_legs", f"with {sql_legs()} select {', '.join(FACT_COLUMNS)} from legs")
def legs(spark, folder):
    return with_facts(N.legs(browser_events(spark, folder))).select(*FACT_COLUMNS)


@register("network_legs_dense", f"with {sql_legs(4)} select {', '.join(LEG_COLUMNS)} from legs")
def legs_dense(spark, folder):
    return N.legs(browser_events(spark, folder, 4)).select(*LEG_COLUMNS)


@register("network_leg_states", f"with {sql_legs()} select state, count(*) as n from legs group by 1")
def leg_states(spark, folder):
    return N.legs(browser_events(spark, folder)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _traced(spark, folder):
    events = browser_events(spark, folder, 4)
    busy = N.page_cuts(events)
    return N.bounded_trace(N.legs(events, busy), 12, busy)


@register(
    "network_bounded_trace",
    f"""with {sql_legs(4)}, r as (select *, row_number() over (partition by page_id order by event_id) as ordinal from legs)
        select page_id, request_id, leg, state, ordinal from r where ordinal <= 12""",
)
def bounded_trace(spark, folder):
    return _traced(spark, folder)[0].select("page_id", "request_id", "leg", "state", "ordinal")


@register(
    "network_dropped_legs",
    f"with {sql_legs(4)} select page_id, least(count(*), 12) as kept, greatest(count(*) - 12, 0) as dropped from legs group by 1",
)
def dropped_legs(spark, folder):
    return _traced(spark, folder)[1]


@register(
    "network_orphans",
    f"with {sql_legs(4)} select page_id, kind, event_id from c where kind <> 'open' and (leg = 0 or event_id > closed_at)",
)
def orphans(spark, folder):
    return N.orphans(browser_events(spark, folder, 4)).select("page_id", "kind", "event_id")


SQL_FLIGHT = """d as (select *, case when kind = 'open' and not coalesce(lag(kind) over q = 'open', false) then 1
      when kind <> 'open' and coalesce(lag(kind) over q = 'open', false) then -1 else 0 end as change
    from e where kind in ('open', 'finished', 'failed') window q as (partition by page_id, request_id order by ts, event_id)),
  f as (select *, cast(sum(change) over (partition by page_id order by ts, event_id rows unbounded preceding) as bigint) as in_flight,
    lead(ts) over (partition by page_id order by ts, event_id) as next_ts from d)"""


@register("network_in_flight", f"with {sql_legs(4)}, {SQL_FLIGHT} select event_id, in_flight from f")
def in_flight(spark, folder):
    return N.in_flight(browser_events(spark, folder, 4)).select("event_id", "in_flight")


SQL_IDLE = f"with {sql_legs(4)}, {SQL_FLIGHT} select page_id, event_id from f where in_flight = 0 and (next_ts is null or epoch_us(next_ts) - epoch_us(ts) >= 14400000000)"


@register("network_idle_gaps", SQL_IDLE)
def idle_gaps(spark, folder):
    return N.idle_gaps(browser_events(spark, folder, 4), 14_400_000).select("page_id", "event_id")


@register(
    "network_stale_gaps",
    "select event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 43200000000, false) as stale from events",
)
def stale_gaps(spark, folder):
    return N.stale_gaps(browser_events(spark, folder), 43_200_000).select("event_id", "stale")


@register(
    "phase_durations",
    """with m as (select event_id, user_id, ts, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) over (partition by user_id) as elapsed_ms from events)
        select event_id, elapsed_ms, elapsed_ms - lag(elapsed_ms, 1, 0) over (partition by user_id order by ts, event_id) as duration_ms from m""",
)
def phase_durations(spark, folder):
    return N.phase_durations(browser_events(spark, folder)).select("event_id", "elapsed_ms", "duration_ms")


@register(
    "renders_since_commit",
    """with m as (select *, max(case when event_type = 'signup' then event_id end) over (partition by user_id) as c from events)
        select user_id as page_id, event_id from m where event_type = 'view' and (c is null or event_id > c)""",
)
def renders_since_commit(spark, folder):
    e = browser_events(spark, folder).withColumn("kind", F.when(F.col("event_type") == "signup", "commit").when(F.col("event_type") == "view", "render").otherwise("other"))
    return N.since_commit(e).select("page_id", "event_id")


@register(
    "event_islands",
    """with f as (select *, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as s from events window w as (partition by user_id order by ts, event_id)),
        i as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from f)
        select user_id as page_id, cast(island as bigint) as island, min(event_id) as first_event, any_value(event_type) as event_type, count(*) as length from i group by 1, 2""",
)
def event_islands(spark, folder):
    out = N.islands(browser_events(spark, folder), ["page_id"], N.ORDER, "event_type")
    return out.select("page_id", "island", F.col("first.event_id").alias("first_event"), "event_type", "length")


@register(
    "busiest_threads",
    """with d as (select cast(ts as date) as day, user_id, event_id, event_type, greatest(value - coalesce(lag(value) over (partition by user_id order by ts, event_id), 0), 0) as delta from events),
        r as (select *, row_number() over (partition by day order by delta desc, event_id) as place from d where delta > 0 or event_type = 'error')
        select cast(day as varchar) as day, user_id, round(delta, 6) as delta, cast(place as int) as place from r where place <= 5""",
)
def busiest_threads(spark, folder):
    d = N.tick_deltas(browser_events(spark, folder), ["page_id"], N.ORDER, "value")
    busy = d.where("delta > 0 or kind = 'failed'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    # The rank filter is pushed below the shuffle: five rows per day leave each map task.
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("delta"), "event_id"))
    return busy.select("day", F.col("page_id").alias("user_id"), F.round("delta", 6).alias("delta"), place.alias("place")).where("place <= 5")


@register(
    "response_headers",
    """with e as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10 as r, cast(200 + floor(value) % 2 as int) as s from events),
        x as (select user_id, r, s, arg_max('x' || value, event_id) as h from e where event_type = 'signup' group by 1, 2, 3)
        select event_id, coalesce(x.h, 'own ' || e.value) as headers from e left join x using (user_id, r, s) where event_type = 'click'""",
)
def response_headers(spark, folder):
    e = browser_events(spark, folder, 10).withColumn("status", (200 + F.floor("value") % 2).cast("int"))
    text = F.col("value").cast("string")
    responses = e.where("kind = 'response'").withColumn("headers", F.concat(F.lit("own "), text))
    extras = e.where("kind = 'cached'").withColumn("headers", F.concat(F.lit("x"), text))
    return N.response_headers(responses, extras).select("event_id", "headers")


def page_errors(spark, folder):
    e = browser_events(spark, folder)
    kind = F.when(F.col("event_type") == "click", "response").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "log").when(
        (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), "console"
    ).when(F.col("event_type") == "signup", "exception").otherwise("open")
    return N.error_rows(e.select(
        "page_id", "ts", "event_id", kind.alias("kind"), (300 + F.floor("value") * 5).cast("int").alias("status"), F.when(F.col("value") > 20, "error").otherwise("info").alias("level"),
        F.when(F.col("event_id") % 2 == 0, "worker").otherwise("page").alias("source"), F.concat(F.lit("m"), F.col("value").cast("string")).alias("text"),
    ))


SQL_ERRORS = """r as (select user_id as page_id, event_id, value, event_type, case when event_type = 'click' and 300 + floor(value) * 5 >= 400 then 'http_error' when event_type = 'error' then 'failed_request'
    when event_type = 'purchase' and value > 20 and event_id % 2 = 1 then 'console_error' when event_type = 'signup' and (event_id % 3 <> 0 or value > 20) then 'console_error' end as tally from events)"""


@register(
    "error_rows",
    f"with {SQL_ERRORS} select page_id, event_id, tally, case when event_type = 'signup' and event_id % 3 <> 0 then 'pageerror: ' else '' end || 'm' || value as message from r where tally is not null",
)
def error_rows(spark, folder):
    return page_errors(spark, folder).drop("ts")


@register(
    "error_tallies",
    f"""with {SQL_ERRORS} select page_id, count(*) filter (where tally = 'http_error') as http_errors, count(*) filter (where tally = 'failed_request') as failed_requests,
        count(*) filter (where tally = 'console_error') as console_errors from r where tally is not null group by 1""",
)
def error_tallies(spark, folder):
    return N.error_tallies(page_errors(spark, folder))


@register(
    "interception_latency",
    f"""with {sql_legs(4)}, p as (select page_id, event_id, cast(request_id as varchar) as network_id, value, status, row_number() over (partition by page_id order by ts, event_id) as ordinal from e where kind in ('response', 'failed') and http),
        l as (select page_id, request_id as network_id, count(*) as n_legs, arg_max(state, leg) as leg_state from legs group by 1, 2)
        select p.page_id, event_id, n_legs, leg_state, case when event_id % 4 <> 0 then round(value, 6) end as latency_ms, case when status > 210 or event_id % 11 = 0 then 'response' else 'request' end as stage,
          case when event_id % 4 = 0 then 'pending' when event_id % 2 = 0 then 'acknowledged' else 'failed' end as state, case when event_id % 2 = 0 then 'continue' else 'fulfil' end as action from p left join l using (page_id, network_id) where ordinal <= 20""",
)
def interception_latency(spark, folder):
    return paused(spark, folder)[0].select("page_id", "event_id", "n_legs", "leg_state", F.round("latency_ms", 6).alias("latency_ms"), "stage", "state", "action")


@register(
    "interceptions_dropped",
    f"with {sql_legs(4)} select page_id, least(count(*), 20) as kept, greatest(count(*) - 20, 0) as dropped from e where kind in ('response', 'failed') and http group by 1",
)
def interceptions_dropped(spark, folder):
    return paused(spark, folder)[1]


def paused(spark, folder):
    e = browser_events(spark, folder, 4)
    even = F.col("event_id") % 2 == 0
    stopped = e.where("kind in ('response', 'failed')").select(
        "page_id", "ts", "event_id", "url", F.col("request_id").alias("network_id"), F.col("value").alias("dispatch_ms"), F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("ack_ms"),
        F.when(F.col("status") > 210, F.col("status")).alias("response_status"), F.when(F.col("event_id") % 11 == 0, "Aborted").alias("response_error"),
        even.alias("ack_ok"), F.when(even, "continue").otherwise("fulfil").alias("action"),
    )
    return N.interceptions(stopped, N.legs(e), 20)


@register(
    "distinct_origins",
    "select distinct lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0)) as origin from pages",
)
def distinct_origins(spark, folder):
    return table(spark, folder, "pages").select(origin(F.col("url")).alias("origin")).distinct()


@register("duplicate_requests", "select user_id, props, count(*) as n from events group by 1, 2 having count(*) > 1")
def duplicate_requests(spark, folder):
    return N.duplicate_ids(table(spark, folder, "events"), ["user_id", "props"])


SQL_NAV = """e as (select user_id as page_id, event_id, case event_type when 'view' then 'navigate' when 'signup' then 'commit' when 'purchase' then 'lifecycle' when 'error' then 'lifecycle' else 'same_document' end as kind,
    case when event_type <> 'click' then cast(regexp_extract(props, '([0-9]+)', 1) as int) % 3 end as loader, case when event_type = 'purchase' then 'load' when event_type = 'error' then 'init' end as name from events),
  s as (select *, max(case when kind = 'navigate' then event_id end) over w as nav, max(case when kind = 'commit' then event_id end) over w as cur from e
    window w as (partition by page_id order by event_id rows between unbounded preceding and 1 preceding)),
  t as (select s.*, n.loader as own, n.start_loader, c.loader as current_loader,
      coalesce((select max(x.event_id) from e x where x.page_id = s.page_id and x.loader = s.loader and x.name = 'load' and x.event_id < s.event_id)
        > coalesce((select max(x.event_id) from e x where x.page_id = s.page_id and x.loader = s.loader and x.name = 'init' and x.event_id < s.event_id), -1), false) as reached
    from s join (select m.event_id, m.loader, b.loader as start_loader from s m left join e b on b.event_id = m.cur where m.kind = 'navigate') n on n.event_id = s.nav
    left join e c on c.event_id = s.cur),
  done as (select nav, min(event_id) as done_event_id from t where (name = 'load' and loader = own)
    or (name = 'load' and loader = current_loader and current_loader is distinct from start_loader and current_loader <> own)
    or (kind = 'commit' and reached and loader <> own and loader is distinct from start_loader) group by 1)"""


@register(
    "navigation_completion",
    f"with {SQL_NAV} select page_id, event_id, cast(loader as int) as loader, done_event_id from e left join done on nav = event_id where kind = 'navigate'",
)
def navigation_completion(spark, folder):
    return N.completions(page_events(spark, folder, "navigate"), "load")


def page_events(spark, folder, begin, e=None):
    e = table(spark, folder, "events") if e is None else e
    kind = F.when(F.col("event_type") == "view", begin).when(F.col("event_type") == "signup", "commit").when(F.col("event_type").isin("purchase", "error"), "lifecycle").when(
        F.col("event_id") % 8 == 0, "same_document").otherwise("other")
    return e.select(
        F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"),
        F.when(~F.col("event_type").isin("click", *(["view"] if begin == "wait" else [])), F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3).alias("loader"),
        F.when(F.col("event_type") == "purchase", "load").when(F.col("event_type") == "error", "init").alias("name"),
    )


SQL_WAIT = """e as (select user_id as page_id, event_id, case event_type when 'view' then 'wait' when 'signup' then 'commit' when 'purchase' then 'lifecycle' when 'error' then 'lifecycle' else case when event_id % 8 = 0 then 'same_document' else 'other' end end as kind,
    case when event_type not in ('click', 'view') then cast(regexp_extract(props, '([0-9]+)', 1) as int) % 3 end as loader, case when event_type = 'purchase' then 'load' when event_type = 'error' then 'init' end as name
    from events),
  s as (select *, max(case when kind = 'wait' then event_id end) over w as nav, max(case when kind = 'commit' then event_id end) over w as cur from e
    window w as (partition by page_id order by event_id rows between unbounded preceding and 1 preceding)),
  n as (select m.event_id, b.loader as start_loader from s m left join e b on b.event_id = m.cur where m.kind = 'wait'),
  t as (select s.*, start_loader, c.loader as current_loader,
      coalesce((select max(x.event_id) from e x where x.page_id = s.page_id and x.loader = s.loader and x.name = 'load' and x.event_id < s.event_id)
        > coalesce((select max(x.event_id) from e x where x.page_id = s.page_id and x.loader = s.loader and x.name = 'init' and x.event_id < s.event_id), -1), false) as reached
    from s join n on n.event_id = s.nav left join e c on c.event_id = s.cur),
  done as (select nav, min(event_id) as done_event_id from t where kind = 'same_document'
    or (name = 'load' and loader = current_loader and loader is distinct from start_loader) or (kind = 'commit' and reached and loader is distinct from start_loader) group by 1)"""


@register(
    "navigation_waits",
    f"with {SQL_WAIT} select e.page_id, e.event_id, done_event_id, cast(d.loader as int) as loader from e left join done on nav = e.event_id left join e d on d.event_id = done_event_id where e.kind = 'wait'",
)
def navigation_waits(spark, folder):
    return N.navigation_waits(page_events(spark, folder, "wait"), "load")
