"""Streams over the events table, each checked against its batch meaning."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.sinks import outcome_writer
from ..streaming import lifecycle as L
from ..streaming import outcomes as O
from ..streaming import pages as P
from ..streaming import windows as W
from ..streaming.run import closable, file_stream, run_batches, run_to_end
from .network import FACT_COLUMNS, KINDS, SQL_IDLE, SQL_NAV, SQL_WAIT, browser_events, page_events, sql_legs, with_facts
from .registry import register
from .runs import SQL_DEADLINES, clocked

DELAY = "1 hour"
TEN_YEARS_MS = 315_576_000_000


def browser_stream(spark, folder, requests: int = 4):
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % requests
    return file_stream(spark, folder, "events").select(
        F.col("user_id").alias("page_id"), "ts", "event_id", F.element_at(names, F.col("event_type")).alias("kind"), k.cast("string").alias("request_id"),
        (F.col("event_id") % 3 != 0).alias("redirect"), (200 + F.floor("value")).cast("int").alias("status"), "value", "event_type",
        F.concat(F.when(F.col("event_id") % 7 == 0, "data:u").otherwise("https://u"), F.col("user_id").cast("string"), F.lit("/")).alias("url"),
    )


@register("stream_legs", f"with {sql_legs(4)} select {', '.join(FACT_COLUMNS)} from legs")
def stream_legs(spark, folder):
    """Every leg with all its facts, those still pending at the end of the stream too."""
    events, close = closable(file_stream(spark, folder, "events"))
    out = run_to_end(L.track_legs(browser_events(spark, folder, 4, events), DELAY, TEN_YEARS_MS), "legs", close)
    return with_facts(out.where("state <> 'orphan'")).select(*FACT_COLUMNS)


def _navigations(spark, folder, begin):
    events, close = closable(file_stream(spark, folder, "events"))
    return run_to_end(P.navigations(page_events(spark, folder, begin, events), "load", DELAY, TEN_YEARS_MS), begin, close)


@register("stream_navigation", f"with {SQL_NAV} select page_id, event_id, cast(loader as varchar) as loader, done_event_id from e left join done on nav = event_id where kind = 'navigate'")
def stream_navigation(spark, folder):
    return _navigations(spark, folder, "navigate").where("what = 'navigation'").select("page_id", "event_id", "loader", "done_event_id")


@register(
    "stream_navigation_waits",
    f"with {SQL_WAIT} select e.page_id, e.event_id, done_event_id, cast(d.loader as varchar) as loader from e left join done on nav = e.event_id left join e d on d.event_id = done_event_id where e.kind = 'wait'",
)
def stream_navigation_waits(spark, folder):
    return _navigations(spark, folder, "wait").where("what = 'wait'").select("page_id", "event_id", "done_event_id", F.col("done_loader").alias("loader"))


@register("stream_network_idle", SQL_IDLE)
def stream_network_idle(spark, folder):
    """Four hours without a request in flight."""
    events, close = closable(file_stream(spark, folder, "events"))
    idle = P.network_idle(browser_events(spark, folder, 4, events).drop("timing"), 14_400_000, DELAY)
    return run_to_end(idle, "idle", close).select("page_id", "event_id")


@register("stream_step_deadlines", SQL_DEADLINES)
def stream_step_deadlines(spark, folder):
    events, close = closable(file_stream(spark, folder, "events"))
    out = run_to_end(P.step_clocks(events.withColumnRenamed("user_id", "page_id"), *clocked(), DELAY), "steps", close)
    return out.where("what = 'step'").select("event_id", "exhausted", "remaining_ms", "error")


@register(
    "stream_orphans",
    f"with {sql_legs(4)} select page_id, event_id from c where kind <> 'open' and (leg = 0 or event_id > closed_at)",
)
def stream_orphans(spark, folder):
    out = run_to_end(L.track_legs(browser_stream(spark, folder), DELAY, TEN_YEARS_MS), "orphans")
    return out.where("state = 'orphan'").select("page_id", "event_id")


@register(
    "stream_idle_sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as s from events),
        i as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select user_id as page_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start_ts, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S.%f') as end_ts, count(*) as n_events
        from i group by user_id, k""",
)
def stream_idle_sessions(spark, folder):
    events, close = closable(browser_stream(spark, folder))
    out = run_to_end(W.idle_sessions(events, "6 hours", DELAY), "sessions", close)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("page_id", text("start_ts"), text("end_ts"), "n_events")


@register(
    "stream_error_rates",
    """with w as (select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - i * interval 6 hours as start_ts from events, (select unnest(range(4)) as i) where event_type = 'error')
        select strftime(start_ts, '%Y-%m-%d %H:%M:%S') as start_ts, 'failed' as tally, count(*) as n from w group by w.start_ts""",
)
def stream_error_rates(spark, folder):
    errors, close = closable(browser_stream(spark, folder).where("kind = 'failed'").select("ts", F.col("kind").alias("tally")))
    out = run_to_end(W.error_rates(errors, "1 day", "6 hours", DELAY), "rates", close)
    return out.select(F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "tally", "n")


@register(
    "stream_error_counts",
    """with w as (select date_trunc('day', ts) as start_ts from events where event_type = 'error')
        select strftime(start_ts, '%Y-%m-%d') as day, count(*) as n from w group by w.start_ts""",
)
def stream_error_counts(spark, folder):
    errors, close = closable(browser_stream(spark, folder).where("kind = 'failed'").select("ts", F.col("kind").alias("tally")))
    out = run_to_end(W.error_rates(errors, "1 day", None, DELAY), "counts", close)
    return out.select(F.date_format("start_ts", "yyyy-MM-dd").alias("day"), "n")


@register("stream_first_writes", "select distinct 'sha1/' || left(sha1(props || event_type), 2) || '/' || sha1(props || event_type) || '.png' as key from events")
def stream_first_writes(spark, folder):
    path = os.path.join(shared_folder(spark), f"firsts-{uuid.uuid4().hex}")
    objects = file_stream(spark, folder, "events").select("ts", F.concat("props", "event_type").alias("content"))
    run_batches(W.first_writes(objects, DELAY), W.content_writer(path), "firsts")
    return spark.read.schema("key STRING, app STRING, batch BIGINT, prefix STRING").parquet(path).select("key")


@register(
    "stream_deadlines",
    """with s as (select user_id as page_id, event_id, epoch_us(ts) // 1000 as now_ms, epoch_us(ts) // 1000 + cast(floor(value * 2000000) as bigint) as deadline_ms from events where event_type = 'signup'),
        n as (select *, lead(now_ms) over (partition by page_id order by now_ms, event_id) as next_ms from s)
        select page_id, event_id, deadline_ms from n where next_ms is null or deadline_ms <= next_ms""",
)
def stream_deadlines(spark, folder):
    starts, close = closable(browser_stream(spark, folder).where("event_type = 'signup'").select(
        "page_id", "ts", "event_id", F.floor(F.col("value") * 2_000_000).cast("bigint").alias("limit_ms")
    ))
    return run_to_end(L.expired_clocks(starts, DELAY), "clocks", close)


@register("stream_outcomes", "select 'u' || user_id as outcome_key, min(event_id) as event_id from events where event_type = 'purchase' group by 1")
def stream_outcomes(spark, folder):
    """Outcomes delivered twice by two runs over the same checkpoint-less input."""
    path = os.path.join(shared_folder(spark), f"outcomes-{uuid.uuid4().hex}")
    outcomes = file_stream(spark, folder, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("outcome_key"), "event_id"
    )
    for attempt in ("first", "again"):
        run_batches(outcomes, outcome_writer(path, "outcome_key STRING, event_id BIGINT"), f"outcomes-{attempt}")
    return _outcomes(spark, path).select("outcome_key", "event_id")


def _outcomes(spark, path):
    return spark.read.schema("outcome_key STRING, event_id BIGINT, app STRING, batch BIGINT, prefix STRING").parquet(path)


@register(
    "stream_outcomes_of_two_apps",
    """with o as (select 'u' || user_id as outcome_key, event_id, case when event_type = 'purchase' then 'shop' else 'desk' end as app from events where event_type in ('purchase', 'signup'))
        select outcome_key, arg_min(app, case app when 'shop' then 0 else 1 end) as app from o group by 1""",
)
def stream_outcomes_of_two_apps(spark, folder):
    """Two apps each deliver their batch 0, and the first one replays it; no app removes what the other stored."""
    path = os.path.join(shared_folder(spark), f"outcomes-{uuid.uuid4().hex}")
    events = file_stream(spark, folder, "events")
    for app, kind in (("shop", "purchase"), ("desk", "signup"), ("shop", "purchase")):
        outcomes = events.where(F.col("event_type") == kind).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("outcome_key"), "event_id")
        run_batches(outcomes, outcome_writer(path, "outcome_key STRING, event_id BIGINT", app), f"outcomes-{app}")
    return _outcomes(spark, path).select("outcome_key", "app")


@register(
    "stream_outcome_conflicts",
    """with a as (select event_id, ts, user_id || ':' || strftime(ts, '%Y-%m-%d') as outcome_key, event_type as body,
          case when event_id % 11 = 0 then 500 when event_id % 5 <> 0 then 200 end as status, ts >= date_trunc('day', ts) + interval 18 hours as late from events),
        n as (select *, row_number() over w as attempt, first_value(body) over w as sent from a where not late window w as (partition by outcome_key order by ts, event_id)),
        r as (select outcome_key, event_id, cast(attempt as int) as attempt, case when attempt > 3 then 'attempt ' || attempt || ' of 3' when body <> sent then 'other bytes than first sent'
            when status = 500 then 'answered 500' end as reason from n
          union all select outcome_key, event_id, null, 'sent after the deadline' from a where late)
        select * from r where reason is not null""",
)
def stream_outcome_conflicts(spark, folder):
    """Deliveries of a day's outcome per user that may not be stored."""
    events, close = closable(file_stream(spark, folder, "events"))
    day = F.date_trunc("day", "ts")
    attempts = events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("outcome_key"), "ts", "event_id", F.col("event_type").alias("body"),
        F.when(F.col("event_id") % 11 == 0, 500).when(F.col("event_id") % 5 != 0, 200).alias("status"), (day + F.expr("interval 18 hours")).alias("deadline"),
    )
    return run_to_end(O.judged_attempts(attempts, DELAY), "attempts", close).where("reason is not null")
