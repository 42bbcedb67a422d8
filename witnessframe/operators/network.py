"""Request lifecycles and page facts from browser events.

events: page_id, ts, event_id, kind, request_id ... with kind one of open, response,
cached, finished, failed (anything else is ignored by the lifecycle). Within a page the
order is (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_slice
from ..functions.values import numeric_members
from ..plans.ordered import Cuts, cuts, running
from ..plans.skew import join_unique

ORDER = ["ts", "event_id"]
TRACE_LIMIT = 128
CLOSERS = ("finished", "failed")


def page_cuts(events: DataFrame) -> Cuts:
    """Where busy pages are cut. Found once for a table of events, they hold for all that is computed from it in the same order."""
    return cuts(events, ["page_id"], ORDER)


def _position() -> Column:
    return F.struct(*ORDER)


def traced(url: Column) -> Column:
    """Whether a request belongs in a trace: only http(s) addresses have an origin to report."""
    return F.coalesce(F.lower(url).rlike("^https?://[^/?#]"), F.lit(False))


def placed(events: DataFrame, chunk: Cuts | Column | None = None, traced_only: bool = True) -> DataFrame:
    """Events with their leg number (0 = no leg yet) and whether that leg is still open
    just before the event. A repeated request id starts a new leg; unless ``traced_only`` is
    off, an open of another scheme ends the leg before it and starts none."""
    opens, closes = F.col("kind") == "open", F.col("kind").isin(*CLOSERS)
    if traced_only:
        opens, closes = opens & traced(F.col("url")), closes | (opens & ~traced(F.col("url")))
    ordered = running(
        events.where(F.col("request_id").isNotNull()), ["page_id", "request_id"], ORDER, page_cuts(events) if chunk is None else chunk,
        sums={"leg": F.when(opens, 1).otherwise(0).cast("bigint")},
        max_before={"_opened": F.when(opens, _position()), "_closed": F.when(closes, _position())},
    )
    live = F.col("_opened").isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") < F.col("_opened")))
    return ordered.withColumn("live", live).drop("_opened", "_closed")


# What a response says about its request, and what the end of a request adds, as far as events carry it.
RESPONSE_FACTS = ("status", "protocol", "connection_id", "connection_reused", "from_disk_cache", "from_service_worker", "from_prefetch_cache")
END_FACTS = ("encoded_data_length", "canceled")


def legs(events: DataFrame, chunk: Cuts | Column | None = None) -> DataFrame:
    """One row per request leg with its state: pending, redirected, finished or failed.

    A repeated id with ``redirect`` set closes the open leg before it as redirected, and its
    facts are those of the redirect's own response; without it that leg stays pending. Responses after the close
    are ignored. Response facts, the numeric members of ``timing`` (a VARIANT) and end facts are returned where the events have those columns.
    Each open event also reports to the leg before its own, so one aggregation sees everything.
    """
    told = [c for c in RESPONSE_FACTS if c in events.columns]
    ended = [c for c in END_FACTS if c in events.columns]
    if "timing" in events.columns:
        events, told = events.withColumn("timing", numeric_members(F.try_variant_get("timing", "$", "map<string,variant>"))), [*told, "timing"]
    opens = F.col("kind") == "open"
    starts = opens & traced(F.col("url"))
    rows = placed(events, chunk).where("leg > 0 and (live or kind = 'open')")
    own, after = F.lit(0), F.lit(1)
    back = F.when(starts & (F.col("leg") > 1), F.array(own, after)).when(opens & ~starts, F.array(after)).otherwise(F.array(own))
    spread = rows.withColumn("_after", F.explode(back)).withColumn("leg", F.col("leg") - F.when(starts, F.col("_after")).otherwise(0))
    own = F.col("_after") == 0
    closer = own & F.col("kind").isin(*CLOSERS)
    redirect = (F.col("_after") == 1) & F.col("live") & F.col("redirect")
    response = own & (F.col("kind") == "response")
    last = lambda when, *fields: F.max_by(F.when(when, F.struct(*fields, *ORDER)), F.when(when, _position()))
    grouped = spread.groupBy("page_id", "request_id", "leg").agg(
        F.min(F.when(own & opens, F.struct(*ORDER, "url"))).alias("open"),
        last(closer, "kind", *ended).alias("close"),
        F.max(F.when(redirect, _position())).alias("next"),
        last(response | redirect, *told).alias("told"),
        F.max(F.when(response, _position())).alias("response"),
        F.coalesce(F.bool_or(own & (F.col("kind") == "cached")), F.lit(False)).alias("served_from_cache"),
    )
    return grouped.select(
        "page_id", "request_id", "leg", F.col("open.ts").alias("ts"), F.col("open.event_id").alias("event_id"), F.col("open.url").alias("url"),
        F.when(F.col("close").isNotNull(), F.col("close.kind")).when(F.col("next").isNotNull(), "redirected").otherwise("pending").alias("state"),
        F.coalesce("close.event_id", "next.event_id").alias("end_event_id"), F.coalesce("close.ts", "next.ts").alias("end_ts"),
        *[F.col(f"told.{c}").alias(c) for c in told], F.col("response.event_id").alias("response_event_id"), "served_from_cache",
        *[F.col(f"close.{c}").alias(c) for c in ended],
    )


def bounded_trace(all_legs: DataFrame, limit: int = TRACE_LIMIT, chunk: Cuts | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(first ``limit`` legs of each page, legs and dropped legs per page).

    The bound is the reported feature: what lies beyond is counted, with all its events. ``chunk`` may be the ``page_cuts`` of the events.
    """
    numbered = running(all_legs, ["page_id"], ORDER, chunk, sums={"ordinal": F.lit(1).cast("bigint")})
    counts = all_legs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    dropped = counts.select("page_id", F.least("n", F.lit(limit)).alias("kept"), F.greatest(F.col("n") - limit, F.lit(0)).alias("dropped"))
    return numbered.where(F.col("ordinal") <= limit), dropped


def orphans(events: DataFrame, chunk: Cuts | Column | None = None) -> DataFrame:
    """Events that belong to no open leg; the lifecycle ignores them."""
    return placed(events, chunk).where("kind <> 'open' and not live")


def in_flight(events: DataFrame, chunk: Cuts | Column | None = None) -> DataFrame:
    """Network events with the number of requests in flight after each and the next event's time."""
    network = F.col("kind").isin("open", *CLOSERS)
    change = F.when((F.col("kind") == "open") & ~F.col("live"), 1).when(F.col("kind").isin(*CLOSERS) & F.col("live"), -1).otherwise(0)
    chunk = page_cuts(events) if chunk is None else chunk
    return running(
        placed(events, chunk, traced_only=False).where(network), ["page_id"], ORDER, chunk,
        sums={"in_flight": change.cast("bigint")}, following={"next_ts": F.col("ts")},
    )


def idle_gaps(events: DataFrame, idle_ms: int, chunk: Cuts | Column | None = None) -> DataFrame:
    """Stretches of at least ``idle_ms`` with nothing in flight; the last one is open-ended."""
    quiet = in_flight(events, chunk).where("in_flight = 0")
    gap = F.unix_micros("next_ts") - F.unix_micros("ts")
    return quiet.where(F.col("next_ts").isNull() | (gap >= idle_ms * 1000)).select(
        "page_id", "event_id", F.col("ts").alias("from_ts"), F.col("next_ts").alias("to_ts")
    )


def stale_gaps(events: DataFrame, most_ms: int, chunk: Cuts | Column | None = None) -> DataFrame:
    """Flag events that follow an idle gap longer than ``most_ms``."""
    out = running(events, ["page_id"], ORDER, page_cuts(events) if chunk is None else chunk, previous={"previous_ts": F.col("ts")})
    gap = F.unix_micros("ts") - F.unix_micros("previous_ts")
    return out.withColumn("stale", F.coalesce(gap > most_ms * 1000, F.lit(False)))


def phase_durations(events: DataFrame, chunk: Cuts | Column | None = None) -> DataFrame:
    """``elapsed_ms`` since the first event of the invocation and the step since the one before."""
    out = running(
        events, ["page_id"], ORDER, page_cuts(events) if chunk is None else chunk, least={"started": F.col("ts")}, previous={"previous_ts": F.col("ts")}
    )
    elapsed = F.unix_millis("ts") - F.unix_millis("started")
    before = F.coalesce(F.unix_millis("previous_ts") - F.unix_millis("started"), F.lit(0))
    return out.withColumn("elapsed_ms", elapsed).withColumn("duration_ms", elapsed - before).drop("started", "previous_ts")


def since_commit(events: DataFrame, chunk: Cuts | Column | None = None) -> DataFrame:
    """Render marks made after the current document committed (all when nothing committed)."""
    commit = F.when(F.col("kind") == "commit", _position())
    out = running(events, ["page_id"], ORDER, page_cuts(events) if chunk is None else chunk, most={"_commit": commit})
    return out.where((F.col("kind") == "render") & (F.col("_commit").isNull() | (_position() > F.col("_commit")))).drop("_commit")


def islands(events: DataFrame, keys: list[str], order: list[str], value: str, chunk: Cuts | Column | None = None) -> DataFrame:
    """Runs of equal consecutive values: first position and length."""
    chunk = cuts(events, keys, order) if chunk is None else chunk
    seen = running(events, keys, order, chunk, previous={"_before": F.struct(value)})
    changed = ~F.col("_before").eqNullSafe(F.struct(value))
    numbered = running(seen.withColumn("_start", changed.cast("bigint")), keys, order, chunk, sums={"island": F.col("_start")})
    return numbered.groupBy(*keys, "island").agg(
        F.min(F.struct(*order)).alias("first"), F.any_value(value).alias(value), F.count(F.lit(1)).alias("length")
    )


def tick_deltas(samples: DataFrame, keys: list[str], order: list[str], ticks: str, chunk: Cuts | Column | None = None) -> DataFrame:
    """Ticks since the same thread's sample before; never negative, the first counts in full."""
    out = running(samples, keys, order, chunk, previous={"_ticks": F.col(ticks)})
    return out.withColumn("delta", F.greatest(F.col(ticks) - F.coalesce("_ticks", F.lit(0)), F.lit(0))).drop("_ticks")


def response_headers(responses: DataFrame, extras: DataFrame) -> DataFrame:
    """Headers of each response: the latest extra record of the same status, else its own."""
    keys = ["page_id", "request_id", "status"]
    latest = extras.groupBy(*keys).agg(F.max_by("headers", _position()).alias("extra_headers"))
    sized = responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(latest, keys, "left")
    out = join_unique(responses, sized, keys, "_n", ORDER)
    return out.withColumn("headers", F.coalesce("extra_headers", "headers")).drop("extra_headers", "_n")


def error_rows(events: DataFrame) -> DataFrame:
    """One row per http error, failed request or console error.

    Console errors are error-level entries not from a worker, ``console`` calls of level error, and exceptions.
    """
    text = js_slice(F.col("text"), 2000)
    shown = F.struct(
        F.when((F.col("kind") == "response") & (F.col("status") >= 400), "http_error")
        .when(F.col("kind") == "failed", "failed_request")
        .when((F.col("kind") == "log") & (F.col("level") == "error") & (F.col("source") != "worker"), "console_error")
        .when((F.col("kind") == "console") & (F.col("level") == "error"), "console_error")
        .when(F.col("kind") == "exception", "console_error").alias("tally"),
        F.when(F.col("kind") == "exception", F.concat(F.lit("pageerror: "), text)).otherwise(text).alias("message"),
    )
    return events.withColumn("_e", shown).where("_e.tally is not null").select("page_id", *ORDER, "_e.tally", "_e.message")


def error_tallies(errors: DataFrame) -> DataFrame:
    return errors.groupBy("page_id").agg(*[
        F.count_if(F.col("tally") == kind).alias(f"{kind}s") for kind in ("http_error", "failed_request", "console_error")
    ])


def interceptions(paused: DataFrame, all_legs: DataFrame, limit: int = TRACE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(first ``limit`` paused requests per page, kept and dropped counts per page).

    A kept one has its action, latency, state (pending until it is acknowledged or the
    action fails) and the last leg of the network request it belongs to; ids of the two kinds differ, so a leg may be
    absent. A response status or error reason makes it one of the response stage. Only http(s) requests count.
    """
    paused = paused.where(traced(F.col("url")))
    every = running(paused, ["page_id"], ORDER, sums={"ordinal": F.lit(1).cast("bigint")})
    numbered = every.where(F.col("ordinal") <= limit)
    last = all_legs.groupBy("page_id", F.col("request_id").alias("network_id")).agg(
        F.count(F.lit(1)).alias("n_legs"), F.max_by("state", "leg").alias("leg_state")
    )
    out = numbered.join(last, ["page_id", "network_id"], "left")
    answered = F.col("response_status").isNotNull() | F.col("response_error").isNotNull()
    kept = out.withColumns({
        "latency_ms": F.col("ack_ms") - F.col("dispatch_ms"),
        "stage": F.when(answered, "response").otherwise("request"),
        "state": F.when(F.col("ack_ms").isNull(), "pending").when(F.col("ack_ok"), "acknowledged").otherwise("failed"),
    })
    counts = paused.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return kept, counts.select("page_id", F.least("n", F.lit(limit)).alias("kept"), F.greatest(F.col("n") - limit, F.lit(0)).alias("dropped"))


def duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _watched(events: DataFrame, event: str, begin: str, chunk: Cuts | Column) -> DataFrame:
    """Beginnings and what happens after each until the next one, for what waits for a lifecycle event.

    Every row has ``_nav``: place and loader of its beginning, and ``start``, the loader current then. A
    later row has ``_current``, the commit before it, and ``_reached``, when its loader had the
    event, unless an ``init`` has cleared that since.
    """
    at = _position()
    # A loader may have reached the event before it became current.
    reached = F.when((F.col("kind") == "lifecycle") & (F.col("name") == event), at)
    cleared = F.when((F.col("kind") == "lifecycle") & (F.col("name") == "init"), at)
    known = running(events, ["page_id", "loader"], ORDER, chunk, max_before={"_reached": reached, "_cleared": cleared})
    holds = F.col("loader").isNotNull() & (F.col("_cleared").isNull() | (F.col("_cleared") < F.col("_reached")))
    known = known.withColumn("_reached", F.when(holds, F.col("_reached"))).drop("_cleared")
    commit = F.when(F.col("kind") == "commit", F.struct(*ORDER, "loader"))
    state = running(known, ["page_id"], ORDER, chunk, max_before={"_current": commit})
    begins = F.when(F.col("kind") == begin, F.struct(*ORDER, "loader", F.col("_current.loader").alias("start")))
    state = running(state, ["page_id"], ORDER, chunk, max_before={"_before": begins})
    watched = F.col("kind").isin("lifecycle", "commit", "same_document") & F.col("_before").isNotNull()
    return state.withColumn("_nav", F.coalesce(begins, F.when(watched, F.col("_before")))).where("_nav is not null").drop("_before")


def completions(events: DataFrame, event: str, chunk: Cuts | Column | None = None) -> DataFrame:
    """When each navigation reached a lifecycle event.

    events kinds: navigate (loader = its own), commit (loader becomes current), lifecycle
    (loader, name), same_document. A navigation is done when its own loader, or a newer
    current loader, has the event; without one it stays open until the next navigation. ``init``
    clears what its loader has reached.
    """
    rows = _watched(events, event, "navigate", page_cuts(events) if chunk is None else chunk)
    start, loader = F.col("_nav.start"), F.col("loader")
    hit = (F.col("kind") == "lifecycle") & (F.col("name") == event)
    own = hit & (loader == F.col("_nav.loader"))
    newer = ~F.col("_current.loader").eqNullSafe(start) & (F.col("_current.loader") != F.col("_nav.loader"))
    current = hit & newer & (loader == F.col("_current.loader"))
    early = (F.col("kind") == "commit") & F.col("_reached").isNotNull() & (loader != F.col("_nav.loader")) & ~loader.eqNullSafe(start)
    done = rows.groupBy("page_id", "_nav").agg(F.min(F.when(own | current | early, _position())).alias("done"))
    return done.select(
        "page_id", F.col("_nav.event_id").alias("event_id"), F.col("_nav.loader").alias("loader"), F.col("done.event_id").alias("done_event_id")
    )


def navigation_waits(events: DataFrame, event: str, chunk: Cuts | Column | None = None) -> DataFrame:
    """When each ``wait`` saw a navigation: a same-document one, which has no loader, or a
    current loader other than at its start that has the lifecycle event. Open waits have no end; a new wait replaces the one before."""
    rows = _watched(events, event, "wait", page_cuts(events) if chunk is None else chunk)
    other = ~F.col("loader").eqNullSafe(F.col("_nav.start"))
    same = F.col("kind") == "same_document"
    hit = (F.col("kind") == "lifecycle") & (F.col("name") == event) & (F.col("loader") == F.col("_current.loader")) & other
    early = (F.col("kind") == "commit") & F.col("_reached").isNotNull() & other
    seen = F.when(same | hit | early, F.struct(*ORDER, F.when(~same, F.col("loader")).alias("loader")))
    done = rows.groupBy("page_id", "_nav").agg(F.min(seen).alias("done"))
    return done.select(
        "page_id", F.col("_nav.event_id").alias("event_id"), F.col("done.event_id").alias("done_event_id"), F.col("done.loader").alias("loader")
    )
