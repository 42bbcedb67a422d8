"""Ordered run outcomes: validation, expectations, step gates, interception rules, HTML values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import status_text
from ..functions.values import js_string, json_text, let, valid_scale, variant_kind
from ..plans.ordered import Cuts, running
from ..plans.skew import join_unique
from .ledger import lower_headers

# Limits of one request.
MAX_STEPS = 200
MAX_STEP_TIMEOUT_MS = 120_000


def _crowd(n: Column, max_steps: int) -> Column:
    return F.concat(F.lit(f"steps accepts at most {max_steps}; got "), n.cast("string"))


def step_errors(steps: DataFrame, operations: Sequence[str], max_steps: int = MAX_STEPS) -> DataFrame:
    """Steps with ``error``, the first rule they break (null for a valid step).

    steps: run_id, idx, id, op, if_ok, if_failed, if_html_incomplete, timeout_ms. An
    absent id is ``idx:op``; a gate must name an id no later than its own step.
    """
    named = steps.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat_ws(":", F.col("idx").cast("string"), "op")))
    firsts = named.groupBy("run_id", "id").agg(F.min("idx").alias("first_idx"))
    counts = named.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"))
    sized = join_unique(named, counts, ["run_id"], "n_steps", ["idx"])
    crowded = sized.where(F.col("n_steps") > max_steps).select(*steps.columns, _crowd(F.col("n_steps"), max_steps).alias("error"))
    # From here on a run has at most max_steps steps.
    # A null run is a run, so every join compares it null-safely.
    few = sized.where(F.col("n_steps") <= max_steps)
    own = firsts.select(F.col("run_id").alias("_run"), F.col("id").alias("_id"), "first_idx")
    out = few.join(own, few["run_id"].eqNullSafe(own["_run"]) & (few["id"] == own["_id"])).drop("_run", "_id")
    at = F.concat(F.lit("steps["), F.col("idx").cast("string"), F.lit("]."))
    rules = [
        F.when(~F.coalesce(F.col("op").isin(*operations), F.lit(False)), F.concat(at, F.lit("op "), json_text(F.col("op")), F.lit(" is not one of "), F.lit(",".join(operations)))),
        F.when(F.col("first_idx") < F.col("idx"), F.concat(at, F.lit("id "), F.col("id"), F.lit(" is duplicated"))),
    ]
    for gate in ("if_ok", "if_failed", "if_html_incomplete"):
        target = firsts.select(F.col("run_id").alias("_run"), F.col("id").alias("_id"), F.col("first_idx").alias(f"_{gate}"))
        out = out.join(target, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col(gate) == F.col("_id")), "left").drop("_run", "_id")
        late = F.col(gate).isNotNull() & (F.col(f"_{gate}").isNull() | (F.col(f"_{gate}") > F.col("idx")))
        rules.append(F.when(late, F.concat(at, F.lit(f"{gate} names "), F.col(gate), F.lit(", which is not an EARLIER step id"))))
    limit = F.col("timeout_ms").isNotNull() & ~F.col("timeout_ms").between(0, MAX_STEP_TIMEOUT_MS)
    rules.append(F.when(limit, F.concat(at, F.lit(f"timeout_ms must be 0..{MAX_STEP_TIMEOUT_MS}"))))
    return out.select(*steps.columns, F.coalesce(*rules).alias("error")).unionByName(crowded)


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows of valid runs, one reject row per run with its first error)."""
    rejects = checked.where("error is not null").groupBy("run_id").agg(F.min_by("error", "idx").alias("error"))
    bad = rejects.select(F.col("run_id").alias("_run"))
    return checked.join(bad, F.col("run_id").eqNullSafe(F.col("_run")), "left_anti").drop("error"), rejects


def spec_errors(n_passes: Column, scale: Column, min_fraction: Column, n_fallback: Column, has_stop_rule: Column) -> Column:
    """Every rule a reading request breaks, in checking order."""
    rules = [
        F.when(n_passes <= 0, "ocr.passes must be a non-empty array of passes"),
        F.when(~valid_scale(scale), F.concat(F.lit("scale "), js_string(scale), F.lit(" must be in (0, 1] or a whole factor 2..4"))),
        F.when(has_stop_rule & ~F.coalesce(min_fraction.between(0, 1), F.lit(False)), "ocr.stop_when.min_fraction must be a number in [0, 1]"),
        F.when((n_fallback > 0) & ~has_stop_rule, "ocr.fallback needs ocr.stop_when: without keywords it could never run"),
    ]
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(rule.isNotNull(), F.array(rule)).otherwise(none) for rule in rules])


def pass_error(v: Column, what: str) -> Column:
    """First rule that a reading pass given as VARIANT breaks, null for a good one."""

    def absent(kind: Column) -> Column:
        return kind.isNull() | (kind == "null")

    # Every member is looked up once.
    names = ("psm", "dpi", "upscale", "pixel_budget")
    kinds = [variant_kind(F.try_variant_get(v, f"$.{name}", "variant")).alias(f"{name}_kind") for name in (*names, "lang")]
    numbers = [F.try_variant_get(v, f"$.{name}", "double").alias(name) for name in names]

    def rules(m: Column) -> Column:
        def number(name: str, whole: bool) -> list[Column]:
            kind, x = m[f"{name}_kind"], m[name]
            good = (kind == "number") & (x >= 0) & (x < float("inf"))
            found = [F.when(~absent(kind) & ~F.coalesce(good, F.lit(False)), F.lit(f"{what}.{name} must be a non-negative number"))]
            if whole:
                found.append(F.when((kind == "number") & (x != F.floor(x)), F.lit(f"{what}.{name} must be an integer")))
            return found

        scale = F.coalesce(F.nullif(m["upscale"], F.lit(0.0)), F.lit(1.0))
        factor = F.concat(F.lit(f"{what}.upscale: scale "), js_string(scale), F.lit(" must be in (0, 1] or a whole factor 2..4"))
        return F.coalesce(
            F.when(~absent(m["lang_kind"]) & (m["lang_kind"] != "text"), F.lit(f"{what}.lang must be a string")),
            *number("psm", True), *number("dpi", True), *number("upscale", False), *number("pixel_budget", True),
            F.when(~valid_scale(scale), factor),
        )

    shaped = F.coalesce(variant_kind(v), F.lit("")) == "object"
    return F.when(~shaped, F.lit(f"{what} must be an object")).otherwise(let(F.struct(*kinds, *numbers), rules))


def expectation_failure(value_json: Column, value_number: Column, value_text: Column, value_truthy: Column,
                        equals: Column, gte: Column, lte: Column, contains: Column, truthy: Column) -> Column:
    """Message of the first expectation that fails, null when all hold.

    NaN fails both bounds; ``contains`` only holds for text.
    """
    number = F.coalesce(value_number, F.lit(float("nan")))

    def below(a, b):  # SQL orders NaN above every number; here it satisfies nothing
        return ~F.isnan(a) & ~F.isnan(b) & (a <= b)

    return F.coalesce(
        F.when(equals.isNotNull() & (value_json != equals), F.concat(F.lit("expected "), equals, F.lit(", got "), value_json)),
        F.when(gte.isNotNull() & ~below(gte, number), F.concat(F.lit("expected >= "), js_string(gte), F.lit(", got "), value_json)),
        F.when(lte.isNotNull() & ~below(number, lte), F.concat(F.lit("expected <= "), js_string(lte), F.lit(", got "), value_json)),
        F.when(contains.isNotNull() & ~F.coalesce(F.contains(value_text, contains), F.lit(False)), F.concat(F.lit("expected to contain "), json_text(contains))),
        F.when(truthy.isNotNull() & (value_truthy != truthy), F.concat(F.lit("expected truthy="), truthy.cast("string"), F.lit(", got "), value_json)),
    )


RESULT = "struct<idx: int, id: string, skipped: boolean, ok: boolean, pending: boolean, optional: boolean, final: boolean, html: boolean>"


def run_outcomes(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Evaluate every run in step order: (run_id, all_ok, results array, error).

    steps: run_id, idx, id, op, optional, if_ok, if_failed, if_html_incomplete, raw_ok,
    started, html_complete. A screenshot whose readers ``started`` counts as ok until a
    later gate names it or the run ends; only then is its ``raw_ok`` known. A failed
    step that is not optional stops the run, and every later step is skipped.

    Gates chain on earlier verdicts, so a run is one ordered fold. Requests hold at most
    ``max_steps`` steps; a larger run is not gathered but returned with no results and the error of its rejection.
    """
    sizes = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    # Oversized runs go before any row is gathered, so a group is at most max_steps rows.
    admitted = join_unique(steps, sizes, ["run_id"], "_n", ["idx"]).where(F.col("_n") <= max_steps)
    crowded = sizes.where(F.col("_n") > max_steps).select(
        "run_id", F.lit(False).alias("all_ok"), F.array().cast(f"array<{RESULT}>").alias("results"), _crowd(F.col("_n"), max_steps).alias("error")
    )
    fields = ("idx", "id", "op", "optional", "if_ok", "if_failed", "if_html_incomplete", "raw_ok", "started", "html_complete")
    gathered = admitted.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    start = F.struct(F.lit(False).alias("stopped"), F.lit(True).alias("all_ok"), F.array().cast(f"array<{RESULT}>").alias("res"))

    def settle(acc, due):
        """Give pending results their verdict where ``due`` says so."""
        failed = F.exists(acc["res"], lambda r: r["pending"] & due(r) & ~r["final"] & ~r["optional"])

        def verdict(r):
            hit = r["pending"] & due(r)
            return F.struct(
                r["idx"].alias("idx"), r["id"].alias("id"), r["skipped"].alias("skipped"), F.when(hit, r["final"]).otherwise(r["ok"]).alias("ok"),
                (r["pending"] & ~hit).alias("pending"), r["optional"].alias("optional"), r["final"].alias("final"), r["html"].alias("html"),
            ).cast(RESULT)

        return let(failed, lambda f: F.struct(
            (acc["stopped"] | f).alias("stopped"), (acc["all_ok"] & ~f).alias("all_ok"), F.transform(acc["res"], verdict).alias("res")
        ))

    def advance(acc, s):
        gates = F.array(s["if_ok"], s["if_failed"], s["if_html_incomplete"])
        named = lambda r: F.coalesce(F.array_contains(gates, r["id"]), F.lit(False))
        return let(settle(acc, named), lambda a: let(skipping(a, s), lambda skip: record(a, s, skip)))

    def skipping(a, s):
        def look(gate):
            return F.get(F.filter(a["res"], lambda r: r["id"] == s[gate]), F.lit(0))

        ran_ok = let(look("if_ok"), lambda r: F.coalesce(~r["skipped"] & r["ok"], F.lit(False)))
        ran_failed = let(look("if_failed"), lambda r: F.coalesce(~r["skipped"] & ~r["ok"], F.lit(False)))
        complete = F.coalesce(look("if_html_incomplete")["html"], F.lit(False))
        return a["stopped"] | (s["if_ok"].isNotNull() & ~ran_ok) | (s["if_failed"].isNotNull() & ~ran_failed) | (s["if_html_incomplete"].isNotNull() & complete)

    def record(a, s, skip):
        image = (s["op"] == "screenshot") & s["started"]
        ok = F.when(skip, F.lit(False)).when(image, F.lit(True)).otherwise(s["raw_ok"])
        halt = ~skip & ~image & ~s["raw_ok"] & ~s["optional"]
        row = F.struct(
            s["idx"].cast("int").alias("idx"), s["id"].alias("id"), skip.alias("skipped"), ok.alias("ok"), (~skip & image).alias("pending"),
            s["optional"].alias("optional"), s["raw_ok"].alias("final"), (~skip & s["html_complete"]).alias("html"),
        ).cast(RESULT)
        return F.struct((a["stopped"] | halt).alias("stopped"), (a["all_ok"] & ~halt).alias("all_ok"), F.array_append(a["res"], row).alias("res"))

    done = F.aggregate("steps", start, advance, lambda acc: settle(acc, lambda r: F.lit(True)))
    return gathered.select("run_id", done.alias("d")).select("run_id", F.col("d.all_ok").alias("all_ok"), F.col("d.res").alias("results"), F.lit(None).cast("string").alias("error")).unionByName(crowded)


def step_results(outcomes: DataFrame) -> DataFrame:
    """One row per step: skipped, or its verdict."""
    rows = outcomes.select("run_id", "all_ok", F.explode("results").alias("r"))
    return rows.select("run_id", "all_ok", F.col("r.idx").alias("idx"), F.col("r.id").alias("id"), F.col("r.skipped").alias("skipped"),
                       F.when(~F.col("r.skipped"), F.col("r.ok")).alias("ok"))


def deadlines(events: DataFrame, keys: list[str], order: list[str], chunk: Cuts | Column | None, started: Column, limit_ms: Column, timeout_ms: Column, now_ms: Column, clock: Column) -> DataFrame:
    """Remaining time of each step under the last start before it of the clock it names.

    ``clock`` names the clock that an event starts or a step obeys; a step that names none
    has its own timeout, one that names a clock never started has an ``error``.
    ``remaining_ms`` is the smaller of the step's own timeout and the clock's rest; an
    ``exhausted`` clock fails the step without running it.
    """
    start = F.when(started, F.struct(*[F.col(c) for c in order], (now_ms + limit_ms).alias("deadline")))
    named = events.withColumn("_name", F.coalesce(clock, F.lit("")))
    placed = running(named, [*keys, "_name"], order, chunk, max_before={"_start": start})
    bound = F.col("_name") != ""
    rest = F.when(bound, F.col("_start.deadline") - now_ms)
    missing = bound & F.col("_start").isNull() & ~started
    return placed.withColumns({
        "exhausted": F.coalesce(rest <= 0, F.lit(False)),
        "remaining_ms": F.when(rest > 0, F.least(rest, timeout_ms)).when(rest.isNull() & ~missing, timeout_ms),
        "error": F.when(missing, F.concat(F.lit("clock "), F.col("_name"), F.lit(" was never started"))),
    }).drop("_start", "_name")


def interception(url: Column, host: Column, abort: Sequence[str], fulfill: Sequence[str], hosts: Sequence[str]) -> Column:
    """Action for a request: any abort pattern, else the first fulfil pattern, else the
    header rule of its host, else continue. A request's rules are a short literal list."""
    out = None
    for pattern in abort:
        hit = url.rlike(pattern)
        out = F.when(hit, "abort") if out is None else out.when(hit, "abort")
    for i, pattern in enumerate(fulfill):
        out = F.when(url.rlike(pattern), f"fulfill:{i}") if out is None else out.when(url.rlike(pattern), f"fulfill:{i}")
    for i, name in enumerate(hosts):
        out = F.when(host == name, f"headers:{i}") if out is None else out.when(host == name, f"headers:{i}")
    return F.lit("continue") if out is None else out.otherwise("continue")


def intercepted(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """What the rules of its run do to every request.

    requests: run_id, request_id, url, host, headers. rules: run_id, position, kind (abort,
    fulfill, headers), pattern (of the address, or the host), status, content_type, body, headers.
    Any abort pattern fails the request; else the first fulfil pattern answers it; else it goes on, with the first header rule of
    its host laid over its own headers, whose names are lower-case then. The rules of a run come with
    its request and are a short list, so they are gathered per run and meet its requests in one join.
    """
    rule = F.struct("position", "kind", "pattern", "status", "content_type", F.length("body").alias("body_bytes"), F.to_json("headers").alias("extra"))
    gathered = rules.groupBy("run_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    sizes = requests.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    known = sizes.join(gathered, "run_id", "left")
    out = join_unique(requests, known, ["run_id"], "_n", ["request_id"])

    def first(kind: str, hit) -> Column:
        return F.get(F.filter(F.coalesce("rules", F.array().cast(gathered.schema["rules"].dataType)), lambda r: (r["kind"] == kind) & hit(r)), F.lit(0))

    matches = lambda r: F.coalesce(F.rlike(F.col("url"), r["pattern"]), F.lit(False))
    out = out.withColumns({
        "_abort": first("abort", matches), "_answer": first("fulfill", matches), "_extra": first("headers", lambda r: F.lower(r["pattern"]) == F.col("host")),
    })
    action = F.when(F.col("_abort").isNotNull(), "fail").when(F.col("_answer").isNotNull(), "fulfill").otherwise("continue")
    extra = F.from_json("_extra.extra", "map<string,string>")
    own = lower_headers(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    answered, goes_on = action == "fulfill", action == "continue"
    return out.select(
        "run_id", "request_id", action.alias("action"),
        F.when(answered, F.coalesce(F.nullif("_answer.status", F.lit(0)), F.lit(200))).alias("status"),
        F.when(answered, F.coalesce(F.nullif("_answer.content_type", F.lit("")), F.lit("application/octet-stream"))).alias("content_type"),
        F.when(answered, F.coalesce("_answer.body_bytes", F.lit(0))).alias("content_length"),
        F.when(goes_on & F.col("_extra").isNotNull(), merged).alias("headers"),
    ).withColumn("phrase", F.when(F.col("status").isNotNull(), status_text(F.col("status"))))


def blocked(url: Column, main_document: Column, patterns: Sequence[str]) -> Column:
    """Fault injection: any listed substring aborts, the main document never does."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | url.contains(pattern)
    return F.when(hit & ~main_document, "abort").otherwise("continue")


# ---- HTML values by tag ----


# Character references by name; the ampersand comes last, so that nothing is decoded twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def decoded(text: Column) -> Column:
    for name, character in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def tag_count(html: Column, tag: str) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(f"(?i)<{tag}(?=[\\s>/])"), 0))


def tag_attribute(html: Column, tag: str, attribute: str) -> Column:
    """Quoted attribute of the first such element that carries it, its common references decoded; null when there is none."""
    return decoded(F.get(F.regexp_extract_all(html, F.lit(f"(?i)<{tag}\\s(?:[^>]*\\s)?{attribute}=\"([^\"]*)\""), 1), F.lit(0)))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element without inner markup, its common references decoded; null when there is none."""
    inner = F.get(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), 1), F.lit(0))
    return decoded(F.regexp_replace(inner, "<[^>]*>", ""))
