"""Evidence ledger: keys, manifests, dedupe, receipts, snapshots, fact maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_ms, manifest_line, metadata_value, public_url, safe_segment
from ..functions.values import js_string, let, variant_kind, variant_number, variant_text, variant_truthy
from ..plans.skew import join_unique

# Fact names by timing field.
TIMING_FACTS = {
    "capture.timing.redirect-ms": "redirect",
    "capture.timing.dns-ms": "dns",
    "capture.timing.tcp-ms": "tcp",
    "capture.timing.tls-ms": "tls",
    "capture.timing.request-ms": "request",
    "capture.timing.response-ms": "response",
    "capture.timing.dom-interactive-ms": "domInteractive",
    "capture.timing.dom-complete-ms": "domComplete",
    "capture.timing.redirect-count": "redirectCount",
    "capture.timing.protocol": "protocol",
    "capture.timing.transfer-bytes": "transferBytes",
    "capture.timing.encoded-body-bytes": "encodedBytes",
    "capture.timing.decoded-body-bytes": "decodedBytes",
}


def timing_facts(timing: Column) -> Column:
    """Map of fact name to text; an unavailable mark is ``-1``, a missing protocol blank."""
    pairs = []
    for fact, field in TIMING_FACTS.items():
        absent = F.lit("" if field == "protocol" else "-1")
        pairs += [F.lit(fact), F.coalesce(F.try_element_at(timing, F.lit(field)), absent)]
    return F.create_map(*pairs)


# Manifest lines before the observed facts, and the object fields they print.
MANIFEST_LINES = (
    ("bucket", "bucket"), ("key", "key"), ("version-id", "version_id"), ("sha256", "sha256"), ("content-length", "content_length"),
    ("content-type", "content_type"), ("last-modified", "last_modified"), ("etag", "etag"), ("attested-at-utc", "attested_at_utc"),
)

# Response headers that may be published.
HEADER_ALLOWLIST = (
    "age", "cache-control", "content-encoding", "content-length", "content-type", "date", "etag", "expires", "last-modified",
    "location", "server", "vary", "via", "x-amz-cf-id", "x-amz-cf-pop", "x-cache", "x-content-type-options", "x-frame-options",
)

# Read-only operation names and services evidence may be read from.
READ_ONLY = "^(Describe|Get|List|Head|Lookup|Query|Scan|BatchGet|Filter)[A-Za-z0-9]*$"
SERVICES = (
    "dynamodb", "sfn", "ssm", "cloudwatch-logs", "sts", "cloudformation", "cloudwatch", "s3", "s3tables", "glue", "athena",
    "lambda", "ses", "iam", "service-quotas", "ce",
)
SAFE_INTEGER = 9007199254740991


def canonical_manifest(observed: Column, header: str) -> Column:
    """One line per object field, then observed facts by key; ``header`` names the canonical form."""
    lines = [F.lit(header + "\n")] + [manifest_line(F.lit(name), F.col(field)) for name, field in MANIFEST_LINES]
    facts = F.transform(
        F.array_sort(F.map_entries(observed)), lambda e: manifest_line(F.concat(F.lit("observed."), e["key"]), e["value"])
    )
    return F.concat(*lines, F.array_join(facts, ""))


def statements(objects: DataFrame, header: str) -> DataFrame:
    """Objects with their manifest and its digest."""
    out = objects.withColumn("manifest", canonical_manifest(F.col("observed"), header))
    return out.withColumn("manifest_sha256", F.sha2("manifest", 256))


def evidence_key(env: Column, issue: Column, digest: Column, stamp: Column, suffix: Column) -> Column:
    """``env/issue-evidence/issue-n/digest/stamp-env-suffix``; a content digest keeps the key repeatable."""
    folder = F.concat(F.lit("issue-"), safe_segment(issue))
    return F.concat_ws("/", env, F.lit("issue-evidence"), folder, digest, F.concat_ws("-", stamp, safe_segment(env), suffix))


def first_writers(objects: DataFrame, key: str, order: str, stored_keys: DataFrame | None = None) -> DataFrame:
    """Flag every row but the first of its key, and all rows of stored keys. Copies of one
    content may be a large part of the table, so the first id joins back instead of
    ranking all copies."""
    first = objects.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    if stored_keys is None:
        first = first.withColumn("_stored", F.lit(False))
    else:
        known = stored_keys.select(key).distinct().withColumn("_stored", F.lit(True))
        first = first.join(known, key, "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    out = join_unique(objects, first, [key], "_copies", [order])
    return out.withColumn("deduplicated", F.col("_stored") | (F.col(order) > F.col("_first"))).drop("_first", "_copies", "_stored")


def put_if_absent(objects: DataFrame, stored_keys: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: first of their key and not stored yet."""
    first = objects.groupBy(key).agg(F.min(order).alias(order))
    fresh = first.join(stored_keys.select(key).distinct(), key, "left_anti")
    return objects.join(fresh, [key, order], "left_semi")


def posted_identities(comments: DataFrame, body: str, tag: str) -> DataFrame:
    """Distinct identities whose marker stands on a line of its own in a comment."""
    pattern = f"\\n<!-- {tag}-identity: ([0-9a-f]{{64}}) -->(?=\\n)"
    return comments.select(F.explode(F.regexp_extract_all(body, F.lit(pattern), 1)).alias("identity")).distinct()


def reuse_receipts(objects: DataFrame, comments: DataFrame, body: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(objects already posted, objects still to post)."""
    posted = posted_identities(comments, body, tag)
    return objects.join(posted, "identity", "left_semi"), objects.join(posted, "identity", "left_anti")


def check_statements(stored: DataFrame, objects: DataFrame, on: list[str], rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Compare stored statements with recomputed ones; the first failing rule is named.

    ``rules`` maps a rule name to the (stored, recomputed) columns; nulls equal nulls. A statement
    without its object fails the rule ``object``.
    """
    pairs = stored.join(objects.withColumn("_found", F.lit(True)), on, "left")
    failures = [F.when(F.col("_found").isNull(), F.lit("object"))]
    failures += [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name)) for name, (a, b) in rules.items()]
    return pairs.withColumn("failed_rule", F.coalesce(*failures)).withColumn("all_ok", F.col("failed_rule").isNull()).drop("_found")


# The observed facts in which a stored statement must agree with the run that reuses it.
RUN_FACTS = ("ci.env", "ci.target-sha")


def check_receipts(stored: DataFrame, objects: DataFrame, on: list[str], text: Column, header: str, key_id: str, region: str) -> DataFrame:
    """Whether stored statements may stand for objects that are published again; the first failing rule is named.

    stored: ``on``, the object fields of the statement, observed, manifest, key_id and body, the comment it was published in. objects: ``on``, bucket, key,
    version_id, observed. A statement must hold together by itself (its manifest is that of its own fields, its key is ``key_id``) and then name the same object under
    the same address, agree in the run's facts, and have been published as ``text``, computed from it. Signatures are not checked here.
    """
    url = public_url(F.col("bucket"), F.col("key"), F.col("version_id"), region)
    facts = {f"_fact{i}": F.element_at("observed", name) for i, name in enumerate(RUN_FACTS)}
    places = {"bucket": "bucket", "key": "key", "version": "version_id", "url": "url"}
    mine = stored.withColumns({"url": url, "_manifest": canonical_manifest(F.col("observed"), header), "_key": F.lit(key_id), "_text": text} | facts)
    now = objects.withColumns({"url": url} | facts).select(*on, *[F.col(c).alias(f"now_{c}") for c in (*places.values(), *facts)])
    rules = {"manifest": ("manifest", "_manifest"), "key id": ("key_id", "_key")} | {rule: (c, f"now_{c}") for rule, c in places.items()}
    rules |= {name: (f"_fact{i}", f"now__fact{i}") for i, name in enumerate(RUN_FACTS)} | {"body": ("body", "_text")}
    return check_statements(mine, now, on, rules).select(*stored.columns, "failed_rule", "all_ok")


def latest_execution(executions: DataFrame) -> DataFrame:
    """Newest execution per environment whatever its state."""
    fields = [c for c in executions.columns if c != "env"]
    newest = executions.groupBy("env").agg(F.max_by(F.struct(*fields), F.struct("start_date", "execution_id")).alias("e"))
    return newest.select("env", "e.*")


def finalizer_payload(parsed: Column) -> Column:
    """struct(mode, exit_code) of a scheduled input (VARIANT) that carries ``mode``, else null.

    A truthy ``Payload`` member is unwrapped; a non-numeric exit code is blank.
    """

    def exit_code(number: Column) -> Column:
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), js_string(number)).otherwise("")

    def read(body: Column) -> Column:
        code = let(let(F.try_variant_get(body, "$.exitCode", "variant"), variant_number), exit_code)
        mode = F.try_variant_get(body, "$.mode", "variant")
        text = let(mode, lambda m: F.when(variant_truthy(m), variant_text(m)).otherwise(""))
        return F.when((variant_kind(body) == "object") & mode.isNotNull(), F.struct(text.alias("mode"), code.alias("exit_code")))

    unwrapped = let(F.try_variant_get(parsed, "$.Payload", "variant"), lambda inner: F.when(variant_truthy(inner), inner).otherwise(parsed))
    return let(unwrapped, read)


def execution_sha(raw: Column) -> Column:
    """Trimmed ``sha`` of an execution input, blank when there is none."""
    return F.coalesce(F.trim(F.try_variant_get(F.try_parse_json(raw), "$.sha", "string")), F.lit(""))


# History events whose input may be a finalizer's.
SCHEDULED = ("TaskScheduled", "LambdaFunctionScheduled")


def newest_payload(history: DataFrame, keys: list[str]) -> DataFrame:
    """First scheduling event (``event_type``) from the newest end that carries a finalizer payload."""
    scheduled = history.where(F.col("event_type").isin(*SCHEDULED) & (F.col("payload") != ""))
    found = scheduled.select(*keys, "event_id", let(F.try_parse_json("payload"), finalizer_payload).alias("_payload")).where("_payload is not null")
    return found.groupBy(*keys).agg(F.max_by(F.struct("event_id", "_payload"), "event_id").alias("f")).select(
        *keys, F.col("f.event_id").alias("event_id"), "f._payload.mode", "f._payload.exit_code"
    )


def ci_snapshot(environments: DataFrame, executions: DataFrame, history: DataFrame, checked_at: Column, failures: DataFrame | None = None) -> DataFrame:
    """ci facts per environment (env, target_sha): newest execution and its finalizer.

    An environment without any execution carries ``ci_error`` with what was asked and when. A
    history that could not be read (``failures``: execution_id, reason) is an error too, and
    its finalizer is blank.
    """
    newest = latest_execution(executions)
    wanted = newest.select("execution_id")
    payload = newest_payload(history.join(wanted, "execution_id", "left_semi"), ["execution_id"]).drop("event_id")
    out = environments.join(newest, "env", "left").join(payload, "execution_id", "left")
    if failures is None:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    else:
        out = out.join(failures.select("execution_id", "reason"), "execution_id", "left")
    known, read = F.col("execution_id").isNotNull(), F.col("reason").isNull()
    return out.select(
        "env", "target_sha", iso_ms(checked_at).alias("checked_at_utc"), "execution_id", F.when(known, execution_sha(F.col("input"))).alias("executed_sha"), "status",
        F.when(known, iso_ms(F.col("start_date"))).alias("start_date"),
        F.when(known, F.coalesce(iso_ms(F.col("stop_date")), F.lit(""))).alias("stop_date"),
        F.when(known, F.coalesce(F.when(read, F.col("mode")), F.lit(""))).alias("finalizer_mode"),
        F.when(known, F.coalesce(F.when(read, F.col("exit_code")), F.lit(""))).alias("worker_exit_code"),
        F.when(~known, F.concat(F.lit("no execution found for "), F.col("env"))).otherwise(F.concat(F.lit("history: "), F.col("reason"))).alias("ci_error"),
    )


def redirect_summary(hops: DataFrame, most: int) -> DataFrame:
    """Per capture: redirects followed, final URL and status, and whether the chain was cut."""
    redirects = F.col("status").between(300, 399) & (F.coalesce("location", F.lit("")) != "")
    last = F.max_by(F.struct("url", "status", redirects.alias("more")), "hop")
    return hops.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"), last.alias("last")).select(
        "capture_id", (F.col("n") - 1).alias("redirect_count"), F.col("last.url").alias("final_url"), F.col("last.status").alias("final_status"),
        ((F.col("n") - 1 >= most) & F.col("last.more")).alias("truncated"),
    )


def redirect_facts(hops: DataFrame) -> DataFrame:
    """Fact rows per hop; hop numbers are zero-padded so key order is hop order.

    A hop that says who fetched it (``fetched_by``, ``remote_address``) has those facts too.
    """
    prefix = F.concat(F.lit("capture.redirect."), F.when(F.col("hop") < 10, F.lpad(F.col("hop").cast("string"), 2, "0")).otherwise(F.col("hop").cast("string")), F.lit("."))
    facts = F.create_map(
        F.lit("url"), metadata_value(F.col("url"), 512), F.lit("status"), F.col("status").cast("string"),
        F.lit("location"), metadata_value(F.col("location"), 512),
    )
    if "fetched_by" in hops.columns:
        seen = F.create_map(F.lit("fetched-by"), metadata_value(F.col("fetched_by"), 256), F.lit("remote-address"), metadata_value(F.col("remote_address"), 128))
        facts = F.when(F.coalesce("fetched_by", F.lit("")) != "", F.map_concat(facts, seen)).otherwise(facts)
    return hops.select("capture_id", prefix.alias("prefix"), F.explode(facts).alias("name", "value")).select(
        "capture_id", F.concat("prefix", "name").alias("fact"), "value"
    )


def lower_headers(headers: Column) -> Column:
    """The map with lower-case names; of several spellings of one name the last counts."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last_of_each(entries: Column) -> Column:
        later = lambda i: F.transform(F.slice(entries, i + 2, F.size(entries)), lambda e: e["key"])
        return F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"]))

    return F.map_from_entries(let(named, last_of_each))


def header_facts(headers: Column) -> Column:
    """Allow-listed headers clamped to 512 characters, and how many there were in all."""
    lower = lower_headers(headers)
    kept = F.map_filter(lower, lambda k, v: k.isin(*HEADER_ALLOWLIST))
    facts = F.transform_keys(F.transform_values(kept, lambda k, v: metadata_value(v, 512)), lambda k, v: F.concat(F.lit("capture.header."), k))
    return F.map_concat(facts, F.create_map(F.lit("capture.header-count"), F.size(lower).cast("string")))


def folded_headers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(name, value, position) rows to one row per lower-case name; ``values`` stays a list
    for set-cookie and joins by comma otherwise. Headers of one response are few."""
    lower = rows.withColumn("name", F.lower("name"))
    grouped = lower.groupBy(*keys, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("values"))
    return grouped.withColumn("values", F.when(F.col("name") == "set-cookie", F.col("values")).otherwise(F.array(F.array_join("values", ", "))))


def read_only_call(service: Column, operation: Column) -> Column:
    return operation.rlike(READ_ONLY) & service.isin(*SERVICES)


def manifest_key_error(key: Column, environments: list[str]) -> Column:
    """Message of the first broken rule of a run-manifest key, null for a good one."""
    grammar = f"^({'|'.join(environments)})/([0-9a-f]{{40}})/([0-9]{{8}}T[0-9]{{6}}Z)/manifest[.]json$"
    stamp = F.regexp_extract(key, grammar, 3)
    return F.when(
        ~key.rlike(grammar) | key.contains("\n"), "key must be <env>/<40-lowercase-hex-sha>/<YYYYMMDDTHHMMSSZ>/manifest.json"
    ).when(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")).isNull(), "key contains an invalid UTC run timestamp")


def claim_target(action: Column, url: Column, env: Column, sha: Column, service: Column, operation: Column, params: Column,
                 bucket: Column, key: Column, version: Column) -> Column:
    """What a claim is about, derived from its action."""
    blank = F.lit("")
    of_run = F.concat(F.coalesce(env, blank), F.lit("@"), F.coalesce(sha, blank))
    of_object = F.concat(
        F.lit("s3://"), bucket, F.lit("/"), F.coalesce(key, blank),
        F.when(F.coalesce(version, blank) != "", F.concat(F.lit("?versionId="), version)).otherwise(blank),
    )
    target = (
        F.when(action.isin("capture-web-ui-screenshot", "capture-http-raw"), F.coalesce(url, blank))
        .when(action == "attest-ci-verdict", of_run)
        .when(action == "attest-aws-resource", F.concat(F.coalesce(service, blank), F.lit("."), F.coalesce(operation, blank), F.lit(" "), F.coalesce(params, F.lit("{}"))))
        .when(F.coalesce(sha, blank) != "", of_run)
        .otherwise(of_object)
    )
    return F.trim(metadata_value(target, 2000))


def claim_context(df: DataFrame, intent: str, category: str, target: str) -> DataFrame:
    """Checked claim columns, with ``error`` on the first broken rule."""
    wanted = F.trim(metadata_value(F.col(intent), 1000))
    side = F.upper(F.trim(metadata_value(F.col(category), 16)))
    error = (
        F.when(wanted == "", "published attestation requires intent")
        .when(~side.isin("BEFORE", "AFTER"), "published attestation category must be BEFORE or AFTER")
        .when(F.col(target) == "", "published attestation action has no target identity")
    )
    return df.select("*", wanted.alias("claim_intent"), side.alias("claim_category"), F.col(target).alias("claim_target"), error.alias("error"))


def cookie_rows(df: DataFrame, keys: list[str], raw: str, url: str) -> tuple[DataFrame, DataFrame]:
    """(one row per cookie, rejects) of JSON text holding an array of cookie objects or a name/value object.

    A listed cookie keeps all its members in ``attributes`` and counts if its name is truthy and it has a
    value; nothing, blank text, null and false hold no cookies, any other shape or text that is no JSON is a reject.
    """
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    parsed = df.select(*keys, F.col(url).alias("_url"), text.alias("_text"), F.try_parse_json(text).alias("_json"))
    parsed = parsed.withColumn("_kind", variant_kind(F.col("_json")))
    # One text is judged in one expression, which the optimizer can not unfold into several parses of the same text; blank, null and false are no JSON of interest.
    judged = let(text, lambda t: F.when(t.isin("", "false", '""'), "none").otherwise(F.coalesce(variant_kind(F.try_parse_json(t)), F.lit("broken"))))
    reason = F.lit("cookies must be an array of cookie objects or a name/value object")
    rejects = df.select(*keys, judged.alias("_kind")).where(~F.col("_kind").isin("none", "null", "list", "object")).select(*keys, reason.alias("error"))
    parts = parsed.where(F.col("_kind").isin("list", "object"))
    members = parts.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_json").outer()))
    name, value = F.try_variant_get("value", "$.name", "variant"), F.try_variant_get("value", "$.value", "variant")
    listed = members.where((F.col("_kind") == "list") & (variant_kind(F.col("value")) == "object")).where(
        variant_truthy(name) & value.isNotNull() & (variant_kind(value) != "null")
    )
    listed = listed.select(*keys, variant_text(name).alias("name"), variant_text(value).alias("v"), "_url", F.try_variant_get("value", "$", "map<string,string>").alias("attributes"))
    listed = listed.select(
        *keys, "name", F.col("v").alias("value"), F.coalesce(F.try_element_at("attributes", F.lit("url")), "_url").alias("url"),
        F.map_filter("attributes", lambda k, v: ~k.isin("name", "value", "url")).alias("attributes"),
    )
    named = members.where("_kind = 'object'").select(
        *keys, F.col("key").alias("name"), F.coalesce(variant_text(F.col("value")), F.lit("null")).alias("value"), F.col("_url").alias("url"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    return listed.unionByName(named), rejects


def issue_error(issue: Column, claimed: Column, key: Column) -> Column:
    """Message when a publication target is no safe positive integer or disagrees with
    the capture's issue or the issue in the evidence key."""
    in_key = F.nullif(F.regexp_extract(F.coalesce(key, F.lit("")), "/issue-evidence/issue-([0-9]+)/", 1), F.lit(""))
    bad = issue.isNull() | F.isnan(issue) | (issue != F.floor(issue)) | (issue <= 0) | (issue > SAFE_INTEGER)
    return (
        F.when(bad, "publication requires a positive issue number")
        .when(claimed.isNotNull() & (claimed != issue), "publication target disagrees with capture issue")
        .when(in_key.isNotNull() & (in_key.cast("double") != issue), "publication target disagrees with evidence key")
    )


def merge_facts(*sources: DataFrame) -> DataFrame:
    """(id, fact, value) rows of several sources; a later source overwrites an earlier one."""
    ranked = [s.select("id", "fact", "value", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "fact").agg(F.max_by("value", "source").alias("value"))


def bounded_scan(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Row count per key; reaching the limit is an error, never a truncation."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "error", F.when(F.col("n") >= limit, F.lit(f"deduplication exceeds {limit} comments"))
    )
