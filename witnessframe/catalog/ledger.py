"""Evidence ledger over documents, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import ledger as L
from ..tables import table
from .registry import register
from .scalars import SQL_META

HEADER = "evidence-manifest-v4"
ISSUER = "CAPTURE"
TAG = "attestation"


def objects(spark, folder):
    d = table(spark, folder, "documents")
    key = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", F.col("source").alias("bucket"), key.alias("key"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"),
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").cast("string").alias("content_length"), F.lit("text/plain").alias("content_type"),
        F.lit("").alias("last_modified"), F.md5("text").alias("etag"), F.lit("2026-01-01T00:00:00.000Z").alias("attested_at_utc"),
        F.create_map(F.lit("claim.text"), F.col("text"), F.lit("claim.lang"), F.col("lang"), F.lit("capture.source"), F.col("source")).alias("observed"),
        "lang", "source",
    )


SQL_OBJECTS = f"""o as (select doc_id, lang, source, text, source as bucket, lang || '/' || doc_id as key, 'v' || doc_id as version_id,
    sha256(text) as sha256, md5(text) as etag, n_chars from documents),
  m as (select *, '{HEADER}' || chr(10) || 'bucket=' || bucket || chr(10) || 'key=' || key || chr(10) || 'version-id=' || version_id || chr(10)
    || 'sha256=' || sha256 || chr(10) || 'content-length=' || n_chars || chr(10) || 'content-type=text/plain' || chr(10) || 'last-modified=' || chr(10)
    || 'etag=' || etag || chr(10) || 'attested-at-utc=2026-01-01T00:00:00.000Z' || chr(10)
    || 'observed.capture.source=' || source || chr(10) || 'observed.claim.lang=' || lang || chr(10)
    || 'observed.claim.text=' || translate(text, chr(13) || chr(10), '  ') || chr(10) as manifest from o)"""


@register("ledger_manifest", f"with {SQL_OBJECTS} select doc_id, manifest, sha256(manifest) as manifest_sha256 from m")
def manifest(spark, folder):
    return L.statements(objects(spark, folder), HEADER).select("doc_id", "manifest", "manifest_sha256")


@register(
    "ledger_first_writer",
    "select doc_id, sha1(text) as sha1, row_number() over (partition by sha1(text) order by doc_id) > 1 as deduplicated from documents",
)
def first_writer(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return L.first_writers(d, "sha1", "doc_id")


@register(
    "ledger_put_if_absent",
    """with d as (select doc_id, 'sha1/' || left(sha1(text), 2) || '/' || sha1(text) || '.txt' as content_key from documents),
        stored as (select content_key from d join labels using (doc_id))
        select min(doc_id) as doc_id, content_key from d where content_key not in (select content_key from stored) group by 2""",
)
def put_if_absent(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", X.content_key(F.col("text"), ext="txt").alias("content_key"))
    stored = d.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return L.put_if_absent(d, stored, "content_key", "doc_id").select("doc_id", "content_key")


@register(
    "ledger_evidence_key",
    f"""select doc_id, source || '/issue-evidence/issue-' || doc_id || '/' || sha1(text) || '/20260101T000000Z-' || source || '-'
        || coalesce(nullif(trim(regexp_replace(left({SQL_META}, 160), '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'evidence') as evidence_key from documents""",
)
def evidence_key(spark, folder):
    d = table(spark, folder, "documents")
    key = L.evidence_key(F.col("source"), F.col("doc_id").cast("string"), F.sha1("text"), F.lit("20260101T000000Z"), X.safe_segment(F.col("text")))
    return d.select("doc_id", key.alias("evidence_key"))


def identified(spark, folder):
    o = objects(spark, folder)
    return o.withColumn("identity", X.identity(F.lit("compact-v1"), F.col("bucket"), F.col("key"), F.col("version_id"), F.col("lang")))


def block(df):
    """Markdown block with the identity marker, as posted for an object."""
    url = X.public_url(F.col("bucket"), F.col("key"), F.col("version_id"), "eu-west-9")
    return X.evidence_text(
        F.lit("BEFORE"), X.markdown_literal(F.element_at("observed", "claim.text")), F.col("lang"), F.col("attested_at_utc"), url,
        F.concat(url, F.lit(".json")), F.lit(HEADER), F.lit("k1"), ISSUER, marker=F.concat(F.lit(f"<!-- {TAG}-identity: "), F.col("identity"), F.lit(" -->")),
    )


SQL_IDENTITY = """sha256('["compact-v1","' || source || '","' || lang || '/' || doc_id || '","v' || doc_id || '","' || lang || '"]')"""


@register(
    "ledger_evidence_text",
    f"""select doc_id, '-----BEGIN CAPTURE SIGNED ATTESTATION-----' || chr(10) || chr(10) || '**BEFORE: ' ||
        regexp_replace(text, '([\\\\`*_\\[\\]<>&|~])', '\\\\\\1', 'g') || '**' || chr(10) || chr(10) || 'Target: ' || lang || chr(10) || chr(10) ||
        'Attested: 2026-01-01T00:00:00.000Z' || chr(10) || chr(10) || 'Evidence: <https://' || source || '.s3.eu-west-9.amazonaws.com/' || lang || '/' || doc_id ||
        '?versionId=v' || doc_id || '>' || chr(10) || chr(10) || 'Statement: <https://' || source || '.s3.eu-west-9.amazonaws.com/' || lang || '/' || doc_id ||
        '?versionId=v' || doc_id || '.json>' || chr(10) || chr(10) || '{HEADER} · Key-ID: k1' || chr(10) || chr(10) || '<!-- attestation-identity: ' || {SQL_IDENTITY}
        || ' -->' || chr(10) || chr(10) || '-----END CAPTURE SIGNED ATTESTATION-----' as body from documents""",
)
def evidence_text(spark, folder):
    o = identified(spark, folder)
    return o.select("doc_id", block(o).alias("body"))


@register(
    "ledger_image_evidence",
    """select doc_id, '-----BEGIN CAPTURE SIGNED ATTESTATION-----' || chr(10) || chr(10) || case when doc_id % 2 = 0 then '![' || case when doc_id % 3 = 0 then 'evidence' else 'ui screenshot' end || ' — https://' || lang ||
          case when doc_id % 4 = 0 then '' else ' — 800x600' end || ' — sha256 ' || left(sha256(text), 12) || '](u)' || chr(10) || chr(10) else '' end ||
          '**AFTER: i**' || chr(10) || chr(10) || 'Target: t' || chr(10) || chr(10) || 'Attested: a' || chr(10) || chr(10) || 'Evidence: <u>' || chr(10) || chr(10) || 'Statement: <s>' || chr(10) || chr(10) ||
          'c · Key-ID: k' || chr(10) || chr(10) || '-----END CAPTURE SIGNED ATTESTATION-----' as body from documents""",
)
def image_evidence(spark, folder):
    d, blank = F.col("doc_id"), F.lit("")
    url = F.concat(F.lit("https://["), "lang", F.lit("]"))
    alt = X.image_alt(
        F.when(d % 3 == 0, blank).otherwise("ui screenshot"), F.when(d % 5 == 0, blank).otherwise(url), url, F.when(d % 4 == 0, blank).otherwise("800x600"), F.sha2("text", 256)
    )
    kind = F.when(d % 2 == 0, "image/png").otherwise("text/html")
    body = X.evidence_text(*map(F.lit, ("AFTER", "i", "t", "a", "u", "s", "c", "k")), "CAPTURE", image_alt=alt, content_type=kind)
    return table(spark, folder, "documents").select("doc_id", body.alias("body"))


@register(
    "ledger_receipts",
    f"""select doc_id, {SQL_IDENTITY} as identity, case when doc_id in (select doc_id from labels) then 'reused' else 'posted' end as outcome from documents""",
)
def receipts(spark, folder):
    o = identified(spark, folder)
    labelled = table(spark, folder, "labels").select("doc_id")
    comments = o.join(labelled, "doc_id", "left_semi").select(block(o).alias("body"))
    reused, fresh = L.reuse_receipts(o, comments, "body", TAG)
    return reused.withColumn("outcome", F.lit("reused")).unionByName(fresh.withColumn("outcome", F.lit("posted"))).select("doc_id", "identity", "outcome")


@register(
    "ledger_statement_check",
    f"""with {SQL_OBJECTS} select m.doc_id, coalesce(toxic, 0) = 0 and coalesce(quality, 1) = 1 as all_ok,
        case when toxic = 1 then 'manifest' when quality = 0 then 'version' end as failed_rule from m left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) l using (doc_id)""",
)
def statement_check(spark, folder):
    now = L.statements(objects(spark, folder), HEADER).select("doc_id", "key", "version_id", "manifest")
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    stored = now.join(marks, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat("manifest", F.lit("x"))).otherwise(F.col("manifest")).alias("stored_manifest"),
        F.when(F.col("quality") == 0, F.lit("other")).otherwise(F.col("version_id")).alias("stored_version"), F.col("key").alias("stored_key"),
    )
    rules = {"manifest": ("stored_manifest", "manifest"), "key": ("stored_key", "key"), "version": ("stored_version", "version_id")}
    return L.check_statements(stored, now, ["doc_id"], rules).select("doc_id", "all_ok", "failed_rule")


@register(
    "ledger_receipt_check",
    """select doc_id, rule as failed_rule, rule is null as all_ok from (select doc_id, case doc_id % 12 when 1 then 'manifest' when 2 then 'key id' when 3 then 'bucket' when 4 then 'key'
        when 5 then 'version' when 6 then 'ci.env' when 7 then 'ci.target-sha' when 8 then 'body' when 9 then 'object' end as rule from documents)""",
)
def receipt_check(spark, folder):
    """Stored statements, nine kinds in twelve of which differ in one thing from what is published again."""
    kind = F.col("doc_id") % 12
    other = lambda n, name: F.when(kind == n, F.concat(F.col(name), F.lit("x"))).otherwise(F.col(name)).alias(name)
    now = identified(spark, folder).withColumn("observed", F.map_concat("observed", F.create_map(F.lit("ci.env"), F.col("lang"), F.lit("ci.target-sha"), F.left("sha256", F.lit(40)))))
    facts = F.transform_values("observed", lambda k, v: F.when(((k == "ci.env") & (kind == 6)) | ((k == "ci.target-sha") & (kind == 7)), F.concat(v, F.lit("x"))).otherwise(v))
    kept = [c for c in now.columns if c not in ("bucket", "key", "version_id", "observed")]
    saved = now.select(*kept, other(3, "bucket"), other(4, "key"), other(5, "version_id"), facts.alias("observed"))
    saved = L.statements(saved, HEADER).withColumns({"key_id": F.when(kind == 2, "k2").otherwise("k1"), "body": block(saved)})
    saved = saved.withColumns({"manifest": F.when(kind == 1, F.concat("manifest", F.lit("x"))).otherwise(F.col("manifest")), "body": F.when(kind == 8, "gone").otherwise(F.col("body"))})
    checked = L.check_receipts(saved, now.where("doc_id % 12 <> 9"), ["doc_id"], block(saved), HEADER, "k1", "eu-west-9")
    return checked.select("doc_id", "failed_rule", "all_ok")


def executions(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderpriority").alias("env"), F.col("o_orderkey").cast("string").alias("execution_id"), F.col("o_orderdate").alias("start_date"),
        F.col("o_orderstatus").alias("status"), F.concat(F.lit('{"sha":" s'), F.col("o_custkey").cast("string"), F.lit(' "}')).alias("input"), "o_custkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("stop_date"),
    )


SQL_LATEST = """n as (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, cast(o_orderkey as varchar) desc) as rn from orders),
  latest as (select o_orderpriority as env, cast(o_orderkey as varchar) as execution_id, o_custkey, o_orderstatus as status, o_orderdate, o_orderkey from n where rn = 1)"""


@register("ledger_latest_execution", f"with {SQL_LATEST} select env, execution_id, status from latest")
def latest_execution(spark, folder):
    return L.latest_execution(executions(spark, folder)).select("env", "execution_id", "status")


def payload(k):
    """Every tenth key carries a mode, some by an escaped name, as "0", or with a flag for its exit code; odd users
    wrap it in a Payload member, where a Payload that is text is no object."""
    name = F.when(k % 20 == 0, F.lit("mode")).otherwise(F.lit("\\u006dode"))
    mode = F.when(k == 20, F.lit("0")).when(k == 30, F.lit("false")).otherwise(F.concat(F.lit("m"), k.cast("string")))
    code = F.when(k == 40, F.lit("true")).otherwise(F.concat(F.lit('" '), k.cast("string"), F.lit('\\t"')))
    body = F.when(k == 50, F.lit('"false"')).when(
        k % 10 == 0, F.concat(F.lit('{"'), name, F.lit('":"'), mode, F.lit('","exitCode":'), code, F.lit("}"))
    ).otherwise(F.lit('{"x":1}'))
    return F.when(F.col("user_id") % 2 == 1, F.concat(F.lit('{"Payload":'), body, F.lit("}"))).otherwise(body)


def scheduled(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.when(F.col("event_type") == "view", "TaskScheduled").when(F.col("event_type") == "click", "LambdaFunctionScheduled").otherwise("TaskSucceeded")
    return table(spark, folder, "events").select("user_id", "event_id", kind.alias("event_type"), payload(k).alias("payload"))


SQL_PAYLOADS = """e as (select user_id, event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
  m as (select user_id, event_id, case k when 20 then '0' when 30 then 'false' else 'm' || k end as mode, case when k = 40 then '1' else cast(k as varchar) end as exit_code
    from e where k % 10 = 0 and k <> 50 and event_type in ('view', 'click'))"""


@register(
    "ledger_newest_payload",
    f"""with {SQL_PAYLOADS} select user_id, max(event_id) as event_id, arg_max(mode, event_id) as mode, arg_max(exit_code, event_id) as exit_code from m group by 1""",
)
def newest_payload(spark, folder):
    return L.newest_payload(scheduled(spark, folder), ["user_id"])


@register(
    "ledger_ci_snapshot",
    f"""with {SQL_LATEST}, {SQL_PAYLOADS},
        p as (select execution_id, arg_max(mode, event_id) as mode, arg_max(exit_code, event_id) as exit_code from latest join m on user_id = o_custkey group by 1),
        envs as (select distinct o_orderpriority as env from orders union all select 'n-' || n_name from nation)
        select envs.env, 't-' || envs.env as target_sha, '2024-05-06T07:08:09.000Z' as checked_at_utc, execution_id,
          case when execution_id is not null then 's' || o_custkey end as executed_sha, status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as start_date,
          case when execution_id is not null then case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') else '' end end as stop_date,
          case when execution_id is not null then case when envs.env like '1-%' then '' else coalesce(mode, '') end end as finalizer_mode,
          case when execution_id is not null then case when envs.env like '1-%' then '' else coalesce(exit_code, '') end end as worker_exit_code,
          case when execution_id is null then 'no execution found for ' || envs.env when envs.env like '1-%' then 'history: throttled' end as ci_error
        from envs left join latest using (env) left join p using (execution_id)""",
)
def ci_snapshot(spark, folder):
    runs = executions(spark, folder)
    latest = L.latest_execution(runs)
    history = scheduled(spark, folder).join(latest.select("execution_id", F.col("o_custkey").alias("user_id")), "user_id")
    envs = runs.select("env").distinct().unionByName(table(spark, folder, "nation").select(F.concat(F.lit("n-"), "n_name").alias("env")))
    envs = envs.withColumn("target_sha", F.concat(F.lit("t-"), "env"))
    failures = latest.where(F.col("env").startswith("1-")).select("execution_id", F.lit("throttled").alias("reason"))
    return L.ci_snapshot(envs, runs, history, F.lit("2024-05-06 07:08:09").cast("timestamp"), failures)


def hops(spark, folder):
    c = table(spark, folder, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    location = F.concat(F.lit("https://hop/"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string"))
    moved = (F.col("turn") < F.col("last")) | (F.col("role") == "user")
    return c.join(last, "conv_id").select(
        F.col("conv_id").alias("capture_id"), F.col("turn").alias("hop"), F.concat(F.lit("https://hop/?"), "text").alias("url"),
        F.when(moved, 302).otherwise(200).alias("status"), F.when(moved, location).otherwise("").alias("location"),
        F.when(F.col("turn") == 0, F.lit("")).otherwise(F.concat(F.lit("worker "), "role")).alias("fetched_by"), F.lit("10.0.0.7:443").alias("remote_address"),
    )


SQL_HOPS = """h as (select conv_id as capture_id, turn as hop, role, 'https://hop/?' || text as url, text,
    turn < max(turn) over (partition by conv_id) or role = 'user' as moved from conversations)"""


@register(
    "ledger_redirect_summary",
    f"""with {SQL_HOPS} select capture_id, count(*) - 1 as redirect_count, arg_max(url, hop) as final_url,
        cast(arg_max(case when moved then 302 else 200 end, hop) as int) as final_status, count(*) - 1 >= 4 and arg_max(moved, hop) as truncated from h group by 1""",
)
def redirect_summary(spark, folder):
    return L.redirect_summary(hops(spark, folder), 4)


@register(
    "ledger_redirect_facts",
    f"""with {SQL_HOPS}, p as (select *, 'capture.redirect.' || lpad(cast(hop as varchar), 2, '0') || '.' as p from h)
        select capture_id, p || 'status' as fact, case when moved then '302' else '200' end as value from p
        union all select capture_id, p || 'location', case when moved then 'https://hop/' || capture_id || '/' || (hop + 1) else '' end from p
        union all select capture_id, p || 'fetched-by', 'worker ' || role from p where hop > 0
        union all select capture_id, p || 'remote-address', '10.0.0.7:443' from p where hop > 0
        union all select capture_id, p || 'url', left({SQL_META.replace('text', 'url')}, 512) from p""",
)
def redirect_facts(spark, folder):
    return L.redirect_facts(hops(spark, folder))


@register(
    "ledger_header_facts",
    f"""select doc_id, 'capture.header.content-type' as fact, left({SQL_META}, 512) as value from documents
        union all select doc_id, 'capture.header.server', source from documents
        union all select doc_id, 'capture.header.via', lang from documents
        union all select doc_id, 'capture.header-count', '4' from documents""",
)
def header_facts(spark, folder):
    headers = F.create_map(F.lit("Content-Type"), F.col("text"), F.lit("SERVER"), F.col("source"), F.lit("Set-Cookie"), F.lit("secret"), F.lit("Via"), F.lit("first"), F.lit("via"), F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", F.explode(L.header_facts(headers)).alias("fact", "value"))


@register(
    "ledger_folded_headers",
    """select doc_id, 'via' as name, [source || ', ' || lang] as values from documents union all select doc_id, 'set-cookie', [text, lang] from documents
        union all select doc_id, 'age', [cast(n_chars as varchar)] from documents""",
)
def folded_headers(spark, folder):
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    sent = F.array(header("Via", F.col("source")), header("Set-Cookie", F.col("text")), header("via", F.col("lang")), header("set-cookie", F.col("lang")), header("Age", F.col("n_chars").cast("string")))
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(sent).alias("position", "h")).select("doc_id", "position", "h.*")
    return L.folded_headers(rows, ["doc_id"])


@register(
    "ledger_redaction",
    """select c_custkey, 'NAME' as variable, 'sha256:' || sha256(c_name) as digest from customer
        union all select c_custkey, 'SEGMENT', 'sha256:' || sha256(c_mktsegment) from customer""",
)
def redaction(spark, folder):
    env = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("SEGMENT"), F.col("c_mktsegment"))
    return table(spark, folder, "customer").select("c_custkey", F.explode(V.redact(env)).alias("variable", "digest"))


@register(
    "ledger_read_only_calls",
    """with t as (select p_partkey, (['Get', 'List', 'Start', 'Describe', 'get'])[p_size % 5 + 1] || p_type as operation,
          (['s3', 'iam', 'ec2', 'sts'])[p_partkey % 4 + 1] as service from part)
        select p_partkey, service, operation, regexp_matches(operation, '^(Describe|Get|List|Head|Lookup|Query|Scan|BatchGet|Filter)[A-Za-z0-9]*$') and service <> 'ec2' as allowed from t""",
)
def read_only_calls(spark, folder):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    calls = table(spark, folder, "part").select(
        "p_partkey", pick(["s3", "iam", "ec2", "sts"], F.col("p_partkey") % 4).alias("service"),
        F.concat(pick(["Get", "List", "Start", "Describe", "get"], F.col("p_size") % 5), "p_type").alias("operation"),
    )
    return calls.withColumn("allowed", L.read_only_call(F.col("service"), F.col("operation")))


@register(
    "ledger_manifest_keys",
    """with t as (select doc_id, lang || '/' || sha1(text) || '/2026' || lpad(cast(doc_id % 14 as varchar), 2, '0') || lpad(cast(n_chars % 33 as varchar), 2, '0')
          || 'T' || lpad(cast(n_chars % 25 as varchar), 2, '0') || '0000Z/manifest.json' as key from documents)
        select doc_id, key, case when not regexp_matches(key, '^(en|fr|de)/[0-9a-f]{40}/[0-9]{8}T[0-9]{6}Z/manifest[.]json$')
          then 'key must be <env>/<40-lowercase-hex-sha>/<YYYYMMDDTHHMMSSZ>/manifest.json'
          when try_strptime(string_split(key, '/')[3], '%Y%m%dT%H%M%SZ') is null then 'key contains an invalid UTC run timestamp' end as error from t""",
)
def manifest_keys(spark, folder):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.concat(F.lit("2026"), two(F.col("doc_id") % 14), two(F.col("n_chars") % 33), F.lit("T"), two(F.col("n_chars") % 25), F.lit("0000Z"))
    keys = table(spark, folder, "documents").select("doc_id", F.concat_ws("/", "lang", F.sha1("text"), stamp, F.lit("manifest.json")).alias("key"))
    return keys.withColumn("error", L.manifest_key_error(F.col("key"), ["en", "fr", "de"]))


@register(
    "ledger_claims",
    f"""with t as (select doc_id, trim(left({SQL_META}, 1000)) as claim_intent, upper((['before', ' After ', 'later'])[doc_id % 3 + 1]) as category,
          (['capture-http-raw', 'attest-ci-verdict', 'attest-aws-resource', 'attest'])[n_chars % 4 + 1] as action, source, lang from documents)
        select doc_id, claim_intent, trim(category) as claim_category,
          case action when 'capture-http-raw' then 'https://' || source when 'attest-ci-verdict' then lang || '@' || doc_id
            when 'attest-aws-resource' then 's3.Get' || lang || ' {{}}' else case when lang = 'en' then 'en@' || doc_id else 's3://' || source || '/' || lang || '/k' end end as claim_target,
          case when claim_intent = '' then 'published attestation requires intent'
            when trim(category) not in ('BEFORE', 'AFTER') then 'published attestation category must be BEFORE or AFTER' end as error from t""",
)
def claims(spark, folder):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    d = table(spark, folder, "documents").withColumn("category", pick(["before", " After ", "later"], F.col("doc_id") % 3))
    action = pick(["capture-http-raw", "attest-ci-verdict", "attest-aws-resource", "attest"], F.col("n_chars") % 4)
    sha = F.when((action == "attest-ci-verdict") | (F.col("lang") == "en"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    target = L.claim_target(
        action, F.concat(F.lit("https://"), "source"), F.col("lang"), sha, F.lit("s3"), F.concat(F.lit("Get"), "lang"), none,
        F.col("source"), F.concat("lang", F.lit("/k")), none,
    )
    return L.claim_context(d.withColumn("target", target), "text", "category", "target").select("doc_id", "claim_intent", "claim_category", "claim_target", "error")


@register(
    "ledger_clamped_options",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
        cast(trunc(greatest(10, least(40, case when l_quantity = 0 then 30 else l_quantity end))) as bigint) as wait_ms,
        cast(trunc(greatest(0.0, least(90000.5, case when l_tax = 0 then 512.0 else l_extendedprice end))) as bigint) as height from lineitem""",
)
def clamped_options(spark, folder):
    height = F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        V.clamp_number(F.col("l_quantity"), 30, 10, 40).alias("wait_ms"), V.clamp_number(height, 512, 0, 90000.5).alias("height"),
    )


@register(
    "ledger_numeric_timing",
    """select event_id, 'value' as name, value as number from events
        union all select event_id, 'k', cast(regexp_extract(props, '([0-9]+)', 1) as double) from events""",
)
def numeric_timing(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    record = F.to_json(F.struct("value", F.col("event_type").alias("type"), k.cast("int").alias("k"), k.alias("text"), F.lit(True).alias("flag")))
    timing = F.variant_get(F.parse_json(record), "$", "map<string,variant>")
    return table(spark, folder, "events").select("event_id", F.explode(V.numeric_members(timing)).alias("name", "number"))


@register(
    "ledger_cookie_rows",
    """select c_custkey, 'seg' as name, c_mktsegment as value, 'https://' || c_nationkey as url, '' as attributes from customer where c_custkey % 2 = 0 and c_custkey % 10 <> 0
        union all select c_custkey, 'bal', cast(c_nationkey as varchar), 'https://' || c_nationkey, '' from customer where c_custkey % 2 = 0 and c_custkey % 10 <> 0
        union all select c_custkey, c_name, c_mktsegment, 'https://x', 'domain=d.example,secure=true' from customer where c_custkey % 2 = 1""",
)
def cookie_rows(spark, folder):
    rows, _ = cookies(spark, folder)
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.withColumn("attributes", F.array_join(pairs, ","))


@register(
    "ledger_cookie_rejects",
    """select c_custkey, 'cookies must be an array of cookie objects or a name/value object' as error from customer where c_custkey % 10 = 0 and (c_custkey // 10) % 5 in (2, 3)""",
)
def cookie_rejects(spark, folder):
    return cookies(spark, folder)[1]


def cookies(spark, folder):
    as_object = F.concat(F.lit('{"seg":"'), "c_mktsegment", F.lit('","bal":'), F.col("c_nationkey").cast("string"), F.lit("}"))
    as_list = F.concat(F.lit('[{"name":"'), "c_name", F.lit('","value":"'), "c_mktsegment", F.lit('","url":"https://x","secure":true,"domain":"d.example"},{"name":"","value":"1"},{"name":"gone"},7]'))
    shaped = F.when(F.col("c_custkey") % 2 == 0, as_object).otherwise(as_list)
    broken = F.element_at(F.array(*map(F.lit, ["", "null", "{broken", "12", "false"])), (F.floor(F.col("c_custkey") / 10) % 5 + 1).cast("int"))
    raw = F.when(F.col("c_custkey") % 10 == 0, broken).otherwise(F.concat(F.lit("\n\t"), shaped))
    df = table(spark, folder, "customer", spread=True).select("c_custkey", raw.alias("raw"), F.concat(F.lit("https://"), F.col("c_nationkey").cast("string")).alias("home"))
    return L.cookie_rows(df, ["c_custkey"], "raw", "home")


@register(
    "ledger_issue_targets",
    """select o_orderkey, case when o_custkey = 0 then 'publication requires a positive issue number'
        when o_orderkey % 3 = 0 and o_orderkey <> o_custkey then 'publication target disagrees with capture issue'
        when o_orderkey % 5 = 0 and o_orderkey % 100 <> o_custkey then 'publication target disagrees with evidence key' end as error from orders""",
)
def issue_targets(spark, folder):
    o = table(spark, folder, "orders")
    claimed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).cast("double")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("e/issue-evidence/issue-"), (F.col("o_orderkey") % 100).cast("string"), F.lit("/u")))
    return o.select("o_orderkey", L.issue_error(F.col("o_custkey").cast("double"), claimed, key).alias("error"))


@register(
    "ledger_merged_facts",
    """with a as (select doc_id as id, unnest(['capture.lang', 'capture.size']) as fact, unnest([lang, cast(n_chars as varchar)]) as value from documents),
        b as (select doc_id as id, 'capture.size' as fact, 'q' || max(quality) as value from labels group by 1)
        select id, fact, coalesce(b.value, a.value) as value from a full outer join b using (id, fact)""",
)
def merged_facts(spark, folder):
    facts = F.explode(F.create_map(F.lit("capture.lang"), F.col("lang"), F.lit("capture.size"), F.col("n_chars").cast("string"))).alias("fact", "value")
    captured = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), facts)
    judged = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.concat(F.lit("q"), F.max("quality").cast("string")).alias("value"))
    return L.merge_facts(captured, judged.select("id", F.lit("capture.size").alias("fact"), "value"))


@register(
    "ledger_bounded_scan",
    "select user_id, count(*) as n, case when count(*) >= 70 then 'deduplication exceeds 70 comments' end as error from events group by 1",
)
def bounded_scan(spark, folder):
    return L.bounded_scan(table(spark, folder, "events"), "user_id", 70)
