"""Profiles and logs over pages, documents, events and customer."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..session import shared_folder
from ..sources import logs, replies, sinks
from ..tables import table
from .registry import register


def stacks(spark, folder):
    path = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    frames = F.reverse(F.filter(path, lambda p: p != ""))
    return table(spark, folder, "pages").select("page_id", frames.alias("frames_leaf_first"), F.length("html").cast("bigint").alias("ms"))


SQL_STACKS = """s as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda p: p <> '') as f, length(html) as ms from pages),
  folded as (select array_to_string(f, ';') as stack, cast(sum(ms) as bigint) as ms from s group by 1),
  nodes as (select node, cast(sum(ms) as bigint) as ms from (select unnest(list_transform(range(1, len(f) + 1), lambda i: array_to_string(f[1:i], ';'))) as node, ms from s) group by 1)"""


@register("folded_stacks", f"with {SQL_STACKS} select stack, ms from folded")
def folded_stacks(spark, folder):
    return P.heaviest_first(P.folded(stacks(spark, folder)))


@register("subtree_totals", f"with {SQL_STACKS} select node, ms from nodes")
def subtree_totals(spark, folder):
    return P.subtree_totals(P.folded(stacks(spark, folder)))


SQL_FLAME = """p as (select node, ms, regexp_replace(node, ';?[^;]*$', '') as parent, regexp_extract(node, '([^;]*)$', 1) as name from nodes),
  o as (select node, ms, coalesce(sum(ms) over (partition by parent order by ms desc, name rows between unbounded preceding and 1 preceding), 0) as off from p),
  st as (select a.node, a.ms, cast(sum(b.off) as bigint) as start from o a join o b on b.node = a.node or starts_with(a.node, b.node || ';') group by 1, 2),
  tot as (select sum(ms) as total from st where not contains(node, ';'))"""


@register("flame_offsets", f"with {SQL_STACKS}, {SQL_FLAME} select node, ms, start from st")
def flame_offsets(spark, folder):
    return P.flame_offsets(P.subtree_totals(P.folded(stacks(spark, folder))))


@register("flame_frames", f"with {SQL_STACKS}, {SQL_FLAME} select node, ms, start, round(100.0::double * ms / total, 6) as pct from st, tot where ms / total * 1384 >= 0.4")
def flame_frames(spark, folder):
    offsets = P.flame_offsets(P.subtree_totals(P.folded(stacks(spark, folder))))
    return P.drawn_frames(offsets).withColumn("pct", F.round("pct", 6))


def log_lines(spark, folder):
    """Document lines; line lengths decide where markers stand."""
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    size = F.length("line")
    return lines.withColumn(
        "line", F.when(size % 11 == 0, "\x1b[91m==== OUT BEGIN\x1b[0m").when(size % 7 == 0, "==== OUT END\r").otherwise(F.regexp_replace("line", "[\r]+$", ""))
    )


@register(
    "marked_block",
    """with l as (select doc_id as file, cast(i - 1 as int) as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
        b as (select file, max(line_no) as b from l where length(line) % 11 = 0 group by 1),
        e as (select l.file, min(line_no) as e from l join b using (file) where line_no > b and length(line) % 7 = 0 group by 1)
        select l.file, line_no, regexp_replace(line, '[\\r]+$', '') as line from l join b using (file) left join e using (file) where line_no > b and (e is null or line_no < e)""",
)
def marked_block(spark, folder):
    return P.marked_block(log_lines(spark, folder), "OUT")


@register(
    "tree_totals",
    """with recursive n as (select c_custkey as id, case when c_custkey // 2 = 0 or c_custkey = 0 then null else c_custkey // 2 end as parent, cast(round(c_acctbal * 100) as bigint) as v from customer),
        up as (select id as node, id as anc, v from n union all select up.node, n.parent, up.v from up join n on n.id = up.anc where n.parent is not null)
        select anc as id, cast(sum(v) as bigint) as total from up group by 1""",
)
def tree_totals(spark, folder):
    parent = F.floor(F.col("c_custkey") / 2)
    nodes = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.when(parent > 0, parent).alias("parent"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("value")
    )
    return P.tree_totals(nodes)


def tagged_lines(spark, folder):
    e = table(spark, folder, "events")
    doc = F.to_json(F.struct("event_id", F.col("props").alias("url"), F.col("value").alias("cpu_ms")))
    phase = F.concat(F.lit("[phase] "), "event_type", F.lit(" +"), F.floor("value").cast("string"), F.lit("ms"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" "), "props")).otherwise(""))
    return e.select(F.explode(F.array(F.concat(F.lit("OCR "), doc), phase, F.lit("noise"))).alias("line"))


@register("source_tagged_log", "select event_id, props as url, value as cpu_ms from events")
def source_tagged_log(spark, folder):
    return logs.tagged(tagged_lines(spark, folder), "OCR", "event_id BIGINT, url STRING, cpu_ms DOUBLE")


@register(
    "source_phase_log",
    "select event_type as phase, cast(floor(value) as bigint) as ms, case when user_id % 2 = 0 then props else '' end as detail, count(*) as n from events group by 1, 2, 3",
)
def source_phase_log(spark, folder):
    return logs.phases(tagged_lines(spark, folder)).groupBy("phase", "ms", "detail").agg(F.count(F.lit(1)).alias("n"))


@register(
    "source_traces",
    f"""with {SQL_STACKS} select page_id, array_to_string(list_reverse(f), ';') as frames, round(case page_id % 2 when 0 then ms when 1 then ms * 1000 end, 6)::double as ms from s""",
)
def source_traces(spark, folder):
    """Trace records built from the page stacks and parsed back."""
    unit = F.when(F.col("page_id") % 2 == 0, "ms").otherwise("s")
    body = F.concat(F.lit("-----\n  "), F.col("ms").cast("string"), unit, F.lit("   "), F.array_join("frames_leaf_first", "\n             "), F.lit("\n"))
    records = stacks(spark, folder).select("page_id", F.explode(F.array(body, F.lit("File: x\nType: cpu"))).alias("value"))
    return logs.stacks(records).select("page_id", F.array_join("frames_leaf_first", ";").alias("frames"), F.round("ms", 6).alias("ms"))


@register(
    "source_xml_replies",
    """select o_orderkey, o_orderstatus as status, [o_orderpriority, cast(o_custkey as varchar)] as tags, cast(o_custkey as varchar) as owner from orders""",
)
def source_xml_replies(spark, folder):
    text = F.concat(
        F.lit('<ns:Reply xmlns:ns="u"><ns:Status>'), "o_orderstatus", F.lit("</ns:Status><Tags><member>"), "o_orderpriority", F.lit("</member><member>"),
        F.col("o_custkey").cast("string"), F.lit("</member></Tags><Owner>"), F.col("o_custkey").cast("string"), F.lit("</Owner></ns:Reply>"),
    )
    df = table(spark, folder, "orders").select("o_orderkey", text.alias("xml"))
    parsed = replies.parse_replies(df, "xml", "Status STRING, Tags STRUCT<member: ARRAY<STRING>>, Owner STRING")
    return parsed.select("o_orderkey", F.col("Status").alias("status"), F.col("Tags.member").alias("tags"), F.col("Owner").alias("owner"))


@register(
    "matched_logs",
    """with s as (select doc_id, sha1(text) as url from documents), r as (select d.doc_id, d.url, quality from s d join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)),
        w as (select url, count(*) as writes from s group by 1) select s.doc_id, s.url, r.quality as cpu_ms, writes from s left join r on r.doc_id = s.doc_id left join w on w.url = s.url""",
)
def matched_logs(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("digest"))
    unique = d.withColumn("url", F.concat_ws("/", "digest", F.col("doc_id").cast("string")))
    judged = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("cpu_ms"))
    reads = unique.join(judged, "doc_id").select(F.to_json(F.struct("url", "cpu_ms")).alias("j")).select(F.concat(F.lit("OCR "), "j").alias("line"))
    shots = unique.select(F.concat(F.lit("SHOT "), F.to_json(F.struct("url", "doc_id", "digest"))).alias("line"))
    writes = d.groupBy("digest").agg(F.count(F.lit(1)).alias("writes"))
    written = unique.join(writes, "digest").select(F.concat(F.lit("WRITTEN "), F.to_json(F.struct("url", "writes"))).alias("line"))
    lines = shots.unionByName(reads).unionByName(written)
    out = P.matched_logs(
        logs.tagged(lines, "SHOT", "url STRING, doc_id BIGINT, digest STRING"), logs.tagged(lines, "OCR", "url STRING, cpu_ms INT"),
        logs.tagged(lines, "WRITTEN", "url STRING, writes BIGINT"),
    )
    return out.select("doc_id", F.col("digest").alias("url"), "cpu_ms", "writes")


@register(
    "sink_content",
    "select doc_id as id, 'sha1/' || left(sha1(text), 2) || '/' || sha1(text) || '.png' as key, row_number() over (partition by sha1(text) order by doc_id) > 1 as deduplicated from documents",
)
def sink_content(spark, folder):
    path = os.path.join(shared_folder(spark), f"content-{uuid.uuid4().hex}")
    return sinks.write_content(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), path)


@register("sink_sidecars", "select lang as env, lang || '/' || doc_id || '.attestation.json' as sidecar_key, sha256(text) as manifest_sha256 from documents")
def sink_sidecars(spark, folder):
    path = os.path.join(shared_folder(spark), f"sidecars-{uuid.uuid4().hex}")
    d = table(spark, folder, "documents").select(
        F.col("lang").alias("env"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"), F.sha2("text", 256).alias("manifest_sha256")
    )
    sinks.write_sidecars(d, path)
    return spark.read.schema("key STRING, manifest_sha256 STRING, sidecar_key STRING, env STRING").json(path).select("env", "sidecar_key", "manifest_sha256")


@register("sink_evidence", "select lang as env, 'issue-' || source as issue, doc_id, sha1(text) as digest from documents")
def sink_evidence(spark, folder):
    path = os.path.join(shared_folder(spark), f"evidence-{uuid.uuid4().hex}")
    d = table(spark, folder, "documents").select(
        F.col("lang").alias("env"), F.concat(F.lit("issue-"), "source").alias("issue"), "doc_id", F.sha1("text").alias("digest")
    )
    sinks.write_evidence(d, path)
    return spark.read.schema("doc_id BIGINT, digest STRING, env STRING, issue STRING").parquet(path).select("env", "issue", "doc_id", "digest")
