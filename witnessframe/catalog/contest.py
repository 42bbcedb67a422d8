"""Benchmark statistics over orders and lineitem."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import contest as B
from ..plans.ordered import order_statistics
from ..session import shared_folder
from ..sources import sessions
from ..tables import table
from .registry import register

REFERENCE = "1-URGENT"
WEIGHTS = {"F": 0.8, "O": 0.2}

SQL_CELLS = """c as (select o_orderstatus as fixture, o_orderkey % 2 as session, o_orderpriority as spec, o_orderkey % 5 as pair,
    min(o_totalprice) as lo, max(o_totalprice) as mid from orders group by 1, 2, 3, 4),
  samples as (select fixture, session, spec, pair, 'total' as phase, lo as ms from c
    union all select fixture, session, spec, pair, 'transform', mid from c)"""
SQL_GATE = """d as (select o_orderpriority as spec, o_orderstatus as fixture, count(*) as pixels,
    count(*) filter (where o_custkey % 97 = 0) as differing, 1 as max_delta from orders group by 1, 2),
  g as (select spec, bool_and(differing * 100.0::double / pixels <= 1.0 and max_delta <= 1) as eligible from d group by 1)"""


def samples(spark, folder):
    cells = table(spark, folder, "orders").groupBy(
        F.col("o_orderstatus").alias("fixture"), (F.col("o_orderkey") % 2).alias("session"), F.col("o_orderpriority").alias("spec"),
        (F.col("o_orderkey") % 5).alias("pair"),
    ).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("mid"))
    phases = F.explode(F.create_map(F.lit("total"), F.col("lo"), F.lit("transform"), F.col("mid"))).alias("phase", "ms")
    return cells.select("fixture", "session", "spec", "pair", phases)


def differences(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("spec"), F.col("o_orderstatus").alias("fixture")).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("o_custkey") % 97 == 0).alias("differing"), F.lit(1).alias("max_delta")
    )


SQL_STATS = """count(*) as n, min({v}) as min_value, max({v}) as max_value, round(avg({v}), 6) as mean_value,
    round(median({v}), 6) as median_value, list_sort(list({v}))[count(*) // 2 + 1] as upper_median_value"""


@register(
    "stats_min_median_mean",
    f"select l_returnflag, l_linestatus, {SQL_STATS.format(v='l_extendedprice')} from lineitem group by 1, 2",
)
def min_median_mean(spark, folder):
    out = order_statistics(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumn("mean_value", F.round("mean_value", 6)).withColumn("median_value", F.round("median_value", 6))


@register(
    "pool_readiness",
    """select o_orderpriority as pool, count(*) as n, list_sort(list(o_custkey))[count(*) // 2 + 1] as p50, max(o_custkey) as max_value,
       cast(sum(o_custkey) as bigint) as total from orders group by 1""",
)
def pool_readiness(spark, folder):
    rss = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("pool"), "o_custkey")
    totals = rss.groupBy("pool").agg(F.sum("o_custkey").alias("total"))
    out = order_statistics(rss, ["pool"], "o_custkey").join(totals, "pool")
    return out.select("pool", "n", F.col("upper_median_value").alias("p50"), "max_value", "total")


@register("contest_best_observed", f"with {SQL_CELLS} select fixture, spec, phase, min(ms) as best_ms from samples group by 1, 2, 3")
def best_observed(spark, folder):
    return B.best_observed(samples(spark, folder))


SQL_RATIO = f"""b as (select * from samples where spec = '{REFERENCE}'),
  p as (select s.fixture, s.session, s.pair, s.phase, s.spec, s.ms, b.ms as reference_ms, case when b.ms > 0 and s.ms > 0 then b.ms / s.ms end as ratio
    from samples s join b using (fixture, session, pair, phase) where s.spec <> '{REFERENCE}')"""


@register(
    "contest_paired_ratios",
    f"with {SQL_CELLS}, {SQL_RATIO} select fixture, cast(session as bigint) as session, cast(pair as bigint) as pair, phase, spec, ms, reference_ms, round(ratio, 6) as ratio from p",
)
def paired_ratios(spark, folder):
    return B.paired_ratios(samples(spark, folder), REFERENCE).withColumn("ratio", F.round("ratio", 6))


@register(
    "contest_ratio_summary",
    f"""with {SQL_CELLS}, {SQL_RATIO} select fixture, spec, phase, count(*) as pairs, count(ratio) as measurable, count(*) filter (where ratio > 1) as wins,
        round(min(ratio), 6) as min_value, round(max(ratio), 6) as max_value, round(avg(ratio), 6) as mean_value, round(median(ratio), 6) as median_value
        from p group by 1, 2, 3""",
)
def ratio_summary(spark, folder):
    out = B.ratio_summary(B.paired_ratios(samples(spark, folder), REFERENCE))
    rounded = {c: F.round(c, 6) for c in ("min_value", "max_value", "mean_value", "median_value")}
    return out.withColumns(rounded)


SQL_WEIGHTED = f"""w as (select spec, max(case when fixture = 'F' then ms end) * 0.8::double + max(case when fixture = 'O' then ms end) * 0.2::double as weighted_ms
    from (select fixture, spec, min(ms) as ms from samples where phase = 'total' group by 1, 2) group by 1)"""


@register("contest_quality_gate", f"with {SQL_GATE} select spec, eligible from g")
def quality_gate(spark, folder):
    return B.gate(differences(spark, folder))


@register("contest_weighted_objective", f"with {SQL_CELLS}, {SQL_WEIGHTED} select spec, round(weighted_ms, 6) as weighted_ms from w")
def weighted_objective(spark, folder):
    out = B.weighted_objective(B.best_observed(samples(spark, folder)), WEIGHTS)
    return out.withColumn("weighted_ms", F.round("weighted_ms", 6))


@register(
    "contest_ranking",
    f"""with {SQL_CELLS}, {SQL_WEIGHTED}, {SQL_GATE} select spec, round(weighted_ms, 6) as weighted_ms, eligible,
        case when eligible then cast(rank() over (partition by eligible order by weighted_ms) as int) end as place from w join g using (spec)""",
)
def ranking(spark, folder):
    objective = B.weighted_objective(B.best_observed(samples(spark, folder)), WEIGHTS)
    return B.ranking(objective, B.gate(differences(spark, folder))).withColumn("weighted_ms", F.round("weighted_ms", 6))


@register(
    "rank_all_orders",
    "select o_orderkey, o_orderstatus, cast(rank() over (partition by o_orderstatus order by o_totalprice) as int) as place from orders",
)
def rank_all_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return B.ranks(orders, ["o_orderstatus"], "o_totalprice", "place").select("o_orderkey", "o_orderstatus", "place")


@register(
    "contest_timed_iterations",
    """with t as (select o_custkey, o_orderkey, cast(round(o_totalprice * 100) as bigint) as ms,
          row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
        u as (select *, sum(ms) over (partition by o_custkey order by o_orderkey rows unbounded preceding) - ms as start from t where n > 3)
        select o_custkey, count(*) as iterations, min(ms) as min_ms, max(o_orderkey) as last_iteration from u where start < 100000000 group by 1""",
)
def timed_iterations(spark, folder):
    runs = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("ms"))
    kept = B.timed_iterations(runs, ["o_custkey"], ["o_orderkey"], "ms", box=100_000_000)
    return kept.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("iterations"), F.min("ms").alias("min_ms"), F.max("o_orderkey").alias("last_iteration")
    )


SQL_CONFIG = "m as (select l_returnflag as fixture, l_linestatus as variant, l_linenumber as cfg, case when l_tax > 0.04 then 'encode' else 'decode' end as phase, l_extendedprice as ms from lineitem)"


def config_samples(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("fixture"), F.col("l_linestatus").alias("variant"), F.col("l_linenumber").alias("cfg"),
        F.when(F.col("l_tax") > 0.04, "encode").otherwise("decode").alias("phase"), F.col("l_extendedprice").alias("ms"),
    )


@register(
    "contest_config_matrix",
    f"with {SQL_CONFIG} select fixture, variant, cfg, phase, {SQL_STATS.format(v='ms')} from m group by 1, 2, 3, 4",
)
def config_matrix(spark, folder):
    out = B.config_matrix(config_samples(spark, folder))
    return out.withColumn("mean_value", F.round("mean_value", 6)).withColumn("median_value", F.round("median_value", 6))


@register(
    "contest_config_totals",
    f"""with {SQL_CONFIG} select fixture, variant, cfg, phase, count(*) as n, min(ms) as min_ms, max(ms) as max_ms,
        cast(grouping(fixture, variant, cfg, phase) as bigint) as level from m group by rollup (fixture, variant, cfg, phase)""",
)
def config_totals(spark, folder):
    return B.config_totals(config_samples(spark, folder))


@register(
    "contest_before_after",
    """with t as (select o_custkey, o_orderstatus, min(case when o_orderkey % 2 = 0 then o_totalprice end) as before_ms,
          min(case when o_orderkey % 2 = 1 then o_totalprice end) as after_ms from orders group by 1, 2)
        select o_custkey, o_orderstatus, before_ms, after_ms, round(before_ms - after_ms, 6) as saved_ms, round(before_ms / after_ms, 6) as factor
        from t where before_ms is not null and after_ms is not null""",
)
def before_after(spark, folder):
    timings = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("version"), F.col("o_totalprice").alias("ms")
    )
    out = B.before_after(timings, ["o_custkey", "o_orderstatus"])
    return out.withColumn("saved_ms", F.round("saved_ms", 6)).withColumn("factor", F.round("factor", 6))


@register(
    "contest_field",
    """select fixture, spec, count(*) as entered, case when count(*) > 1 then 'contestant specs must be unique' end as error from (
        select o_orderstatus as fixture, cast(o_custkey as varchar) as spec from orders group by 1, 2
        union all select case when c_acctbal > 5000 then 'F' else 'O' end, cast(c_custkey as varchar) from customer) group by 1, 2""",
)
def contest_field(spark, folder):
    ordered = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("fixture"), F.col("o_custkey").cast("string").alias("spec")).distinct()
    known = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 5000, "F").otherwise("O").alias("fixture"), F.col("c_custkey").cast("string").alias("spec")
    )
    return B.contest_field(ordered, known)


@register(
    "stage_shares",
    """with s as (select l_linenumber, l_returnflag as stage, sum(cast(l_quantity as bigint)) as ms from lineitem group by 1, 2)
        select l_linenumber, stage, cast(ms as double) as ms, cast(sum(ms) over (partition by l_linenumber) as double) as total_ms,
        round(cast(ms as double) / sum(ms) over (partition by l_linenumber), 6) as share from s""",
)
def stage_shares(spark, folder):
    stages = table(spark, folder, "lineitem").select("l_linenumber", F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("ms"))
    return B.stage_shares(stages, ["l_linenumber"]).withColumn("share", F.round("share", 6))


@register(
    "source_sessions",
    f"""with {SQL_CELLS}, n as (select *, row_number() over (partition by fixture, session, spec, phase order by pair) - 1 as slot from samples)
        select fixture, spec, phase, cast(slot as int) as pair, ms from n""",
)
def source_sessions(spark, folder):
    """Session files written from the orders samples and scanned back."""
    # A session file holds the few timings of one run: (pair, ms) of a spec and phase, then maps of those.
    lists = samples(spark, folder).groupBy("fixture", "session", "spec", "phase").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pair", "ms"))), lambda s: s["ms"]).alias("values")
    )
    phases = lists.groupBy("fixture", "session", "spec").agg(F.map_from_entries(F.collect_list(F.struct("phase", "values"))).alias("phases"))
    files = phases.groupBy("fixture", "session").agg(F.map_from_entries(F.collect_list(F.struct("spec", "phases"))).alias("absolute_ms"))
    path = os.path.join(shared_folder(spark), f"sessions-{uuid.uuid4().hex}")
    one_each = files.withColumn("part", F.concat_ws("-", "fixture", "session")).repartition("part")
    one_each.write.partitionBy("part").json(path)
    return sessions.samples(sessions.read_sessions(spark, path)).select("fixture", "spec", "phase", "pair", "ms")
