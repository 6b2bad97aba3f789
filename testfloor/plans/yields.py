"""Registered queries: verdicts, scopes, yields and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from testfloor.functions import verdicts
from testfloor.operators import identity, scope, yields
from testfloor.plans import adapters
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query

VERDICT_SQL = "case when flags & 20 <> 0 then 'unknown' when flags & 8 <> 0 then 'fail' else 'pass' end"

YIELD_COUNTS_SQL = """
select case when grouping(key)=1 then 'total' else 'group' end as level, key,
  count(*) as scoped, count(*) filter (not excluded) as eligible, count(*) filter (excluded) as excluded,
  count(*) filter (not excluded and verdict='pass') as pass,
  count(*) filter (not excluded and verdict='fail') as fail,
  count(*) filter (not excluded and verdict='unknown') as unknown,
  count(*) filter (not excluded and ecid is null) as unresolved
from rows group by rollup(key)"""


def yield_sql(key: str, where: str = "true", excluded: str = "false", extra: str = "", base: str = "attempts") -> str:
    return f"""{cte('attempts')}{extra},
rows as (select *, {key} as key, {excluded} as excluded, {VERDICT_SQL} as verdict from {base} where {where}),
counts as ({YIELD_COUNTS_SQL})
select *, round(pass::double/nullif(eligible,0),6) as yield_all,
  round(pass::double/nullif(pass+fail,0),6) as yield_known,
  case when eligible=0 then 'zero-eligible' end as yield_all_reason,
  case when pass+fail=0 then 'zero-known' end as yield_known_reason from counts"""


# Latest attempt by the Pareto rule, written with windows.
LATEST_SQL = """,
dev as (select *, concat(source_id,'/',run) as scope_id,
   count(*) over (partition by ecid)=count(start_t) over (partition by ecid) as all_timed,
   max(start_t) over (partition by ecid) as max_start from attempts where ecid is not null),
cand as (select * from dev where not all_timed or start_t=max_start),
latest as (select ecid, count(distinct scope_id) as scopes, max(attempt) as latest from cand group by ecid),
flagged as (select a.*, case when a.ecid is null or l.scopes<>1 then null else a.attempt=l.latest end as is_latest,
   case when a.ecid is null then 'unresolved_identity' when l.scopes<>1 then 'ambiguous_latest' end as issue
   from attempts a left join latest l on a.ecid=l.ecid)"""

# First and latest attempt by the engineering rule.
ENGINEERING_SQL = """,
dev as (select *, coalesce(start_t,-1) as st, concat(source_id,'/',run) as scope_id from attempts where ecid is not null),
ext as (select ecid, max(st) as hi, min(st) as lo, count(distinct scope_id)>1 and count(*)<>count(start_t) as bad
   from dev group by ecid),
lst as (select d.ecid, case when any_value(e.bad) or count(distinct scope_id)>1 then null else max(attempt) end as latest
   from dev d join ext e on d.ecid=e.ecid and d.st=e.hi group by d.ecid),
fst as (select d.ecid, case when any_value(e.bad) or count(distinct scope_id)>1 then null else min(attempt) end as first
   from dev d join ext e on d.ecid=e.ecid and d.st=e.lo group by d.ecid),
flagged as (select a.*, a.attempt=f.first as is_first, a.attempt=l.latest as is_latest,
   case when a.ecid is null then 'unresolved_identity' when l.latest is null then 'ambiguous_latest' end as issue
   from attempts a left join lst l on a.ecid=l.ecid left join fst f on a.ecid=f.ecid)"""


def flagged_attempts(spark, sf):
    return identity.latest_pareto(adapters.attempts(spark, sf))


def engineering_attempts(spark, sf):
    return identity.latest_engineering(adapters.attempts(spark, sf))


@query("c01_attempt_verdict", cte("attempts") + f" select flags, {VERDICT_SQL} as verdict, count(*) as n from attempts group by all")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).withColumn("verdict", verdicts.attempt_verdict(F.col("flags")))
    return rows.groupBy("flags", "verdict").agg(F.count("*").alias("n"))


@query("c02_part_pass", cte("attempts") + " select flags, (flags & 16)=0 and (flags & 8)=0 as part_pass, count(*) as n from attempts group by all")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).withColumn("part_pass", verdicts.part_pass(F.col("flags")))
    return rows.groupBy("flags", "part_pass").agg(F.count("*").alias("n"))


@query("f01_attempt_yield", yield_sql("source_id"))
def _(spark, sf):
    return yields.attempt_yield(yields.requested(adapters.attempts(spark, sf)))


@query("f02_site_variation", yield_sql("'H'||head||' / S'||site"))
def _(spark, sf):
    return yields.site_variation(yields.requested(adapters.attempts(spark, sf)))


@query("f03_lot_comparison", yield_sql("lot"))
def _(spark, sf):
    return yields.lot_comparison(yields.requested(adapters.attempts(spark, sf)))


@query("f04_wafer_comparison", yield_sql("case when wafer is null then '__missing__' when wafer='' then '__empty__' else wafer end"))
def _(spark, sf):
    return yields.wafer_comparison(yields.requested(adapters.attempts(spark, sf)))


# Sites and runs of a request; pairs, so that both engines see the same list.
_SITES, _RUNS = ((1, 0), (1, 2)), tuple((f"S{s}", 1995 * 12 + m) for s in range(6) for m in range(1, 25))


@query(
    "d01_scope",
    yield_sql(
        "lot",
        "lot in ('BUILDING','MACHINERY') and wafer in ('W2','W3','W4','') and (head,site) in ((1,0),(1,2)) "
        f"and source_id in ('S0','S1','S2','S3','S4','S5') and run between {1995*12+1} and {1995*12+24}",
    ),
)
def _(spark, sf):
    wanted = scope.Scope(("BUILDING", "MACHINERY"), ("W2", "W3", "W4", ""), _SITES, _RUNS)
    return yields.lot_comparison(yields.requested(adapters.attempts(spark, sf), scope=wanted))


@query("d02_exclusions", yield_sql("source_id", excluded="hard_bin=1 and attempt % 3=0"))
def _(spark, sf):
    rows = adapters.attempts(spark, sf)
    out = rows.filter((F.col("hard_bin") == 1) & (F.col("attempt") % 3 == 0)).select("source_id", "attempt")
    return yields.attempt_yield(yields.requested(rows, excluded=out))


@query("d03_population_latest", yield_sql("lot", "is_latest", extra=LATEST_SQL, base="flagged"))
def _(spark, sf):
    return yields.lot_comparison(yields.requested(flagged_attempts(spark, sf), population="latest"))


@query("d03_population_first", yield_sql("lot", "is_first", extra=ENGINEERING_SQL, base="flagged"))
def _(spark, sf):
    return yields.lot_comparison(yields.requested(engineering_attempts(spark, sf), population="first"))


@query(
    "d09_unknown_requests",
    cte("attempts") + """ select distinct concat('S', o_orderkey % 9) as source_id, year(o_orderdate)*12+month(o_orderdate) as run
from orders o where not exists (select 1 from attempts a where a.source_id=concat('S', o.o_orderkey % 9)
  and a.run=year(o.o_orderdate)*12+month(o.o_orderdate))""",
)
def _(spark, sf):
    rows = adapters.attempts(spark, sf)
    asked = rows.select(F.concat(F.lit("S"), (F.col("attempt") - 1) % 9).alias("source_id"), "run")
    return scope.unknown_requests(rows, ["source_id", "run"], asked)


@query(
    "e04_ecid",
    cte("attempts") + """, k as (select attempt, case when trim(lot)<>'' and x is not null then
'["lot-wafer-xy",'||to_json(lot)||','||coalesce(to_json(wafer)::varchar,'null')||','||x||','||y||']' end as ecid_key,
case when x is null then 'unresolved' else 'PRR' end as coordinate_source from attempts)
select coordinate_source, ecid_key, count(*) as attempts from k group by all""",
)
def _(spark, sf):
    from testfloor.functions import keys

    key = keys.ecid(F.col("lot"), F.col("wafer"), F.col("x"), F.col("y"))
    rows = adapters.attempts(spark, sf).select(
        F.when(F.col("x").isNull(), "unresolved").otherwise("PRR").alias("coordinate_source"), key.alias("ecid_key")
    )
    return rows.groupBy("coordinate_source", "ecid_key").agg(F.count("*").alias("attempts"))


@query("e05_latest_pareto", cte("attempts") + LATEST_SQL + " select attempt, ecid, is_latest, issue from flagged")
def _(spark, sf):
    return flagged_attempts(spark, sf).select("attempt", "ecid", "is_latest", "issue")


@query("e06_latest_engineering", cte("attempts") + ENGINEERING_SQL + " select attempt, ecid, is_first, is_latest, issue from flagged")
def _(spark, sf):
    return engineering_attempts(spark, sf).select("attempt", "ecid", "is_first", "is_latest", "issue")


@query(
    "e07_population_counts",
    cte("attempts") + ENGINEERING_SQL + """ select count(*) filter (is_latest) as latest, count(*) filter (not is_latest) as earlier,
count(*) filter (is_latest is null) as unresolved_latest, count(*) filter (is_first) as first,
count(*) filter (coalesce(not is_first, true)) as not_first from flagged""",
)
def _(spark, sf):
    return identity.population_counts(engineering_attempts(spark, sf))


def _retest_sql(where: str, wanted: str) -> str:
    return f"""{cte('attempts')}{LATEST_SQL},
kept as (select *, {VERDICT_SQL} as verdict from flagged where {where}),
ranked as (select *, row_number() over (partition by source_id, ecid order by attempt) as up,
   row_number() over (partition by source_id, ecid order by attempt desc) as down from kept where ecid is not null),
devices as (select source_id, ecid, count(*) as n, max(verdict) filter (up=1) as first, max(verdict) filter (down=1) as last,
   count(*) filter (verdict='pass')>0 and count(*) filter (verdict='fail')>0 as changed, {wanted} as wanted
   from ranked group by 1,2),
d as (select * from devices where wanted),
t as (select count(*) as devices, count(*) filter (n>1) as retested_devices, coalesce(sum(n-1),0)::bigint as extra_attempts,
   count(*) filter (changed) as ever_verdict_changed,
   count(*) filter (first='pass') as first_pass, count(*) filter (first='fail') as first_fail,
   count(*) filter (first='unknown') as first_unknown, count(*) filter (last='pass') as latest_pass,
   count(*) filter (last='fail') as latest_fail, count(*) filter (last='unknown') as latest_unknown,
   count(*) filter (first='fail' and last='pass') as recovered,
   count(*) filter (first='pass' and last='fail') as degraded from d)
select t.*, (select count(*) from kept where ecid is null) as unresolved_identity_attempts,
   round(first_pass::double/nullif(first_pass+first_fail,0),6) as first_yield_known,
   round(latest_pass::double/nullif(latest_pass+latest_fail,0),6) as latest_yield_known,
   round(retested_devices::double/nullif(devices,0),6) as retest_device_rate,
   round(recovered::double/nullif(first_fail,0),6) as recovery_rate_known,
   round(degraded::double/nullif(first_pass,0),6) as degradation_rate_known from t"""


@query("f05_retest_impact", _retest_sql("not (hard_bin=1 and attempt % 3=0)", "true"))
def _(spark, sf):
    rows = flagged_attempts(spark, sf)
    out = rows.filter((F.col("hard_bin") == 1) & (F.col("attempt") % 3 == 0)).select("source_id", "attempt")
    return yields.retest_impact(yields.requested(rows, excluded=out))


@query("f05_retest_impact_latest", _retest_sql("lot in ('BUILDING','AUTOMOBILE')", "coalesce(bool_or(is_latest),false)"))
def _(spark, sf):
    rows = yields.requested(flagged_attempts(spark, sf), scope=scope.Scope(lots=("BUILDING", "AUTOMOBILE")))
    return yields.retest_impact(rows, population="latest")


@query(
    "f06_coverage",
    """with snap as (select concat('doc',doc_id) as source_id, sha256(text) as content_sha256 from documents),
sel as (select concat('doc',doc_id) as source_id, sha256(text) as content_sha256 from documents where lang='en'),
al as (select content_sha256, count(*) as n from sel group by 1)
select (select count(*) from snap) as snapshot_sources, (select count(*) from sel) as selected_sources,
 (select count(*) from snap where source_id not in (select source_id from sel)) as missing_sources,
 (select count(*) from al where n>1) as content_alias_sources,
 (select count(*) from snap where source_id not in (select source_id from sel))>0 as partial""",
)
def _(spark, sf):
    documents = adapters.table(spark, sf, "documents")
    sources = documents.select(
        F.concat(F.lit("doc"), "doc_id").alias("source_id"), F.sha2("text", 256).alias("content_sha256"), "lang"
    )
    return yields.coverage(sources.drop("lang"), sources.filter("lang = 'en'").drop("lang"))
