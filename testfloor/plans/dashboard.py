"""Registered queries: dashboard results and test identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.functions import keys, verdicts
from testfloor.operators import dashboard, identity, scope
from testfloor.plans import adapters
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query

_ROWS = cte("dashboard_rows")
_ONE = ", scoped as (select *, '(all)' as scope from dashboard_rows)"
_LOTS = """, scoped as (select *, '(all)' as scope from dashboard_rows
 union all select *, 'lot '||lot as scope from dashboard_rows)"""

_SUMMARY = """, ts as (select scope, test_num, test_type, case when test_type='MPR' then test_txt end as channel_txt,
  test_num||' - '||min(test_txt) as label, count(*) as total, count(*) filter (test_pass) as pass,
  count(*) filter (not test_pass) as fail, count(*) filter (test_pass is null) as unknown,
  count(*) filter (result<lo_limit or result>hi_limit) as limit_fail,
  avg(result) as mean, stddev_samp(result) as sigma, min(result) as min, max(result) as max,
  arg_min(lo_limit, record_seq) as lo_limit, arg_min(hi_limit, record_seq) as hi_limit,
  arg_min(units, record_seq) as units from scoped group by 1,2,3,4),
summary as (select *, case when pass+fail>0 then pass*1e2/(pass+fail) else 0e0 end as yield_percent from ts),
pareto as (select *, row_number() over (partition by scope order by fail desc, limit_fail desc, total desc, label, test_num, test_type) as position from summary)"""

_DEVICES = """, devices as (select scope, device, bool_and(part_pass) as part_pass,
  arg_min({'w': wafer, 'h': head, 's': site, 'hb': hard_bin, 'sb': soft_bin}, record_seq) as f from scoped group by 1,2)"""

_ROUNDED = ["mean", "sigma", "min", "max", "lo_limit", "hi_limit", "yield_percent"]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names if n in df.columns})


_SUMMARY_COLUMNS = """scope, test_num, test_type, label, total, pass, fail, unknown, limit_fail, round(mean,6) as mean,
 round(sigma,6) as sigma, round(min,6) as min, round(max,6) as max, round(lo_limit,6) as lo_limit,
 round(hi_limit,6) as hi_limit, units, round(yield_percent,6) as yield_percent"""


def _one(spark, sf):
    return dashboard.all_rows(adapters.dashboard_rows(spark, sf))


def _lots(spark, sf):
    return dashboard.all_and_per_lot(adapters.dashboard_rows(spark, sf))


def _count(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()]).groupBy(*columns).agg(F.count("*").alias("n"))


@query("c03_reliable_verdict", cte("measurements") + """ select test_type, test_flg,
 case when test_flg & 126 = 0 then test_flg & 128 = 0 end as verdict, count(*) as n from measurements group by all""")
def _(spark, sf):
    return _count(
        adapters.measurements(spark, sf), test_type=F.col("test_type"), test_flg=F.col("test_flg"),
        verdict=verdicts.reliable_test_pass(F.col("test_flg")),
    )


@query("c04_parametric_verdict", cte("measurements") + """ select test_flg,
 case when test_flg & 64 = 0 then test_flg & 128 = 0 end as verdict, count(*) as n from measurements
 where test_type='PTR' group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf).filter("test_type = 'PTR'")
    return _count(rows, test_flg=F.col("test_flg"), verdict=verdicts.parametric_test_pass(F.col("test_flg")))


@query("c05_functional_class", cte("measurements") + """ select pattern, case when test_flg & 16 <> 0 then 'not_executed'
 when test_flg & 110 <> 0 then 'unknown' when test_flg & 128 <> 0 then 'fail' else 'pass' end as class,
 test_flg & 1 <> 0 as alarm, count(*) as n from measurements where test_type='FTR' group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf).filter("test_type = 'FTR'")
    flags = F.col("test_flg")
    return _count(
        rows, pattern=F.col("pattern"), **{"class": verdicts.functional_class(flags)},
        alarm=verdicts.has_bits(flags, verdicts.FTR_ALARM),
    )


@query("c06_valid_bin", """select case when l_partkey*37 % 65536 <= 32767 then l_partkey*37 % 65536 end as bin,
 count(*) as n from lineitem group by all""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "lineitem")
    return _count(rows, bin=verdicts.valid_bin(F.col("l_partkey") * 37 % 65536))


_RAW_ID = "case doc_id % 5 when 0 then '  ' when 1 then 'LOT'||chr(7)||doc_id when 2 then 'W'||chr(65533) else source||doc_id%50 end"


@query("c07_clean_id", f"""with r as (select {_RAW_ID} as raw from documents)
 select case when trim(raw)<>'' and strpos(raw,chr(7))=0 and strpos(raw,chr(65533))=0 then raw end as id, count(*) as n from r group by all""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "documents")
    branch = F.col("doc_id") % 5
    raw = (
        F.when(branch == 0, "  ").when(branch == 1, F.concat(F.lit("LOT\x07"), "doc_id"))
        .when(branch == 2, "W�").otherwise(F.concat("source", (F.col("doc_id") % 50).cast("string")))
    )
    return _count(rows, id=keys.clean_id(raw))


@query("c08_row_failure", _ROWS + " select test_num, failed, count(*) as n from dashboard_rows group by all")
def _(spark, sf):
    rows = adapters.measurements(spark, sf)
    failed = verdicts.row_failure(F.col("test_pass"), F.col("result"), F.col("lo_limit"), F.col("hi_limit"))
    return _count(rows, test_num=F.col("test_num"), failed=failed)


@query("c09_limit_failure", cte("measurements") + """ select test_num,
 coalesce(result<lo_limit or result>hi_limit, false) as failed, count(*) as n from measurements group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf)
    failed = verdicts.limit_failure(F.col("result"), F.col("lo_limit"), F.col("hi_limit"))
    return _count(rows, test_num=F.col("test_num"), failed=failed)


@query("c10_percent", cte("measurements") + """ select pattern, units, round(case when count(test_pass)>0
 then count(*) filter (test_pass)*1e2/count(test_pass) else 0e0 end, 6) as yield_percent from measurements group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf).groupBy("pattern", "units").agg(
        F.count_if("test_pass").alias("p"), F.count("test_pass").alias("t")
    )
    return rows.select("pattern", "units", F.round(verdicts.percent(F.col("p"), F.col("t")), 6).alias("yield_percent"))


@query("c11_exact_ratio", cte("measurements") + """ select attempt, count(*) filter (test_pass) as numerator,
 count(test_pass) as denominator, round(count(*) filter (test_pass)::double/nullif(count(test_pass),0),6) as ratio,
 case when count(test_pass)=0 then 'zero-known' end as null_reason from measurements group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf).groupBy("attempt").agg(
        F.count_if("test_pass").alias("numerator"), F.count("test_pass").alias("denominator")
    )
    return rows.select(
        "*", F.round(verdicts.ratio(F.col("numerator"), F.col("denominator")), 6).alias("ratio"),
        verdicts.null_reason(F.col("denominator"), "zero-known").alias("null_reason"),
    )


@query("c12_test_keys", cte("measurements") + """ select
 '['||test_num||',"'||test_type||'",'||case when test_type='MPR' then '"'||test_txt||'"' else 'null' end||']' as dashboard_key,
 '["'||test_type||'",'||test_num||',"'||test_txt||'",null]' as engineering_key,
 '["'||test_type||'",'||test_num||',"'||test_txt||'"]' as mode_key, count(*) as n from measurements group by all""")
def _(spark, sf):
    number, kind, text = F.col("test_num"), F.col("test_type"), F.col("test_txt")
    return _count(
        adapters.measurements(spark, sf), dashboard_key=keys.test_key(number, kind, text),
        engineering_key=keys.engineering_test_key(kind, number, text, F.lit(None)),
        mode_key=keys.mode_key(kind, number, text),
    )


@query("c13_labels", _ROWS + """ select test_num||' - '||test_txt as test, 'H'||head||' / S'||site as site,
 'HBIN '||hard_bin as hard_bin, 'SBIN '||soft_bin as soft_bin, coalesce(wafer,'(no wafer)') as wafer, count(*) as n
 from dashboard_rows group by all""")
def _(spark, sf):
    return _count(
        adapters.test_rows(spark, sf), test=keys.test_label(F.col("test_num"), F.col("test_txt")),
        site=keys.site_label(F.col("head"), F.col("site")), hard_bin=keys.hard_bin_label(F.col("hard_bin")),
        soft_bin=keys.soft_bin_label(F.col("soft_bin")), wafer=keys.wafer_label(F.col("wafer")),
    )


@query("c14_wafer_key", _ROWS + " select merge_key, count(*) as n from dashboard_rows where merge_key is not null group by all")
def _(spark, sf):
    rows = adapters.dashboard_rows(spark, sf).filter(F.col("part_merge_key").isNotNull())
    return _count(rows, merge_key=F.col("part_merge_key"))


@query("c15_positive_integer", """select test, case when v>0 and v=floor(v) then v::bigint end as value, count(*) as n
 from (select l_linenumber as test, (l_quantity-5)/2 as v from lineitem) group by all""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "lineitem")
    return _count(rows, test=F.col("l_linenumber"), value=keys.positive_integer((F.col("l_quantity") - 5) / 2))


# Test names of a product whose parametric tests carry the die position.
_NAMES_SQL = """case l_linenumber when 1 then 'dieX' when 2 then 'DIE_Y_POS' when 3 then 'pos x' when 4 then 'positionY'
 when 5 then 'MAX_V' when 6 then 'xy' else 'Vdd' end"""
_AXIS_SQL = """case l_linenumber when 1 then 'x' when 2 then 'y' when 3 then 'x' when 4 then 'y' when 5 then 'x' end"""
_RANK_SQL = """case l_linenumber when 1 then 2 when 2 then 2 when 3 then 2 when 4 then 2 when 5 then 1 end"""


def _named_tests(spark, sf):
    adapters.tables(spark, sf, "lineitem")
    return spark.sql(
        f"select l_orderkey+1 as attempt, 'PTR' as test_type, {_NAMES_SQL} as test_txt, l_quantity as result from lineitem"
    )


@query("c16_coordinate_axis", f"select {_NAMES_SQL} as name, {_AXIS_SQL} as axis, {_RANK_SQL} as rank, count(*) as n from lineitem group by all")
def _(spark, sf):
    rows = _named_tests(spark, sf).withColumn("c", keys.coordinate_axis(F.col("test_txt")))
    return _count(rows, name=F.col("test_txt"), axis=F.col("c.axis"), rank=F.col("c.rank"))


_CANDIDATES_SQL = f""" t as (select l_orderkey+1 as attempt, {_AXIS_SQL} as axis, {_RANK_SQL} as rk,
  case when l_quantity>0 and l_quantity=floor(l_quantity) then l_quantity::bigint end as v from lineitem),
c as (select *, max(rk) over (partition by attempt, axis) as top from t where axis is not null),
r as (select attempt, axis, case when min(v)=max(v) and count(v)=count(*) then min(v) end as v from c where rk=top group by 1,2),
xy as (select attempt, max(v) filter (axis='x') as test_x, max(v) filter (axis='y') as test_y from r group by 1)"""


@query("e02_coordinate_candidates", "with" + _CANDIDATES_SQL + " select * from xy")
def _(spark, sf):
    return identity.coordinate_candidates(_named_tests(spark, sf), ["attempt"])


@query("e01_merge_key", cte("attempts") + "," + _CANDIDATES_SQL + """
select attempt, case when wafer ~ '^[A-Z0-9]+$' and x>0 and y>0 then '["wafer-prr","'||wafer||'",'||x||','||y||']'
 when test_x is not null and test_y is not null then '["lot-ptr","'||lot||'",'||test_x||','||test_y||']' end as merge_key
from attempts left join xy using (attempt)""")
def _(spark, sf):
    found = identity.coordinate_candidates(_named_tests(spark, sf), ["attempt"])
    joined = adapters.attempts(spark, sf).join(found, "attempt", "left")
    key = keys.merge_key(*[F.col(c) for c in ("wafer", "x", "y", "lot", "test_x", "test_y")])
    return joined.select("attempt", key.alias("merge_key"))


@query("e03_device_key", _ROWS + " select device, count(*) as rows from dashboard_rows group by all")
def _(spark, sf):
    return adapters.dashboard_rows(spark, sf).groupBy("device").agg(F.count("*").alias("rows"))


_KPI_SQL = _SUMMARY + _DEVICES + """,
 p as (select scope, count(*) as parts, count(*) filter (part_pass) as passed_parts, count(distinct (f.h, f.s)) as sites from devices group by 1),
 t as (select scope, count(*) as tests, count(*) filter (fail>0) as failing_tests from summary group by 1),
 r as (select scope, count(*) as rows, count(distinct lot) as lots, count(distinct wafer) as wafers from scoped group by 1)
select scope, rows, parts, passed_parts, parts-passed_parts as failed_parts, round(passed_parts*1e2/parts,6) as yield_percent,
 tests, lots, wafers, sites, failing_tests from r join p using (scope) join t using (scope)"""


@query("f07_kpis", _ROWS + _ONE + _KPI_SQL)
def _(spark, sf):
    return _rounded(dashboard.kpis(_one(spark, sf)), "yield_percent")


@query("f15_kpis_per_lot", _ROWS + _LOTS + _KPI_SQL)
def _(spark, sf):
    return _rounded(dashboard.kpis(_lots(spark, sf)), "yield_percent")


def _pareto(rows: DataFrame, limit: int) -> DataFrame:
    top = dashboard.failure_pareto(dashboard.test_summary(rows), limit).drop("channel_txt")
    return _rounded(top, *_ROUNDED)


@query("f08_failure_pareto", _ROWS + _ONE + _SUMMARY + f" select {_SUMMARY_COLUMNS}, position from pareto where position<=20")
def _(spark, sf):
    return _pareto(_one(spark, sf), 20)


@query("f15_failure_pareto_per_lot", _ROWS + _LOTS + _SUMMARY + f" select {_SUMMARY_COLUMNS}, position from pareto where position<=4")
def _(spark, sf):
    return _pareto(_lots(spark, sf), 4)


_PART_YIELD_SQL = _DEVICES + """, labelled as (
 select scope, 'wafer' as dimension, coalesce(f.w,'(no wafer)') as label, part_pass from devices
 union all select scope, 'site', 'H'||f.h||' / S'||f.s, part_pass from devices
 union all select scope, 'hard_bin', 'HBIN '||f.hb, part_pass from devices
 union all select scope, 'soft_bin', 'SBIN '||f.sb, part_pass from devices)
select scope, dimension, label, count(*) as total, count(*) filter (part_pass) as pass, count(*) filter (not part_pass) as fail,
 round(count(*) filter (part_pass)*1e2/count(*),6) as yield_percent from labelled group by 1,2,3"""


@query("f09_part_yield", _ROWS + _ONE + _PART_YIELD_SQL)
def _(spark, sf):
    return _rounded(dashboard.part_yield(_one(spark, sf)), "yield_percent")


@query("f15_part_yield_per_lot", _ROWS + _LOTS + _PART_YIELD_SQL)
def _(spark, sf):
    return _rounded(dashboard.part_yield(_lots(spark, sf)), "yield_percent")


_CORR_SQL = _SUMMARY + """, chosen as (select *, row_number() over (partition by scope order by fail desc, limit_fail desc, total desc, label) as p
   from summary where sigma>0),
 first_value as (select s.scope, s.device, c.p, c.label, arg_min(s.result, s.record_seq) as v
   from scoped s join chosen c on s.scope=c.scope and s.test_num=c.test_num and s.test_type=c.test_type and c.p<=16
   where s.result is not null group by 1,2,3,4),
 pairs as (select a.scope, a.p as l, b.p as r, a.label as x_test, b.label as y_test, count(*) as pairs, corr(a.v,b.v) as c
   from first_value a join first_value b on a.scope=b.scope and a.device=b.device and a.p<b.p group by 1,2,3,4,5),
 o as (select *, round(c,6) as correlation from pairs where pairs>=3 and c is not null and not isnan(c)),
 ranked as (select *, row_number() over (partition by scope order by abs(correlation) desc, pairs desc, l, r) as position from o)
select scope, x_test, y_test, correlation, pairs, position from ranked where position<=60"""


def _correlations(rows: DataFrame) -> DataFrame:
    return dashboard.correlations(rows, dashboard.test_summary(rows))


@query("f10_correlations", _ROWS + _ONE + _CORR_SQL)
def _(spark, sf):
    return _correlations(_one(spark, sf))


@query("f15_correlations_per_lot", _ROWS + _LOTS + _CORR_SQL)
def _(spark, sf):
    return _correlations(_lots(spark, sf))


_COMMON_SQL = """, bad as (select *, test_num||' - '||test_txt as test from scoped where failed), d as (
 select scope, 'test' as dimension, test as label from bad union all select scope, 'wafer', coalesce(wafer,'(no wafer)') from bad
 union all select scope, 'site', 'H'||head||' / S'||site from bad union all select scope, 'hard_bin', 'HBIN '||hard_bin from bad
 union all select scope, 'soft_bin', 'SBIN '||soft_bin from bad
 union all select scope, 'test_site', test||' @ H'||head||' / S'||site from bad
 union all select scope, 'test_hard_bin', test||' @ HBIN '||hard_bin from bad),
 g as (select scope, dimension, label, count(*) as count from d group by 1,2,3),
 ranked as (select *, row_number() over (partition by scope order by count desc, dimension, label) as position from g)
select * from ranked where position<=25"""


@query("f11_commonality", _ROWS + _ONE + _COMMON_SQL)
def _(spark, sf):
    return dashboard.commonality(_one(spark, sf), 25)


@query("f15_commonality_per_lot", _ROWS + _LOTS + _COMMON_SQL)
def _(spark, sf):
    return dashboard.commonality(_lots(spark, sf), 25)


_HEAT_SQL = """ select scope, x, y, count(*) as total, count(*) filter (failed) as fail,
 round((count(*)-count(*) filter (failed))*1e2/count(*),6) as yield_percent from scoped
 where x is not null and y is not null group by 1,2,3"""


@query("f12_heatmap", _ROWS + _ONE + _HEAT_SQL)
def _(spark, sf):
    return _rounded(dashboard.heatmap(_one(spark, sf)), "yield_percent")


@query("f15_heatmap_per_lot", _ROWS + _LOTS + _HEAT_SQL)
def _(spark, sf):
    return _rounded(dashboard.heatmap(_lots(spark, sf)), "yield_percent")


_CP_SQL = _SUMMARY + """, c as (select *, case when sigma>0 and lo_limit is not null and hi_limit is not null
   then least(hi_limit-mean, mean-lo_limit)/(3e0*sigma) end as cp from summary where sigma is not null),
 ranked as (select *, row_number() over (partition by scope order by limit_fail desc, cp asc nulls last, label) as position from c)
select scope, label, round(mean,6) as mean, round(sigma,6) as sigma, round(min,6) as min, round(max,6) as max, lo_limit, hi_limit,
 limit_fail, round(cp,6) as cp, position from ranked where position<=20"""


def _capability(rows: DataFrame) -> DataFrame:
    windows = dashboard.process_windows(dashboard.test_summary(rows), 20)
    kept = ["scope", "label", "mean", "sigma", "min", "max", "lo_limit", "hi_limit", "limit_fail", "cp", "position"]
    return _rounded(windows.select(*kept), "mean", "sigma", "min", "max", "cp")


@query("f13_process_capability", _ROWS + _ONE + _CP_SQL)
def _(spark, sf):
    return _capability(_one(spark, sf))


@query("f15_process_capability_per_lot", _ROWS + _LOTS + _CP_SQL)
def _(spark, sf):
    return _capability(_lots(spark, sf))


_QUALITY_SQL = """, c as (select scope, count(*) as total, count(*) filter (wafer is null) as q1, count(*) filter (part_id='') as q2,
  count(*) filter (x is null or y is null) as q3, count(*) filter (test_pass is null) as q4, count(*) filter (result is null) as q5,
  count(*) filter (lo_limit is null or hi_limit is null) as q6, count(*) filter (duration_ms is null) as q7,
  count(*) filter (merge_key is null) as q8 from scoped group by 1),
 l as (select scope, total, 'missing wafer_id' as label, q1 as fail from c union all select scope, total, 'missing part_id', q2 from c
  union all select scope, total, 'missing x/y coordinate', q3 from c union all select scope, total, 'missing test_pass', q4 from c
  union all select scope, total, 'missing result', q5 from c union all select scope, total, 'missing limits', q6 from c
  union all select scope, total, 'missing test_time_ms', q7 from c
  union all select scope, total, 'unresolved coordinate identity', q8 from c)
select scope, label, total, total-fail as pass, fail, round((total-fail)*1e2/total,6) as yield_percent from l"""


@query("f14_quality_scorecard", _ROWS + _ONE + _QUALITY_SQL)
def _(spark, sf):
    return _rounded(dashboard.quality_scorecard(_one(spark, sf)), "yield_percent")


@query("f15_quality_per_lot", _ROWS + _LOTS + _QUALITY_SQL)
def _(spark, sf):
    return _rounded(dashboard.quality_scorecard(_lots(spark, sf)), "yield_percent")


@query("d11_label_and_failures", _ROWS + _LOTS + _PART_YIELD_SQL.replace("select scope, dimension, label, count(*) as total", ", g as (select scope, dimension, label, count(*) as total") + """)
select * from g where scope='lot BUILDING' and contains(lower(label),'w1') and fail>=20""")
def _(spark, sf):
    rows = dashboard.all_and_per_lot(adapters.dashboard_rows(spark, sf)).filter("scope = 'lot BUILDING'")
    found = scope.label_and_failures(dashboard.part_yield(rows), "label", "W1", 20)
    return _rounded(found, "yield_percent")
