"""Registered queries: engineering rows, distributions, tables and Paretos
(B12-B13, C18, C20, D04-D08, E11, F16-F33)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from testfloor.functions import filters, verdicts
from testfloor.operators import distribution, executions, identity, paging, pareto, scope
from testfloor.plans import adapters
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query
from testfloor.plans.yields import ENGINEERING_SQL, LATEST_SQL, flagged_attempts
from testfloor.session import materialize

# Engineering rows: value, state, verdict, flags of the device, last execution.
_ENG = cte("measurements", "attempts") + ENGINEERING_SQL + """,
eng0 as (select attempt, record_seq, test_type as kind, test_num as number, test_txt as name,
  case when test_type='MPR' then 0 end as channel, pattern, units, lo_limit as low, hi_limit as high, test_flg,
  '["'||test_type||'",'||test_num||',"'||test_txt||'",'||case when test_type='MPR' then '0' else 'null' end||']' as test,
  case when test_type<>'FTR' and test_flg & 63 = 0 then result end as value,
  case when result is not null and test_flg & 63 = 0 then 'valid' when test_type='FTR' then 'not_numeric'
       when test_flg & 63 <> 0 then 'invalid' when result is null then 'missing' else 'unknown' end as value_state,
  case when test_type<>'MPR' and test_flg & 126 = 0 then test_flg & 128 = 0 end as passed,
  test_flg & 1 <> 0 as alarm,
  row_number() over (partition by l.attempt, test_num, test_type, pattern order by record_seq desc)=1 as last_execution
  from measurements l),
eng as (select e.*, f.* exclude (attempt, start_t, finish_t, ecid, issue, flags) from eng0 e join flagged f on e.attempt=f.attempt),
ana as (select * from eng where is_latest and last_execution)"""

_KEY = ["attempt", "test", "pattern"]


def _analysis(spark, sf, *columns: str) -> DataFrame:
    """Latest devices, last execution of each test, with the columns the analysis needs."""
    rows = adapters.engineering_rows(spark, sf)
    chosen = scope.Selection()
    kept = scope.in_population(scope.in_selection(rows, chosen), chosen.population)
    return executions.last_executions(kept, _KEY, columns=list(columns))


_MODE = ("kind", "number", "name", "channel", "passed", "head", "site", "lot")
_STATS = ("head", "site", "units", "value", "value_state", "low", "high")
_POINT = ("head", "site", "units", "value")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("b12_value_state", _ENG + " select kind, test_flg, value_state, count(*) as n, count(value) as numeric from eng0 group by all")
def _(spark, sf):
    rows = adapters.engineering_rows(spark, sf)
    return rows.groupBy("kind", "test_flg", "value_state").agg(F.count("*").alias("n"), F.count("value").alias("numeric"))


@query("b13_last_execution", _ENG + """ select attempt, test, coalesce(pattern,'') as pattern, count(*) as executions,
 count(*) filter (last_execution) as last_rows, round(max(value) filter (last_execution),6) as value from eng group by 1,2,3""")
def _(spark, sf):
    rows = executions.mark_last_execution(adapters.engineering_rows(spark, sf), _KEY)
    return rows.groupBy("attempt", "test", F.coalesce("pattern", F.lit("")).alias("pattern")).agg(
        F.count("*").alias("executions"), F.count_if("last_execution").alias("last_rows"),
        F.round(F.max(F.when(F.col("last_execution"), F.col("value"))), 6).alias("value"),
    )


_FILTERS = [
    ("duration_ms", ">= 250000"), ("x", "!=7"), ("wafer", "=[null]"), ("lot", "machin"), ("hard_bin", "<3"),
    ("wafer", "!=W2"), ("lot", ">A"), ("x", "[null]"),
]
_FILTER_SQL = [
    "duration_ms>=250000", "coalesce(x<>7, true)", "wafer is null", "lower(lot) like '%machin%'", "hard_bin<3",
    "coalesce(wafer,'[null]')<>'W2'", "false", "x is null",
]


@query("c18_filter_expressions", cte("attempts") + " ".join(
    f"{'union all' if i else ''} select {i} as filter, count(*) as n from attempts where {sql}" for i, sql in enumerate(_FILTER_SQL)))
def _(spark, sf):
    rows = adapters.attempts(spark, sf)
    counts = rows.agg(
        *[F.count_if(filters.expression(rows, name, text)).alias(str(i)) for i, (name, text) in enumerate(_FILTERS)]
    )
    return counts.unpivot([], [str(i) for i in range(len(_FILTERS))], "filter", "n").withColumn(
        "filter", F.col("filter").cast("int")
    )


@query("c20_alarm", cte("measurements") + """ select test_num, (test_flg & 1 <> 0) or (units='V' and attempt % 50=0) as alarm,
 count(*) as n from measurements group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf)
    alarm_id = F.when((F.col("units") == "V") & (F.col("attempt") % 50 == 0), "VDD")
    return rows.groupBy("test_num", verdicts.alarm(F.col("test_flg"), alarm_id).alias("alarm")).agg(F.count("*").alias("n"))


@query("d04_engineering_scope", _ENG + """ select test, count(*) as n from eng where run between 23941 and 23960 and wafer='W3'
 and site in (1,2) and number in (1,6) and hard_bin in (1,2) and soft_bin in (10,20,30) and run=23953 group by 1""")
def _(spark, sf):
    chosen = scope.Selection(run=23953, wafer="W3", sites=(1, 2), tests=(1, 6), hard_bins=(1, 2), soft_bins=(10, 20, 30))
    rows = scope.in_selection(adapters.engineering_rows(spark, sf), chosen)
    return rows.groupBy("test").agg(F.count("*").alias("n"))


_EXCLUDED = tuple(range(1, 4000, 7))


@query("d05_analysis_rows", _ENG + """ select 'analysis' as view, test, count(*) as n from ana
 where not (attempt % 7=1 and attempt<4000) group by 2
 union all select 'display', test, count(*) from eng where is_latest group by 2
 union all select 'devices', lot, count(*) from flagged group by 2""")
def _(spark, sf):
    chosen = scope.Selection(excluded_devices=_EXCLUDED)
    rows = executions.mark_last_execution(adapters.engineering_rows(spark, sf), _KEY)
    count = lambda df, view, name: df.groupBy(F.col(name).alias("test")).agg(F.count("*").alias("n")).select(
        F.lit(view).alias("view"), "test", "n"
    )
    return (
        count(scope.analysis_rows(rows, chosen, True), "analysis", "test")
        .unionByName(count(scope.display_rows(rows, chosen, True), "display", "test"))
        .unionByName(count(scope.display_rows(adapters.engineering_devices(spark, sf), chosen, False), "devices", "lot"))
    )


@query("d05_excluded_measurements", _ENG + """ select number, count(*) filter (not out) as analysed, count(*) filter (out) as left_out
 from (select *, (attempt % 7=1 and attempt<4000) or (attempt % 11=3 and number % 2=1) as out from ana) group by 1""")
def _(spark, sf):
    """Single measurements and whole devices left out, both as tables."""
    rows = executions.mark_last_execution(adapters.engineering_rows(spark, sf), _KEY).filter("last_execution")
    # Read four times: for both lists of what is left out, and counted with and without it.
    rows = materialize(rows.select("attempt", "test", "number", "is_latest", "is_first", "last_execution"), "last-executions")
    tests = rows.filter("attempt % 11 = 3 and number % 2 = 1").select("attempt", "test")
    devices = rows.filter("attempt % 7 = 1 and attempt < 4000").select("attempt")
    chosen = scope.Selection(excluded_devices=devices, excluded_measurements=tests)
    left = scope.analysis_rows(rows, chosen, True).groupBy("number").agg(F.count("*").alias("analysed"))
    total = scope.analysis_rows(rows, scope.Selection(), True).groupBy("number").agg(F.count("*").alias("total"))
    joined = total.join(left, "number", "left").withColumn("analysed", F.coalesce("analysed", F.lit(0)))
    return joined.select("number", "analysed", (F.col("total") - F.col("analysed")).alias("left_out"))


@query("d06_display_filters", cte("attempts") + """ select attempt, lot, wafer, x, y from attempts
 where duration_ms>=100000 and (wafer in ('W3','W4') or wafer is null) and lower(lot) like '%auto%'""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).select("attempt", "lot", "wafer", "x", "y", "duration_ms")
    found = filters.display(rows, {"duration_ms": ">=100000"}, {"wafer": ["W3", "W4", None]}, "AUTO")
    return found.drop("duration_ms")


@query("d07_inclusion_counts", cte("attempts") + ENGINEERING_SQL + """ select
 count(*) filter (not (attempt % 7=1 and attempt<4000)) as included, count(*) filter (attempt % 7=1 and attempt<4000) as excluded
 from flagged where is_latest""")
def _(spark, sf):
    return scope.inclusion_counts(adapters.engineering_devices(spark, sf), scope.Selection(excluded_devices=_EXCLUDED))


@query("d08_record_enrichment", cte("measurements", "attempts") + ENGINEERING_SQL + """ select test_type, lot, site, is_latest,
 count(*) as n from measurements left join flagged using (attempt) group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf).select("attempt", "test_type")
    enriched = scope.enrich_records(rows, adapters.engineering_devices(spark, sf))
    return enriched.groupBy("test_type", "lot", "site", "is_latest").agg(F.count("*").alias("n"))


# Bin names defined for all sites of a run, and for odd bins again for site 0.
_BIN_DEFS = """defs as (select distinct run, hard_bin as bin, 255 as def_head, 255 as def_site, 'BIN '||hard_bin as name from attempts
 union select distinct run, hard_bin, 1, 0, 'BIN '||hard_bin||' of site 0' from attempts where hard_bin % 2=1
 union select distinct run, hard_bin, 255, 1, 'BIN '||hard_bin||' of run '||run from attempts where run % 5=0)"""


@query("e11_bin_names", cte("attempts") + "," + _BIN_DEFS + """, c as (select a.attempt, d.name, rank() over (partition by a.attempt
  order by case when def_head=255 then 0 else 2 end + case when def_site=255 then 0 else 1 end desc) as r
 from attempts a join defs d on a.run=d.run and a.hard_bin=d.bin and def_head in (255, head) and def_site in (255, site))
select attempt, string_agg(name, ' / ' order by name) as bin_name from c where r=1 group by 1""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf)
    bins = rows.select("run", F.col("hard_bin").alias("bin")).distinct()
    text = F.concat(F.lit("BIN "), F.col("bin").cast("string"))
    define = lambda df, head, site, name: df.select(
        "run", "bin", F.lit(head).alias("def_head"), F.lit(site).cast("bigint").alias("def_site"), name.alias("name")
    )
    definitions = (
        define(bins, 255, 255, text)
        .unionByName(define(bins.filter("bin % 2 = 1"), 1, 0, F.concat(text, F.lit(" of site 0"))))
        .unionByName(define(bins.filter("run % 5 = 0"), 255, 1, F.concat(text, F.lit(" of run "), F.col("run").cast("string"))))
    )
    return identity.bin_names(rows, definitions, "hard_bin").select("attempt", "bin_name")


# --- pattern and device Paretos -------------------------------------------------

_FTR_SQL = cte("test_rows") + """, ftr as (select *, 'prog'||run % 3 as program, 'r'||run % 2 as revision, attempt*8+test_num as record,
 case when test_flg & 16 <> 0 then 'not_executed' when test_flg & 110 <> 0 then 'unknown'
   when test_flg & 128 <> 0 then 'fail' else 'pass' end as class from test_rows where test_type='FTR'),
groups as (select source_id, pattern, run, lot, program, revision, head, site, test_num, count(*) as attempts,
 count(*) filter (class='pass') as pass, count(*) filter (class='fail') as fail, count(*) filter (class='unknown') as unknown,
 count(*) filter (class='not_executed') as not_executed, count(*) filter (test_flg & 1 <> 0) as alarms,
 min(record) as first_record, max(record) as last_record from ftr group by 1,2,3,4,5,6,7,8,9)"""


def _pattern_groups(spark, sf) -> DataFrame:
    rows = adapters.test_rows(spark, sf).filter("test_type = 'FTR'")
    rows = rows.withColumn("program", F.concat(F.lit("prog"), (F.col("run") % 3).cast("string")))
    return pareto.pattern_groups(rows.withColumn("revision", F.concat(F.lit("r"), (F.col("run") % 2).cast("string"))))


@query("f16_pattern_groups", _FTR_SQL + " select * from groups")
def _(spark, sf):
    return _pattern_groups(spark, sf)


@query("f17_pattern_pareto", _FTR_SQL + """, p as (select pattern, sum(attempts)::bigint as attempts, sum(pass)::bigint as pass, sum(fail)::bigint as fail,
  sum(unknown)::bigint as unknown, sum(not_executed)::bigint as not_executed, sum(alarms)::bigint as alarms from groups where lot<>'BUILDING' group by 1)
select *, round(pass*1e2/nullif(pass+fail,0),6) as yield_percent, round(fail*1e2/nullif(pass+fail,0),6) as failure_rate,
 round(fail*1e2/sum(fail) over (),6) as share,
 round(sum(fail) over (order by fail desc, coalesce(pattern,'[null]') rows unbounded preceding)*1e2/sum(fail) over (),6) as cumulative from p""")
def _(spark, sf):
    groups = _pattern_groups(spark, sf).filter("lot <> 'BUILDING'")
    return _rounded(pareto.pattern_pareto(groups), "yield_percent", "failure_rate", "share", "cumulative")


_MODES_SQL = """, ex as (select attempt, test_type, test_num, test_txt, pattern,
  case when test_flg & 126 = 0 then test_flg & 128 = 0 end as passed,
  row_number() over (partition by attempt, test_type, test_num, test_txt, pattern order by record_seq desc) as rn from measurements),
 tests as (select attempt, '["'||test_type||'",'||test_num||',"'||test_txt||'"]' as mode, test_type||' '||test_num||' '||test_txt as label,
  case when count(*) filter (passed=false)>0 then false when count(passed)=count(*) then true end as passed from ex where rn=1 group by 1,2,3),
 patterns as (select attempt, '"'||pattern||'"' as mode, pattern as label,
  case when count(*) filter (passed=false)>0 then false when count(passed)=count(*) then true end as passed
  from ex where rn=1 and test_type='FTR' group by 1,2,3)"""


def _device_sql(modes: str, bins: bool, group: str, having: str) -> str:
    keep = "true" if bins else "passed=false"
    return f""", r as (select {group} as grp, m.* from flagged a join {modes} m on a.attempt=m.attempt where a.is_latest and {keep}),
 t as (select mode, label, count(*) as count, count(*) filter (passed) as pass, count(*) filter (not passed) as fail,
  count(*) filter (passed is null) as unknown from r group by 1,2)
select t.*, g.grp as group, g.n as group_count from t join (select mode, grp, count(*) as n from r group by 1,2) g using (mode)
 where {having}"""


_BIN_MODES = """(select attempt, coalesce({0}::varchar,'[null]') as mode, '{1} '||coalesce({0}::varchar,'[null]') as label,
 case when flags & 20 = 0 then flags & 8 = 0 end as passed from attempts)"""


def _device_query(name, modes, bins, by, group, having, level=None, **options):
    base = cte("attempts", "measurements") + LATEST_SQL + _MODES_SQL
    source = _BIN_MODES.format(level, "HBIN" if level == "hard_bin" else "SBIN") if bins else modes

    @query(name, base + _device_sql(source, bins, group, having))
    def _(spark, sf):
        latest = flagged_attempts(spark, sf).filter("is_latest")
        if bins:
            return pareto.latest_device_pareto(latest, pareto.bin_modes(latest, level), bins, by, **options)
        # The latest attempts are few; they select the tests before these are collapsed.
        latest = materialize(latest.select("attempt", "lot", "wafer", "head", "site"), "latest-attempts")
        tests = adapters.measurements(spark, sf).join(latest, "attempt", "left_semi")
        found = pareto.test_modes(tests) if modes == "tests" else pareto.pattern_modes(tests)
        return pareto.latest_device_pareto(latest, found, bins, by, **options)


_device_query("f18_device_modes_tests", "tests", False, "lot", "lot", "t.fail>=5 and contains(lower(t.label),'ptr')", min_fail=5, text="PTR")
_device_query("f18_device_modes_patterns", "patterns", False, "wafer", "coalesce(wafer,'[null]')", "true")
_device_query("f18_device_modes_hard_bin", None, True, "site", "'H'||head||'/S'||site", "t.fail>0 or t.unknown>0", level="hard_bin")
_device_query("f18_device_modes_soft_bin", None, True, "all", "'All'", "true", level="soft_bin", show_passing=True)


@query("f19_mode_collapse", cte("attempts", "measurements") + _MODES_SQL + """ select 'tests' as level, label, passed, count(*) as attempts
 from tests group by all union all select 'patterns', label, passed, count(*) from patterns group by all""")
def _(spark, sf):
    rows = adapters.measurements(spark, sf)
    count = lambda modes, level: modes.groupBy("label", "passed").agg(F.count("*").alias("attempts")).select(
        F.lit(level).alias("level"), "label", "passed", "attempts"
    )
    return count(pareto.test_modes(rows), "tests").unionByName(count(pareto.pattern_modes(rows), "patterns"))


def _eng_pareto_sql(source: str, label: str, group: str, where: str, bins: bool, having: str) -> str:
    counted = "count(*)" if bins else "count(*) filter (passed=false)"
    return f""", c as (select attempt, {label} as label, {group} as grp,
  case when count(*) filter (passed=false)>0 then false when count(passed)=count(*) then true end as passed
  from {source} where {where} group by 1,2,3),
 t as (select label, {counted} as count, count(*) filter (passed) as pass, count(*) filter (not passed) as fail,
  count(*) filter (passed is null) as unknown from c group by 1),
 g as (select label, grp, {counted} as n from c group by 1,2)
select t.*, g.grp as group, g.n as group_count from t join g using (label) where g.n>0 and ({having})"""


_DEV = """, dv as (select *, case when flags & 20 = 0 then flags & 8 = 0 end as passed from flagged where is_latest)"""


@query("f20_engineering_pareto_test", _ENG + _eng_pareto_sql("ana", "kind||' '||number||' '||name", "head||'/'||site", "channel is null", False, "t.count<>0"))
def _(spark, sf):
    return pareto.engineering_pareto(_analysis(spark, sf, *_MODE), "test", "site")


@query("f20_engineering_pareto_pattern", _ENG + _eng_pareto_sql("ana", "coalesce(pattern,'[null]')", "lot", "kind='FTR'", False, "t.count<>0"))
def _(spark, sf):
    return pareto.engineering_pareto(_analysis(spark, sf, *_MODE), "pattern", "lot")


@query("f20_engineering_pareto_bin", _ENG + _DEV + _eng_pareto_sql("dv", "soft_bin::varchar", "coalesce(wafer,'[null]')", "true", True, "fail<>0 or unknown<>0"))
def _(spark, sf):
    rows = adapters.engineering_devices(spark, sf).filter("is_latest")
    return pareto.engineering_pareto(rows, "soft_bin", "wafer")


_SUMMARY_SQL = """ select {key} as key, {label} as label, count(*) as count, count(*) filter (passed) as pass,
 count(*) filter (not passed) as fail, count(*) filter (passed is null) as unknown, {stats} from {source} group by 1,2"""
_STATS_SQL = """round(min(value),6) as min, round(max(value),6) as max, round(coalesce(sum(value),0),4) as sum, round(avg(value),6) as mean"""
_NO_STATS = "null::double as min, null::double as max, 0e0 as sum, null::double as mean"


@query("f21_test_summary", _ENG + _SUMMARY_SQL.format(
    key="test", label="kind||' '||number||' '||name||coalesce(' [result '||channel||']','')", stats=_STATS_SQL, source="ana"))
def _(spark, sf):
    summary = paging.entity_summary(_analysis(spark, sf, *_MODE, "value"), "tests")
    return _rounded(summary, "min", "max", "mean").withColumn("sum", F.round("sum", 4))


@query("f21_wafer_summary", _ENG + _DEV + _SUMMARY_SQL.format(
    key="coalesce(wafer,'[null]')", label="coalesce(wafer,'[null]')", stats=_NO_STATS, source="dv"))
def _(spark, sf):
    return paging.entity_summary(adapters.engineering_devices(spark, sf).filter("is_latest"), "wafers")


@query("f21_soft_bin_summary", _ENG + _DEV + _SUMMARY_SQL.format(
    key="soft_bin::varchar", label="soft_bin::varchar", stats=_NO_STATS, source="dv"))
def _(spark, sf):
    return paging.entity_summary(adapters.engineering_devices(spark, sf).filter("is_latest"), "soft_bin")


# --- distributions --------------------------------------------------------------

_SERIES_SQL = _ENG + ", s as (select *, {place} as place from ana)"
_ALL = _SERIES_SQL.format(place="''")
_BY_SITE = _SERIES_SQL.format(place="head||'/'||site")


def _series(spark, sf, by_site=False, columns=_POINT):
    return distribution.series(_analysis(spark, sf, *columns), by_site)


@query("f22_series_statistics", _BY_SITE + """, t as (select test, place, units, count(value) as count,
  count(*) filter (value is null and value_state not in ('missing','nonfinite','not_numeric')) as invalid,
  count(*) filter (value is null and value_state='missing') as missing, count(*) filter (value is null and value_state='nonfinite') as nonfinite,
  count(*) filter (value is null and value_state='not_numeric') as not_numeric, avg(value) as m, stddev_samp(value) as s,
  min(value) as mn, max(value) as mx, count(distinct (coalesce(low,-1e99),coalesce(high,-1e99))) filter (value is not null)>1 as variable_limits,
  min(low) filter (value is not null) as l, min(high) filter (value is not null) as h from s group by 1,2,3)
select test, place, units, count, invalid, missing, nonfinite, not_numeric, round(m,6) as mean, round(s,6) as sigma, round(mn,6) as min,
 round(mx,6) as max, variable_limits, l as low, h as high, round(case when s>0 and h>l then least((h-m)/(3*s),(m-l)/(3*s)) end,6) as ppk from t""")
def _(spark, sf):
    return _rounded(distribution.statistics(_series(spark, sf, True, _STATS)), "mean", "sigma", "min", "max", "ppk")


@query("f23_exact_quantiles", _BY_SITE + """ select test, place, units, """ + ", ".join(
    f"round(quantile_cont(value, {p / 100}),6) as p{p}" for p in (2, 25, 50, 75, 98)) + " from s where value is not null group by 1,2,3")
def _(spark, sf):
    found = distribution.quantiles(distribution.cumulative_counts(_series(spark, sf, True)))
    return _rounded(found, "p2", "p25", "p50", "p75", "p98")


@query("f24_histogram", _ALL + """, b as (select units, case when min(value)=max(value) then min(value)-0.5 else min(value) end as lo,
  case when min(value)=max(value) then max(value)+0.5 else max(value) end as hi from s where value is not null group by 1),
 v as (select test, place, s.units, lo, hi, least(floor((value-lo)/(hi-lo)*20),19)::bigint as bin from s join b on s.units=b.units where value is not null),
 k as (select distinct test, place, units, lo, hi from v)
select k.test, k.place, k.units, round(k.lo,6) as hist_min, round(k.hi,6) as hist_max, r.bin, count(v.bin) as count
 from k cross join (select unnest(range(20))::bigint as bin) r
 left join v on v.test=k.test and v.place=k.place and v.units=k.units and v.bin=r.bin group by all""")
def _(spark, sf):
    return _rounded(distribution.histogram(_series(spark, sf), 20), "hist_min", "hist_max")


@query("f25_empirical_cdf", _ALL + """, c as (select test, place, units, value,
  row_number() over (partition by test, place, units order by value) as i, count(*) over (partition by test, place, units) as n
  from s where value is not null)
select test, place, units, round(value,6) as value, round(max(i)*1e2/any_value(n),6) as probability from c
 group by test, place, units, c.value having count(*) filter ((i-1) % greatest(ceil(n/2e2),1)=0 or i=n)>0""")
def _(spark, sf):
    found = distribution.empirical_cdf(distribution.cumulative_counts(_series(spark, sf)), 200)
    return _rounded(found, "value", "probability")


@query("f26_trend", _ALL + """, c as (select test, place, units, attempt, value,
  row_number() over (partition by test, place, units order by record_seq) as position, count(*) over (partition by test, place, units) as total
  from s where value is not null)
select test, place, units, attempt, round(value,6) as value, position, total from c
 where (position-1) % greatest(ceil(total/9.8e1),1)=0 or position=total""")
def _(spark, sf):
    found = distribution.trend(_series(spark, sf), 100)
    return _rounded(found.select("test", "place", "units", "attempt", "value", "position", "total"), "value")


_X, _Y = '["PTR",2,"T2",null]', '["PTR",4,"T4",null]'
_PAIR_SQL = _ENG + f""", p as (select attempt, arg_max(value, record_seq) filter (test='{_X}') as x_value,
  arg_max(value, record_seq) filter (test='{_Y}') as y_value, max(site) as site from ana
  where value is not null and test in ('{_X}','{_Y}') group by 1)"""


@query("f27_scatter", _PAIR_SQL + """ select count(*) filter (x_value is not null and y_value is not null) as count,
 count(*) filter (x_value is null or y_value is null) as unpaired, round(min(x_value) filter (y_value is not null),6) as x_min,
 round(max(x_value) filter (y_value is not null),6) as x_max, round(min(y_value) filter (x_value is not null),6) as y_min,
 round(max(y_value) filter (x_value is not null),6) as y_max, false as mixed_units, round(corr(x_value,y_value),6) as correlation from p""")
def _(spark, sf):
    return _rounded(distribution.scatter(_analysis(spark, sf, *_POINT), _X, _Y), "x_min", "x_max", "y_min", "y_max", "correlation")


@query("f27_scatter_points", _PAIR_SQL + """ select attempt, site, round(x_value,6) as x_value, round(y_value,6) as y_value
 from p where x_value is not null and y_value is not null order by attempt limit 20000""")
def _(spark, sf):
    return _rounded(distribution.scatter_points(_analysis(spark, sf, *_POINT), _X, _Y, 20_000), "x_value", "y_value")


@query("f28_bin_map", _ENG + " select attempt, wafer, x, y, hard_bin, soft_bin from flagged where is_latest and wafer is not null and x is not null and y is not null")
def _(spark, sf):
    cells = distribution.wafer_map(adapters.engineering_devices(spark, sf).filter("is_latest"))
    return cells.select("attempt", "wafer", "x", "y", "hard_bin", "soft_bin")


@query("f28_parametric_map", _ENG + f""" select count(*) filter (wafer is not null and x is not null and y is not null) as cells,
 count(*) filter (wafer is null or x is null or y is null) as missing_coordinates from ana where test='{_X}'""")
def _(spark, sf):
    return distribution.map_coverage(_analysis(spark, sf, "x", "y", "wafer").filter(F.col("test") == _X))


@query("f29_timing", _ENG + """ select count(duration_ms) as count, sum(duration_ms)::bigint as sum_ms,
 count(*) filter (duration_ms is null) as missing from flagged where is_latest""")
def _(spark, sf):
    return distribution.timing(adapters.engineering_devices(spark, sf).filter("is_latest"))


@query("f30_distinct_values", _ENG + " select wafer, count(*) as count from eng where is_latest and value>=50000 group by 1")
def _(spark, sf):
    rows = adapters.engineering_rows(spark, sf).filter("is_latest")
    return paging.distinct_values(filters.display(rows, {"value": ">=50000"}), "wafer")


@query("f31_sorted_page", cte("attempts") + """ select attempt, lot, wafer, duration_ms from attempts
 order by duration_ms desc, attempt limit 100 offset 250""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).select("attempt", "lot", "wafer", "duration_ms")
    return paging.page(rows, "duration_ms", ["attempt"], 250, 100, descending=True)


@query("f31_sorted_page_text", cte("attempts") + """ select attempt, lot, wafer, duration_ms from attempts
 order by lower(coalesce(wafer,'[null]')), attempt limit 50 offset 100""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).select("attempt", "lot", "wafer", "duration_ms")
    return paging.page(rows, "wafer", ["attempt"], 100, 50)


_MARKS_SQL = cte("attempts") + """, r as (select *, row_number() over (order by duration_ms, attempt)-1 as position,
  coalesce(flags & 20 = 0 and flags & 8 <> 0, false) as failed, site=3 and hard_bin=1 as alarm,
  attempt % 7=1 and attempt<4000 as is_excluded, duration_ms>=400000 as alert from attempts),
 marks as (select * from r where failed or alarm or is_excluded or alert)"""


def _marks(spark, sf) -> DataFrame:
    rows = adapters.attempts(spark, sf).select(
        "attempt", "duration_ms", verdicts.attempt_passed(F.col("flags")).alias("passed"),
        ((F.col("site") == 3) & (F.col("hard_bin") == 1)).alias("alarm"),
    )
    return paging.annotate(
        rows, "duration_ms", ["attempt"], F.col("attempt").isin(list(_EXCLUDED)), {"duration_ms": ">=400000"}
    )


@query("f32_annotations", _MARKS_SQL + " select attempt, duration_ms, failed, alarm, is_excluded, alert, position from marks")
def _(spark, sf):
    return _marks(spark, sf)


@query("f32_neighbours", _MARKS_SQL + """ select count(*) as annotation_count, max(position) filter (position<1000) as previous_annotation,
 min(position) filter (position>1000) as next_annotation from marks""")
def _(spark, sf):
    return paging.neighbours(_marks(spark, sf), 1000)


@query("f33_selection_audit", cte("attempts") + LATEST_SQL + """ select coalesce(issue,'Earlier attempt') as reason, count(*) as attempts,
 count(distinct ecid) as devices from flagged where is_latest is not true group by 1""")
def _(spark, sf):
    return pareto.selection_audit(flagged_attempts(spark, sf))
