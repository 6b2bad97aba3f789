"""Registered queries: validation and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from testfloor.functions import keys
from testfloor.operators import identity, quality, stream
from testfloor.plans import adapters
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query
from testfloor.plans.stream import SESSION_SQL

_CTX = cte("context_records")


def _pair_sql(opening: str, closing: str, key: str, rule: str, where: str, source: str = "context_records") -> str:
    return f"""select source_id, 'error' as severity, '{rule}' as rule, kind as record_type, seq,
 case when kind='{opening}' then '{opening} opened while the previous one never closed for ' else '{closing} has no matching {opening} for ' end||{where} as message
 from (select *, lag(kind) over (partition by source_id, {key} order by seq) as prev from {source} where kind in ('{opening}','{closing}'))
 where (kind='{opening}' and prev='{opening}') or (kind='{closing}' and coalesce(prev,'{closing}')='{closing}')
union all select source_id, 'error', '{rule}', '{opening}', max(seq), '{opening} never closed for '||{where}
 from {source} where kind in ('{opening}','{closing}') group by source_id, {key} having arg_max(kind, seq)='{opening}'"""


PARTS_SQL = _pair_sql("PIR", "PRR", "head, site", "STRUCT/PIR_PRR_PAIR", "'head='||head||' site='||site")
WAFERS_SQL = _pair_sql("WIR", "WRR", "head, site_grp", "STRUCT/WIR_WRR_PAIR", "'head='||head||' site_grp='||site_grp")


def _depth_sql(opening: str, closing: str, source: str, name: str = "depth") -> str:
    return f"""{name}_s as (select source_id, seq, kind, sum(case when kind='{opening}' then 1 else -1 end) over (partition by source_id order by seq) as s
  from {source} where kind in ('{opening}','{closing}')),
 {name}_m as (select *, min(s) over (partition by source_id order by seq) as low,
  min(s) over (partition by source_id order by seq rows between unbounded preceding and 1 preceding) as before from {name}_s),
 {name} as (select *, s-least(0,low) as depth, s<least(0,coalesce(before,0)) as unmatched from {name}_m)"""


BPS_SQL = """select source_id, 'error' as severity, 'STRUCT/BPS_EPS_BALANCE' as rule, 'EPS' as record_type, seq, 'EPS without matching BPS' as message
 from depth where unmatched
union all select d.source_id, 'error', 'STRUCT/BPS_EPS_BALANCE', 'BPS', min(d.seq), any_value(l.n)||' BPS record(s) never closed by EPS'
 from depth d join (select source_id, arg_max(depth, seq) as n, coalesce(max(seq) filter (depth=0),-1) as z from depth group by 1) l
  on d.source_id=l.source_id and d.seq>l.z where l.n>0 and d.kind='BPS' group by 1"""

MIR_SQL = """select source_id, 'error' as severity, 'STRUCT/MIR_SINGLETON' as rule, 'MIR' as record_type, seq, 'MIR seen '||n||' times' as message
 from (select *, row_number() over (partition by source_id order by seq) as n from {} where kind='MIR') where n>1"""


def _abort_sql(source: str) -> str:
    return f"""select source_id, 'warning' as severity, 'ABORT/NO_MRR' as rule, null::varchar as record_type, null::bigint as seq, 'No MRR found' as message
 from {source} group by 1 having count(*) filter (kind='MRR')=0
union all select d.source_id, 'error', 'ABORT/OPEN_WIR', 'WIR', m.last, d.n||' WIR(s) unclosed by WRR'
 from (select source_id, arg_max(depth, seq) as n from wafer_depth group by 1) d
 join (select source_id, max(seq) as last from {source} group by 1) m on d.source_id=m.source_id where d.n>0
union all select source_id, 'error', 'ABORT/OPEN_PIR', 'PIR', max(seq), 'PIR for head='||head||' site='||site||' never closed by PRR'
 from {source} where kind in ('PIR','PRR') group by source_id, head, site having arg_max(kind, seq)='PIR'
union all select source_id, 'warning', 'ABORT/OPEN_BPS', 'BPS', null, arg_max(depth, seq)||' BPS section(s) not closed by EPS'
 from depth group by 1 having arg_max(depth, seq)>0"""


@query("h01_part_pairing", _CTX + PARTS_SQL)
def _(spark, sf):
    return quality.part_pairing(adapters.context_records(spark, sf))


@query("h02_wafer_pairing", _CTX + WAFERS_SQL)
def _(spark, sf):
    return quality.wafer_pairing(adapters.context_records(spark, sf))


@query("h03_section_balance", _CTX + "," + _depth_sql("BPS", "EPS", "context_records") + BPS_SQL)
def _(spark, sf):
    return quality.section_balance(adapters.context_records(spark, sf))


@query("h04_single_mir", cte("records") + MIR_SQL.format("records"))
def _(spark, sf):
    return quality.single_mir(adapters.records(spark, sf))


_ABORT = ", ".join([_depth_sql("BPS", "EPS", "sanity_records"), _depth_sql("WIR", "WRR", "sanity_records", "wafer_depth")])


@query("h05_abort_detection", cte("sanity_records") + "," + _ABORT + _abort_sql("sanity_records"))
def _(spark, sf):
    return quality.abort_detection(adapters.sanity_records(spark, sf))


_PTR_SQL = """select concat('S', l_orderkey % 8) as source_id, l_orderkey * 8 + l_linenumber as seq, 'PTR' as kind, l_linenumber as test_num,
 l_discount as lo_limit, l_tax as hi_limit, case l_suppkey % 6 when 0 then null when 1 then 16 when 2 then 128 when 3 then 1 else 0 end as opt_flag,
 case when l_partkey % 40 = 0 then concat('T', l_linenumber, 'b') else concat('T', l_linenumber) end as test_txt from lineitem"""


def _ptr(spark, sf) -> DataFrame:
    adapters.tables(spark, sf, "lineitem")
    return spark.sql(_PTR_SQL)


@query("h06_limit_order", f"""with p as ({_PTR_SQL}) select source_id, 'error' as severity, 'FIELD/PTR_LIMIT_ORDER' as rule, 'PTR' as record_type, seq,
 'test '||test_num||' lo_limit > hi_limit' as message from p where opt_flag & 80=0 and opt_flag & 160=0 and lo_limit>hi_limit""")
def _(spark, sf):
    return quality.limit_order(_ptr(spark, sf))


@query("h07_empty_lot", """select 'S'||(o_orderkey % 8) as source_id, 'warning' as severity, 'FIELD/MIR_LOT_ID' as rule, 'MIR' as record_type,
 o_orderkey as seq, 'MIR.LOT_ID is empty' as message from orders where o_custkey % 13=0""")
def _(spark, sf):
    mirs = adapters.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), F.col("o_orderkey") % 8).alias("source_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_custkey") % 13 == 0, "  ").otherwise(F.concat(F.lit("L"), "o_custkey")).alias("lot_id"),
    )
    return quality.empty_lot(mirs)


@query("h08_test_names", f"""with p as ({_PTR_SQL}), f as (select source_id, test_num, arg_min(test_txt, (seq, test_txt)) as first_name from p group by 1,2)
select p.source_id, 'warning' as severity, 'SEMANTIC/TEST_NAME_CONSISTENCY' as rule, 'PTR' as record_type, seq,
 'test_num '||p.test_num||' has name '||test_txt||' (first '||first_name||')' as message from p join f using (source_id, test_num) where test_txt<>first_name""")
def _(spark, sf):
    return quality.test_name_consistency(_ptr(spark, sf))


_HBR_SQL = cte("attempts") + """, hbr as (
 select source_id, head, site, hard_bin as bin, count(*)+case when site=1 and hard_bin=2 then 1 else 0 end as n from attempts where hard_bin<>5 group by 1,2,3,4
 union all select source_id, 255, 255, hard_bin, count(*)+hard_bin % 3 from attempts where hard_bin<>4 or source_id='S1' group by 1,4
 union all select distinct source_id, 255, 255, 9, 3 from attempts)"""


@query("h09_bin_counts", _HBR_SQL + """, d as (select source_id, bin, coalesce(sum(n) filter (head<>255 and site<>255), max(n) filter (head=255 or site=255)) as hbr from hbr group by 1,2),
 p as (select source_id, hard_bin as bin, count(*) as prr from attempts group by 1,2)
select coalesce(d.source_id,p.source_id) as source_id, 'warning' as severity, 'SEMANTIC/HBR_BIN_COUNT' as rule, 'HBR' as record_type, null::bigint as seq,
 case when hbr is null then 'bin '||p.bin||' appears in PRRs ('||prr||' times) but has no HBR record'
  else 'bin '||d.bin||' HBR says '||hbr||' but PRR count is '||coalesce(prr,0) end as message
 from d full join p on d.source_id=p.source_id and d.bin=p.bin where coalesce(hbr,-1)<>coalesce(prr,0)""")
def _(spark, sf):
    parts = adapters.attempts(spark, sf)
    wide = F.lit(255).cast("bigint")
    per_site = parts.filter("hard_bin <> 5").groupBy("source_id", "head", "site", F.col("hard_bin").alias("bin")).agg(F.count("*").alias("n"))
    per_site = per_site.withColumn("n", F.col("n") + F.when((F.col("site") == 1) & (F.col("bin") == 2), 1).otherwise(0))
    rolled = parts.filter("hard_bin <> 4 or source_id = 'S1'").groupBy("source_id", F.col("hard_bin").alias("bin")).agg(F.count("*").alias("n"))
    rolled = rolled.select("source_id", wide.alias("head"), wide.alias("site"), "bin", (F.col("n") + F.col("bin") % 3).alias("n"))
    extra = parts.select("source_id", wide.alias("head"), wide.alias("site"), F.lit(9).alias("bin"), F.lit(3).alias("n")).distinct()
    summaries = per_site.unionByName(rolled).unionByName(extra)
    return quality.bin_counts(parts, summaries)


@query("h11_report_summary", cte("sanity_records") + "," + _ABORT + ", f as (" + PARTS_SQL.replace("context_records", "sanity_records") + " union all "
       + WAFERS_SQL.replace("context_records", "sanity_records") + " union all " + MIR_SQL.format("sanity_records") + " union all " + _abort_sql("sanity_records") + """)
select source_id, count(*) filter (severity='error') as errors, count(*) filter (severity='warning') as warnings,
 count(*) filter (starts_with(rule,'ABORT/'))>0 as likely_aborted from f group by 1""")
def _(spark, sf):
    rows = adapters.sanity_records(spark, sf)
    rules = [quality.part_pairing, quality.wafer_pairing, quality.single_mir, quality.abort_detection]
    return quality.report_summary(quality.all_findings([rule(rows) for rule in rules]))


# --- fields ---------------------------------------------------------------------

FIELD_SQL = """, plain as (select *, case
  when kind='Cn' and regexp_matches(text,'[^\\x00-\\x7F]') then 'non-ASCII character bytes'
  when kind='R4' and (isnan(number) or isinf(number)) then 'nonfinite number'
  when field in ('HARD_BIN','SOFT_BIN') and number>32767 and not (field='SOFT_BIN' and number=65535) then 'bin number exceeds 32767' end as base_issue,
  (kind='Cn' and text='') or (field='X_COORD' and number=-32768) or (field='SOFT_BIN' and number=65535) as is_default,
  kind='Cn' or field in ('X_COORD','SOFT_BIN') as has_default from fields),
 st as (select *, case when field='RESULT' and test_flg & 63<>0 then 'invalid'
  when record='PTR' and ((field='LO_LIMIT' and opt_flag & 80<>0) or (field='HI_SPEC' and opt_flag & 8<>0)) then 'missing'
  when record='PTR' and field in ('LO_LIMIT','HI_SPEC') and opt_flag is null and presence='present' then 'unknown'
  when base_issue is not null then 'invalid' when presence='omitted' then case when has_default then 'missing' else 'unknown' end
  when is_default then 'missing' else 'valid' end as status,
  case when presence='present' then 'explicit' when has_default then 'standard_default' else 'unresolved' end as origin,
  case when field='RESULT' and test_flg & 63<>0 then 'the flags call the result unreliable' else base_issue end as issue from plain),
 checked as (select *, case when status='valid' then text end as eff_text, case when status='valid' then number end as eff_number from st)"""

_FIELDS = cte("fields") + FIELD_SQL


def _checked(spark, sf) -> DataFrame:
    return quality.field_status(adapters.record_fields(spark, sf))


@query("h12_field_status", _FIELDS + """ select source_id, record, field, presence, status, origin, issue, count(*) as n, count(eff_text) as texts,
 count(eff_number) as numbers from checked group by all""")
def _(spark, sf):
    return _checked(spark, sf).groupBy("source_id", "record", "field", "presence", "status", "origin", "issue").agg(
        F.count("*").alias("n"), F.count("eff_text").alias("texts"), F.count("eff_number").alias("numbers")
    )


@query("h17_field_totals", _FIELDS + " select source_id, status, count(*) as fields from checked where status<>'valid' group by all")
def _(spark, sf):
    return quality.field_totals(_checked(spark, sf))


@query("h17_offending_fields", _FIELDS + " select source_id, \"offset\", record, field, status, presence, origin, issue from checked where status='invalid'")
def _(spark, sf):
    return _checked(spark, sf).filter("status = 'invalid'").select(
        "source_id", "offset", "record", "field", "status", "presence", "origin", "issue"
    )


@query("d10_important_fields", _FIELDS + """ select record, field, count(*) as n from checked where record not in ('PRR','PTR')
 or (record='PRR' and field in ('PART_ID','HARD_BIN','SOFT_BIN','X_COORD')) or (record='PTR' and field in ('RESULT','UNITS')) group by all""")
def _(spark, sf):
    chosen = quality.important_fields(_checked(spark, sf), {"PTR": ["RESULT", "UNITS"]})
    return chosen.groupBy("record", "field").agg(F.count("*").alias("n"))


# Required fields of a product: the default list and the characterisation axes.
_EXTRA_CHECKS = """
PRR PART_ID FT
PTR UNITS CP|FT
CTSR CHAR_NAM CP|FT
CTSR AXES[].AXIS_NAM CP|FT
CTSR AXES[].INIT_VAL CP
CTSR AXES[].TRACKING[].TRACK_NAM CP|FT
"""

_CHECKS_SQL = """, rules as (select * from (values ('PRR','HARD_BIN','',''),('PRR','SOFT_BIN','',''),('PRR','PART_ID','','ft'),('PTR','RESULT','',''),('PTR','UNITS','',''),
  ('CTSR','CHAR_NAM','',''),('CTSR','AXIS_NAM','axis',''),('CTSR','INIT_VAL','axis','cp'),('CTSR','TRACK_NAM','track','')) r(record, name, member, only_flow)),
 named as (select *, regexp_replace(field,'^.*\\.','') as name, case when contains(field,'TRACKING') then 'track' when contains(field,'AXES') then 'axis' else '' end as member,
  regexp_extract(field,'^(.*\\])',1) as place from checked),
 ruled as (select n.*, r.name is not null as listed from named n left join rules r on n.record=r.record and n.name=r.name and n.member=r.member
  and (r.only_flow='' or r.only_flow=n.flow)),
 proj as (select source_id, "offset", record, flow, field, presence, case when not listed then 'not_checked'
   when ((eff_text is null and eff_number is null) or trim(coalesce(eff_text,'x'))='') and status<>'invalid' then 'missing' else status end as status from ruled),
 places as (select distinct source_id, "offset", flow, place, member from named where record='CTSR' and member<>''
   union select distinct source_id, "offset", flow, regexp_extract(place,'^(AXES\\[[0-9]+\\])',1), 'axis' from named where record='CTSR' and member<>''),
 wanted as (select p.source_id, p."offset", 'CTSR' as record, p.flow, p.place||'.'||r.name as field from places p join rules r on r.record='CTSR' and r.member=p.member
   and (r.only_flow='' or r.only_flow=p.flow)
  union all select d.source_id, d."offset", d.record, d.flow, r.name from (select distinct source_id, "offset", record, flow from named where record='PTR') d
   join (values ('TEST_NUM'),('HEAD_NUM'),('SITE_NUM'),('TEST_FLG'),('PARM_FLG')) r(name) on true
  union all select d.source_id, d."offset", d.record, d.flow, r.name from (select distinct source_id, "offset", record, flow from named where record='PRR') d
   join (values ('HEAD_NUM'),('SITE_NUM'),('PART_FLG'),('NUM_TEST')) r(name) on true),
 absent as (select w.* from wanted w where not exists (select 1 from checked c where c.source_id=w.source_id and c."offset"=w."offset" and c.record=w.record and c.flow=w.flow and c.field=w.field)),
 projected as (select * from proj union all select source_id, "offset", record, flow, field, 'omitted', 'missing' from absent)"""


def _projected(spark, sf) -> DataFrame:
    checks = quality.check_list(spark, quality.DEFAULT_CHECKS.rstrip() + _EXTRA_CHECKS)
    return quality.project_checks(_checked(spark, sf), checks)


@query("h13_checks_projection", _FIELDS + _CHECKS_SQL + " select record, flow, field, presence, status, count(*) as n from projected group by all")
def _(spark, sf):
    return _projected(spark, sf).groupBy("record", "flow", "field", "presence", "status").agg(F.count("*").alias("n"))


_RULES = [
    ("demo", "PRR", "PART_ID", True, "UNIT[0-9]+5", None, None, None),
    ("demo", "PRR", "HARD_BIN", False, None, None, 10.0, 30000.0),
    ("demo", "PTR", "UNITS", True, None, ["V", "A"], None, None),
    ("demo", "CTSR", "AXES[].AXIS_NAM", True, None, None, None, None),
]
_RULE_SCHEMA = "profile string, record string, field string, required boolean, pattern string, allowed array<string>, min double, max double"


@query("h14_profile_rules", _FIELDS + """ select source_id, 'error' as severity, 'profile' as rule, record as record_type, "offset" as seq,
 record||'.'||field||' does not satisfy profile demo' as message from checked
 where (record='PRR' and field='PART_ID' and (status<>'valid' or not regexp_full_match(eff_text,'UNIT[0-9]+5')))
 or (record='PRR' and field='HARD_BIN' and not coalesce(eff_number between 10 and 30000, false))
 or (record='PTR' and field='UNITS' and (status<>'valid' or not coalesce(eff_text in ('V','A'),false)))
 or (record='CTSR' and field like 'AXES[%].AXIS_NAM' and status<>'valid')""")
def _(spark, sf):
    rules = spark.createDataFrame(_RULES, _RULE_SCHEMA)
    return quality.profile_violations(_checked(spark, sf), F.broadcast(rules))


# --- structure --------------------------------------------------------------------

_RUN_SQL = cte("sanity_records") + """, b as (select *, kind in ('MIR','MRR') as border,
  count(*) filter (kind='MIR') over (partition by source_id order by seq) as run,
  count(*) filter (kind in ('MIR','MRR')) over (partition by source_id order by seq) as epoch,
  last_value(case when kind in ('MIR','MRR') then kind end ignore nulls) over (partition by source_id order by seq rows between unbounded preceding and 1 preceding) as lb from sanity_records),
 s as (select *, coalesce(lb='MIR',false) as in_run from b),
 ends as (select source_id, max(epoch) as epoch, max(run) as run, max(seq) as seq, count(*) filter (kind='MIR') as mirs, count(*) filter (kind='MRR') as mrrs,
  arg_max(kind, seq) filter (border) as last_border from s group by 1),
 u as (select *, lag(kind) over (partition by source_id, epoch, head, site order by seq) as prev from s where kind in ('PIR','PRR') and in_run),
 openu as (select distinct source_id, epoch from (select source_id, epoch, head, site, arg_max(kind, seq) as k from u group by 1,2,3,4) where k='PIR'),
 w as (select *, lag(kind) over (partition by source_id, run, head, site_grp order by seq) as prev from s where kind in ('WIR','WRR')),
 openw as (select distinct source_id, run from (select source_id, run, head, site_grp, arg_max(kind, seq) as k from w group by 1,2,3,4) where k='WIR'),
 own as (select t.source_id, t.seq, t.kind, e.kind as state from s t asof left join u e on t.source_id=e.source_id and t.epoch=e.epoch and t.head=e.head and t.site=e.site and t.seq>=e.seq
  where t.kind in ('PTR','FTR')),
 """ + _depth_sql("BPS", "EPS", "sanity_records") + """, f as (
 select source_id, 'far_position' as rule, kind as record_type, seq from s where kind='FAR' and seq>(select min(seq) from s x where x.source_id=s.source_id)
 union all select source_id, 'run_overlap', kind, seq from s where kind='MIR' and in_run
 union all select source_id, 'run_context', kind, seq from s where kind in ('SDR','WIR','WRR','WCR','MRR','SBR','HBR') and not in_run
 union all select source_id, 'part_context', kind, seq from s where kind in ('PIR','PRR') and not in_run
 union all select source_id, 'part_pair', kind, seq from u where (kind='PIR' and prev='PIR') or (kind='PRR' and coalesce(prev,'PRR')='PRR')
 union all select s.source_id, 'unclosed_unit', kind, seq from s join openu o on s.source_id=o.source_id and s.epoch-1=o.epoch where kind='MRR'
 union all select e.source_id, 'unclosed_unit', null, seq from ends e join openu o on e.source_id=o.source_id and e.epoch=o.epoch
 union all select source_id, 'run_closure', null, seq from ends where mirs=0 or mrrs=0 or last_border='MIR'
 union all select source_id, 'wafer_overlap', kind, seq from w where kind='WIR' and prev='WIR'
 union all select source_id, 'wafer_pair', kind, seq from w where kind='WRR' and coalesce(prev,'WRR')='WRR'
 union all select e.source_id, 'wafer_closure', null, seq from ends e join openw o on e.source_id=o.source_id and e.run=o.run
 union all select source_id, 'record_ownership', kind, seq from own where coalesce(state,'PRR')='PRR'
 union all select source_id, 'program_section', record_type, seq from (""" + BPS_SQL + """))
select rule, record_type, source_id, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from f group by 1,2,3"""


@query("h15_run_findings", _RUN_SQL)
def _(spark, sf):
    found = quality.run_findings(adapters.sanity_records(spark, sf))
    return found.groupBy("rule", "record_type", "source_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query("h15_wafer_requirement", _RUN_SQL.split(" openu as")[0].rstrip().rstrip(",") + """,
 created as (select * from u where kind='PIR' or coalesce(prev,'PRR')='PRR'),
 sdr as (select source_id, run, head, site, seq, site_grp from s where kind='SDR' union all select source_id, run, head, (site+2) % 4, seq, site_grp from s where kind='SDR'),
 g as (select c.source_id, c.run, c.head, c.site, c.seq, coalesce(d.site_grp, 255) as grp from created c asof left join sdr d
  on c.source_id=d.source_id and c.run=d.run and c.head=d.head and c.site=d.site and c.seq>=d.seq),
 ev as (select source_id, run, head, site_grp, seq, case when kind='WIR' then wafer_id end as name, kind='WIR' as open from s where kind in ('WIR','WRR')),
 a as (select g.*, e.name as own, coalesce(e.open,false) as own_open from g asof left join ev e on g.source_id=e.source_id and g.run=e.run and g.head=e.head and g.grp=e.site_grp and g.seq>=e.seq),
 b2 as (select a.*, e.name as shared, coalesce(e.open,false) as shared_open from a asof left join (select * from ev where site_grp=255) e
  on a.source_id=e.source_id and a.run=e.run and a.head=e.head and a.seq>=e.seq)
select source_id, head, site, count(*) as n, min(seq) as first_seq from b2
 where coalesce(case when own_open then own when shared_open then shared end,'')='' group by 1,2,3""")
def _(spark, sf):
    rows = adapters.sanity_records(spark, sf).withColumn("sites", F.array("site", (F.col("site") + 2) % 4))
    found = quality.run_findings(rows, require_wafer=True).filter("rule = 'cp_wafer'")
    joined = found.join(rows.select("source_id", "seq", "head", "site"), ["source_id", "seq"])
    return joined.groupBy("source_id", "head", "site").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("h15_text_ownership", _CTX + """, d as (select source_id, seq from context_records where kind='DTR'),
 ev as (select source_id, head, site, seq, kind='PIR' as open from context_records where kind in ('PIR','PRR')),
 st as (select d.source_id, d.seq, e.open from (select d.*, h.head, h.site from d join (select distinct source_id, head, site from ev) h using (source_id)) d
  asof left join ev e on d.source_id=e.source_id and d.head=e.head and d.site=e.site and d.seq>=e.seq)
select source_id, 'warning' as severity, 'record_ownership' as rule, null::varchar as record_type, seq,
 'no single unit owns the record; it stays with its run' as message from st group by source_id, seq having count(*) filter (open)<>1""")
def _(spark, sf):
    return quality.text_ownership(stream.assign_records(adapters.context_records(spark, sf)))


@query("h15_identity", cte("attempts") + """ select source_id, 'warning' as severity, 'identity' as rule, 'PRR' as record_type, attempt as seq,
 'no coordinate identity; the unit counts by itself' as message from attempts where not coalesce(wafer ~ '^[A-Z0-9]+$' and x>0 and y>0, false)""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf)
    merge = keys.wafer_merge_key(F.col("wafer"), F.col("x"), F.col("y"))
    return quality.unresolved_identity(rows.withColumn("part_merge_key", merge))


@query("h16_unit_preview", cte("records") + SESSION_SQL.format("records") + """, p as (select *, row_number() over (partition by source_id, head, site, sess, kind order by seq) as position from opened)
select source_id, open_seq, head, site, kind, seq, position from p where position<=2""")
def _(spark, sf):
    sessioned = stream.sessions(adapters.records(spark, sf))
    opened = sessioned.groupBy("source_id", "head", "site", "session").agg(F.min("seq").alias("open_seq"))
    rows = quality.unit_preview(sessioned, 2).join(opened, ["source_id", "head", "site", "session"])
    return rows.select("source_id", "open_seq", "head", "site", "kind", "seq", "position")


@query("h16_unit_counts", cte("records") + SESSION_SQL.format("records") + """ select source_id, head, site, kind, sess_n, count(*) as units from
 (select source_id, head, site, sess, kind, count(*) as sess_n from opened group by all) group by all""")
def _(spark, sf):
    counts = quality.unit_counts(stream.sessions(adapters.records(spark, sf)))
    return counts.groupBy("source_id", "head", "site", "kind", F.col("records").alias("sess_n")).agg(F.count("*").alias("units"))


@query("h18_coverage_checks", cte("records") + SESSION_SQL.format("records") + """,
 r as (select source_id, count(*) as records, count(*) filter (kind='PRR') as closing_records from records group by 1),
 a as (select source_id, count(*) as attempts from numbered where close_seq is not null group by 1)
select source_id, records, closing_records, attempts, records as inventory, attempts=closing_records as consistent from r left join a using (source_id)""")
def _(spark, sf):
    rows = adapters.records(spark, sf)
    found = stream.attempts(stream.sessions(rows))
    return quality.coverage_checks(rows, found, quality.decode_summary(rows))


# --- identifiers, routing, association -------------------------------------------

@query("c17_characterization_id", """with r as (select case user_id % 4 when 0 then '0x'||lower(to_hex(event_id)) when 1 then '0X'||upper(to_hex(event_id)) when 2 then event_id::varchar else 'id'||event_id end as raw from events)
select substr(raw,1,2) in ('0x','0X') as hex, count(*) as n, sum(case when substr(raw,1,2) in ('0x','0X') then ('0x'||substr(raw,3))::bigint
 when regexp_full_match(raw,'[0-9]+') then raw::bigint end)::bigint as total from r group by 1""")
def _(spark, sf):
    number, branch = F.col("event_id"), F.col("user_id") % 4
    raw = (
        F.when(branch == 0, F.concat(F.lit("0x"), F.lower(F.hex(number)))).when(branch == 1, F.concat(F.lit("0X"), F.hex(number)))
        .when(branch == 2, number.cast("string")).otherwise(F.concat(F.lit("id"), number.cast("string")))
    )
    rows = adapters.table(spark, sf, "events").select(raw.alias("raw"))
    return rows.groupBy(F.substr("raw", F.lit(1), F.lit(2)).isin("0x", "0X").alias("hex")).agg(
        F.count("*").alias("n"), F.sum(keys.characterization_id(F.col("raw"))).alias("total")
    )


@query("c19_canonical_field", cte("fields") + r""" select regexp_replace(field,'\[[^\]]*\]','[]','g') as canonical, count(*) as n from fields group by 1""")
def _(spark, sf):
    fields = adapters.record_fields(spark, sf)
    return fields.groupBy(keys.canonical_field(F.col("field")).alias("canonical")).agg(F.count("*").alias("n"))


_RUN_COLUMNS = """select o_orderkey as run, concat('JOB_', substring(o_orderpriority,1,1)) as job_nam, cast(o_custkey % 3 as string) as job_rev,
 o_orderstatus as test_cod, case when o_custkey % 5=0 then null else concat('F', o_custkey % 5) end as flow_id, cast(o_custkey % 2 * 25 as string) as tst_temp from orders"""

STEPS = [
    ("probe", [{"job_nam": "JOB_1"}, {"job_nam": "JOB_2", "job_rev": "0"}]),
    ("final", [{"job_nam": "JOB_2"}, {"job_nam": "JOB_3", "test_cod": "F", "tst_temp": "25"}]),
    ("burnin", [{"job_nam": "JOB_4", "flow_id": "F1"}, {"flow_id": "F2", "job_rev": "1"}]),
    ("rework", [{"test_cod": "P", "flow_id": "F3"}]),
]
_STEP_SQL = f"""with r as ({_RUN_COLUMNS}), m as (select *,
 job_nam='JOB_1' or (job_nam='JOB_2' and job_rev='0') as s1, job_nam='JOB_2' or (job_nam='JOB_3' and test_cod='F' and tst_temp='25') as s2,
 (job_nam='JOB_4' and coalesce(flow_id='F1',false)) or (coalesce(flow_id='F2',false) and job_rev='1') as s3, test_cod='P' and coalesce(flow_id='F3',false) as s4 from r),
 n as (select *, s1::int+s2::int+s3::int+s4::int as n from m)"""


def _flow_runs(spark, sf) -> DataFrame:
    adapters.tables(spark, sf, "orders")
    return spark.sql(_RUN_COLUMNS)


@query("e09_step_matching", _STEP_SQL + " select run, case when n=1 then case when s1 then 'probe' when s2 then 'final' when s3 then 'burnin' else 'rework' end end as step from n")
def _(spark, sf):
    return identity.match_step(_flow_runs(spark, sf), STEPS).select("run", "step")


@query("e10_profile_routing", _STEP_SQL + """ select case when n=1 then case when s1 then 'probe' when s2 then 'final' when s3 then 'burnin' else 'rework' end end as profile,
 case when n=0 then 'no profile selects the run; its checks were skipped' when n>1 then 'several profiles select the run: '||concat_ws(', ', case when s1 then 'probe' end,
  case when s2 then 'final' end, case when s3 then 'burnin' end, case when s4 then 'rework' end) end as route_finding, count(*) as runs from n group by all""")
def _(spark, sf):
    routed = identity.route_profiles(_flow_runs(spark, sf), STEPS)
    return routed.groupBy("profile", "route_finding").agg(F.count("*").alias("runs"))


_SETUP_SQL = """select concat('S', user_id % 10) as source_id, event_id as seq, 1 as head, (user_id + event_id) % 4 as site,
 case when event_type='signup' then 'PIR' when event_type='purchase' then 'PRR' when event_type='view' then 'CTSR' else 'CTRR' end as kind,
 event_id % 20 as char_id from events where event_type<>'error'"""


@query("e12_setup_association", f"""with r as ({_SETUP_SQL}), p as (select c.source_id, c.seq, c.char_id, case when e.kind='PIR' then e.seq end as unit_seq
  from (select * from r where kind='CTRR') c asof left join (select * from r where kind in ('PIR','PRR')) e
  on c.source_id=e.source_id and c.head=e.head and c.site=e.site and c.seq>=e.seq),
 n as (select p.*, (select count(*) from r s where s.kind='CTSR' and s.source_id=p.source_id and s.char_id=p.char_id and s.seq>p.unit_seq and s.seq<p.seq) as setups from p)
select *, case when setups=1 then 'resolved' when setups>1 then 'ambiguous' else 'unresolved' end as association from n""")
def _(spark, sf):
    adapters.tables(spark, sf, "events")
    return quality.setup_association(spark.sql(_SETUP_SQL))
