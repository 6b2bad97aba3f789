"""Registered queries: record stream to attempts and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from testfloor.operators import stream
from testfloor.plans import adapters
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query
from testfloor.session import materialize

_SIDE = "kind in ('PIR','PTR','MPR','FTR','PRR')"

# Sessionization written with windows: boundary, running count, rank of the opening record.
SESSION_SQL = f""", side as (select *, lag(kind) over (partition by source_id, head, site order by seq) as prev
  from {{0}} where {_SIDE}),
 bounded as (select *, sum(case when kind='PIR' or prev is null or prev='PRR' then 1 else 0 end)
  over (partition by source_id, head, site order by seq) as sess from side),
 opened as (select *, min(seq) over (partition by source_id, head, site, sess) as open_seq from bounded),
 att as (select source_id, head, site, open_seq, max(seq) filter (kind='PRR') as close_seq,
  count(*) filter (kind in ('PTR','MPR','FTR')) as tests from opened group by 1,2,3,4),
 numbered as (select *, row_number() over (partition by source_id order by open_seq) as part_sequence from att)"""

_RUN_SQL = """, r as (select *, count(*) filter (kind='MIR') over (partition by source_id order by seq) as run,
  max(case when kind='MIR' then seq end) over (partition by source_id order by seq) as mir_seq from {0})"""


def _context(spark, sf) -> DataFrame:
    """Context records with the site list of an SDR and the names a WRR brings."""
    rows = adapters.context_records(spark, sf)
    text = F.when(F.col("seq") % 7 == 0, " ").otherwise(F.col("wafer_id"))
    return rows.select(
        "source_id", "seq", "head", "site", "kind", "site_grp", "value",
        F.array("site", ((F.col("site") + 2) % 4)).alias("sites"), text.alias("wafer_id"),
        F.when((F.col("kind") == "WRR") & (F.col("seq") % 3 == 0), F.concat(F.lit("F"), F.col("seq") % 25)).alias("fabwf_id"),
    )


@query("b01_run_numbering", cte("records") + _RUN_SQL.format("records") + " select source_id, seq, kind, run from r")
def _(spark, sf):
    return stream.number_runs(adapters.records(spark, sf)).select("source_id", "seq", "kind", "run")


@query("b02_run_context", cte("records") + _RUN_SQL.format("records") + """
 select r.source_id, r.seq, r.run, 'lot'||(m.seq % 40) as lot, round(m.value,6) as start_value
 from r left join records m on r.source_id=m.source_id and r.mir_seq=m.seq""")
def _(spark, sf):
    rows = adapters.records(spark, sf).withColumns(
        {"lot": F.concat(F.lit("lot"), F.col("seq") % 40), "start_value": F.round("value", 6)}
    )
    return stream.number_runs(rows, ("lot", "start_value")).select("source_id", "seq", "run", "lot", "start_value")


GROUP_SQL = SESSION_SQL.format("context_records") + """,
 sdr as (select source_id, head, site, seq, site_grp from context_records where kind='SDR'
  union all select source_id, head, (site+2) % 4, seq, site_grp from context_records where kind='SDR'),
 grp as (select a.*, s.site_grp as site_group from numbered a asof left join sdr s
  on a.source_id=s.source_id and a.head=s.head and a.site=s.site and a.open_seq>=s.seq)"""


def probes(spark, sf):
    rows = _context(spark, sf)
    found = stream.attempts(stream.sessions(rows))
    return rows, found.select("source_id", "head", "site", F.col("open_seq").alias("seq"), "part_sequence")


@query("b03_site_groups", cte("context_records") + GROUP_SQL + " select source_id, head, site, open_seq as seq, part_sequence, site_group from grp")
def _(spark, sf):
    rows, opened = probes(spark, sf)
    return stream.site_groups(rows, opened, ["source_id"])


@query("b04_open_wafer", cte("context_records") + GROUP_SQL + """,
 ev as (select source_id, head, site_grp as grp, seq, case when kind='WIR' then seq else -1 end as state from context_records where kind in ('WIR','WRR')),
 p4 as (select g.*, v.s as slot from grp g, (select unnest([0,1,2,255]) as s) v),
 st as (select p4.*, e.state from p4 asof left join ev e on p4.source_id=e.source_id and p4.head=e.head and p4.slot=e.grp and p4.open_seq>=e.seq),
 w as (select source_id, head, site, open_seq, part_sequence, site_group, max(state) filter (slot=site_group and state>=0) as own,
  max(state) filter (slot=255 and state>=0) as shared, count(*) filter (state>=0) as open_count, max(state) as only_seq from st group by 1,2,3,4,5,6)
select source_id, head, site, open_seq as seq, part_sequence, site_group, open_count,
 case when site_group is not null then coalesce(own, shared) else coalesce(shared, case when open_count=1 then only_seq end) end as wafer_seq from w""")
def _(spark, sf):
    rows, opened = probes(spark, sf)
    return stream.open_wafers(rows, opened).drop("own", "shared")


def _fold_sql() -> str:
    """The strict wafer rule as a record-by-record fold: a recursive query that carries
    the opening position of each wafer slot (head 1 and 2, groups 0, 1 and 255)."""
    slots = [(h, g) for h in (1, 2) for g in (0, 1, 255)]
    names = ["s%d_%d" % s for s in slots]
    mine = lambda g: f"(case n.head when 1 then f.s1_{g} else f.s2_{g} end)"
    count = " + ".join(f"({mine(g)} is not null)::int" for g in (0, 1, 255))
    only = f"coalesce({mine(0)}, {mine(1)}, {mine(255)})"
    mapped = "(n.head=1 and n.run>=1)"
    group = "(case when n.site<2 then 0 else 1 end)"
    own = f"(case when n.site<2 then {mine(0)} else {mine(1)} end)"
    side = "n.kind in ('PIR','PTR','MPR','FTR','PRR')"
    chosen = f"(case when {mapped} then coalesce({own}, {mine(255)}) when {mine(255)} is not null then {mine(255)} when {count}=1 then {only} end)"
    opens = f"({side} and {chosen} is null and ({mapped} or {count}=0))"
    at = f"(case n.site_grp when 0 then {mine(0)} when 1 then {mine(1)} else {mine(255)} end)"
    steps = []
    for (h, g), name in zip(slots, names):
        steps.append(f"""case when n.kind='MIR' then null when n.head<>{h} then f.{name} when n.kind='WIR' and n.site_grp={g} then n.seq
          when n.kind='WRR' and (n.site_grp={g} or ({g}=255 and {at} is null)) then null
          when {opens} and {g}=(case when {mapped} then {group} else 255 end) then n.seq else f.{name} end""")
    return f"""{cte('context_records', 'late_records')},
 n as materialized (select *, row_number() over (partition by source_id order by seq) as rn,
   count(*) filter (kind='MIR') over (partition by source_id order by seq) as run from late_records),
 f as (select source_id, 0::bigint as rn, {', '.join(f'null::bigint as {x}' for x in names)}, null::bigint as closed, null::bigint as sel
   from (select distinct source_id from late_records)
  union all select n.source_id, n.rn, {', '.join(steps)}, case when n.kind='WRR' then coalesce({at}, {mine(255)}) end,
   case when {opens} then n.seq when {side} then {chosen} end from f join n on n.source_id=f.source_id and n.rn=f.rn+1),
 named as (select f.source_id, f.closed as seq, any_value(coalesce(nullif(trim(n.fabwf_id),''), nullif(trim(n.wafer_id),''))) as name
   from f join n using (source_id, rn) where f.closed is not null group by 1,2)"""


@query("b05_late_wafer", _fold_sql().replace("with ", "with recursive ", 1) + SESSION_SQL.format("late_records") + """
select p.source_id, n.run, p.head, p.site, p.open_seq as seq, p.part_sequence,
 coalesce(c.name, case when w.kind='WIR' then nullif(trim(w.wafer_id),'') end) as wafer, case when f.sel is null then 'ambiguous_wafer' end as wafer_issue
 from numbered p join n on p.source_id=n.source_id and p.open_seq=n.seq join f on f.source_id=n.source_id and f.rn=n.rn
 left join named c on c.source_id=p.source_id and c.seq=f.sel left join late_records w on w.source_id=p.source_id and w.seq=f.sel""")
def _(spark, sf):
    # The numbered stream is read by every step below, as the stored stream of an ingest would be.
    rows = materialize(stream.number_runs(adapters.late_records(spark, sf)), "numbered-records")
    found = stream.attempts(stream.sessions(rows))
    runs = rows.select("source_id", "run", F.col("seq").alias("open_seq"))
    probes = found.join(runs, ["source_id", "open_seq"]).select(
        "source_id", "run", "head", "site", F.col("open_seq").alias("seq"), "part_sequence"
    )
    return stream.late_wafers(rows, probes)


def _free_fold_sql() -> str:
    """The strict rule as a fold over all context records: slots of groups 0, 1, 2 and 255, and the group of each site,
    which any SDR may change."""
    groups, sites = (0, 1, 2, 255), (0, 1, 2, 3)
    slots, maps = [(h, g) for h in (1, 2) for g in groups], [(h, x) for h in (1, 2) for x in sites]
    mine = lambda g: f"(case n.head when 1 then f.s1_{g} else f.s2_{g} end)"
    pick = lambda what, values: f"(case {what} " + " ".join(f"when {g} then {v}" for g, v in values) + " end)"
    group = "(case n.head when 1 then " + pick("n.site", [(x, f"f.m1_{x}") for x in sites]) + " else " + pick("n.site", [(x, f"f.m2_{x}") for x in sites]) + " end)"
    at = pick("n.site_grp", [(g, mine(g)) for g in groups])
    state = ", ".join([f"f.s{h}_{g}" for h, g in slots] + [f"f.m{h}_{x}" for h, x in maps])
    names = [f"s{h}_{g}" for h, g in slots] + [f"m{h}_{x}" for h, x in maps]
    own = pick("e.grp", [(g, f"e.c{g}") for g in groups])
    count = " + ".join(f"(e.c{g} is not null)::int" for g in groups)
    only = f"coalesce({', '.join(f'e.c{g}' for g in groups)})"
    chosen = f"(case when e.grp is not null then coalesce({own}, e.c255) when e.c255 is not null then e.c255 when {count}=1 then {only} end)"
    steps = [
        f"""case when kind='MIR' then null when head<>{h} then s{h}_{g} when kind='WIR' and site_grp={g} then seq
          when kind='WRR' and (site_grp={g} or ({g}=255 and held is null)) then null when opens and {g}=coalesce(grp,255) then seq else s{h}_{g} end"""
        for h, g in slots
    ] + [f"case when kind='MIR' then null when kind='SDR' and head={h} and (site={x} or (site+2) % 4={x}) then site_grp else m{h}_{x} end" for h, x in maps]
    return cte("context_records").replace("with ", "with recursive ", 1) + f""",
 n as materialized (select *, row_number() over (partition by source_id order by seq) as rn, count(*) filter (kind='MIR') over (partition by source_id order by seq) as run,
   case when seq % 7=0 then ' ' else wafer_id end as wid, case when kind='WRR' and seq % 3=0 then 'F'||seq % 25 end as fab from context_records),
 f as (select source_id, 0::bigint as rn, {', '.join('null::bigint as ' + x for x in names)}, null::bigint as closed, null::bigint as sel from (select distinct source_id from context_records)
  union all select source_id, rn, {', '.join(steps)}, case when kind='WRR' then coalesce(held, c255) end, case when opens then seq when side then chosen end
   from (select *, side and chosen is null and (grp is not null or {count.replace('e.', '')}=0) as opens
    from (select e.*, {chosen} as chosen from (select n.source_id, n.rn, n.seq, n.kind, n.head, n.site, n.site_grp, {state}, {group} as grp, {at} as held,
      {', '.join(f'{mine(g)} as c{g}' for g in groups)}, n.{_SIDE} as side from f join n on n.source_id=f.source_id and n.rn=f.rn+1) e))),
 named as (select f.source_id, f.closed as seq, any_value(coalesce(nullif(trim(n.fab),''), nullif(trim(n.wid),''))) as name from f join n using (source_id, rn) where f.closed is not null group by 1,2)"""


@query("b05_partly_mapped", _free_fold_sql() + SESSION_SQL.format("context_records") + """
select p.source_id, n.run, p.head, p.site, p.open_seq as seq, p.part_sequence,
 coalesce(c.name, case when w.kind='WIR' then nullif(trim(w.wid),'') end) as wafer, case when f.sel is null then 'ambiguous_wafer' end as wafer_issue
 from numbered p join n on p.source_id=n.source_id and p.open_seq=n.seq join f on f.source_id=n.source_id and f.rn=n.rn
 left join named c on c.source_id=p.source_id and c.seq=f.sel left join n w on w.source_id=p.source_id and w.seq=f.sel""")
def _(spark, sf):
    """All context records as they are: any SDR maps some sites of a head at any time."""
    rows = materialize(stream.number_runs(_context(spark, sf)), "numbered-records")
    found = stream.attempts(stream.sessions(rows))
    runs = rows.select("source_id", "run", F.col("seq").alias("open_seq"))
    probes = found.join(runs, ["source_id", "open_seq"]).select("source_id", "run", "head", "site", F.col("open_seq").alias("seq"), "part_sequence")
    return stream.late_wafers(rows, probes)


@query("b06_sessions", cte("records") + SESSION_SQL.format("records") + " select source_id, head, site, open_seq, close_seq, tests, part_sequence from numbered")
def _(spark, sf):
    return stream.attempts(stream.sessions(adapters.records(spark, sf))).drop("session")


@query("b07_attempt_records", cte("records") + SESSION_SQL.format("records") + """
 select n.source_id, n.head, n.site, n.part_sequence, n.open_seq, n.close_seq,
  case when r.seq % 3=0 then 'U'||r.seq else 'H'||n.head||'_S'||n.site||'_P'||n.part_sequence end as part_id,
  (r.seq % 32 & 24)=0 as part_pass from numbered n join records r on n.source_id=r.source_id and n.close_seq=r.seq""")
def _(spark, sf):
    rows = adapters.records(spark, sf)
    typed = rows.select(
        "source_id", "seq", "head", "site", "kind", (F.col("seq") % 32).alias("part_flg"),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("U"), "seq")).alias("part_id"),
    )
    found = stream.attempt_records(typed, stream.attempts(stream.sessions(rows)))
    return found.select("source_id", "head", "site", "part_sequence", "open_seq", "close_seq", "part_id", "part_pass")


def _test_records(spark, sf) -> DataFrame:
    """Test records with the arrays of a multi-result record."""
    rows = adapters.measurements(spark, sf).withColumnsRenamed({"test_type": "kind", "record": "seq"})
    n = (F.col("attempt") % 4).cast("int")
    values = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.col("result") + i))
    return rows.withColumns({
        "rtn_rslt": values, "rtn_stat": F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))),
        "rslt_cnt": n + F.when(F.col("attempt") % 50 == 0, 1).otherwise(0),
        "rtn_icnt": n - F.when(F.col("attempt") % 47 == 0, 1).otherwise(0),
    })


_FLAT_SQL = cte("measurements") + """, flat as (
 select attempt, attempt*8+test_num as seq, test_num, 'PTR' as test_type, test_txt, 0 as expansion_index, result,
  case when test_flg & 64=0 then test_flg & 128=0 end as test_pass, lo_limit, hi_limit, units from measurements where test_type='PTR'
 union all select attempt, attempt*8+test_num, test_num, 'FTR', test_txt, 0, null, case when test_flg & 126=0 then test_flg & 128=0 end, null, null, null
  from measurements where test_type='FTR'
 union all select attempt, attempt*8+test_num, test_num, 'MPR', test_txt||' [MPR overall]', 0, null,
  case when test_flg & 126=0 then test_flg & 128=0 end, null, null, units from measurements where test_type='MPR'
 union all select attempt, attempt*8+test_num, test_num, 'MPR', test_txt||' [MPR result '||(i-1)||']', i, result+i, null, lo_limit, hi_limit, units
  from (select *, unnest(range(1, (attempt % 4)::int+1)) as i from measurements where test_type='MPR'))"""


@query("b08_flattened_measurements", _FLAT_SQL + " select * replace (round(result,6) as result) from flat")
def _(spark, sf):
    return stream.flatten_measurements(_test_records(spark, sf)).withColumn("result", F.round("result", 6))


@query("b09_array_length_errors", cte("measurements") + """ select attempt, attempt*8+test_num as seq, test_num from measurements
 where test_type='MPR' and (attempt % 50=0 or attempt % 47=0)""")
def _(spark, sf):
    return stream.array_length_errors(_test_records(spark, sf)).select("attempt", "seq", "test_num")


@query("b10_measurement_rows", cte("records") + SESSION_SQL.format("records") + """
 select n.source_id, n.head, n.site, n.part_sequence, n.open_seq, n.close_seq, o.seq, o.kind, round(o.value,6) as value
 from opened o join numbered n on o.source_id=n.source_id and o.head=n.head and o.site=n.site and o.open_seq=n.open_seq
 where n.close_seq is not null and o.kind in ('PTR','FTR','MPR')""")
def _(spark, sf):
    sessioned = stream.sessions(adapters.records(spark, sf))
    found = stream.measurement_rows(stream.attempts(sessioned), sessioned)
    return found.drop("session").withColumn("value", F.round("value", 6))


# Parametric records with optional fields, per source and run of their attempt.
_PTR_SQL = """select concat('S', l_orderkey % 8) as source_id, l_orderkey % 40 as run,
 case when l_linenumber=7 then 'MPR' else 'PTR' end as kind, l_linenumber as test_num,
 l_orderkey as k0, l_partkey as k1, l_suppkey as k2, l_extendedprice as k3, l_quantity as k4, l_shipdate as k5,
 case l_suppkey % 8 when 0 then null when 1 then 16 when 2 then 64 when 3 then 32 when 4 then 128 when 5 then 80 when 6 then 12 else 0 end as opt_flag,
 case when l_partkey % 4=0 then null else l_tax end as lo_limit, case when l_partkey % 5=0 then null else l_quantity end as hi_limit,
 case when l_partkey % 3=0 then null else l_linenumber*cast(10 as double) end as lo_spec,
 case when l_partkey % 6=0 then null else floor(l_discount*50) end as hi_spec,
 case l_partkey % 3 when 0 then null when 1 then '' else concat('u', l_suppkey % 5) end as units from lineitem"""

_ORDER = ["k0", "k1", "k2", "k3", "k4", "k5"]


def _inherit_sql() -> str:
    """The rule field by field; each status is computed once, in the step that its value reads."""
    masks = {"lo_limit": (16, 64, False), "hi_limit": (32, 128, False), "lo_spec": (0, 4, True), "hi_spec": (0, 8, True)}
    own, first, taken, final = [], [], [], []
    for n, (default, missing, spec) in masks.items():
        known = lambda opt: f"{opt} is not null" if default or missing else "true"
        own.append(f"""case when opt_flag & {missing} <> 0 then 'missing' when {n} is null or opt_flag & {default} <> 0 then 'unknown'
          when {known('opt_flag')} then 'valid' else 'unknown' end as {n}_own""")
        first.append(f"{n}_own as f_{n}_status, case when {n}_own='valid' then {n}::double end as f_{n}")
        changed = f" when f_{n}_status='valid' and f_{n}<>{n} then 'invalid'" if spec else ""
        taken.append(f"""coalesce({n} is null or opt & {default} <> 0, false) as {n}_taken,
         case when is_first then {n}_own when opt & {missing} <> 0 then 'missing' when {n} is null or opt & {default} <> 0 then
          case when f_{n}_status in ('valid','missing') then f_{n}_status else 'unknown' end when not ({known('opt')}) then 'unknown'{changed} else 'valid' end as {n}_status""")
        final.append(f"{n}_status, round(case when {n}_status='valid' then case when not is_first and {n}_taken then f_{n} else {n}::double end end, 6) as {n}")
    key = "source_id, run, kind, test_num"
    return f"""with p as ({_PTR_SQL}), t as (select *, row_number() over (partition by {key} order by {', '.join(_ORDER)})=1 as is_first from p),
 o as materialized (select *, {', '.join(own)} from t),
 f as materialized (select {key}, opt_flag as f_opt, units as f_units, {', '.join(first)} from o where is_first),
 j as (select *, coalesce(opt_flag, f_opt) as opt from o join f using ({key})),
 r as materialized (select *, {', '.join(taken)} from j)
 select {key}, k0, k1, k2, is_first as is_first_definition, case when not is_first and coalesce(units,'')='' then f_units else units end as units, {', '.join(final)} from r"""


@query("b11_definition_inheritance", _inherit_sql())
def _(spark, sf):
    adapters.tables(spark, sf, "lineitem")
    rows = spark.sql(_PTR_SQL).withColumn("seq", F.struct(*_ORDER)).drop("k3", "k4", "k5")
    found = stream.inherit_definitions(rows)
    return found.drop("seq", "opt_flag").withColumns({n: F.round(n, 6) for n in stream.DEFAULT_MASKS})


@query("b14_definition_only", cte("records") + _RUN_SQL.format("records") + """,
 t as (select *, seq % 12 as test_num, seq % 32 as test_flg, seq % 2 as parm_flg,
  min(seq) over (partition by source_id, run, kind, seq % 12) as f from r where kind in ('PTR')),
 u as (select t.*, e.kind as last_kind from t asof left join (select * from records where kind in ('PIR','PRR')) e
  on t.source_id=e.source_id and t.head=e.head and t.site=e.site and t.seq>=e.seq)
select source_id, run, kind, test_num, seq from u where seq=f and run>0 and test_flg & 16<>0 and parm_flg=0 and coalesce(last_kind,'PRR')='PRR'""")
def _(spark, sf):
    rows = stream.number_runs(adapters.records(spark, sf))
    tests = rows.filter("kind = 'PTR'").withColumns(
        {"test_num": F.col("seq") % 12, "test_flg": F.col("seq") % 32, "parm_flg": F.col("seq") % 2}
    )
    return stream.definition_only(tests, rows)


@query("b15_record_ownership", cte("context_records") + """, d as (select source_id, seq from context_records where kind='DTR'),
 ev as (select source_id, head, site, seq, case when kind='PIR' then seq else -1 end as state from context_records where kind in ('PIR','PRR')),
 hs as (select distinct source_id, head, site from ev),
 st as (select d.source_id, d.seq, e.state from (select d.*, h.head, h.site from d join hs h on d.source_id=h.source_id) d
  asof left join ev e on d.source_id=e.source_id and d.head=e.head and d.site=e.site and d.seq>=e.seq)
select source_id, seq, count(*) filter (state>=0) as open_count, case when count(*) filter (state>=0)=1 then max(state) end as unit_seq
 from st group by 1,2""")
def _(spark, sf):
    return stream.assign_records(adapters.context_records(spark, sf))
