"""The driver's tables seen as tester data.

Customer is a device, order an attempt, lineitem a test execution and event a
record. The view texts run unchanged in Spark SQL and DuckDB; the oracle of a
query uses the same text as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from testfloor.functions import keys, verdicts
from testfloor.operators.identity import latest_engineering
from testfloor.session import sorting_tasks
from testfloor.sources.eav import EAV

ATTEMPTS_SQL = """
select o_orderkey+1 as attempt, concat('S', o_orderkey % 8) as source_id,
       year(o_orderdate)*12+month(o_orderdate) as run,
       case when o_orderkey % 97 = 0 then null
            else (year(o_orderdate)*12+month(o_orderdate))*100+day(o_orderdate) end as start_t,
       (year(o_orderdate)*12+month(o_orderdate))*100+day(o_orderdate)+3 as finish_t,
       c_mktsegment as lot,
       case when c_nationkey=0 then null when c_nationkey=1 then '' else concat('W', c_nationkey) end as wafer,
       1 as head, o_orderkey % 4 as site,
       case when o_orderkey % 41 = 0 then 4 when o_orderstatus='O' then 0 when o_orderstatus='F' then 8 else 16 end as flags,
       cast(substring(o_orderpriority,1,1) as int) as hard_bin, (o_orderkey % 6)*10 as soft_bin,
       case when o_custkey % 17 = 0 then null else o_custkey % 50 + 1 end as x,
       case when o_custkey % 17 = 0 then null else cast(floor(o_custkey / 50) as int) + 1 end as y,
       cast(floor(o_totalprice) as bigint) as duration_ms,
       case when o_custkey % 17 = 0 then null
            else concat(c_mktsegment,'|',coalesce(case when c_nationkey=0 then null when c_nationkey=1 then ''
                 else concat('W', c_nationkey) end,'[null]'),'|',o_custkey % 50 + 1,'|',
                 cast(floor(o_custkey / 50) as int) + 1) end as ecid
from orders join customer on o_custkey = c_custkey
"""

MEASUREMENTS_SQL = """
select l_orderkey+1 as attempt, l_linenumber as test_num,
       case when l_linenumber=6 then 'FTR' when l_linenumber=7 then 'MPR' else 'PTR' end as test_type,
       concat('T', l_linenumber) as test_txt,
       case when l_linenumber=6 then null else l_extendedprice end as result,
       case when l_returnflag='N' then null else l_returnflag='A' end as test_pass,
       case when l_linenumber<=4 then cast(5000 as double) end as lo_limit,
       case when l_linenumber<=4 then cast(95000 as double) end as hi_limit,
       case when l_linenumber % 2 = 0 then 'V' else 'mA' end as units,
       case when l_linenumber=6 then concat('pat', l_suppkey % 10) end as pattern,
       case l_returnflag when 'R' then 128 when 'A' then 0
            else case l_suppkey % 3 when 0 then 16 when 1 then 64 else 1 end end as test_flg,
       l_partkey as o1, l_suppkey as o2, l_extendedprice as o3, l_quantity as o4, l_shipdate as o5
from lineitem
"""

RECORDS_SQL = """
select concat('S', user_id % 10) as source_id, event_id as seq, 1 as head, (user_id + event_id) % 4 as site,
       case when event_type='signup' then 'PIR' when event_type='purchase' then 'PRR'
            when event_type='view' then 'PTR' when event_type='click' then 'FTR'
            when value >= 100 then 'MIR' when event_id % 2 = 0 then 'WIR' else 'WRR' end as kind, value
from events
"""

# The record stream with the other context records: site maps, program sections, text.
CONTEXT_RECORDS_SQL = """
select concat('S', user_id % 10) as source_id, event_id as seq, 1 + event_id % 2 as head,
       (user_id + event_id) % 4 as site,
       case when event_type='signup' then 'PIR' when event_type='purchase' then 'PRR'
            when event_type='view' then 'PTR' when event_type='click' then 'FTR'
            when value >= 100 then 'MIR'
            when user_id % 9 <= 2 then 'WIR' when user_id % 9 <= 4 then 'WRR' when user_id % 9 = 5 then 'SDR'
            when user_id % 9 = 6 then 'BPS' when user_id % 9 = 7 then 'EPS' else 'DTR' end as kind,
       case when user_id % 5 = 0 then 255 else event_id % 3 end as site_grp,
       concat('W', event_id % 25) as wafer_id, value
from events
"""

# The record stream with run ends and file headers, for the structure checks.
SANITY_RECORDS_SQL = """
select concat('S', user_id % 10) as source_id, event_id as seq, 1 as head, (user_id + event_id) % 3 as site,
       case when event_type='signup' then 'PIR' when event_type='purchase' then 'PRR'
            when event_type='view' then 'PTR' when event_type='click' then 'FTR'
            when value >= 60 then case when event_id % 2 = 0 then 'MIR' else 'MRR' end
            when user_id % 9 <= 2 then 'WIR' when user_id % 9 <= 4 then 'WRR' when user_id % 9 = 5 then 'SDR'
            when user_id % 9 = 6 then 'BPS' when user_id % 9 = 7 then 'EPS'
            when event_id % 4 = 0 then 'FAR' else 'DTR' end as kind,
       case when user_id % 5 = 0 then 255 else event_id % 2 end as site_grp,
       case when event_id % 6 = 0 then '' else concat('W', event_id % 25) end as wafer_id, value
from events
"""

# The record stream of the strict wafer rule: in every run the sites of head 1 are
# mapped to two groups, those of head 2 are not mapped.
LATE_RECORDS_SQL = """
select source_id, seq * 10 as seq, head, site, kind, cast(null as bigint) as site2,
       case when kind not in ('WIR','WRR') then null when head = 1 then cast(floor(seq / 2) as bigint) % 2
            when seq % 5 = 0 then 255 else cast(floor(seq / 2) as bigint) % 2 end as site_grp,
       case when seq % 7 = 0 then ' ' else wafer_id end as wafer_id,
       case when kind = 'WRR' and seq % 3 = 0 then concat('F', seq % 25) end as fabwf_id
from {records} where kind <> 'SDR'
union all
select source_id, seq * 10 + 1, 1, cast(0 as bigint), 'SDR', cast(1 as bigint), cast(0 as bigint), null, null from {records} where kind = 'MIR'
union all
select source_id, seq * 10 + 2, 1, cast(2 as bigint), 'SDR', cast(3 as bigint), cast(1 as bigint), null, null from {records} where kind = 'MIR'
"""

# Fields of part and parametric records, one row per field.
_PRR_FIELD = "select concat('S', o_orderkey % 8) as source_id, o_orderkey * 10 as offset, 'PRR' as record, case when o_orderkey % 8 < 3 then 'cp' when o_orderkey % 8 < 6 then 'ft' else 'unknown' end as flow, {} as field, {} as kind, {} as presence, {} as text, {} as number, cast(null as int) as test_flg, cast(null as int) as opt_flag from orders"
_PTR_FIELD = "select concat('S', l_orderkey % 8) as source_id, l_orderkey * 10 + l_linenumber as offset, 'PTR' as record, case when l_orderkey % 8 < 3 then 'cp' when l_orderkey % 8 < 6 then 'ft' else 'unknown' end as flow, {} as field, {} as kind, {} as presence, {} as text, {} as number, cast(case l_suppkey % 4 when 0 then 16 when 1 then 128 else 0 end as int) as test_flg, cast(case l_suppkey % 7 when 0 then null when 1 then 64 when 2 then 32 when 3 then 12 else 0 end as int) as opt_flag from lineitem"
_CTSR_FIELD = "select concat('S', user_id % 10) as source_id, event_id * 10 as offset, 'CTSR' as record, case when user_id % 10 < 5 then 'cp' else 'ft' end as flow, {} as field, {} as kind, {} as presence, {} as text, {} as number, cast(null as int) as test_flg, cast(null as int) as opt_flag from events where event_type='click'"
_NO_TEXT, _NO_NUMBER = "cast(null as string)", "cast(null as double)"
_FIELDS = [
    (_PRR_FIELD, "'HARD_BIN'", "'U2'", "'present'", _NO_TEXT, "cast(o_custkey * 37 % 40000 as double)"),
    (_PRR_FIELD, "'SOFT_BIN'", "'U2'", "'present'", _NO_TEXT, "cast(case when o_custkey % 11 = 0 then 65535 else o_custkey % 100 end as double)"),
    (_PRR_FIELD, "'X_COORD'", "'I2'", "case when o_orderkey % 19 = 0 then 'omitted' else 'present' end", _NO_TEXT,
     "cast(case when o_orderkey % 19 = 0 then null when o_custkey % 13 = 0 then -32768 else o_custkey % 90 end as double)"),
    (_PRR_FIELD, "'PART_ID'", "'Cn'", "'present'",
     "case when o_orderkey % 23 = 0 then '' when o_orderkey % 29 = 0 then concat('é', o_custkey) else concat('UNIT', o_custkey) end", _NO_NUMBER),
    (_PRR_FIELD, "'PART_TXT'", "'Cn'", "'omitted'", _NO_TEXT, _NO_NUMBER),
    (_PTR_FIELD, "'RESULT'", "'R4'", "'present'", _NO_TEXT, "case when l_partkey % 31 = 0 then cast('NaN' as double) else l_extendedprice end"),
    (_PTR_FIELD, "'LO_LIMIT'", "'R4'", "'present'", _NO_TEXT, "l_tax"),
    (_PTR_FIELD, "'HI_SPEC'", "'R4'", "case when l_partkey % 9 = 0 then 'omitted' else 'present' end", _NO_TEXT, "case when l_partkey % 9 = 0 then null else l_discount end"),
    (_PTR_FIELD, "'UNITS'", "'Cn'", "'present'", "case when l_linenumber % 2 = 0 then 'V' else ' ' end", _NO_NUMBER),
    (_CTSR_FIELD, "'CHAR_NAM'", "'Cn'", "'present'", "concat('C', event_id % 9)", _NO_NUMBER),
    (_CTSR_FIELD, "'AXES[0].AXIS_NAM'", "'Cn'", "'present'", "case when event_id % 5 = 0 then ' ' else 'VDD' end", _NO_NUMBER),
    (_CTSR_FIELD + " and event_id % 2 = 0", "'AXES[1].INIT_VAL'", "'Cn'", "'present'", "'1.2'", _NO_NUMBER),
    (_CTSR_FIELD + " and event_id % 3 = 0", "'AXES[0].TRACKING[0].TRACK_ID'", "'U1'", "'present'", _NO_TEXT, "cast(event_id % 4 as double)"),
]
FIELDS_SQL = " union all ".join(part[0].format(*part[1:]) for part in _FIELDS)

# Order of a measurement inside the whole table; seven columns, unique together.
MEASUREMENT_ORDER = ["attempt", "test_num", "o1", "o2", "o3", "o4", "o5"]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register driver tables as views; columns are pruned by each query."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders", "customer")
    return spark.sql(ATTEMPTS_SQL)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec`` orders the rows of the table; it stands for the record number."""
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(MEASUREMENTS_SQL).withColumn("rec", F.struct(*MEASUREMENT_ORDER))
    # The record number of a row up to repeats of a test; only ``rec`` is unique.
    rows = rows.withColumn("record", F.col("attempt") * 8 + F.col("test_num"))
    return rows.drop("o1", "o2", "o3", "o4", "o5")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(RECORDS_SQL)


def context_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(CONTEXT_RECORDS_SQL)


def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    context_records(spark, sf_dir).createOrReplaceTempView("late_base")
    rows = spark.sql(LATE_RECORDS_SQL.format(records="late_base"))
    return rows.withColumn("sites", F.array("site", "site2")).drop("site2").withColumn("site_grp", F.col("site_grp").cast("int"))


def sanity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(SANITY_RECORDS_SQL)


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders", "lineitem", "events")
    return spark.sql(FIELDS_SQL).withColumn("bad_padding", F.lit(False))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with the context of their attempt on every row.

    What follows in the tasks of the join holds their attempts, so there are more of them for more rows.
    """
    rows = measurements(spark, sf_dir)
    tasks = sorting_tasks(rows.count(), spark)
    return rows.repartition(tasks, "attempt").join(attempts(spark, sf_dir).repartition(tasks, "attempt"), "attempt")


def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows in the shape of the EAV table, with the device of each row."""
    rows = test_rows(spark, sf_dir)
    merge = keys.wafer_merge_key(F.col("wafer"), F.col("x"), F.col("y"))
    rows = rows.withColumn("part_merge_key", merge).withColumn("part_pass", verdicts.part_pass(F.col("flags")))
    device = keys.device_key(F.col("part_merge_key"), F.col("source_id"), F.col("attempt"))
    part = F.when(F.col("attempt") % 101 == 0, "").otherwise(F.concat(F.lit("P"), "attempt"))
    return rows.withColumn("device", device).withColumn("part_id", part)


def eav_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows under the column names of the stored table."""
    rows = dashboard_rows(spark, sf_dir)
    names = {
        "lot_id": "lot", "wafer_id": "wafer", "head_num": "head", "site_num": "site", "x_coord": "x", "y_coord": "y",
        "test_time_ms": "duration_ms", "part_sequence": "attempt",
    }
    columns = [F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in EAV]
    return rows.select(*columns, "source_id")


def engineering_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows with verdict, usable value, key, and the device flags."""
    rows = measurements(spark, sf_dir)
    kind, flags, result = F.col("test_type"), F.col("test_flg"), F.col("result").cast("double")
    channel = F.when(kind == "MPR", F.lit(0))
    no_flags = F.lit(0)
    rows = rows.select(
        "attempt", "rec", "record", kind.alias("kind"), F.col("test_num").alias("number"),
        F.col("test_txt").alias("name"), channel.alias("channel"), "pattern", "units",
        F.col("lo_limit").alias("low"), F.col("hi_limit").alias("high"), "test_flg",
        keys.engineering_test_key(kind, F.col("test_num"), F.col("test_txt"), channel).alias("test"),
        F.when(kind != "FTR", verdicts.effective_result(result, flags, no_flags)).alias("value"),
        verdicts.value_state(kind, channel, result, result, flags, no_flags).alias("value_state"),
        F.when(channel.isNull(), verdicts.reliable_test_pass(flags)).alias("passed"),
        verdicts.alarm(flags, F.lit("")).alias("alarm"),
    )
    context = latest_engineering(attempts(spark, sf_dir)).drop("start_t", "finish_t", "ecid", "issue", "flags")
    return rows.join(context, "attempt")


def engineering_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with verdict and device flags."""
    rows = latest_engineering(attempts(spark, sf_dir))
    return rows.withColumn("passed", verdicts.attempt_passed(F.col("flags")))


def cte(*names: str) -> str:
    """``with`` clause of the oracle texts for the named views."""
    order = "attempt, test_num, o1, o2, o3, o4, o5"
    texts = {
        "attempts": ATTEMPTS_SQL,
        "measurements": f"select *, row_number() over (order by {order}) as record_seq from ({MEASUREMENTS_SQL})",
        "records": RECORDS_SQL,
        "context_records": CONTEXT_RECORDS_SQL,
        "sanity_records": SANITY_RECORDS_SQL,
        "fields": FIELDS_SQL,
        "late_records": LATE_RECORDS_SQL.format(records="context_records"),
    }
    texts["test_rows"] = "select * from measurements join attempts using (attempt)"
    texts["dashboard_rows"] = """select *,
      case when merge_key is null then '["unresolved","'||source_id||'",'||attempt||']' else merge_key end as device
      from (select *, case when wafer ~ '^[A-Z0-9]+$' and x>0 and y>0
              then '["wafer-prr","'||wafer||'",'||x||','||y||']' end as merge_key,
              (flags & 24)=0 as part_pass, case when attempt % 101=0 then '' else 'P'||attempt end as part_id,
              coalesce(not test_pass,false) or coalesce(result<lo_limit,false) or coalesce(result>hi_limit,false) as failed
            from test_rows)"""
    needed = list(names)
    if "dashboard_rows" in needed and "test_rows" not in needed:
        needed.insert(0, "test_rows")
    if "test_rows" in needed:
        needed = ["attempts", "measurements"] + [n for n in needed if n not in ("attempts", "measurements")]
    return "with " + ",\n".join(f"{n} as ({texts[n]})" for n in needed)
