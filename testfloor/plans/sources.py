"""Registered queries: reading, writing and comparing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from testfloor.operators import distribution, identity, quality, yields
from testfloor.plans import adapters, stdf_files
from testfloor.plans.adapters import cte
from testfloor.plans.registry import query
from testfloor.plans.yields import VERDICT_SQL, YIELD_COUNTS_SQL
from testfloor.session import materialize, scratch_path
from testfloor.sources import dataset, eav, stdf, tables
from testfloor.streaming import ingest as streaming

_NAME = "printf('S%d/run-%09d%s', block % 8, block, case when block % 4=1 then '.stdf.gz' when block % 7=3 then '.STD' else '.stdf' end)"

# What the files hold, said by the tables they were written from.
FILES_SQL = f"""with o as (select *, floor(o_orderkey/256)::bigint as block from orders),
 l as (select *, floor(l_orderkey/256)::bigint as block, case when l_linenumber=6 then 'FTR' when l_linenumber=7 then 'MPR' else 'PTR' end as kind from lineitem
   where l_orderkey in (select o_orderkey from orders)),
 blocks as (select block, count(*) as orders, count(*) filter (o_orderkey % 50=0) as customs from o group by 1),
 files as (select block, {_NAME} as name from blocks union all select block, 'copy/'||{_NAME} from blocks where block % 5=0),
 kinds as (select block, 'FAR' as kind, 1::bigint as n from blocks union all select block, 'MIR', 1 from blocks union all select block, 'DTR', 1 from blocks
  union all select block, 'ATER', 1 from blocks union all select block, 'UNKNOWN_99_77', 1 from blocks union all select block, 'SDR', 1 from blocks where block % 2=0
  union all select block, 'WIR', 1 from blocks union all select block, 'WRR', 1 from blocks union all select block, 'MRR', 1 from blocks where block % 11<>10
  union all select block, 'GDR', 1+customs from blocks union all select block, 'PIR', orders from blocks union all select block, 'PRR', orders from blocks
  union all select block, kind, count(*) from l group by 1,2)"""


def _records(spark, sf) -> DataFrame:
    """Records of all files, copies included."""
    return stdf_files.records(spark, sf)


def _unique(spark, sf) -> DataFrame:
    return stdf.unique_content(_records(spark, sf))


def _name(path: str = "path"):
    return F.regexp_extract(path, r"((copy/)?S\d+/run-.*)$", 1).alias("name")


@query("a01_discover", FILES_SQL + " select name from files")
def _(spark, sf):
    found = stdf.discover(spark, [stdf_files.folder(spark, sf)])
    return found.select(_name())


@query("a02_frames", FILES_SQL + """ select name, any_value(f.block % 3=2) as big_endian, sum(n)::bigint as records, sum(n)::bigint-1 as last_seq, true as contiguous,
 any_value(f.block % 11=10) as cut_short from files f join kinds using (block) group by 1""")
def _(spark, sf):
    good = F.col("kind") != "FRAME_ERROR"
    end = F.col("offset") + 4 + F.col("rec_len")
    per_file = _records(spark, sf).groupBy("source_id").agg(
        F.max("path").alias("path"),
        F.bool_or("big_endian").alias("big_endian"), F.count_if(good).alias("records"), F.max(F.when(good, F.col("record_seq"))).alias("last_seq"),
        (F.sum(F.when(good, F.col("rec_len") + 4)) == F.max(F.when(good, end))).alias("contiguous"), F.bool_or(~good).alias("cut_short"),
    )
    return per_file.select(_name(), "big_endian", "records", "last_seq", "contiguous", "cut_short")


_FLAG = "case l_returnflag when 'R' then 128 when 'A' then 0 else case l_suppkey % 3 when 0 then 16 when 1 then 64 else 1 end end"


@query("a02_small_blocks", FILES_SQL + """ select name, sum(n)::bigint as records, sum(n)::bigint-1 as last_seq, true as contiguous, any_value(f.block % 11=10) as cut_short,
 sum(case kind when 'PIR' then 6 when 'MRR' then 8 else 0 end * n)::bigint as known_bytes from files f join kinds using (block) group by 1""")
def _(spark, sf):
    """Every file framed in blocks of 8 KB, whose maps are composed in groups of 4."""
    good, size = F.col("kind") != "FRAME_ERROR", F.col("rec_len") + 4
    framed = stdf.frames(stdf_files.files(spark, sf), block_bytes=8192, group=4)
    per_file = framed.groupBy("source_id").agg(
        F.max("path").alias("path"), F.count_if(good).alias("records"), F.max(F.when(good, F.col("record_seq"))).alias("last_seq"),
        (F.sum(F.when(good, size)) == F.max(F.when(good, F.col("offset") + size))).alias("contiguous"), F.bool_or(~good).alias("cut_short"),
        F.sum(F.when(F.col("kind").isin("PIR", "MRR"), size)).alias("known_bytes"),
    )
    return per_file.select(_name(), "records", "last_seq", "contiguous", "cut_short", "known_bytes")


@query("a03_parametric_records", FILES_SQL + f""" select l_linenumber as test_num, l_orderkey % 4 as site_num, {_FLAG} as test_flg,
 round(l_extendedprice::float::double,2) as result, 'T'||l_linenumber as test_txt, case when l_linenumber % 2=1 then 5000e0 end as lo_limit,
 case when l_linenumber % 2=1 then 95000e0 end as hi_limit, case when l_linenumber % 2=1 then 'mA' end as units from l where kind='PTR'""")
def _(spark, sf):
    rows = stdf.decode(_unique(spark, sf), "PTR")
    return rows.select(
        "test_num", "site_num", "test_flg", F.round(F.col("result").cast("double"), 2).alias("result"), "test_txt",
        F.col("lo_limit").cast("double"), F.col("hi_limit").cast("double"), "units",
    )


@query("a03_multi_result_records", FILES_SQL + f""" select l_orderkey % 4 as site_num, {_FLAG} as test_flg, '1,2,3' as rtn_stat,
 round(l_extendedprice::float::double,2) as first_result, round((l_extendedprice+1)::float::double,2) as second_result from l where kind='MPR'""")
def _(spark, sf):
    rows = stdf.decode(_unique(spark, sf), "MPR")
    value = lambda i: F.round(F.element_at("rtn_rslt", i).cast("double"), 2)
    return rows.select(
        "site_num", "test_flg", F.concat_ws(",", F.col("rtn_stat").cast("array<string>")).alias("rtn_stat"),
        value(1).alias("first_result"), value(2).alias("second_result"),
    )


@query("a03_functional_records", FILES_SQL + f""" select 'pat'||l_suppkey % 10 as vect_nam, {_FLAG} as test_flg, 'T6' as test_txt, -2 as yfail_ad, -3 as vect_off,
 count(*) as n from l where kind='FTR' group by all""")
def _(spark, sf):
    rows = stdf.decode(_unique(spark, sf), "FTR")
    return rows.groupBy("vect_nam", "test_flg", "test_txt", "yfail_ad", "vect_off").agg(F.count("*").alias("n"))


@query("a03_part_records", FILES_SQL + """ select o_orderkey % 4 as site_num, case when o_orderkey % 41=0 then 4 when o_orderstatus='O' then 0 when o_orderstatus='F' then 8 else 16 end as part_flg,
 substring(o_orderpriority,1,1)::int as hard_bin, (o_orderkey % 6)*10 as soft_bin, case when o_custkey % 17=0 then -32768 else o_custkey % 50+1 end as x_coord,
 o_orderkey % 1000 as test_t, case when o_orderkey % 9<>0 then 'U'||o_orderkey end as part_id from o""")
def _(spark, sf):
    return stdf.decode(_unique(spark, sf), "PRR").select("site_num", "part_flg", "hard_bin", "soft_bin", "x_coord", "test_t", "part_id")


@query("a03_run_records", FILES_SQL + """ select 'LOT'||block % 10 as lot_id, 'JOB'||block % 8 as job_nam, 'r'||block % 2 as job_rev, 2000+block as start_t, 65535 as burn_tim,
 null::varchar as sblot_id from blocks""")
def _(spark, sf):
    return stdf.decode(_unique(spark, sf), "MIR").select("lot_id", "job_nam", "job_rev", "start_t", "burn_tim", "sblot_id")


_HEAD = "REC_CUSTM CHAR_ID CHAR_NAM TAGT_INS RSLT_TITLE EXE_ORDER BYPASS_FLG AXIS_CNT".split()
_AXIS = "AXIS_ID AXIS_NAM SETUP_SIG RSC_TYP RSC_NAM INIT_VAL RNG_FMT RNG_VAL RNG_RESO RNG_STEP RNG_FSTEP RNG_SCAL TRACK_CNT".split()
_TRACK = "TRACK_ID TRACK_NAM TRACK_SETUP_SIG TRACK_RSC_TYP TRACK_RSC_NAM TRACK_RNG_FMT TRACK_RNG_VAL TRACK_MARGIN_VAL".split()
_SETUP_NAMES = _HEAD + [f"AXES[0].{n}" for n in _AXIS] + [f"AXES[0].TRACKING[0].{n}" for n in _TRACK]
_RESULT_NAMES = "REC_CUSTM CHAR_ID_REF HEAD_NUM SITE_NUM TEST_NUM_REF CELL_COORD RSLT_TAGT_INS CELL_RSLT".split()


def _names_sql(record: str, names: list[str], rows: str) -> str:
    return f"select '{record}' as record, f as field, count(*) as n from {rows}, (select unnest({names!r}) as f) group by 2"


@query("a03_event_records", FILES_SQL + """ select kind, n, case kind when 'PTR' then (select sum(l_linenumber) from l where l.kind='PTR') when 'MPR' then 7*n when 'FTR' then 6*n end::bigint as tests
 from (select kind, sum(n)::bigint as n from kinds where kind<>'UNKNOWN_99_77' group by 1)""")
def _(spark, sf):
    """All types that carry stream state, decoded in one scan of the stored records."""
    rows = stdf.decode_events(_unique(spark, sf)).filter("kind <> 'FRAME_ERROR'")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("test_num").alias("tests"))


@query("a04_custom_records", FILES_SQL + f", c as ({_names_sql('CTSR', _SETUP_NAMES, 'blocks')} union all {_names_sql('CTRR', _RESULT_NAMES, '(select 1 from o where o_orderkey % 50=0)')})"
       """ select *, case when field='CHAR_ID_REF' then (select sum(o_orderkey) from o where o_orderkey % 50=0) end::bigint as ids from c""")
def _(spark, sf):
    fields = stdf.custom_fields(stdf.decode(_unique(spark, sf), "GDR"))
    reference = F.when(F.col("field") == "CHAR_ID_REF", F.col("value").cast("bigint"))
    return fields.groupBy("record", "field").agg(F.count("*").alias("n"), F.sum(reference).alias("ids"))


@query("a05_content_duplicates", FILES_SQL + " select block, case when block % 5=0 then 2 else 1 end as paths from blocks")
def _(spark, sf):
    return stdf.content_paths(_records(spark, sf)).select(stdf_files.block_of("first_path").alias("block"), "paths")


@query("a05_unique_records", FILES_SQL + " select kind, sum(n)::bigint as n from kinds group by 1")
def _(spark, sf):
    return _unique(spark, sf).filter("kind <> 'FRAME_ERROR'").groupBy("kind").agg(F.count("*").alias("n"))


_EAV_SQL = cte("dashboard_rows")


@query("a06_read_measurements", _EAV_SQL + """ select lot as lot_id, test_num, count(*) as n, count(result) as results, count(distinct attempt) as parts,
 count(*) filter (part_pass) as passed from dashboard_rows group by 1,2""")
def _(spark, sf):
    path = scratch_path(spark, "eav")
    adapters.eav_rows(spark, sf).write.parquet(path)
    rows = eav.read_eav(spark, path)
    return rows.groupBy("lot_id", "test_num").agg(
        F.count("*").alias("n"), F.count("result").alias("results"), F.count_distinct("part_sequence").alias("parts"), F.count_if("part_pass").alias("passed")
    )


@query("a07_write_measurements", _EAV_SQL + " select count(*) as rows from dashboard_rows")
def _(spark, sf):
    path, rows = scratch_path(spark, "eav"), adapters.eav_rows(spark, sf)
    eav.write_eav(rows, path)
    # A second write without overwriting keeps the first one.
    return eav.write_eav(rows.limit(0), path, overwrite=False).select("rows")


@query("a08_partitioned_write", _EAV_SQL + """ select lot as lot_p, case when wafer='' then '__empty' else wafer end as wafer_p, count(*) as n from dashboard_rows group by 1,2""")
def _(spark, sf):
    path = scratch_path(spark, "eav")
    eav.write_partitioned(adapters.eav_rows(spark, sf), path, ["lot_id", "wafer_id"])
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("lot_id_p").alias("lot_p"), F.col("wafer_id_p").alias("wafer_p")).agg(F.count("*").alias("n"))


@query("a08_partition_values", """select p_name as raw, list_aggregate(list_transform(string_split(p_name,''), lambda c: case when regexp_full_match(c,'[A-Z0-9_-]') then c
 else printf('%%%02X', ascii(c)) end), 'string_agg', '') as encoded, count(*) as n from part group by 1,2""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "part")
    return rows.groupBy(F.col("p_name").alias("raw"), eav.partition_value(F.col("p_name")).alias("encoded")).agg(F.count("*").alias("n"))


@query("a09_mixed_sources", cte("attempts") + """ select lot||run % 3 as source_id, concat_ws(',', case when count(distinct lot)>1 then 'lot_id' end,
 case when count(distinct coalesce(wafer,chr(1)))>1 then 'wafer_id' end) as mixed from attempts where (run % 3=0 or wafer='W3') group by 1
 having count(distinct lot)>1 or count(distinct coalesce(wafer,chr(1)))>1""")
def _(spark, sf):
    rows = adapters.attempts(spark, sf).filter("run % 3 = 0 or wafer = 'W3'")
    named = rows.select(F.concat("lot", (F.col("run") % 3).cast("string")).alias("source_id"), F.col("lot").alias("lot_id"), F.col("wafer").alias("wafer_id"))
    return eav.mixed_sources(named, ["lot_id", "wafer_id"])


def _measurements(files: DataFrame) -> eav.Converted:
    """Measurement rows of files, and the sources that are not whole."""
    return eav.convert(stdf.read_events(files))


_DATASETS: dict[tuple[str, str], tuple[str, str]] = {}


def _grown(spark, sf) -> tuple[str, str]:
    """A dataset of all files built in two ingest runs, and a snapshot pinned between them; once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DATASETS:
        root, files = scratch_path(spark, "dataset"), stdf.discover(spark, [stdf_files.folder(spark, sf)])
        dataset.ingest(spark, root, files.filter(stdf_files.block_of() % 2 == 0), _measurements)
        pinned = dataset.pin(spark, root)
        dataset.ingest(spark, root, files, _measurements)
        _DATASETS[key] = root, pinned
    return _DATASETS[key]


# Rows of a whole file: a multi-result record has one of its own and one per result.
_SOURCES_SQL = FILES_SQL + """, s as (select f.block, f.name, coalesce(k.n,0) as rows from files f
 left join (select block, sum(case when kind='MPR' then 3*n else n end)::bigint as n from kinds where kind in ('PTR','MPR','FTR') group by 1) k on f.block=k.block
 where f.block % 11<>10)"""


@query("a10_incremental_ingest", _SOURCES_SQL + " select name, rows, block % 2=0 as first_run from s")
def _(spark, sf):
    root, _ = _grown(spark, sf)
    now, before = dataset.sources(spark, root), dataset.sources(spark, root, 1).select("source_id", "generation")
    joined = now.join(before.withColumn("first_run", F.lit(True)), ["source_id", "generation"], "left")
    return joined.select(_name(), "rows", F.coalesce("first_run", F.lit(False)).alias("first_run"))


@query("a10_failed_sources", FILES_SQL + """ select name, 'FRAME_ERROR' as kind, 'unexpected end of file in record body' as error, sum(n)::bigint as record_seq
 from files f join kinds using (block) where f.block % 11=10 group by 1""")
def _(spark, sf):
    """Logs that are cut off: both runs met those of the first, which stay without a version."""
    root, _ = _grown(spark, sf)
    return dataset.errors(spark, root, 2).select(_name(), "kind", "error", "record_seq")


@query("a10_streaming_ingest", _SOURCES_SQL + " select name, rows from s")
def _(spark, sf):
    root = scratch_path(spark, "dataset")
    running = streaming.watch_files(spark, stdf_files.folder(spark, sf), root, scratch_path(spark, "checkpoint"), _measurements)
    running.awaitTermination()
    return dataset.sources(spark, root).select(_name(), "rows")


@query("a11_verification", _SOURCES_SQL + " select 0 as findings, count(*) as sources, sum(rows)::bigint as rows from s")
def _(spark, sf):
    root, _ = _grown(spark, sf)
    findings = dataset.verify(spark, root).agg(F.count("*")).scalar()
    listed = dataset.sources(spark, root).agg(F.count("*").alias("sources"), F.sum("rows").alias("rows"))
    return listed.withColumn("findings", findings)


@query("a12_pinned_read", FILES_SQL + """, r as (select l.*, name, unnest(case when kind='MPR' then [0,1,2] else [0] end) as i from files f join l using (block) where block % 2=0 and block % 11<>10)
 select 'LOT'||block % 10 as lot_id, kind as test_type, l_linenumber as test_num, count(*) as n,
 round(sum(case when kind='PTR' then l_extendedprice::float::double when i>0 then (l_extendedprice+i-1)::float::double end),0) as total,
 count(distinct name||l_orderkey) as parts, count(*) filter (kind='PTR' and l_linenumber % 2=1) as limited from r group by 1,2,3""")
def _(spark, sf):
    root, pinned = _grown(spark, sf)
    rows = eav.conform(dataset.read_pinned(spark, root, pinned).select(*[f.name for f in eav.EAV], "source_id"))
    part = F.struct("source_id", "part_sequence")
    return rows.groupBy("lot_id", "test_type", "test_num").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("result").cast("double")), 0).alias("total"),
        F.count_distinct(part).alias("parts"), F.count("lo_limit").alias("limited"),
    )


_DIGEST_SQL = cte("attempts") + """, d as (select lot, attempt, sha256(concat_ws(chr(31), '='||attempt, coalesce('='||wafer,'~'), '='||hard_bin, coalesce('='||x,'~'))) as digest from attempts)"""
_DIGEST = ["attempt", "wafer", "hard_bin", "x"]


@query("a13_multiset_digest", _DIGEST_SQL + """ select lot, count(*) as rows, sha256(concat_ws(':', count(*), sum(('0x'||substr(digest,1,15))::bigint), sum(('0x'||substr(digest,16,15))::bigint),
 sum(('0x'||substr(digest,31,15))::bigint), sum(('0x'||substr(digest,46,15))::bigint))) as multiset_digest from d group by 1""")
def _(spark, sf):
    return eav.multiset_digest(eav.row_digest(adapters.attempts(spark, sf), _DIGEST), ["lot"])


@query("a13_multiset_difference", _DIGEST_SQL + """, e as (select * from d where attempt % 100<>7 union all select * from d where attempt % 250=9)
select coalesce(a.digest,b.digest) as digest, coalesce(a.n,0) as left_rows, coalesce(b.n,0) as right_rows from (select digest, count(*) as n from d group by 1) a
 full join (select digest, count(*) as n from e group by 1) b on a.digest=b.digest where coalesce(a.n,0)<>coalesce(b.n,0)""")
def _(spark, sf):
    rows = eav.row_digest(adapters.attempts(spark, sf), _DIGEST)
    other = rows.filter("attempt % 100 <> 7").unionByName(rows.filter("attempt % 250 = 9"))
    return eav.multiset_difference(rows.select("digest"), other.select("digest"))


@query("a14_row_pairing", """with l as (select sha256('='||l_returnflag||chr(31)||'='||l_linenumber) as digest, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem),
 a as (select *, row_number() over (partition by digest order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) as copy from l),
 b as (select *, row_number() over (partition by digest order by l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_quantity) as copy from l where l_orderkey % 3<>0)
select a.digest, a.copy, a.l_orderkey as left_order, b.l_orderkey as right_order from a left join b on a.digest=b.digest and a.copy=b.copy""")
def _(spark, sf):
    rows = eav.row_digest(adapters.table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"])
    rest = ["l_partkey", "l_suppkey"]
    left = rows.select("digest", "l_orderkey", *rest, "l_extendedprice", "l_quantity")
    right = left.filter("l_orderkey % 3 <> 0").withColumnsRenamed({c: f"r_{c}" for c in left.columns if c != "digest"})
    paired = eav.pair_equal_rows(
        left, right, ["l_orderkey", *rest, "l_extendedprice", "l_quantity"],
        ["r_l_extendedprice", "r_l_orderkey", "r_l_partkey", "r_l_suppkey", "r_l_quantity"],
    )
    return paired.select("digest", "copy", F.col("l_orderkey").alias("left_order"), F.col("r_l_orderkey").alias("right_order"))


@query("a15_file_summary", FILES_SQL + """ select name, kind, n as records, sum(n) over (partition by name)::bigint as total_records, f.block % 11=10 as truncated
 from files f join kinds using (block)""")
def _(spark, sf):
    return stdf.file_summary(_records(spark, sf)).select(_name(), "kind", "records", "total_records", "truncated")


@query("a16_record_lines", FILES_SQL + f""", lines as (
 select 'PIR HEAD_NUM=1 SITE_NUM='||o_orderkey % 4 as line from o
 union all select 'PRR HEAD_NUM=1 SITE_NUM='||o_orderkey % 4||' NUM_TEST='||coalesce(n,0)||' HARD_BIN='||substring(o_orderpriority,1,1)||' SOFT_BIN='||(o_orderkey % 6)*10||' PART_ID='||
  case when o_orderkey % 9=0 then '' else 'U'||o_orderkey end||' PASSED='||(o_orderkey % 41<>0 and o_orderstatus='O' or o_orderkey % 41=0)
  from o left join (select l_orderkey, count(*) as n from l group by 1) c on o_orderkey=l_orderkey
 union all select 'PTR TEST_NUM='||l_linenumber||' HEAD_NUM=1 SITE_NUM='||l_orderkey % 4||' RESULT='||l_extendedprice::float||' TEST_TXT=T'||l_linenumber||' PASSED='||({_FLAG} & 128=0) from l where kind='PTR'
 union all select 'MPR TEST_NUM=7 HEAD_NUM=1 SITE_NUM='||l_orderkey % 4||' RTN_ICNT=3 RSLT_CNT=2 TEST_TXT=T7' from l where kind='MPR'
 union all select 'FTR TEST_NUM=6 HEAD_NUM=1 SITE_NUM='||l_orderkey % 4||' TEST_TXT=T6 PASSED='||({_FLAG} & 128=0) from l where kind='FTR'
 union all select 'FAR CPU_TYPE='||case when block % 3=2 then 1 else 2 end||' STDF_VER=4' from blocks
 union all select 'MIR LOT_ID=LOT'||block % 10||' PART_TYP=DEVICE JOB_NAM=JOB'||block % 8||' START_T='||2000+block from blocks
 union all select 'DTR TEXT_DAT=block '||block from blocks union all select 'ATER LEN=21' from blocks union all select 'UNKNOWN REC_TYP=99 REC_SUB=77 LEN=3' from blocks
 union all select 'SDR LEN=25' from blocks where block % 2=0
 union all select 'WIR HEAD_NUM=1 SITE_GRP='||case when block % 2=0 then 1 else 255 end||' START_T='||2000+block||' WAFER_ID=W'||block % 25 from blocks
 union all select 'WRR HEAD_NUM=1 SITE_GRP='||case when block % 2=0 then 1 else 255 end||' FINISH_T='||3000+block||' PART_CNT='||orders||' WAFER_ID=' from blocks
 union all select 'MRR FINISH_T='||4000+block||' DISP_COD=' from blocks where block % 11<>10
 union all select 'GDR FLD_CNT=8 GEN_DATA=CN(SHMOO_RESULT),U4('||o_orderkey||'),U1(1),U4('||o_orderkey % 4||'),CN(1),CN(0,0),CN(i),CN(P) CUSTOM_RECORD=CTRR REC_CUSTM=CN(SHMOO_RESULT) CHAR_ID_REF=U4('||o_orderkey||') HEAD_NUM=U1(1) SITE_NUM=U4('||o_orderkey % 4||') TEST_NUM_REF=CN(1) CELL_COORD=CN(0,0) RSLT_TAGT_INS=CN(i) CELL_RSLT=CN(P)' from o where o_orderkey % 50=0
 union all select 'GDR FLD_CNT=30 GEN_DATA=PAD,'||array_to_string(v,',')||' CUSTOM_RECORD=CTSR '||array_to_string(list_transform(list_zip({_SETUP_NAMES!r}, v), lambda z: z[1]||'='||z[2]),' ') from
  (select ['CN(SHMOO)','CN(0x'||lower(to_hex(block))||')','CN(name)','CN(ins)','CN(title)','CN(o)','CN(N)','U1(1)','U1(1)','CN(VDD)','CN(s)','CN(DPS)','CN(r)','CN(1.0)','CN(f)','CN(0:2)','R8(0.5)','U4(4)','U4(2)','CN(lin)','U1(1)','U1(1)','CN(T)','CN(s)','CN(t)','CN(n)','CN(f)','CN(1:2)','R8(0.25)'] as v from blocks))
select line, count(*) as n from lines group by 1""")
def _(spark, sf):
    return stdf.record_lines(_unique(spark, sf)).groupBy("line").agg(F.count("*").alias("n"))


_RISKY = "case p_size % 6 when 0 then '=' when 1 then '+' when 2 then '@' when 3 then '-' else '' end||p_name"


@query("a17_csv_export", f"""with r as (select p_partkey::varchar as id, {_RISKY} as label from part)
select id, case when substr(label,1,1) in ('=','+','@','-') then ''''||label else label end as label from r""")
def _(spark, sf):
    size = F.col("p_size") % 6
    sign = F.when(size == 0, "=").when(size == 1, "+").when(size == 2, "@").when(size == 3, "-").otherwise("")
    path = scratch_path(spark, "export")
    rows = adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(sign, "p_name").alias("label"))
    eav.export(rows, path)
    return spark.read.option("header", "true").csv(path)


@query("a17_json_export", cte("attempts") + " select attempt, lot, wafer, duration_ms from attempts where wafer is not null")
def _(spark, sf):
    path = scratch_path(spark, "export")
    rows = adapters.attempts(spark, sf).filter("wafer is not null").select("attempt", "lot", "wafer", "duration_ms")
    eav.export(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


def _evidence_sql() -> str:
    """Field rows per record type: how many fields a record of the files holds."""
    held = {  # record type: (variant condition over its rows, fields present)
        "FAR": [("blocks", 2)], "MIR": [("blocks", 14)], "DTR": [("blocks", 1)], "ATER": [("blocks", 6)],
        "SDR": [("(select * from blocks where block % 2=0)", 8)], "WIR": [("blocks", 4)], "WRR": [("blocks", 4)],
        "MRR": [("(select * from blocks where block % 11<>10)", 1)], "PIR": [("o", 2)],
        "PRR": [("(select * from o where o_orderkey % 9=0)", 9), ("(select * from o where o_orderkey % 9<>0)", 10)],
        "PTR": [("(select * from l where kind='PTR' and l_linenumber % 2=1)", 15), ("(select * from l where kind='PTR' and l_linenumber % 2=0)", 7)],
        "MPR": [("(select * from l where kind='MPR')", 10)], "FTR": [("(select * from l where kind='FTR')", 23)],
        "GDR": [("(select 1 from blocks union all select 1 from o where o_orderkey % 50=0)", 2)],
    }
    parts = []
    for record, variants in held.items():
        names = [f.name for f in stdf.layouts()[record]]
        for rows, present in variants:
            names = names + ["ACTIVITY_BYTES"] if record == "ATER" else names
            states = [(n, "present" if i < present else "omitted") for i, n in enumerate(names)] + [(n, "present") for n in ("REC_LEN", "REC_TYP", "REC_SUB")]
            listed = ", ".join(f"('{n}','{s}')" for n, s in states)
            parts.append(f"select '{record}' as record, v.f as field, v.s as presence from {rows} r, (values {listed}) v(f, s)")
    return FILES_SQL + ", e as (" + " union all ".join(parts) + ") select record, field, presence, count(*) as n from e group by 1,2,3"


@query("a18_field_evidence", _evidence_sql())
def _(spark, sf):
    fields = stdf.field_evidence(stdf.dealt(_unique(spark, sf)), ("record", "field", "presence"))
    return fields.groupBy("record", "field", "presence").agg(F.count("*").alias("n"))


@query("a18_evidence_status", FILES_SQL + """ select 'PRR' as record, 'X_COORD' as field, case when o_custkey % 17=0 then 'missing' else 'valid' end as status, count(*) as n from o group by all
 union all select 'PRR', 'PART_ID', case when o_orderkey % 9=0 then 'missing' else 'valid' end, count(*) from o group by all
 union all select 'MIR', 'BURN_TIM', 'missing', count(*) from blocks
 union all select 'PTR', 'RESULT', case when l_returnflag='N' and l_suppkey % 3<>1 then 'invalid' else 'valid' end, count(*) from l where kind='PTR' group by all""")
def _(spark, sf):
    checked = quality.field_status(stdf.field_evidence(stdf.dealt(_unique(spark, sf))))
    wanted = F.concat_ws(".", "record", "field").isin("PRR.X_COORD", "PRR.PART_ID", "MIR.BURN_TIM", "PTR.RESULT")
    return checked.filter(wanted).groupBy("record", "field", "status").agg(F.count("*").alias("n"))


@query("h15_decode_findings", FILES_SQL + """ select rule, n as findings from (select 'framing' as rule, count(*) as n from files where block % 11=10
 union all select 'unsupported_record', count(*) from files) where n>0""")
def _(spark, sf):
    return quality.decode_findings(_records(spark, sf)).groupBy("rule").agg(F.count("*").alias("findings"))


@query("b10_convert_files", FILES_SQL + """, p as (select *, row_number() over (partition by block order by o_orderkey) as part_sequence from o),
 r as (select 'LOT'||p.block % 10 as lot_id, 'W'||p.block % 25 as wafer_id, part_sequence, o_custkey, kind as test_type, l_linenumber as test_num,
  unnest(case when kind='MPR' then [0,1,2] else [0] end) as i, l_extendedprice as v, l_returnflag, l_suppkey, o_orderkey,
  case when o_custkey % 17<>0 then 1 end as known from p join l on l.l_orderkey=p.o_orderkey)
select lot_id, wafer_id, test_type, case when test_type='MPR' then case when i=0 then 'T7 [MPR overall]' else 'T7 [MPR result '||(i-1)||']' end else 'T'||test_num end as test_txt,
 count(*) as rows, sum(part_sequence)::bigint as sequences, count(*) filter (test_type='PTR' or i>0) as results,
 round(sum(case when test_type='PTR' then v::float::double when i>0 then (v+i-1)::float::double end),0) as total,
 count(known) as identified, count(*) filter (o_orderkey % 9=0) as default_parts from r group by all""")
def _(spark, sf):
    rows = eav.convert(stdf.read_events(stdf_files.files(spark, sf), unique=True)).rows
    return rows.groupBy("lot_id", "wafer_id", "test_type", "test_txt").agg(
        F.count("*").alias("rows"), F.sum("part_sequence").alias("sequences"), F.count("result").alias("results"),
        F.round(F.sum(F.col("result").cast("double")), 0).alias("total"), F.count("part_merge_key").alias("identified"),
        F.count_if(F.col("part_id").startswith("H1_S")).alias("default_parts"),
    )


@query("f01_running_yield", cte("attempts") + """ select lot, count(*) as attempts, count(*) filter (flags & 20=0 and flags & 8=0) as pass,
 count(*) filter (flags & 20=0 and flags & 8<>0) as fail, count(*) filter (flags & 20<>0) as unknown from attempts group by 1""")
def _(spark, sf):
    arriving = scratch_path(spark, "attempts")
    rows = adapters.attempts(spark, sf).select("lot", "flags")
    rows.write.parquet(arriving)
    counts = streaming.running_yield(spark, arriving, rows.schema, "lot")
    name = "running_yield_" + arriving.rsplit("-", 1)[1]
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option(
        "checkpointLocation", scratch_path(spark, "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# --- logs to results ----------------------------------------------------------------

_BUILT: dict[tuple[str, str], tables.Tables] = {}


def _tables(spark, sf) -> tables.Tables:
    """Attempts and tests of all files, stored once per application as an ingest job would."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = tables.stored(tables.build(stdf.read_events(stdf_files.files(spark, sf), unique=True, context=tables.CONTEXT)))
    return _BUILT[key]


_PARTS_SQL = """, a as (select *, 'LOT'||block % 10 as lot, case when o_orderkey % 41=0 then 4 when o_orderstatus='O' then 0 when o_orderstatus='F' then 8 else 16 end as flags,
  case when o_custkey % 17<>0 then 1 end as ecid from o)"""


@query("f03_lot_comparison_from_files", FILES_SQL + _PARTS_SQL + f""",
 rows as (select lot as key, false as excluded, {VERDICT_SQL} as verdict, ecid from a), counts as ({YIELD_COUNTS_SQL})
select *, round(pass::double/nullif(eligible,0),6) as yield_all, round(pass::double/nullif(pass+fail,0),6) as yield_known,
  case when eligible=0 then 'zero-eligible' end as yield_all_reason, case when pass+fail=0 then 'zero-known' end as yield_known_reason from counts""")
def _(spark, sf):
    return yields.lot_comparison(yields.requested(_tables(spark, sf).attempts))


@query("a02_cut_off_sources", FILES_SQL + """ select min(name) as name, block, 'FRAME_ERROR' as kind, 'unexpected end of file in record body' as error, any_value(orders) as attempts
 from files join blocks using (block) where block % 11=10 group by block""")
def _(spark, sf):
    """Logs that are not whole in the tables of attempts and tests, with the attempts that were read before the end."""
    built = _tables(spark, sf)
    counts = built.attempts.groupBy("source_id").agg(F.count("*").alias("attempts"))
    return built.errors.join(counts, "source_id", "left").select(_name(), stdf_files.block_of().alias("block"), "kind", "error", "attempts")


@query("e05_latest_from_files", FILES_SQL + """,
 d as (select o_orderkey, block, case when o_custkey % 17<>0 then block % 10||'|'||block % 25||'|'||o_custkey % 50||'|'||o_custkey // 50 end as ecid from o),
 f as (select case when ecid is null then 'unresolved' when block<max(block) over (partition by ecid) then 'earlier'
   when o_orderkey=max(o_orderkey) over (partition by ecid, block) then 'latest' else 'earlier' end as state from d)
select state, count(*) as n from f group by 1""")
def _(spark, sf):
    flagged = identity.latest_pareto(_tables(spark, sf).attempts)
    state = F.when(F.col("is_latest").isNull(), "unresolved").when(F.col("is_latest"), "latest").otherwise("earlier")
    return flagged.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("f22_statistics_from_files", FILES_SQL + f""", r as (select *, {_FLAG} as flg from l),
 e as (select kind, l_linenumber as num, null::int as channel, l_extendedprice::float::double as v, flg from r where kind='PTR'
  union all select kind, l_linenumber, null, null, flg from r where kind in ('FTR','MPR')
  union all select kind, l_linenumber, c, (l_extendedprice+c)::float::double, flg from r, (select unnest([0,1]) as c) x where kind='MPR')
select kind, num::bigint as number, channel, count(case when flg & 63=0 then v end) as count,
 count(*) filter (v is not null and flg & 63<>0) as invalid, count(*) filter (v is null) as not_numeric, round(avg(case when flg & 63=0 then v end),2) as mean
 from e group by 1,2,3""")
def _(spark, sf):
    tests = _tables(spark, sf).tests
    found = distribution.statistics(distribution.series(tests.withColumn("units", F.lit(""))))
    key = F.from_json("test", "array<string>")
    named = found.select(
        key[0].alias("kind"), key[1].cast("bigint").alias("number"), key[3].cast("int").alias("channel"), "count", "invalid", "not_numeric",
        F.round("mean", 2).alias("mean"),
    )
    return named
