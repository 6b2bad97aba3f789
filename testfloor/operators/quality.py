"""Validation rules over the record stream; every rule gives rows of one findings table.

Findings: ``source_id, severity, rule, record_type, seq, message``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from testfloor.functions import keys, verdicts
from testfloor.operators.joins import attach_few
from testfloor.operators.ordered import CHUNK_ROWS, Running, carry
from testfloor.operators.stream import ALL_SITES, open_wafers
from testfloor.session import materialize, shuffled


def finding(df: DataFrame, severity: str, rule: str, record_type, message: Column, seq: Column | None = None) -> DataFrame:
    kind = F.lit(record_type) if record_type is None or isinstance(record_type, str) else record_type
    return df.select(
        "source_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), kind.cast("string").alias("record_type"),
        (F.col("seq") if seq is None else seq).cast("bigint").alias("seq"), message.alias("message"),
    )


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _no_seq() -> Column:
    return F.lit(None).cast("bigint")


def _pairing(events: DataFrame, key: list[str], opening: str, closing: str, rule: str, where: Column, chunk_rows: int) -> DataFrame:
    """Opening and closing records must alternate per ``key``."""
    seen = carry(
        events, key, "seq", chunk_rows,
        before=Running("last", F.col("kind"), include_row=False),
    )
    reopened = seen.filter((F.col("kind") == opening) & (F.col("before") == opening))
    unmatched = seen.filter((F.col("kind") == closing) & (F.coalesce("before", F.lit(closing)) == closing))
    last = events.groupBy(*key).agg(F.max(F.struct("seq", "kind")).alias("e")).select(*key, "e.seq", "e.kind")
    left_open = last.filter(F.col("kind") == opening)
    text = lambda what: F.concat(F.lit(f"{what} for "), where)
    return all_findings([
        finding(reopened, "error", rule, opening, text(f"{opening} opened while the previous one never closed")),
        finding(unmatched, "error", rule, closing, text(f"{closing} has no matching {opening}")),
        finding(left_open, "error", rule, opening, text(f"{opening} never closed")),
    ])


def part_pairing(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    key = ["source_id", "head", "site"]
    events = records.filter(F.col("kind").isin("PIR", "PRR")).select(*key, "seq", "kind")
    where = F.format_string("head=%d site=%d", "head", "site")
    return _pairing(events, key, "PIR", "PRR", "STRUCT/PIR_PRR_PAIR", where, chunk_rows)


def wafer_pairing(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    key = ["source_id", "head", "grp"]
    events = records.filter(F.col("kind").isin("WIR", "WRR")).select(
        "source_id", "head", F.coalesce("site_grp", F.lit(ALL_SITES)).cast("int").alias("grp"), "seq", "kind"
    )
    where = F.format_string("head=%d site_grp=%d", "head", "grp")
    return _pairing(events, key, "WIR", "WRR", "STRUCT/WIR_WRR_PAIR", where, chunk_rows)


def clamped_depth(records: DataFrame, opening: str, closing: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Nesting depth that never drops below zero, after each opening or closing record.

    With s the plain running sum, the clamped depth is s - min(0, running min of s).
    """
    step = F.when(F.col("kind") == opening, 1).otherwise(-1)
    events = records.filter(F.col("kind").isin(opening, closing)).select("source_id", "seq", "kind", step.alias("__d"))
    summed = carry(events, ["source_id"], "seq", chunk_rows, __s=Running("sum", F.col("__d")))
    lowest = carry(
        summed, ["source_id"], "seq", chunk_rows,
        __low=Running("min", F.col("__s")), __before=Running("min", F.col("__s"), include_row=False),
    )
    floor = lambda c: F.least(F.lit(0), F.coalesce(c, F.lit(0)))
    return lowest.select(
        "source_id", "seq", "kind", (F.col("__s") - floor(F.col("__low"))).alias("depth"),
        (F.col("__s") < floor(F.col("__before"))).alias("unmatched"),
    )


def section_balance(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """BPS and EPS must balance; an EPS too many does not change the depth."""
    depth = clamped_depth(records, "BPS", "EPS", chunk_rows)
    last = depth.groupBy("source_id").agg(
        F.max(F.struct("seq", "depth"))["depth"].alias("depth"),
        F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("seq"))), F.lit(-1)).alias("zero_at"),
    ).filter(F.col("depth") > 0)
    first_open = (
        depth.filter("kind = 'BPS'").select("source_id", "seq").join(last, "source_id").filter(F.col("seq") > F.col("zero_at"))
        .groupBy("source_id", "depth").agg(F.min("seq").alias("seq"))
    )
    rule = "STRUCT/BPS_EPS_BALANCE"
    never = F.concat(F.col("depth").cast("string"), F.lit(" BPS record(s) never closed by EPS"))
    return finding(depth.filter("unmatched"), "error", rule, "EPS", F.lit("EPS without matching BPS")).unionByName(
        finding(first_open, "error", rule, "BPS", never)
    )


def single_mir(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    mirs = records.filter("kind = 'MIR'").select("source_id", "seq")
    counted = carry(mirs, ["source_id"], "seq", chunk_rows, n=Running("sum", F.lit(1))).filter("n > 1")
    text = F.concat(F.lit("MIR seen "), F.col("n").cast("string"), F.lit(" times"))
    return finding(counted, "error", "STRUCT/MIR_SINGLETON", "MIR", text)


def abort_detection(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Signs of an aborted writer: no MRR, open wafers, open parts, open program sections."""
    sources = records.groupBy("source_id").agg(
        F.coalesce(F.bool_or(F.col("kind") == "MRR"), F.lit(False)).alias("closed"), F.max("seq").alias("last_seq")
    )

    def still_open(opening: str, closing: str) -> DataFrame:
        depth = clamped_depth(records, opening, closing, chunk_rows)
        return depth.groupBy("source_id").agg(F.max(F.struct("seq", "depth"))["depth"].alias("n")).filter("n > 0")

    wafers = still_open("WIR", "WRR").join(sources, "source_id")
    parts = (
        records.filter(F.col("kind").isin("PIR", "PRR")).groupBy("source_id", "head", "site")
        .agg(F.max(F.struct("seq", "kind")).alias("e")).filter("e.kind = 'PIR'")
        .select("source_id", "head", "site", F.col("e.seq").alias("seq"))
    )
    count = lambda text: F.concat(F.col("n").cast("string"), F.lit(text))
    return all_findings([
        finding(sources.filter(~F.col("closed")), "warning", "ABORT/NO_MRR", None, F.lit("No MRR found"), _no_seq()),
        finding(wafers, "error", "ABORT/OPEN_WIR", "WIR", count(" WIR(s) unclosed by WRR"), F.col("last_seq")),
        finding(parts, "error", "ABORT/OPEN_PIR", "PIR", F.format_string("PIR for head=%d site=%d never closed by PRR", "head", "site")),
        finding(still_open("BPS", "EPS"), "warning", "ABORT/OPEN_BPS", "BPS", count(" BPS section(s) not closed by EPS"), _no_seq()),
    ])


def limit_order(tests: DataFrame) -> DataFrame:
    """Low limit above the high limit where OPT_FLAG says both are valid."""
    opt = F.col("opt_flag")
    valid = opt.isNotNull() & ~verdicts.has_bits(opt, 0x50) & ~verdicts.has_bits(opt, 0xA0)
    wrong = tests.filter((F.col("kind") == "PTR") & valid & (F.col("lo_limit") > F.col("hi_limit")))
    text = F.concat(F.lit("test "), F.col("test_num").cast("string"), F.lit(" lo_limit > hi_limit"))
    return finding(wrong, "error", "FIELD/PTR_LIMIT_ORDER", "PTR", text)


def empty_lot(mirs: DataFrame) -> DataFrame:
    return finding(mirs.filter(F.trim("lot_id") == ""), "warning", "FIELD/MIR_LOT_ID", "MIR", F.lit("MIR.LOT_ID is empty"))


def test_name_consistency(tests: DataFrame) -> DataFrame:
    """Parametric records whose name differs from the first name of their test number."""
    named = tests.filter("kind = 'PTR'").withColumn("name", F.coalesce("test_txt", F.lit("")))
    first = named.groupBy("source_id", "test_num").agg(F.min(F.struct("seq", "name"))["name"].alias("first_name"))
    wrong = named.join(first, ["source_id", "test_num"]).filter(F.col("name") != F.col("first_name"))
    text = F.concat(
        F.lit("test_num "), F.col("test_num").cast("string"), F.lit(" has name "), "name", F.lit(" (first "), "first_name", F.lit(")")
    )
    return finding(wrong, "warning", "SEMANTIC/TEST_NAME_CONSISTENCY", "PTR", text)


def bin_counts(parts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Hard bins counted from PRR against HBR; counts per site override roll-ups (255)."""
    rolled = (F.col("head") == ALL_SITES) | (F.col("site") == ALL_SITES)
    declared = summaries.groupBy("source_id", "bin").agg(
        F.sum(F.when(~rolled, F.col("n"))).alias("granular"), F.max(F.when(rolled, F.col("n"))).alias("rolled")
    ).select("source_id", "bin", F.coalesce("granular", "rolled").alias("hbr"))
    counted = parts.groupBy("source_id", F.col("hard_bin").alias("bin")).agg(F.count("*").alias("prr"))
    both = declared.join(counted, ["source_id", "bin"], "full_outer")
    text = lambda c: F.col(c).cast("string")
    message = F.when(
        F.col("hbr").isNull(), F.concat(F.lit("bin "), text("bin"), F.lit(" appears in PRRs ("), text("prr"), F.lit(" times) but has no HBR record"))
    ).otherwise(
        F.concat(F.lit("bin "), text("bin"), F.lit(" HBR says "), text("hbr"), F.lit(" but PRR count is "), F.coalesce(text("prr"), F.lit("0")))
    )
    wrong = both.filter(~F.col("hbr").eqNullSafe(F.coalesce("prr", F.lit(0))))
    return finding(wrong, "warning", "SEMANTIC/HBR_BIN_COUNT", "HBR", message, _no_seq())


def report_summary(findings: DataFrame) -> DataFrame:
    """Findings per source and severity, and whether the writer likely aborted."""
    aborted = F.coalesce(F.bool_or(F.col("rule").startswith("ABORT/")), F.lit(False))
    return findings.groupBy("source_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning")], aborted.alias("likely_aborted")
    )


def decode_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("source_id", "kind").agg(F.count("*").alias("records"))


# --- fields ---------------------------------------------------------------------

# Fields whose standard says "missing" by a value, by name.
COORDINATES = ("X_COORD", "Y_COORD", "CENTER_X", "CENTER_Y")
TIMES = ("SETUP_T", "START_T", "FINISH_T", "MOD_TIM")
MAX_U2_MISSING = ("SOFT_BIN", "BURN_TIM")
COUNTS = ("RTST_CNT", "ABRT_CNT", "GOOD_CNT", "FUNC_CNT", "EXEC_CNT", "FAIL_CNT", "ALRM_CNT")
COUNT_RECORDS = ("PCR", "WRR", "TSR")
BIN_FIELDS = ("HARD_BIN", "SOFT_BIN", "HBIN_NUM", "SBIN_NUM")
# OPT_FLAG bits that make a parametric field missing.
OPT_MASKS = {"RES_SCAL": 0x01, "LLM_SCAL": 0x50, "LO_LIMIT": 0x50, "HLM_SCAL": 0xA0, "HI_LIMIT": 0xA0, "LO_SPEC": 0x04, "HI_SPEC": 0x08}


def field_status(fields: DataFrame) -> DataFrame:
    """Status of each field from its raw value: valid, missing, invalid or unknown.

    Input rows carry ``record, field, kind, presence, text, number, bad_padding,
    test_flg, opt_flag``; added are ``status``, ``origin``, ``issue`` and the
    effective value (``eff_text``, ``eff_number``), NULL unless valid.
    """
    name, kind, number, text = F.col("field"), F.col("kind"), F.col("number"), F.col("text")
    present, omitted = F.col("presence") == "present", F.col("presence") == "omitted"
    count_field = name.isin(*COUNTS) & F.col("record").isin(*COUNT_RECORDS)
    has_default = (
        kind.isin("Cn", "C1") | name.isin(*COORDINATES) | name.isin(*TIMES) | name.isin(*MAX_U2_MISSING) | count_field
    )
    default = (
        ((kind == "Cn") & (text == "")) | ((kind == "C1") & (text == " ")) | (name.isin(*COORDINATES) & (number == -32768))
        | (name.isin(*TIMES) & (number == 0)) | (name.isin(*MAX_U2_MISSING) & (number == 65535))
        | (count_field & (number == 4294967295))
    )
    nonfinite = kind.isin("R4", "R8") & number.isNotNull() & ~verdicts.is_finite(number)
    issue = (
        F.when(F.col("presence") == "truncated", "unexpected end of record")
        .when(kind.isin("Cn", "C1") & text.rlike(r"[^\x00-\x7F]"), "non-ASCII character bytes")
        .when(F.col("bad_padding"), "nonzero padding").when(nonfinite, "nonfinite number")
        .when(present & name.isin(*BIN_FIELDS) & (number > verdicts.MAX_BIN) & ~default, "bin number exceeds 32767")
        .when(name == "__TRAILING_BYTES", "unparsed bytes after known record layout")
    )
    plain = (
        F.when(issue.isNotNull(), "invalid")
        .when(omitted, F.when(has_default, "missing").otherwise("unknown"))
        .when(F.col("presence") == "unread", "unknown")
        .when(default, "missing")
        .otherwise("valid")
    )
    masked = name.isin("RESULT", "RTN_RSLT") & verdicts.has_bits(F.coalesce("test_flg", F.lit(0)), 0x3F)
    parametric = F.col("record").isin("PTR", "MPR")
    opt = F.col("opt_flag")
    option_missing = reduce(
        lambda a, b: a | b, [(name == n) & F.coalesce(verdicts.has_bits(opt, m), F.lit(False)) for n, m in OPT_MASKS.items()]
    )
    option_unknown = name.isin(*OPT_MASKS) & opt.isNull() & present
    status = (
        F.when(masked, "invalid").when(parametric & option_missing, "missing").when(parametric & option_unknown, "unknown").otherwise(plain)
    )
    origin = F.when(present | (F.col("presence") == "truncated"), "explicit").when(omitted & has_default, "standard_default").otherwise("unresolved")
    checked = fields.select(
        "*", F.coalesce(status, F.lit("valid")).alias("status"), origin.alias("origin"),
        F.when(masked, _UNRELIABLE).otherwise(issue).alias("issue"),
    )
    valid = F.col("status") == "valid"
    return checked.select("*", F.when(valid, F.col("text")).alias("eff_text"), F.when(valid, F.col("number")).alias("eff_number"))


# Fields that the first record of a test sets for the later ones, with the OPT_FLAG bits that ask for the
# default and that say there is none, "field default none records".
DEFAULT_FIELDS = """
OPT_FLAG 0 0 MPR
RES_SCAL 1 0 PTR|MPR
LLM_SCAL 16 64 PTR|MPR
HLM_SCAL 32 128 PTR|MPR
LO_LIMIT 16 64 PTR|MPR
HI_LIMIT 32 128 PTR|MPR
START_IN 0 2 MPR
INCR_IN 0 2 MPR
RTN_INDX 0 0 MPR
UNITS 0 0 PTR|MPR
UNITS_IN 0 0 MPR
C_RESFMT 0 0 PTR|MPR
C_LLMFMT 0 0 PTR|MPR
C_HLMFMT 0 0 PTR|MPR
LO_SPEC 0 4 PTR|MPR
HI_SPEC 0 8 PTR|MPR
"""
_UNRELIABLE = "the flags call the result unreliable"


def _default_rules() -> Column:
    """Map of "record field" to its bits (default, none)."""
    cells = []
    for line in DEFAULT_FIELDS.strip().splitlines():
        name, default, none, records = line.split()
        for record in records.split("|"):
            cells += [F.lit(f"{record} {name}"), F.array(F.lit(int(default)), F.lit(int(none)))]
    return F.create_map(*cells)


def resolved_status(checked: DataFrame, runs: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """``field_status`` rows with the fields of a test resolved against the first record of the test in its run.

    ``checked`` rows also have ``record_seq``, ``test_num``, ``parm_flg`` and ``rtn_icnt``; ``runs`` gives the ``run`` of a
    (source_id, record_seq), unless they have it as well. ``firsts`` are the rows of the records that come first among those
    of a test in a run, for callers that know these records; else they are looked for among all rows. Added is ``inherited_from``, the record_seq of the definition that a value was taken from.
    A result that the flags call unreliable is unknown, not invalid. Truncated and faulty fields stay as they are.

    The definitions are the rows of one record per test and run, found by the least record_seq. They are one aggregation,
    stored and joined back, so that the rows themselves are neither stored nor dealt out for it.
    """
    key = ["source_id", "run", "record", "test_num"]
    rules, name = _default_rules(), F.col("field")
    rows = checked if runs is None else checked.join(
        shuffled(runs.select("source_id", "record_seq", "run")), ["source_id", "record_seq"], "left"
    )
    ruled = lambda df: df.withColumn("__rule", F.try_element_at(rules, F.concat_ws(" ", "record", "field")))
    steers = F.col("record").isin("PTR", "MPR") & (F.col("__rule").isNotNull() | name.isin("RESULT", "RTN_RSLT"))

    omitted, bits = F.col("presence") == "omitted", lambda opt, i: F.coalesce(opt.bitwiseAND(F.col("__rule")[i]) != 0, F.lit(False))
    text = F.col("kind") == "Cn"
    blank = omitted | (F.col("text") == "")
    fixed = F.col("issue").isNotNull() | F.col("presence").isin("truncated", "unread")
    result = name.isin("RESULT", "RTN_RSLT")
    outcome = lambda status, value_text=None, value_number=None, origin="explicit", source=None, issue=None: F.struct(
        F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
        (F.lit(None) if value_text is None else value_text).cast("string").alias("eff_text"),
        (F.lit(None) if value_number is None else value_number).cast("double").alias("eff_number"),
        (F.lit(origin) if isinstance(origin, str) else origin).alias("origin"),
        (F.lit(None) if source is None else source).cast("long").alias("inherited_from"), F.lit(issue).cast("string").alias("issue"),
    )
    as_is = outcome(F.col("status"), F.col("eff_text"), F.col("eff_number"), F.col("origin"))
    explicit = outcome("valid", F.col("text"), F.col("number"))

    def resolve(opt: Column, inherited: Column, has_prior: bool) -> Column:
        masks = (F.col("__rule")[0] != 0) | (F.col("__rule")[1] != 0)
        numeric = (
            F.when(bits(opt, 1), outcome("missing")).when(omitted | bits(opt, 0), inherited)
            .when(opt.isNull() & masks, outcome("unknown", origin="unresolved")).otherwise(explicit)
        )
        texts = F.when(blank, inherited if has_prior else as_is).when(F.col("text") == "\x00", outcome("valid", F.lit(""))).otherwise(as_is)
        flag = F.when(omitted, inherited).otherwise(as_is)
        found = F.when(text, texts).when(name == "OPT_FLAG", flag).otherwise(numeric)
        length = F.size(F.from_json(found["eff_text"], "array<double>"))
        wrong = (name == "RTN_INDX") & (found["status"] == "valid") & ~length.eqNullSafe(F.col("rtn_icnt"))
        return F.when(wrong, outcome("invalid", issue="RTN_INDX and RTN_ICNT differ in length")).otherwise(found)

    unresolved = outcome("unknown", origin="unresolved")
    owned = lambda df: ruled(df).withColumn("__own", resolve(F.col("opt_flag"), unresolved, False))
    said = F.struct(F.col("opt_flag").alias("opt"), F.when(fixed, as_is).otherwise(F.col("__own")).alias("prior"))
    # Of each field its first row; it is a definition if its record is the first of the test.
    fields = owned(rows if firsts is None else firsts).filter(steers).select(*key, "field", "record_seq", F.when(~result, said).alias("said")).groupBy(*key, "field").agg(
        F.min("record_seq").alias("at"), F.min_by("said", "record_seq").alias("said"), F.count("*").alias("n")
    )
    tests = fields.groupBy(*key).agg(
        F.min("at").alias("first_seq"), F.map_from_entries(F.collect_list(F.struct("field", F.struct("at", "said")))).alias("__said"), F.sum("n").alias("__rows")
    )
    joined = attach_few(owned(rows), tests, key, "__rows", ["source_id", "record_seq", "field"]).filter(~steers | F.col("first_seq").isNotNull())
    of_field = F.try_element_at("__said", name)
    told = F.when(of_field["at"] == F.col("first_seq"), of_field["said"])
    joined = joined.select("*", told["opt"].alias("__opt"), told["prior"].alias("__prior"))
    prior = F.col("__prior")
    inherited = F.when(
        prior["status"].isin("valid", "missing"),
        outcome(prior["status"], prior["eff_text"], prior["eff_number"], "inherited", F.col("first_seq")),
    ).otherwise(unresolved)
    later = resolve(F.coalesce("opt_flag", "__opt"), inherited, True)
    same = later["eff_number"].eqNullSafe(prior["eff_number"])
    changed = name.isin("LO_SPEC", "HI_SPEC") & ~omitted & (later["status"] == "valid") & (prior["status"] == "valid") & ~same
    later = F.when(changed, outcome("invalid", issue="another specification limit than at first")).otherwise(later)
    first = F.col("record_seq") == F.col("first_seq")
    unreliable = verdicts.has_bits(F.coalesce("test_flg", F.lit(0)), 0x3F) | verdicts.has_bits(F.coalesce("parm_flg", F.lit(0)), 0x07)
    faulty = F.col("issue").isNotNull() & (F.col("issue") != _UNRELIABLE)
    plain_issue = F.struct(*[as_is[c].alias(c) for c in ("status", "eff_text", "eff_number", "origin", "inherited_from")], F.col("issue").alias("issue"))
    chosen = (
        F.when(result & unreliable & ~faulty, outcome("unknown", origin=F.col("origin")))
        .when(result | fixed, plain_issue).when(first, F.col("__own")).otherwise(later)
    )
    kept = [c for c in checked.columns if c not in ("status", "eff_text", "eff_number", "origin", "issue", "run")]
    return joined.withColumn("__chosen", F.when(steers, chosen).otherwise(plain_issue)).select(*kept, "run", "__chosen.*")


# Default list of required fields, "record field flows".
DEFAULT_CHECKS = """
FAR CPU_TYPE CP|FT
FAR STDF_VER CP|FT
MIR SETUP_T CP|FT
MIR START_T CP|FT
MIR LOT_ID CP|FT
MIR JOB_NAM CP|FT
MRR FINISH_T CP|FT
SDR HEAD_NUM CP|FT
SDR SITE_GRP CP|FT
SDR SITE_CNT CP|FT
SDR SITE_NUM CP|FT
WIR HEAD_NUM CP
WIR WAFER_ID CP
WRR HEAD_NUM CP
WRR FINISH_T CP
WRR PART_CNT CP
PIR HEAD_NUM CP|FT
PIR SITE_NUM CP|FT
PRR HEAD_NUM CP|FT
PRR SITE_NUM CP|FT
PRR PART_FLG CP|FT
PRR NUM_TEST CP|FT
PRR HARD_BIN CP|FT
PRR SOFT_BIN CP|FT
PTR TEST_NUM CP|FT
PTR HEAD_NUM CP|FT
PTR SITE_NUM CP|FT
PTR TEST_FLG CP|FT
PTR PARM_FLG CP|FT
PTR RESULT CP|FT
MPR TEST_NUM CP|FT
MPR HEAD_NUM CP|FT
MPR SITE_NUM CP|FT
MPR TEST_FLG CP|FT
MPR PARM_FLG CP|FT
MPR RTN_ICNT CP|FT
MPR RSLT_CNT CP|FT
MPR RTN_STAT CP|FT
MPR RTN_RSLT CP|FT
FTR TEST_NUM CP|FT
FTR HEAD_NUM CP|FT
FTR SITE_NUM CP|FT
FTR TEST_FLG CP|FT
DTR TEXT_DAT CP|FT
GDR FLD_CNT CP|FT
GDR GEN_DATA CP|FT
"""


def check_list(spark, text: str = DEFAULT_CHECKS) -> DataFrame:
    """A list of required fields as the DataFrame ``record, field, flow``."""
    rows = []
    for line in text.strip().splitlines():
        if line.startswith("#") or not line.strip():
            continue
        record, field, flows = line.split()
        rows += [(record, field, flow.lower()) for flow in flows.split("|")]
    if len(set(rows)) != len(rows):
        raise ValueError("duplicate entry in the list of checks")
    return spark.createDataFrame(rows, "record string, field string, flow string")


def project_checks(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """Apply the list of required fields (``record, field, flow``; [] for any index).

    Fields not listed are ``not_checked``, listed ones must be usable, and listed
    ones absent from a record are added as missing, per actual array member.
    """
    ident = ["source_id", "offset", "record", "flow"]
    rules = checks.select("record", F.col("field").alias("canonical"), "flow").distinct()
    # A run of unknown flow is checked by the rules common to both flows.
    common = rules.groupBy("record", "canonical").agg(F.count_distinct("flow").alias("n")).filter("n = 2").select(
        "record", "canonical", F.lit("unknown").alias("flow")
    )
    rules = rules.unionByName(common)
    named = fields.withColumn("canonical", keys.canonical_field(F.col("field")))
    # The list is short; without the hint Spark shuffles all fields to its few keys, as it does not know its size.
    listed = named.join(F.broadcast(rules.withColumn("listed", F.lit(True))), ["record", "canonical", "flow"], "left")
    blank = F.col("eff_text").isNull() & F.col("eff_number").isNull() | (F.trim(F.coalesce("eff_text", F.lit("x"))) == "")
    status = (
        F.when(F.col("listed").isNull(), "not_checked").when(blank & (F.col("status") != "invalid"), "missing").otherwise(F.col("status"))
    )
    projected = listed.select(
        *ident, "field", F.col("presence"), status.alias("status"),
        F.when(F.col("listed") & (status != "valid"), "required by checks; usable value missing or invalid").alias("check_issue"),
        "eff_text", "eff_number",
    )
    # The suffixes wanted below each prefix, per record type and flow.
    last = r"^(.*\[\])?(.*)$"
    suffixes = rules.groupBy("record", "flow", F.regexp_extract("canonical", last, 1).alias("prefix")).agg(
        F.collect_set(F.regexp_extract("canonical", last, 2)).alias("suffixes")
    )
    suffixes = suffixes.groupBy("record", "flow").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "suffixes"))).alias("below"))
    # One grouping by record gives its fields, and from these its concrete array members, itself being member ''.
    records = fields.join(F.broadcast(rules.select("record", "flow").distinct()), ["record", "flow"], "left_semi")
    records = records.groupBy(*ident).agg(F.collect_set("field").alias("fields")).join(F.broadcast(suffixes), ["record", "flow"])
    prefixes = lambda field: F.array(F.regexp_extract(field, r"^([^\[]*\[\d+\])", 1), F.regexp_extract(field, r"^(.*\[\d+\])", 1))
    arrays = F.filter("fields", lambda field: F.contains(field, F.lit("[")))
    members = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(arrays, prefixes))))
    below = lambda member: F.coalesce(F.col("below")[keys.canonical_field(member)], F.array().cast("array<string>"))
    wanted = F.flatten(F.transform("members", lambda member: F.transform(below(member), lambda suffix: F.concat(member, suffix))))
    absent = records.withColumn("members", members).select(*ident, F.explode(F.array_except(wanted, "fields")).alias("field")).select(
        *ident, "field", F.lit("omitted").alias("presence"), F.lit("missing").alias("status"),
        F.lit("required by checks; field absent from this record").alias("check_issue"),
        F.lit(None).cast("string").alias("eff_text"), F.lit(None).cast("double").alias("eff_number"),
    )
    return projected.unionByName(absent)


def profile_violations(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields that break a product rule: ``profile, record, field, required, pattern, allowed, min, max``."""
    named = fields.filter(F.col("status") != "not_checked").withColumn("canonical", keys.canonical_field(F.col("field")))
    joined = named.join(rules.withColumnRenamed("field", "canonical"), ["record", "canonical"])
    text, number = F.col("eff_text"), F.col("eff_number")
    value = F.coalesce(text, number.cast("string"))
    finite = verdicts.is_finite(number)
    broken = (
        (F.col("required") & (F.col("status") != "valid"))
        | (F.col("pattern").isNotNull() & ~F.coalesce(F.expr("rlike(eff_text, concat('^(?:', pattern, ')$'))"), F.lit(False)))
        | (F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", value), F.lit(False)))
        | (F.col("min").isNotNull() & ~F.coalesce(finite & (number >= F.col("min")), F.lit(False)))
        | (F.col("max").isNotNull() & ~F.coalesce(finite & (number <= F.col("max")), F.lit(False)))
    )
    text_out = F.concat("record", F.lit("."), "field", F.lit(" does not satisfy profile "), "profile")
    return finding(joined.filter(broken), "error", "profile", F.col("record"), text_out, F.col("offset"))


# Fields shown by default for a record type.
IMPORTANT = {
    "MIR": "LOT_ID PART_TYP JOB_NAM JOB_REV SBLOT_ID TEST_COD OPER_NAM FLOW_ID TST_TEMP SETUP_T START_T STAT_NUM MODE_COD RTST_COD "
    "NODE_NAM TSTR_TYP DATE_COD FACIL_ID FLOOR_ID PROC_ID USER_TXT",
    "PRR": "HEAD_NUM SITE_NUM PART_ID PART_FLG HARD_BIN SOFT_BIN X_COORD Y_COORD",
    "SDR": "HEAD_NUM SITE_GRP SITE_CNT SITE_NUM HAND_TYP HAND_ID CARD_TYP CARD_ID LOAD_TYP LOAD_ID DIB_TYP DIB_ID CONT_TYP CONT_ID EXTR_ID",
}


def important_fields(fields: DataFrame, configured: dict[str, list[str]] | None = None) -> DataFrame:
    """Per record type the configured, else the default list of fields, else all."""
    chosen = {k: v.split() for k, v in IMPORTANT.items()} | (configured or {})
    record, field = F.col("record"), F.col("field")
    keep = ~record.isin(*chosen)
    for kind, names in chosen.items():
        keep = keep | ((record == kind) & field.isin(*names))
    return fields.filter(keep)


def field_totals(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("status").isin("invalid", "missing", "unknown")).groupBy("source_id", "status").agg(
        F.count("*").alias("fields")
    )


# --- structure of a run -----------------------------------------------------------

_META = ("SDR", "WIR", "WRR", "WCR", "MRR", "SBR", "HBR")
# The fields of a record that structure, wafers and sections are judged by.
_STRUCTURE = ("source_id", "seq", "kind", "head", "site", "site_grp", "sites", "wafer_id", "fabwf_id")


def run_findings(records: DataFrame, require_wafer: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Findings on the structure of runs, units, wafers and sections.

    Units are closed by MIR and MRR, wafers and site maps by MIR. ``epoch``
    numbers the stretches between two MIR or MRR, ``run`` those between MIRs.
    """
    # The records are dealt out, sorted and stored, so the fields that no rule looks at are left behind.
    records = records.select(*[c for c in records.columns if c in _STRUCTURE])
    border = F.col("kind").isin("MIR", "MRR")
    staged = carry(
        records, ["source_id"], "seq", chunk_rows,
        run=Running("sum", F.when(F.col("kind") == "MIR", 1).otherwise(0)),
        epoch=Running("sum", F.when(border, 1).otherwise(0)),
        last_border=Running("last", F.when(border, F.col("kind")), include_row=False),
    )
    in_run = F.coalesce(F.col("last_border") == "MIR", F.lit(False))
    staged = materialize(staged.withColumn("in_run", in_run), "runs")
    one = lambda rows, rule, severity, text: finding(rows, severity, rule, F.col("kind"), F.lit(text))

    first = staged.groupBy("source_id").agg(F.min("seq").alias("first_seq"))
    far = staged.filter("kind = 'FAR'").join(first, "source_id").filter(F.col("seq") > F.col("first_seq"))
    overlap = staged.filter("kind = 'MIR' and in_run")
    outside = staged.filter(F.col("kind").isin(*_META) & ~F.col("in_run"))

    unit_key = ["source_id", "epoch", "head", "site"]
    units = staged.filter(F.col("kind").isin("PIR", "PRR"))
    lost = units.filter(~F.col("in_run"))
    paired = carry(
        units.filter("in_run"), unit_key, "seq", chunk_rows, before=Running("last", F.col("kind"), include_row=False)
    )
    is_open = F.coalesce(F.col("before") == "PIR", F.lit(False))
    wrong_pair = paired.filter(((F.col("kind") == "PIR") & is_open) | ((F.col("kind") == "PRR") & ~is_open))
    created = paired.filter((F.col("kind") == "PIR") | ~is_open)

    open_units = (
        units.filter("in_run").groupBy(*unit_key).agg(F.max(F.struct("seq", "kind"))["kind"].alias("last"))
        .filter("last = 'PIR'").select("source_id", "epoch").distinct()
    )
    closes = staged.filter("kind = 'MRR'").select("source_id", "seq", "kind", (F.col("epoch") - 1).alias("epoch"))
    unclosed = closes.join(open_units, ["source_id", "epoch"], "left_semi")
    ends = staged.groupBy("source_id").agg(
        F.max("epoch").alias("epoch"), F.max("run").alias("run"), F.max("seq").alias("seq"),
        F.count_if(F.col("kind") == "MIR").alias("mirs"), F.count_if(F.col("kind") == "MRR").alias("mrrs"),
        F.max(F.struct(F.when(border, F.col("seq")).alias("s"), F.when(border, F.col("kind")).alias("k")))["k"].alias("last_border"),
    )
    unclosed_end = ends.join(open_units, ["source_id", "epoch"], "left_semi")
    not_closed = ends.filter((F.col("mirs") == 0) | (F.col("mrrs") == 0) | (F.col("last_border") == "MIR"))

    slot_key = ["source_id", "run", "head", "slot"]
    wafers = staged.filter(F.col("kind").isin("WIR", "WRR")).withColumn(
        "slot", F.coalesce("site_grp", F.lit(ALL_SITES)).cast("int")
    )
    slots = carry(wafers, slot_key, "seq", chunk_rows, before=Running("last", F.col("kind"), include_row=False))
    slot_open = F.coalesce(F.col("before") == "WIR", F.lit(False))
    open_slots = (
        wafers.groupBy(*slot_key).agg(F.max(F.struct("seq", "kind"))["kind"].alias("last")).filter("last = 'WIR'")
        .select("source_id", "run").distinct()
    )

    # Test records without an open unit at their site.
    tests = ("PTR", "MPR", "FTR")
    owners = staged.filter(F.col("kind").isin("PIR", "PRR", *tests) & F.col("in_run"))
    owned = carry(
        owners, unit_key, "seq", chunk_rows, now=Running("last", F.when(F.col("kind").isin("PIR", "PRR"), F.col("kind")))
    )
    free = staged.filter(F.col("kind").isin(*tests) & ~F.col("in_run")).select("source_id", "seq", "kind").unionByName(
        owned.filter(F.col("kind").isin(*tests) & (F.coalesce("now", F.lit("PRR")) == "PRR")).select("source_id", "seq", "kind")
    )
    sections = section_balance(records, chunk_rows)
    program = sections.withColumns({
        "rule": F.lit("program_section"),
        "message": F.when(F.col("record_type") == "EPS", "section end without a section").otherwise("stream ends inside a section"),
    })
    parts = [
        one(far, "far_position", "error", "file header after the first record"),
        one(overlap, "run_overlap", "error", "run opened inside a run"),
        one(outside, "run_context", "error", "no run is open here"),
        one(lost, "part_context", "error", "unit record without an open run"),
        one(wrong_pair, "part_pair", "error", "unit record without its counterpart at this site"),
        one(unclosed, "unclosed_unit", "error", "run ends while units are open"),
        finding(unclosed_end, "error", "unclosed_unit", None, F.lit("stream ends while units are open")),
        finding(not_closed, "error", "run_closure", None, F.lit("a run has no start or no end")),
        one(slots.filter((F.col("kind") == "WIR") & slot_open), "wafer_overlap", "error", "wafer opened in a slot that is open"),
        one(slots.filter((F.col("kind") == "WRR") & ~slot_open), "wafer_pair", "error", "wafer closed in a slot that is not open"),
        finding(ends.join(open_slots, ["source_id", "run"], "left_semi"), "error", "wafer_closure", None, F.lit("stream ends while wafers are open")),
        one(free, "record_ownership", "error", "no single unit owns the record; it stays with its run"),
        program,
    ]
    if require_wafer:
        probes = created.select("source_id", "run", "head", "site", "seq", "kind")
        placed = open_wafers(staged, probes.drop("kind"), ["source_id", "run"], False, chunk_rows, only_open=False)
        names = staged.filter("kind = 'WIR'").select("source_id", F.col("seq").alias("wafer_seq"), "wafer_id")
        # The only open wafer of a head is not enough here: a site map or a shared wafer is required.
        bare = placed.join(names, ["source_id", "wafer_seq"], "left").filter(F.coalesce("wafer_id", F.lit("")) == "")
        parts.append(finding(bare, "error", "cp_wafer", None, F.lit("the profile asks for a known wafer")))
    return all_findings(parts)


def text_ownership(assigned: DataFrame) -> DataFrame:
    """Text records that belong to no single open unit, from ``stream.assign_records``."""
    return finding(
        assigned.filter(F.col("unit_seq").isNull()), "warning", "record_ownership", None,
        F.lit("no single unit owns the record; it stays with its run"),
    )


def unresolved_identity(attempts: DataFrame) -> DataFrame:
    return finding(
        attempts.filter(F.col("part_merge_key").isNull()), "warning", "identity", "PRR",
        F.lit("no coordinate identity; the unit counts by itself"), F.col("attempt"),
    )


def decode_findings(records: DataFrame) -> DataFrame:
    """Framing and decoding errors, and record types without a layout."""
    message = F.concat("kind", F.lit(": "), F.coalesce("error", F.lit("kept as bytes, its fields are not checked")))
    bad = records.filter(F.col("error").isNotNull() | F.col("kind").startswith("UNKNOWN"))
    rule = (
        F.when(F.col("kind") == "FRAME_ERROR", "framing").when(F.col("error").isNotNull(), "decode").otherwise("unsupported_record")
    )
    return bad.select(
        "source_id", F.lit("error").alias("severity"), rule.alias("rule"), F.col("kind").alias("record_type"),
        F.col("record_seq").alias("seq"), message.alias("message"),
    )


def setup_association(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Characterisation results to the setups seen while their unit was open.

    The number of setups of an id inside the unit is the running count at the
    result minus the one at the unit's PIR.
    """
    key = ["source_id", "head", "site"]
    events = records.filter(F.col("kind").isin("PIR", "PRR", "CTRR"))
    state = F.when(F.col("kind") == "PIR", F.col("seq")).when(F.col("kind") == "PRR", F.lit(-1))
    placed = carry(events, key, "seq", chunk_rows, unit=Running("last", state)).filter("kind = 'CTRR'")
    placed = placed.select("source_id", "seq", "char_id", F.when(F.col("unit") >= 0, F.col("unit")).alias("unit_seq"))
    nothing = F.lit(None).cast("bigint")
    setups = records.filter("kind = 'CTSR'").select("source_id", "char_id", "seq", F.lit(1).alias("n"))
    at_result = placed.select("source_id", "char_id", "seq", F.lit(0).alias("n"))
    at_open = placed.filter("unit_seq is not null").select("source_id", "char_id", F.col("unit_seq").alias("seq"), F.lit(0).alias("n"))
    points = setups.unionByName(at_result).unionByName(at_open).distinct()
    counted = carry(points, ["source_id", "char_id"], "seq", chunk_rows, upto=Running("sum", F.col("n"))).select(
        "source_id", "char_id", "seq", "upto"
    )
    joined = placed.join(counted, ["source_id", "char_id", "seq"], "left").join(
        counted.select("source_id", "char_id", F.col("seq").alias("unit_seq"), F.col("upto").alias("before")),
        ["source_id", "char_id", "unit_seq"], "left",
    )
    refs = F.when(F.col("unit_seq").isNull(), 0).otherwise(F.col("upto") - F.col("before"))
    status = F.when(refs == 1, "resolved").when(refs > 1, "ambiguous").otherwise("unresolved")
    return joined.select("source_id", "seq", "char_id", "unit_seq", refs.cast("bigint").alias("setups"), status.alias("association"))


def unit_preview(rows: DataFrame, limit: int) -> DataFrame:
    """First records per unit and type; the limit is applied before the shuffle."""
    order = Window.partitionBy("source_id", "session", "head", "site", "kind").orderBy("seq")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def unit_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_id", "session", "head", "site", "kind").agg(F.count("*").alias("records"))


def coverage_checks(records: DataFrame, attempts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per source: attempts against closing records, and stored rows against the inventory."""
    seen = records.groupBy("source_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("kind") == "PRR").alias("closing_records")
    )
    built = attempts.filter(F.col("close_seq").isNotNull()).groupBy("source_id").agg(F.count("*").alias("attempts"))
    declared = inventory.groupBy("source_id").agg(F.sum("records").alias("inventory"))
    joined = seen.join(built, "source_id", "full_outer").join(declared, "source_id", "full_outer")
    return joined.select(
        "source_id", "records", "closing_records", "attempts", "inventory",
        (F.col("attempts").eqNullSafe(F.col("closing_records")) & F.col("records").eqNullSafe(F.col("inventory"))).alias("consistent"),
    )
