"""From the ordered record stream to attempts, wafers and measurements.

A record row has ``source_id``, ``seq`` (position in its source), ``kind`` and
the fields of its type. Stream state is carried chunk by chunk
(:mod:`testfloor.operators.ordered`), so a large source is never one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.functions import keys, verdicts
from testfloor.operators.joins import attach, attach_few
from testfloor.operators.ordered import CHUNK_ROWS, Running, carry
from testfloor.session import materialize, shuffled

SIDE_KINDS = ("PIR", "PTR", "MPR", "FTR", "PRR")
ALL_SITES = 255
_SITE = ["source_id", "head", "site"]


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


# A source with at most so many runs has their starts at hand in each of its rows.
FEW_RUNS = 4


def number_runs(
    records: DataFrame, context: tuple[str, ...] = (), chunk_rows: int = CHUNK_ROWS, stored: bool = False, few_runs: int = FEW_RUNS,
) -> DataFrame:
    """Add ``run`` (1 from the first MIR) and the ``context`` columns of the latest MIR.

    With ``stored`` the records are a stored table, which can be read more than once: the rows of sources with at most
    ``few_runs`` runs are then neither dealt out nor sorted, but compared with the starts of their source's runs.
    """
    kept = [c for c in records.columns if c not in (*context, "run_here", "whole")]
    if "whole" in records.columns:
        # Sources that were read as one block have their runs; the blocks of the others follow each other.
        near = records.filter("whole").select(*kept, F.col("run_here").alias("run"), *context)
        parts = records.filter("not whole")
        if stored and not parts.head(1):
            return near
        return near.unionByName(number_runs(parts.drop("run_here", "whole"), context, chunk_rows, stored, few_runs))
    if not stored:
        return _carried_runs(records, context, chunk_rows)
    totals = records.groupBy("source_id").agg(F.count_if(_is("MIR")).alias("__runs"), F.count("*").alias("__rows"))
    totals = materialize(totals, "source-totals")
    short = totals.filter(F.col("__runs") <= few_runs)
    starts = records.filter(_is("MIR")).select("source_id", F.struct("seq", *context).alias("__start"))
    starts = starts.join(shuffled(short), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list("__start")).alias("__starts"))
    beside = attach_few(records, totals.join(shuffled(starts), "source_id", "left"), ["source_id"], "__rows", ["seq"])

    begun = [F.coalesce(F.get("__starts", F.lit(i))["seq"] <= F.col("seq"), F.lit(False)).cast("bigint") for i in range(few_runs)]
    beside = beside.withColumn("run", reduce(Column.__add__, begun))
    latest = F.get("__starts", (F.col("run") - 1).cast("int"))
    numbered = beside.filter(F.col("__runs") <= few_runs).select(*kept, "run", *[latest[c].alias(c) for c in context])
    if not totals.filter(F.col("__runs") > few_runs).head(1):
        return numbered
    long = beside.filter(F.col("__runs") > few_runs).select(*records.columns)
    return numbered.unionByName(_carried_runs(long, context, chunk_rows))


def _carried_runs(records: DataFrame, context: tuple[str, ...], chunk_rows: int) -> DataFrame:
    running = {"run": Running("sum", F.when(_is("MIR"), 1).otherwise(0))}
    if context:
        latest = F.when(_is("MIR"), F.struct(*[F.col(c) for c in context]))
        running["__mir"] = Running("last", latest)
    numbered = carry(records, ["source_id"], "seq", chunk_rows, **running)
    kept = [c for c in records.columns if c not in context]
    return numbered.select(*kept, "run", *[F.col(f"__mir.{c}").alias(c) for c in context])


def sessions(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Side records with the ``session`` they belong to.

    A PIR opens an attempt, a PRR closes it, and a record after a PRR opens one
    implicitly. The last PIR or earlier PRR of the site, whichever is later,
    names the session, so one pass over the stream is enough.
    """
    side = records.filter(_is(*SIDE_KINDS))
    marked = carry(
        side, _SITE, "seq", chunk_rows,
        __pir=Running("last", F.when(_is("PIR"), F.col("seq"))),
        __prr=Running("last", F.when(_is("PRR"), F.col("seq")), include_row=False),
    )
    none = F.lit(-1).cast("bigint")
    key = F.greatest(F.coalesce("__pir", none), F.coalesce("__prr", none))
    return marked.withColumn("session", key).drop("__pir", "__prr")


def attempts(sessioned: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per session, numbered in open order within its source.

    ``close_seq`` is NULL for a session without a PRR; it takes a number but
    yields no attempt.
    """
    tests = _is("PTR", "MPR", "FTR")
    found = sessioned.groupBy(*_SITE, "session").agg(
        F.min("seq").alias("open_seq"),
        F.max(F.when(_is("PRR"), F.col("seq"))).alias("close_seq"),
        F.count_if(tests).alias("tests"),
    )
    found = materialize(found, "attempts")
    return carry(found, ["source_id"], "open_seq", chunk_rows, part_sequence=Running("sum", F.lit(1)))


def attempt_records(records: DataFrame, numbered: DataFrame) -> DataFrame:
    """Complete attempts with the fields of their PRR and a default part id."""
    prr = records.filter(_is("PRR")).withColumnRenamed("seq", "close_seq").drop("kind")
    joined = numbered.filter(F.col("close_seq").isNotNull()).join(shuffled(prr), [*_SITE, "close_seq"])
    default = F.format_string("H%d_S%d_P%d", F.col("head"), F.col("site"), F.col("part_sequence"))
    return joined.withColumn("part_id", F.coalesce("part_id", default)).withColumn(
        "part_pass", verdicts.part_pass(F.col("part_flg"))
    )


def site_groups(records: DataFrame, probes: DataFrame, scope: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``site_group`` to probes (scope, head, site, seq): the latest SDR that lists the site."""
    key = [*scope, "head", "site"]
    maps = records.filter(_is("SDR")).select(
        *scope, "head", F.explode(F.array_distinct("sites")).alias("site"), "seq", F.col("site_grp").alias("grp")
    )
    asked = probes.select(*key, "seq", F.struct("*").alias("probe"))
    stream = maps.unionByName(asked, allowMissingColumns=True)
    seen = carry(stream, key, "seq", chunk_rows, site_group=Running("last", F.col("grp")))
    return seen.filter(F.col("probe").isNotNull()).select("probe.*", "site_group")


def _slot_events(records: DataFrame, scope: list[str], fall_back: bool, chunk_rows: int) -> DataFrame:
    """WIR and WRR per wafer slot with the wafer open before them (``was_open``, by WIR seq)."""
    key = [*scope, "head", "slot"]
    extra = [c for c in ("wafer_id", "fabwf_id") if c in records.columns]
    events = records.filter(_is("WIR", "WRR")).select(
        *scope, "head", F.coalesce("site_grp", F.lit(ALL_SITES)).cast("int").alias("slot"), "seq", "kind", *extra
    )
    state = Running("last", F.when(_is("WIR"), F.col("seq")).otherwise(F.lit(-1)), include_row=False)
    if fall_back:
        # A WRR whose own slot is not open closes the slot of all sites.
        first = carry(events, key, "seq", chunk_rows, __open=state)
        orphan = _is("WRR") & (F.coalesce("__open", F.lit(-1)) < 0)
        events = first.withColumn("slot", F.when(orphan, F.lit(ALL_SITES)).otherwise(F.col("slot"))).drop("__open")
    seen = carry(events, key, "seq", chunk_rows, __open=state)
    return seen.withColumn("was_open", F.when(F.col("__open") >= 0, F.col("__open"))).drop("__open")


def open_wafers(
    records: DataFrame, probes: DataFrame, scope: list[str] = ["source_id"], fall_back: bool = False,
    chunk_rows: int = CHUNK_ROWS, only_open: bool = True,
) -> DataFrame:
    """Add to probes (scope, head, site, seq) the open wafer as the ``wafer_seq`` of its WIR,
    the wafers in the site's own slot and in the shared one, and the number open on the head.

    With a site group: its own slot, else the slot of all sites. Without: the
    slot of all sites, else (``only_open``) the only open wafer of the head. How many wafers are
    open, and which one if it is alone, are running sums over the head's stream.

    Between two context records of the head nothing changes, so of the probes of a site there only the first is asked.
    """
    place = [*scope, "head", "site", "__stretch"]
    context = records.filter(_is("WIR", "WRR", "SDR")).select(*scope, "head", "seq", F.lit(1).alias("__context"))
    staged = carry(
        context.unionByName(probes.select(*probes.columns, F.lit(0).alias("__context")), allowMissingColumns=True), [*scope, "head"], "seq",
        chunk_rows, __stretch=Running("sum", F.col("__context")),
    )
    staged = materialize(staged.filter("__context = 0").drop("__context"), "staged-probes")
    firsts = staged.groupBy(*place).agg(F.min("seq").alias("seq"))
    found = _wafers_of(records, firsts, scope, fall_back, chunk_rows, only_open).drop("seq")
    return staged.join(shuffled(found), place, "left").drop("__stretch")


def _wafers_of(records: DataFrame, probes: DataFrame, scope: list[str], fall_back: bool, chunk_rows: int, only_open: bool) -> DataFrame:
    # Context events and first probes are few beside the test records and are
    # read several times below, so they are written out once.
    probes = materialize(probes, "first-probes")
    events = materialize(_slot_events(records, scope, fall_back, chunk_rows), "wafer-events")
    grouped = materialize(
        site_groups(records, probes.select(*scope, "head", "site", "seq"), scope, chunk_rows), "site-groups"
    )
    ident = [*scope, "head", "site", "seq"]

    # State of the site's own slot and of the slot of all sites.
    asked = grouped.select(
        *ident,
        F.explode(F.array_distinct(F.array(F.coalesce("site_group", F.lit(ALL_SITES)), F.lit(ALL_SITES)))).alias("slot"),
    )
    change = F.when(F.col("kind") == "WIR", F.col("seq")).otherwise(F.lit(-1))
    no_site = F.lit(None).cast("bigint")
    slots = events.select(*scope, "head", "slot", "seq", change.alias("state"), no_site.alias("site")).unionByName(
        asked.select(*scope, "head", "slot", "seq", no_site.alias("state"), F.col("site").cast("bigint"))
    )
    slot_state = carry(slots, [*scope, "head", "slot"], "seq", chunk_rows, now=Running("last", F.col("state"))).filter(
        F.col("site").isNotNull()
    )

    # Number of open wafers of the head and the sum of their WIR positions.
    was, opened = F.coalesce("was_open", F.lit(0)), F.col("was_open").isNotNull()
    starts = F.col("kind") == "WIR"
    steps = events.select(
        *scope, "head", "seq", no_site.alias("site"),
        F.when(starts & ~opened, 1).when(~starts & opened, -1).otherwise(0).alias("d_n"),
        F.when(starts, F.col("seq") - was).otherwise(-was).alias("d_seq"),
    ).unionByName(
        grouped.select(*scope, "head", "seq", F.col("site").cast("bigint"), F.lit(0).alias("d_n"), F.lit(0).cast("bigint").alias("d_seq"))
    )
    head_state = carry(
        steps, [*scope, "head"], "seq", chunk_rows, n=Running("sum", F.col("d_n")), total=Running("sum", F.col("d_seq"))
    ).filter(F.col("site").isNotNull())

    shape = [*scope, "head", "site", "seq"]
    parts = slot_state.select(*shape, "slot", "now", no_site.alias("n"), no_site.alias("total")).unionByName(
        head_state.select(*shape, F.lit(None).cast("int").alias("slot"), no_site.alias("now"), "n", "total")
    ).withColumnRenamed("site", "__site")
    state = parts.groupBy(*scope, "head", F.col("__site").alias("site"), "seq").agg(
        F.max(F.when((F.col("slot") != ALL_SITES) & (F.col("now") >= 0), F.col("now"))).alias("own"),
        F.max(F.when((F.col("slot") == ALL_SITES) & (F.col("now") >= 0), F.col("now"))).alias("shared"),
        F.max("n").alias("open_count"),
        F.max("total").alias("open_total"),
    )
    joined = grouped.join(shuffled(state), ident)
    only = F.when(F.col("open_count") == 1, F.col("open_total"))
    chosen = F.when(F.col("site_group").isNotNull(), F.coalesce("own", "shared")).otherwise(
        F.coalesce("shared", only) if only_open else F.col("shared")
    )
    found = joined.select(*ident, "site_group", "open_count", "own", "shared", chosen.alias("wafer_seq"))
    return probes.join(shuffled(found), ident, "left")


_CHANGES = "source_id string, run long, head int, seq long, slots map<int,long>, groups map<int,int>, closed long, name string"


def _fold_slots(batches):
    """State changes of the wafer slots of a head, from its state-changing records in order.

    ``slots`` maps a site group to the record that opened its wafer, ``groups`` a site to its group.
    """
    import pyarrow as pa

    key, slots, groups = None, {}, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if key != (r["source_id"], r["run"], r["head"]):
                key, slots, groups = (r["source_id"], r["run"], r["head"]), {}, {}
            kind, group, closed, changed = r["kind"], r["slot"], None, True
            if kind == "SDR":
                groups.update({site: group for site in r["sites"] or () if site is not None})
            elif kind == "WIR":
                slots[group] = r["seq"]
            elif kind == "WRR":
                closed = slots.pop(group if group in slots else ALL_SITES, None)
                changed = closed is not None
            else:
                own = groups.get(r["site"])
                found = own in slots or ALL_SITES in slots if own is not None else bool(slots)
                changed = not found
                if changed:
                    slots[ALL_SITES if own is None else own] = r["seq"]
            if changed:
                out.append((*key, r["seq"], list(slots.items()), list(groups.items()), closed, r["name"] if closed is not None else None))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.map_(pa.int32(), pa.int64()), pa.map_(pa.int32(), pa.int32()), pa.int64(), pa.string()]
            names = [c.split()[0] for c in _CHANGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def slot_changes(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The wafer slots and site groups of every (source, run, head) after each record that changes them (strict rule).

    WIR opens its slot, WRR closes its slot or else that of all sites, SDR assigns sites to groups. A side record that
    finds no wafer opens an implicit one: in the slot of its group, or of all sites where its site has no group and the
    head nothing open. ``closed`` names the opening record of the wafer that a WRR closes, ``name`` what it is called
    then.

    From one context record of the head to the next only the first side record of a site can open a wafer. So the
    stream of test records is reduced to these by running sums and an aggregation, and what is left, which grows with
    the wafers and not with the tests, is folded in order, head by head, in bounded memory.
    """
    scope = ["source_id", "run", "head"]
    context = _is("WIR", "WRR", "SDR")
    rows = records.filter((context | _is(*SIDE_KINDS)) & F.col("head").isNotNull())
    staged = carry(rows.select(*scope, "site", "seq", "kind"), scope, "seq", chunk_rows, stretch=Running("sum", F.when(context, 1).otherwise(0)))
    firsts = staged.filter(_is(*SIDE_KINDS)).groupBy(*scope, "site", "stretch").agg(F.min("seq").alias("seq"))
    opened, closed = keys.clean_id(F.col("wafer_id")), F.coalesce(keys.clean_id(F.col("fabwf_id")), keys.clean_id(F.col("wafer_id")))
    named = rows.filter(context).select(
        *scope, "seq", "kind", F.coalesce("site_grp", F.lit(ALL_SITES)).cast("int").alias("slot"), F.col("sites").cast("array<int>").alias("sites"),
        F.when(_is("WRR"), closed).otherwise(opened).alias("name"),
    )
    side = firsts.select(*scope, "seq", F.lit("side").alias("kind"), F.col("site").cast("int").alias("site"))
    events = named.unionByName(side, allowMissingColumns=True).withColumns({"run": F.col("run").cast("long"), "head": F.col("head").cast("int")})
    ordered = events.repartition(*scope).sortWithinPartitions(*scope, "seq")
    return ordered.mapInArrow(_fold_slots, _CHANGES)


def late_wafers(records: DataFrame, probes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Wafer of each attempt (probe: source_id, run, head, site, seq) by the strict rule, per (source, run).

    A site with a group takes the wafer of its group's slot, else that of all sites; a site without one the wafer of
    all sites, else the only one open on the head; several are ambiguous. The wafer is called what the WRR that closed
    it says, else as its WIR did; an implicit one has no name until then.
    """
    scope = ["source_id", "run", "head"]
    changes = materialize(slot_changes(records, chunk_rows), "slot-changes")
    # A side record that opens a wafer finds it: its change comes before the question.
    state = changes.select(*scope, (F.col("seq") * 2).alias("at"), F.struct("slots", "groups").alias("state"))
    typed = {c: F.col(c).cast(kind) for c, kind in (("run", "long"), ("head", "int"))}
    asked = probes.withColumns({f"__{c}": F.col(c) for c in ("run", "head")}).withColumns(typed)
    asked = asked.select(*scope, (F.col("seq") * 2 + 1).alias("at"), F.struct(*[F.col(f"__{c}" if c in ("run", "head") else c).alias(c) for c in probes.columns]).alias("probe"))
    seen = carry(state.unionByName(asked, allowMissingColumns=True), scope, "at", chunk_rows, now=Running("last", F.col("state")))
    seen = seen.filter("probe is not null")
    slots, groups = (F.coalesce(f"now.{c}", F.create_map().cast(state.schema["state"].dataType[c].dataType)) for c in ("slots", "groups"))
    group, shared = F.try_element_at(groups, F.col("probe.site").cast("int")), F.try_element_at(slots, F.lit(ALL_SITES))
    only = F.when(F.size(slots) == 1, F.map_values(slots)[0])
    wafer_seq = F.when(group.isNotNull(), F.coalesce(F.try_element_at(slots, group), shared)).otherwise(F.coalesce(shared, only))
    found = seen.select(*scope, "probe", wafer_seq.alias("wafer_seq"))
    opens = records.filter(_is("WIR")).select(*[F.col(c).cast(k).alias(c) for c, k in (("source_id", "string"), ("run", "long"))], F.col("seq").alias("wafer_seq"), keys.clean_id(F.col("wafer_id")).alias("name"), F.lit(0).alias("closed"))
    closes = changes.filter("closed is not null and name is not null").select("source_id", "run", F.col("closed").alias("wafer_seq"), "name", F.lit(1).alias("closed"))
    names = opens.unionByName(closes).groupBy("source_id", "run", "wafer_seq").agg(F.max_by("name", "closed").alias("wafer"))
    joined = found.join(names, ["source_id", "run", "wafer_seq"], "left")
    return joined.select("probe.*", "wafer", F.when(F.col("wafer_seq").isNull(), "ambiguous_wafer").alias("wafer_issue"))


def flatten_measurements(tests: DataFrame, base: tuple[str, ...] = ("attempt", "seq", "test_num")) -> DataFrame:
    """One row per result, with the ``base`` columns: a multi-result record gives its overall verdict, then each value."""
    kind, flags, text = F.col("kind"), F.col("test_flg"), F.coalesce("test_txt", F.lit(""))
    none = F.lit(None).cast("double")
    # Position 0 is the record itself, positions 1.. the results of a multi-result record.
    values = F.when(kind == "MPR", F.concat(F.array(none), F.coalesce("rtn_rslt", F.array().cast("array<double>")))).otherwise(
        F.array(F.when(kind == "PTR", F.col("result")))
    )
    flat = tests.filter(_is("PTR", "MPR", "FTR")).select("*", F.posexplode(values).alias("__pos", "__value"))
    multi, overall = kind == "MPR", F.col("__pos") == 0
    label = F.when(overall, F.concat(text, F.lit(" [MPR overall]"))).otherwise(
        F.concat(text, F.lit(" [MPR result "), (F.col("__pos") - 1).cast("string"), F.lit("]"))
    )
    limited = (kind == "PTR") | (multi & ~overall)
    return flat.select(
        *base, kind.alias("test_type"), F.when(multi, label).otherwise(F.col("test_txt")).alias("test_txt"), F.col("__pos").alias("expansion_index"),
        F.col("__value").alias("result"),
        F.when(kind == "PTR", verdicts.parametric_test_pass(flags)).when(overall, verdicts.reliable_test_pass(flags)).alias("test_pass"),
        F.when(limited, F.col("lo_limit")).alias("lo_limit"), F.when(limited, F.col("hi_limit")).alias("hi_limit"),
        F.when(kind != "FTR", F.col("units")).alias("units"),
    )


def array_length_errors(tests: DataFrame) -> DataFrame:
    """Multi-result records whose arrays differ from their declared counts."""
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    wrong = (size("rtn_rslt") != F.col("rslt_cnt")) | (size("rtn_stat") != F.col("rtn_icnt"))
    return tests.filter(_is("MPR") & wrong)


def measurement_rows(attempt_rows: DataFrame, sessioned: DataFrame) -> DataFrame:
    """Test records with the context of their complete attempt; attempts without tests give none."""
    tests = sessioned.filter(_is("PTR", "MPR", "FTR"))
    context = attempt_rows.filter(F.col("close_seq").isNotNull()).select(*_SITE, "session", "part_sequence", "open_seq", "close_seq")
    return tests.join(shuffled(context), [*_SITE, "session"])


def owned_tests(records: DataFrame, complete: DataFrame, chunk_rows: int = CHUNK_ROWS, context: tuple[str, ...] = ()) -> DataFrame:
    """Test records with the ``part_sequence`` and the ``context`` columns of the complete attempt (``open_seq`` to
    ``close_seq``) they belong to.

    The attempts of a site follow each other, so the attempt opened last is a running value of the site's stream: the
    records are dealt out and sorted once, for their attempts and their sessions together.
    """
    # An attempt comes before the record that opens it.
    unit = F.struct("close_seq", "part_sequence", *context).alias("__unit")
    opened = complete.select(*_SITE, (F.col("open_seq") * 2).alias("__at"), unit).dropna(subset=_SITE)
    tests = records.filter(_is("PTR", "MPR", "FTR")).withColumn("__at", F.col("seq") * 2 + 1)
    seen = carry(opened.unionByName(tests, allowMissingColumns=True), _SITE, "__at", chunk_rows, __now=Running("last", F.col("__unit")))
    inside = seen.filter(F.col("kind").isNotNull() & (F.col("seq") <= F.col("__now.close_seq")))
    return inside.select(*records.columns, *[F.col(f"__now.{c}").alias(c) for c in ("part_sequence", *context)])


_TEST = ["source_id", "run", "kind", "test_num"]


def _masked(opt: Column, mask: int) -> Column:
    return F.coalesce(verdicts.has_bits(opt, mask), F.lit(False))


def _resolve(raw: Column, opt: Column, first: Column | None, default_mask: int, missing_mask: int) -> Column:
    """``struct(value, status)`` of a default field; ``first`` is the first definition's."""
    unresolved = F.struct(F.lit(None).cast("double").alias("value"), F.lit("unknown").alias("status"))
    inherited = unresolved
    if first is not None:
        inherited = F.when(first["status"].isin("valid", "missing"), first).otherwise(unresolved)
    explicit = F.struct(raw.cast("double").alias("value"), F.lit("valid").alias("status"))
    missing = F.struct(F.lit(None).cast("double").alias("value"), F.lit("missing").alias("status"))
    chosen = F.when(_masked(opt, missing_mask), missing).when(raw.isNull() | _masked(opt, default_mask), inherited)
    if default_mask or missing_mask:
        chosen = chosen.when(opt.isNull(), unresolved)
    return chosen.otherwise(explicit)


# OPT_FLAG bits (use the default, explicitly none) per numeric default field.
DEFAULT_MASKS = {"lo_limit": (0x10, 0x40), "hi_limit": (0x20, 0x80), "lo_spec": (0x00, 0x04), "hi_spec": (0x00, 0x08)}


def inherit_definitions(tests: DataFrame, order: str = "seq") -> DataFrame:
    """Limits, specifications and units inherited from the first record of the test in its run.

    The first definitions are one aggregate row per test and run, joined back.
    """
    opt = F.col("opt_flag")
    units = F.col("units")
    own = {name: _resolve(F.col(name), opt, None, *masks) for name, masks in DEFAULT_MASKS.items()}
    first = tests.select(
        *_TEST, order, opt.alias("f_opt"),
        F.when(units == "\x00", "").otherwise(units).alias("f_units"), *[c.alias(f"f_{n}") for n, c in own.items()],
    ).groupBy(*_TEST).agg(
        F.min(F.struct(order, "f_opt", "f_units", *[f"f_{n}" for n in own])).alias("first"), F.count("*").alias("__rows")
    )
    joined = attach_few(tests, first, _TEST, "__rows", [order])
    is_first = F.col(order) == F.col(f"first.{order}")
    opt_used = F.coalesce(opt, F.when(~is_first, F.col("first.f_opt")))
    resolved = {}
    for name, masks in DEFAULT_MASKS.items():
        prior = F.col(f"first.f_{name}")
        later = _resolve(F.col(name), opt_used, prior, *masks)
        if name.endswith("_spec"):
            changed = F.col(name).isNotNull() & (later["status"] == "valid") & (prior["status"] == "valid") & (
                prior["value"] != later["value"]
            )
            invalid = F.struct(F.lit(None).cast("double").alias("value"), F.lit("invalid").alias("status"))
            later = F.when(F.coalesce(changed, F.lit(False)), invalid).otherwise(later)
        resolved[name] = F.when(is_first, own[name]).otherwise(later)
    blank = units.isNull() | (units == "")
    units_used = F.when(units == "\x00", "").when(blank & ~is_first, F.col("first.f_units")).otherwise(units)
    kept = [c for c in tests.columns if c not in (*DEFAULT_MASKS, "units")]
    return joined.select(
        *kept, units_used.alias("units"), is_first.alias("is_first_definition"),
        *[c["value"].alias(n) for n, c in resolved.items()], *[c["status"].alias(f"{n}_status") for n, c in resolved.items()],
    )


def open_units(records: DataFrame, scope: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """PIR and PRR with the effect on the set of open units: ``opens``, ``closes`` and the unit."""
    key = [*scope, "head", "site"]
    events = records.filter(_is("PIR", "PRR")).select(*key, "seq", "kind")
    before = carry(
        events, key, "seq", chunk_rows,
        __open=Running("last", F.when(_is("PIR"), F.col("seq")).otherwise(F.lit(-1)), include_row=False),
    )
    was = F.when(F.col("__open") >= 0, F.col("__open"))
    return before.select(*key, "seq", "kind", was.alias("was_open"))


def assign_records(
    records: DataFrame, kinds: tuple[str, ...] = ("DTR", "GDR"), scope: tuple[str, ...] = ("source_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Text records belong to the only open unit (``unit_seq`` of its PIR), else to the run."""
    key = list(scope)
    changes = open_units(records, key, chunk_rows)
    was, starts = F.coalesce("was_open", F.lit(0)), F.col("kind") == "PIR"
    opened = F.col("was_open").isNotNull()
    steps = changes.select(
        *key, "seq", F.lit(False).alias("asked"),
        F.when(starts & ~opened, 1).when(~starts & opened, -1).otherwise(0).alias("d_n"),
        F.when(starts, F.col("seq") - was).otherwise(-was).alias("d_seq"),
    )
    asked = records.filter(_is(*kinds)).select(
        *key, "seq", F.lit(True).alias("asked"), F.lit(0).alias("d_n"), F.lit(0).cast("bigint").alias("d_seq")
    )
    state = carry(
        steps.unionByName(asked), key, "seq", chunk_rows,
        open_count=Running("sum", F.col("d_n")), __total=Running("sum", F.col("d_seq")),
    )
    unit = F.when(F.col("open_count") == 1, F.col("__total"))
    return state.filter("asked").select(*key, "seq", "open_count", unit.alias("unit_seq"))


def explicit_owners(records: DataFrame, kinds: tuple[str, ...] = ("ATER", "CTRR"), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Records that name their head and site belong to the unit open there (``unit_seq`` of its PIR), if one is.

    A unit ends with its PRR, or with the run.
    """
    key = ["source_id", "run", "head", "site"]
    state = F.when(_is("PIR"), F.col("seq")).when(_is("PRR"), F.lit(-1))
    rows = records.filter(_is("PIR", "PRR", *kinds) & F.col("head").isNotNull() & F.col("site").isNotNull())
    seen = carry(rows.select(*key, "seq", "kind"), key, "seq", chunk_rows, unit=Running("last", state)).filter(_is(*kinds))
    placed = seen.select("source_id", "run", "seq", "kind", F.when(F.col("unit") >= 0, F.col("unit")).alias("unit_seq"))
    nowhere = records.filter(_is(*kinds) & (F.col("head").isNull() | F.col("site").isNull()))
    return placed.unionByName(nowhere.select("source_id", "run", "seq", "kind", F.lit(None).cast("bigint").alias("unit_seq")))


def record_owners(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The unit of every record that is no part of the test stream of a site, and how it was found.

    Text and generic records go to the only open unit, event and characterisation result records to the head and site
    that they name; ``ownership`` is ``only_open_unit``, ``explicit_head_site`` or ``unresolved`` (kept with the run).
    """
    text = ("DTR", "GDR")
    alone = assign_records(records, text, ("source_id", "run"), chunk_rows)
    kinds = records.filter(_is(*text)).select("source_id", "seq", "kind")
    alone = alone.join(shuffled(kinds), ["source_id", "seq"]).select("source_id", "run", "seq", "kind", "unit_seq", F.lit("only_open_unit").alias("how"))
    named = explicit_owners(records, chunk_rows=chunk_rows).withColumn("how", F.lit("explicit_head_site"))
    rows = alone.unionByName(named)
    return rows.select(
        "source_id", "run", "seq", "kind", "unit_seq", F.when(F.col("unit_seq").isNull(), "unresolved").otherwise(F.col("how")).alias("ownership")
    )


def definition_only(tests: DataFrame, records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First parametric record of a test in a run that was not executed and has no open unit:
    a definition, not an ownership error."""
    first = tests.groupBy(*_TEST).agg(F.min("seq").alias("__first"), F.count("*").alias("__rows"))
    executed = verdicts.has_bits(F.col("test_flg"), 0x10) & (F.col("parm_flg") == 0)
    candidates = attach(tests, first, _TEST, "__rows", ["seq"]).filter((F.col("seq") == F.col("__first")) & (F.col("run") > 0) & executed)
    key = ["source_id", "head", "site"]
    state = F.when(F.col("kind") == "PIR", 1).when(F.col("kind").isin("PRR", "MIR"), 0)
    events = records.filter(_is("PIR", "PRR")).select(*key, "seq", state.alias("open"), F.lit(False).alias("asked"))
    asked = candidates.select(*key, "seq", F.lit(None).cast("int").alias("open"), F.lit(True).alias("asked"))
    seen = carry(events.unionByName(asked), key, "seq", chunk_rows, now=Running("last", F.col("open")))
    free = seen.filter(F.col("asked") & (F.coalesce("now", F.lit(0)) == 0)).select(*key, "seq")
    return candidates.join(free, [*key, "seq"], "left_semi").select("source_id", "run", "kind", "test_num", "seq")
