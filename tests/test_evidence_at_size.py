"""Fields of many records: work in even tasks, and definitions that reach their rows."""

from pyspark.sql import functions as F

from testfloor.operators import quality, stream
from testfloor.plans import load, stdf_files
from testfloor.session import materialize, shuffled
from testfloor.sources import stdf


def framed(spark, sf):
    load()
    return stdf.unique_content(stdf_files.records(spark, sf))


def test_fields_are_read_in_even_tasks(spark, sf, monkeypatch):
    """All records of the commonest type were the work of one task."""
    monkeypatch.setattr(stdf, "TASK_RECORDS", 500)
    records = framed(spark, sf)
    sizes = [r["n"] for r in stdf.dealt(records).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == -(-records.count() // 500) and max(sizes) < 1000


def test_only_the_columns_asked_for(spark, sf):
    records = framed(spark, sf)
    every, some = stdf.field_evidence(records), stdf.field_evidence(records, ("record", "presence", "number"))
    assert some.columns == ["record", "presence", "number"] and every.columns[:4] == ["source_id", "record_seq", "offset", "record"]
    counts = lambda df: sorted(map(str, df.groupBy("record", "presence").agg(F.count("*"), F.count("number"), F.round(F.sum(F.nanvl("number", F.lit(0.0))), 1)).collect()))
    assert counts(every) == counts(some)


def test_fields_are_resolved_by_the_run_of_their_record(spark, sf):
    records = framed(spark, sf)
    runs = stream.number_runs(stdf.decode_events(records)).select("source_id", F.col("seq").alias("record_seq"), "run")
    beside = quality.resolved_status(quality.field_status(stdf.field_evidence(records)), runs)
    numbered = materialize(records.join(shuffled(runs), ["source_id", "record_seq"], "left"), "test")
    within = quality.resolved_status(quality.field_status(stdf.field_evidence(numbered)))
    columns = ["record", "field", "run", "test_num", "status", "eff_text", "eff_number", "origin", "inherited_from", "issue"]
    counts = lambda df: sorted(map(str, df.groupBy(columns).count().collect()))
    assert beside.columns == within.columns and counts(beside) == counts(within)
    tests = ["source_id", "run", "record", "test_num"]
    rows = quality.field_status(stdf.field_evidence(numbered))
    least = rows.filter("record in ('PTR', 'MPR')").groupBy(*tests).agg(F.min("record_seq").alias("record_seq"))
    known = quality.resolved_status(rows, firsts=rows.join(least.select("source_id", "record_seq"), ["source_id", "record_seq"], "left_semi"))
    assert counts(known) == counts(within)
    # No row of a field is dealt out for its definition.
    assert within._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0


def test_structure_is_judged_by_its_fields_alone(spark, sf, monkeypatch):
    """Whole records of dozens of fields were dealt out, sorted and stored (F8)."""
    kept = []
    monkeypatch.setattr(quality, "materialize", lambda df, label: kept.append(df.columns) or materialize(df, label))
    events = stdf.decode_events(framed(spark, sf))
    assert quality.run_findings(events).columns == ["source_id", "severity", "rule", "record_type", "seq", "message"]
    assert set(kept[0]) == {"source_id", "seq", "kind", "head", "site", "site_grp", "sites", "wafer_id", "fabwf_id", "run", "epoch", "last_border", "in_run"}
