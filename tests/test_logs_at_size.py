"""Tables of many logs: what is neither dealt out nor sorted gives the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from testfloor.operators import stream
from testfloor.session import materialize
from testfloor.sources import framing
from tests.test_stream import SCHEMA, random_stream


def records_of_runs():
    """Sources with 0 to 7 runs; what a run is called by is at times missing."""
    rng = random.Random(5)
    rows = []
    for runs in range(8):
        seq = 0
        for run in range(runs + 1):
            if run:
                rows.append((f"S{runs}", seq, "MIR", rng.choice([None, f"lot{run}"]), rng.choice([None, run])))
                seq += 1
            for _ in range(rng.randint(0, 6)):
                rows.append((f"S{runs}", seq, "PTR", "not a lot", 99))
                seq += rng.randint(1, 3)
    return rows


@pytest.mark.parametrize("few", [0, 4, 100])
def test_runs_of_stored_records(spark, few):
    rows = records_of_runs()
    table = materialize(spark.createDataFrame(rows, "source_id string, seq long, kind string, lot string, start long"), "test")
    expected, latest = set(), {}
    for source, seq, kind, lot, start in rows:
        if kind == "MIR":
            latest[source] = (latest.get(source, (0,))[0] + 1, lot, start)
        expected.add((source, seq, kind, *latest.get(source, (0, None, None))))
    found = stream.number_runs(table, ("lot", "start"), 5, stored=True, few_runs=few) if few else stream.number_runs(table, ("lot", "start"), 5)
    assert {tuple(r) for r in found.select("source_id", "seq", "kind", "run", "lot", "start").collect()} == expected
    assert found.count() == len(rows)
    assert found.schema == stream.number_runs(table, ("lot", "start")).schema


def test_records_of_short_sources_stay_where_they_are(spark):
    rows = [r for r in records_of_runs() if r[0] < "S5"]
    table = materialize(spark.createDataFrame(rows, "source_id string, seq long, kind string, lot string, start long"), "test")
    plan = stream.number_runs(table, ("lot",), stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan  # they were dealt out and sorted for two windows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_tests_of_complete_attempts(spark, seed):
    rows = random_stream(seed, strict=False)
    table = spark.createDataFrame(rows + [("A", 10_000, "PTR", None, 1, None, None, None, None)], SCHEMA)
    sessioned = stream.sessions(table)
    complete = stream.attempts(sessioned).filter("close_seq is not null")
    site = ["source_id", "head", "site"]
    tests = sessioned.filter(F.col("kind").isin("PTR", "MPR", "FTR"))
    joined = tests.join(complete.select(*site, "session", "part_sequence"), [*site, "session"])
    expected = {tuple(r) for r in joined.select(*site, "seq", "kind", "part_sequence").collect()}
    assert expected and len(expected) < tests.count()
    for chunk in (5, 1 << 16):
        found = stream.owned_tests(table.select(*site, "seq", "kind"), complete, chunk)
        got = found.select(*site, "seq", "kind", "part_sequence").collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_a_part_of_the_tests(spark, seed):
    table = spark.createDataFrame(random_stream(seed, strict=False), SCHEMA)
    some = F.col("kind").isin("PIR", "PRR") | ((F.col("kind") == "PTR") & (F.col("seq") % 3 == 0))
    shown = lambda df: {tuple(r) for r in df.select("source_id", "head", "site", "seq", "session").collect()}
    assert shown(stream.sessions(table.filter(some), 7)) == shown(stream.sessions(table, 7).filter(some))


def test_short_files_are_read_many_at_once(spark):
    cores = spark.sparkContext.defaultParallelism
    files = spark.range(cores * 64).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(10_000).cast("long").alias("length"))
    assert framing._reading_tasks(files) == cores  # 16 at a time before
    assert framing._reading_tasks(files.select("path")) == cores * 4
    assert framing._reading_tasks(files.withColumn("length", F.lit(framing.TASK_BYTES))) == cores * 64
