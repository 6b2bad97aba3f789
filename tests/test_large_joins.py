"""Joins of tables that grow with the input shuffle, however small their stored files look."""

from pyspark.sql import functions as F

from testfloor.operators import executions, joins, stream
from testfloor.operators.ordered import Running, carry
from testfloor.session import materialize
from testfloor.sources import eav


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    rows = spark.range(200).select(
        F.lit("one").alias("source_id"), F.lit(1).alias("head"), F.lit(0).alias("site"), F.col("id").alias("seq"),
        F.when(F.col("id") % 4 == 0, "PIR").when(F.col("id") % 4 == 3, "PRR").otherwise("PTR").alias("kind"), F.lit(0).alias("part_flg"),
        F.lit(None).cast("string").alias("part_id"),
    )
    return materialize(rows, "records")


def test_running_values_are_not_broadcast(spark):
    counted = carry(stored(spark), ["source_id"], "seq", 16, n=Running("sum", F.lit(1)))
    assert "Broadcast" not in plan(counted) and counted.filter("n <> seq + 1").isEmpty()


def test_attempts_meet_their_records_without_a_broadcast(spark):
    records = stored(spark)
    sessioned = stream.sessions(records)
    numbered = stream.attempts(sessioned)
    for joined in (stream.attempt_records(records, numbered), stream.measurement_rows(numbered, sessioned)):
        assert "Broadcast" not in plan(joined)
    assert stream.attempt_records(records, numbered).count() == 50 and stream.measurement_rows(numbered, sessioned).count() == 100


def test_few_facts_reach_their_rows_without_a_shuffle(spark):
    rows = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).union(spark.sql("select null, 300L"))
    facts = rows.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    few, many = (joins.attach_few(rows, facts, ["k"], "n", ["v"], limit) for limit in (100, 0))
    assert "Exchange hashpartitioning" not in plan(few) and "Exchange hashpartitioning" in plan(many)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.filter("top is null").count() == 1


def test_last_executions_are_dealt_out_once(spark):
    data = [(1, "5", None, 1), (1, "5", None, 2), (1, "5", "~", 3), (None, "~", "p", 4), (None, "~", "p", 5), (12, None, "", 6), (1, "2", "p", 7)]
    rows = spark.createDataFrame(data, "attempt long, test string, pattern string, rec int")
    marked = executions.mark_last_execution(rows, ["attempt", "test", "pattern"])
    assert marked.columns == [*rows.columns, "last_execution"] and marked.schema[0:3] == rows.schema[0:3]
    found = {r.rec: tuple(r) for r in marked.collect()}
    assert found == {d[3]: (*d, d[3] not in (1, 4)) for d in data}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # the rows once, the last executions once for their broadcast and once for their join
        assert plan(executions.mark_last_execution(rows, ["attempt", "test", "pattern"])).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_excluded_measurements_are_counted_from_stored_rows(spark, sf):
    from testfloor.plans import load
    from testfloor.plans.registry import QUERIES

    load()
    assert all("last-executions" in f for f in QUERIES["d05_excluded_measurements"](spark, sf).inputFiles())


def test_tasks_that_sort_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr("testfloor.session.TASK_ROWS", 50)
    rows = spark.range(1000).select(F.lit("same").alias("digest"), "id", F.col("id").alias("other"))
    paired = eav.pair_equal_rows(rows.select("digest", "id"), rows.select("digest", "other"), ["id"], ["other"])
    assert "Exchange hashpartitioning(digest" in plan(paired) and ", 40), REPARTITION_BY_NUM" in plan(paired)
    assert paired.count() == 1000 and paired.filter("id <> other").isEmpty()


def test_tasks_of_the_dashboard_rows_grow_with_the_rows(spark, sf, monkeypatch):
    from testfloor.plans import adapters

    monkeypatch.setattr("testfloor.session.TASK_ROWS", 100)
    rows = adapters.test_rows(spark, sf)
    tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert plan(rows).count(f", {tasks}), REPARTITION_BY_NUM") == 2
