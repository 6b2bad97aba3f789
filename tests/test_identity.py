"""First and latest attempts, retests, yields: small hand-written populations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from testfloor.operators import identity, joins, pareto, yields
from testfloor.operators.scope import Scope

SCHEMA = "source_id string, run int, start_t int, attempt long, ecid string, wafer_issue string"


def latest(spark, rows, rule=identity.latest_pareto):
    df = spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], SCHEMA)
    return {(r.source_id, r.attempt): r for r in rule(df).collect()}


def test_latest_start_wins_whatever_the_row_order(spark):
    rows = [("a", 1, 10, 1, "d"), ("a", 2, 30, 2, "d"), ("b", 1, 20, 9, "d")]
    for order in itertools.permutations(rows):
        got = latest(spark, list(order))
        assert [got["a", 1].is_latest, got["a", 2].is_latest, got["b", 9].is_latest] == [False, True, False]


def test_tie_between_runs_is_ambiguous(spark):
    got = latest(spark, [("a", 1, 10, 1, "d"), ("b", 1, 10, 1, "d"), ("a", 1, 10, 2, "e"), ("a", 1, 10, 3, "e")])
    assert got["a", 1].is_latest is None and got["a", 1].issue == "ambiguous_latest"
    assert got["a", 3].is_latest and got["a", 2].is_latest is False


def test_missing_start_needs_one_run(spark):
    rows = [("a", 1, None, 1, "d"), ("a", 1, 5, 2, "d"), ("a", 1, None, 3, "e"), ("a", 2, 9, 4, "e"), ("a", 1, 1, 5, None)]
    got = latest(spark, rows)
    assert [got["a", i].is_latest for i in range(1, 6)] == [False, True, None, None, None]
    assert got["a", 5].issue == "unresolved_identity"


def test_wafer_issue_is_kept_by_one_rule_only(spark):
    rows = [("a", 1, 1, 1, None, "ambiguous_wafer")]
    assert latest(spark, rows)["a", 1].issue == "ambiguous_wafer"
    assert latest(spark, rows, identity.latest_engineering)["a", 1].issue == "unresolved_identity"


def engineering_fold(rows):
    """First and latest per device by a sequential scan."""
    out, devices = {}, {}
    for r in rows:
        devices.setdefault(r[4], []).append(r)
    for ecid, group in devices.items():
        scopes = {(r[0], r[1]) for r in group}
        bad = ecid is None or (len(scopes) > 1 and any(r[2] is None for r in group))
        value = lambda r: -1 if r[2] is None else r[2]

        def extreme(best, pick):
            edge = best(value(r) for r in group)
            at = [r for r in group if value(r) == edge]
            return None if bad or len({(r[0], r[1]) for r in at}) > 1 else pick(at, key=lambda r: r[3])

        first, last = extreme(min, min), extreme(max, max)
        for r in group:
            out[r[0], r[3]] = (None if first is None else r is first, None if last is None else r is last)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_first_and_latest_match_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice("ab"), rng.randint(1, 2), rng.choice([None, 1, 2, 3, 3]), i, rng.choice([None, "d", "e", "f", "g", "h", "i"])) for i in range(60)
    ]
    rows += [("a", 1, 5, 100, "solo"), ("a", 1, 5, 101, "solo")]
    expected = engineering_fold(rows)
    got = latest(spark, rows, identity.latest_engineering)
    assert {k: (r.is_first, r.is_latest) for k, r in got.items()} == expected


def test_hot_device_is_one_row_before_the_join(spark):
    rows = spark.range(3000).select(
        F.lit("a").alias("source_id"), F.lit(1).alias("run"), F.lit(1).alias("start_t"), F.col("id").alias("attempt"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ecid"),
    )
    flagged = identity.latest_pareto(rows)
    assert flagged.filter("is_latest").count() == 2001
    assert flagged.filter("is_latest and ecid = 'hot'").first().attempt == 2997


def test_attach_spreads_hot_and_missing_keys(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id"
    )
    facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    plain = {r.id: (r.k, r.top) for r in rows.join(facts, "k", "left").collect()}
    for hot_rows in (1, 100, 10**9):
        got = joins.attach(rows, facts, ["k"], "n", ["id"], hot_rows)
        assert {r.id: (r.k, r.top) for r in got.collect()} == plain and got.count() == 2000


def test_spread_keys_are_part_of_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").alias("k"), "id")
        facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
        plan = joins.attach(rows, facts, ["k"], "n", ["id"], 100)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(__key" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ATTEMPTS = [  # source, attempt, run, lot, wafer, head, site, flags, ecid, is_latest
    ("s", 1, 1, "L", "W1", 1, 0, 8, "d", False), ("s", 2, 1, "L", "W1", 1, 0, 0, "d", True), ("s", 3, 1, "L", None, 1, 1, 4, None, None),
    ("s", 4, 2, "M", "", 1, 1, 0, "e", False), ("s", 5, 2, "M", "W1", 1, 1, 8, "e", True), ("t", 1, 1, "M", "W2", 1, 0, 0, "d", None),
]
COLUMNS = "source_id string, attempt long, run int, lot string, wafer string, head int, site int, flags int, ecid string, is_latest boolean"


def test_yield_counts_and_reasons(spark):
    df = spark.createDataFrame(ATTEMPTS, COLUMNS)
    rows = yields.attempt_yield(yields.requested(df, excluded=[("s", 1), ("t", 1)])).collect()
    total = next(r for r in rows if r.level == "total")
    assert (total.scoped, total.eligible, total.excluded, total["pass"], total.fail, total.unknown, total.unresolved) == (6, 4, 2, 2, 1, 1, 1)
    empty = next(r for r in rows if r.key == "t")
    assert empty.yield_all is None and empty.yield_all_reason == "zero-eligible" and empty.yield_known_reason == "zero-known"
    for r in rows:
        assert r.scoped == r.eligible + r.excluded and r.eligible == r["pass"] + r.fail + r.unknown


def test_scope_rules(spark):
    df = spark.createDataFrame(ATTEMPTS, COLUMNS)
    count = lambda **kw: yields.requested(df, scope=Scope(**kw)).count()
    assert count() == 6 and count(lots=()) == 6 and count(lots=("L",)) == 3
    assert count(wafers=("W1", "")) == 4  # a missing wafer never matches
    assert count(sites=((1, 0),)) == 3 and count(runs=(("t", 1), ("s", 2))) == 3


def test_retest_impact(spark):
    df = spark.createDataFrame(ATTEMPTS, COLUMNS)
    r = yields.retest_impact(yields.requested(df)).first()
    assert (r.devices, r.retested_devices, r.extra_attempts, r.ever_verdict_changed, r.unresolved_identity_attempts) == (3, 2, 2, 2, 1)
    assert (r.recovered, r.degraded, r.first_fail, r.first_pass) == (1, 1, 1, 2)
    one = yields.retest_impact(yields.requested(df, excluded=[("s", 3), ("s", 1)]), population="latest").first()
    assert (one.devices, one.retested_devices, one.unresolved_identity_attempts) == (2, 1, 0)


def test_wafer_groups_keep_missing_and_empty_apart(spark):
    df = spark.createDataFrame(ATTEMPTS, COLUMNS)
    keys = {r.key for r in yields.wafer_comparison(yields.requested(df)).collect() if r.level == "group"}
    assert keys == {"W1", "W2", "__missing__", "__empty__"}


def test_step_matching(spark):
    runs = spark.createDataFrame([("A", "1"), ("A", None), ("B", "1"), ("C", "1")], "job_nam string, job_rev string")
    steps = [("one", [{"job_nam": "A", "job_rev": "1"}]), ("two", [{"job_nam": "A"}, {"job_nam": "B"}])]
    assert [r.step for r in identity.match_step(runs, steps).collect()] == [None, "two", "two", None]


def test_collapse_of_repeated_modes(spark):
    rows = [  # attempt, type, num, txt, pattern, rec, flag
        (1, "FTR", 6, "T", "p", 1, 128), (1, "FTR", 6, "T", "p", 2, 0), (1, "FTR", 6, "T", "q", 3, 0), (2, "FTR", 6, "T", "p", 4, 0),
        (2, "FTR", 6, "T", None, 5, 16), (3, "FTR", 6, "T", "p", 6, 16), (3, "FTR", 6, "T", "q", 7, 128),
    ]
    df = spark.createDataFrame(rows, "attempt int, test_type string, test_num int, test_txt string, pattern string, rec int, test_flg int")
    got = {r.attempt: r.passed for r in pareto.test_modes(df).collect()}
    assert got == {1: True, 2: None, 3: False}
