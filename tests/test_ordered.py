"""Chunked running values against a plain fold."""

import random

from pyspark.sql import functions as F

from testfloor.operators.ordered import Running, carry, rank_in_order, running_in_order


def rows(n=400, seed=3):
    rng = random.Random(seed)
    order = rng.sample(range(n * 5), n)
    return [(rng.choice("aab"), seq, rng.choice([None, 1, 2, 5, -3])) for seq in order]


def fold(data):
    out, state = {}, {}
    for key, seq, value in sorted(data, key=lambda r: (r[0], r[1])):
        total, low, last = state.get(key, (0, None, None))
        before = last
        total += value or 0
        if value is not None:
            low, last = (value if low is None else min(low, value)), value
        state[key] = (total, low, last)
        out[key, seq] = (total, low, last, before)
    return out


def test_carry_matches_a_fold_for_any_chunk_size(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, seq long, v int").repartition(5)
    expected = fold(data)
    for chunk in (1, 7, 100, 1 << 16):
        found = carry(
            df, ["k"], "seq", chunk, total=Running("sum", F.col("v")), low=Running("min", F.col("v")),
            last=Running("last", F.col("v")), before=Running("last", F.col("v"), include_row=False),
        )
        got = {(r.k, r.seq): (r.total, r.low, r["last"], r.before) for r in found.collect()}
        assert got == expected


def test_running_in_order_with_one_hot_group_and_ties(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else None, rng.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    found = running_in_order(df, ["g"], [F.col("v").desc(), F.col("i")], upto=F.col("v"))
    expected = {}
    for g in ("hot", None):
        total = 0
        for _, v, i in sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])):
            total += v
            expected[i] = total
    assert {r.i: r.upto for r in found.collect()} == expected


def test_rank_over_the_whole_table(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert rank_in_order(df, [], [F.col("v")]).filter("rank <> v + 1").count() == 0


def test_carry_sorts_its_rows_once(spark):
    df = spark.createDataFrame(rows(), "k string, seq long, v int")
    plan = carry(df, ["k"], "seq", 7, total=Running("sum", F.col("v")))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    # The rows by chunk and place, the totals of chunks for their running sums, and these for the join.
    assert plan.count(" Sort [") == 3
