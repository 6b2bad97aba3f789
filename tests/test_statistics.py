"""Distributions, dashboards and pages against Python's own arithmetic."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from testfloor.operators import dashboard, distribution, paging

ROWS = "test string, place string, units string, attempt long, rec long, value double, value_state string, low double, high double"


def series(spark, seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        test = rng.choice(["hot", "hot", "hot", "b"])
        value = rng.choice([None, 1.0, 2.0, 2.0, rng.gauss(5, 3)])
        rows.append((test, "", "V", i, (i * 7919) % 1000, value, "valid" if value is not None else rng.choice(["missing", "invalid", "nonfinite"]), 0.0, 10.0))
    return rows, spark.createDataFrame(rows, ROWS)


def test_quantiles_interpolate(spark):
    rows, df = series(spark)
    got = {r.test: r for r in distribution.quantiles(distribution.cumulative_counts(df)).collect()}
    for test in ("hot", "b"):
        values = sorted(r[5] for r in rows if r[0] == test and r[5] is not None)
        for p in (2, 25, 50, 75, 98):
            rank = (len(values) - 1) * p / 100
            low = int(rank)
            exact = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (rank - low)
            assert got[test][f"p{p}"] == pytest.approx(exact)


def test_statistics_and_states(spark):
    rows, df = series(spark)
    for r in distribution.statistics(df).collect():
        mine = [x for x in rows if x[0] == r.test]
        values = [x[5] for x in mine if x[5] is not None]
        assert (r["count"], r.missing, r.invalid) == (len(values), sum(x[6] == "missing" for x in mine), sum(x[6] == "invalid" for x in mine))
        assert r.sigma == pytest.approx(statistics.stdev(values)) and not r.variable_limits
        mean = statistics.mean(values)
        assert r.ppk == pytest.approx(min((10 - mean), mean) / (3 * r.sigma))


def test_limits_that_vary_give_no_ppk(spark):
    rows = [("t", "", "V", i, i, float(i), "valid", 0.0 if i else None, 9.0) for i in range(5)]
    r = distribution.statistics(spark.createDataFrame(rows, ROWS)).first()
    assert r.variable_limits and r.ppk is None and r.low is None


def test_histogram_shares_ranges_per_unit(spark):
    rows = [("a", "", "V", 1, 1, 0.0, "valid", None, None), ("b", "", "V", 1, 2, 10.0, "valid", None, None), ("c", "", "A", 1, 3, 4.0, "valid", None, None)]
    got = {(r.test, r.bin): r for r in distribution.histogram(spark.createDataFrame(rows, ROWS), 5).collect()}
    assert got["a", 0]["count"] == 1 and got["b", 4]["count"] == 1 and got["c", 2]["count"] == 1
    assert got["c", 0].hist_min == 3.5 and got["c", 0].hist_max == 4.5 and len(got) == 15


def test_cdf_is_thinned_but_ends_at_one_hundred(spark):
    _, df = series(spark, n=900)
    points = distribution.empirical_cdf(distribution.cumulative_counts(df), 20).filter("test = 'hot'").orderBy("value").collect()
    shares = [p.probability for p in points]
    assert shares == sorted(shares) and shares[-1] == 100.0 and len(points) <= 30


def test_trend_keeps_both_ends(spark):
    rows, df = series(spark, n=500)
    got = distribution.trend(df, 10).filter("test = 'hot'").orderBy("position").collect()
    mine = sorted((x[4], x[3]) for x in rows if x[0] == "hot" and x[5] is not None)
    assert got[0].attempt == mine[0][1] and got[-1].attempt == mine[-1][1] and len(got) <= 11


def test_scatter_pairs_last_values_and_refuses_mixed_units(spark):
    rows = [("x", "", "V", a, a, float(a), "valid", None, None) for a in range(5)] + [("y", "", "V", a, a, 2.0 * a, "valid", None, None) for a in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", site int")
    r = distribution.scatter(df, "x", "y").first()
    assert (r["count"], r.unpaired, r.mixed_units) == (4, 1, False) and r.correlation == pytest.approx(1.0)
    mixed = distribution.scatter(df.withColumn("units", F.when(F.col("attempt") == 0, "A").otherwise("V")), "x", "y").first()
    assert mixed.mixed_units and mixed.correlation is None


EAV_ROWS = (
    "device string, attempt long, record long, rec long, lot string, wafer string, head int, site int, hard_bin int, soft_bin int, x int, y int, "
    "part_pass boolean, test_num int, test_type string, test_txt string, result double, test_pass boolean, lo_limit double, hi_limit double, "
    "units string, part_id string, duration_ms long, part_merge_key string"
)


def eav_row(device, record, test, result, test_pass, lo=None, hi=None, units=None, part_pass=True, wafer="W", site=0, lot="L", kind="PTR", text="t"):
    return (device, record, record, record, lot, wafer, 1, site, 1, 2, 1, 1, part_pass, test, kind, text, result, test_pass, lo, hi, units, "p", 5, "k")


def test_summary_takes_first_known_limits_and_merges_definitions(spark):
    values = [1e6 + v for v in (0.001, 0.002, 0.003, 0.004)]
    rows = [
        eav_row("a", 1, 7, values[0], None), eav_row("b", 2, 7, values[1], True, lo=5.0, units="V"),
        eav_row("c", 3, 7, values[2], False, lo=6.0, hi=9.0, units="A"), eav_row("d", 4, 7, values[3], True, hi=2e6), eav_row("e", 5, 7, None, None),
    ]
    r = dashboard.test_summary(dashboard.all_rows(spark.createDataFrame(rows, EAV_ROWS))).first()
    assert (r.lo_limit, r.hi_limit, r.units) == (5.0, 9.0, "V")
    assert (r.total, r["pass"], r.fail, r.unknown, r.limit_fail) == (5, 2, 1, 2, 1)
    assert r.sigma == pytest.approx(statistics.stdev(values), rel=1e-6) and r.mean == pytest.approx(statistics.mean(values))


def test_single_value_has_no_sigma(spark):
    r = dashboard.test_summary(dashboard.all_rows(spark.createDataFrame([eav_row("a", 1, 7, 1.0, True)], EAV_ROWS))).first()
    assert r.sigma is None and r.mean == 1.0 and r.yield_percent == 100.0


def test_device_passes_only_if_every_row_does(spark):
    rows = [eav_row("a", 2, 7, 1.0, True, site=3), eav_row("a", 1, 8, 1.0, True, part_pass=False, site=1), eav_row("b", 3, 7, 1.0, True, wafer=None)]
    df = dashboard.all_rows(spark.createDataFrame(rows, EAV_ROWS))
    k = dashboard.kpis(df).first()
    assert (k.parts, k.passed_parts, k.failed_parts, k.yield_percent, k.wafers, k.sites, k.tests) == (2, 1, 1, 50.0, 1, 2, 2)
    sites = {r.label: r.total for r in dashboard.part_yield(df).filter("dimension = 'site'").collect()}
    assert sites == {"H1 / S1": 1, "H1 / S0": 1}  # the first row of a device decides


def test_correlation_needs_three_pairs(spark):
    rows = [eav_row(f"d{i}", i * 10 + t, t, float(i if t == 1 else -i if t == 2 else i * i), True) for i in range(4) for t in (1, 2, 3) if t < 3 or i < 2]
    df = dashboard.all_rows(spark.createDataFrame(rows, EAV_ROWS))
    got = [(r.x_test, r.y_test, r.correlation, r.pairs) for r in dashboard.correlations(df, dashboard.test_summary(df)).collect()]
    assert got == [("1 - t", "2 - t", -1.0, 4)]


def test_missing_values_are_all_listed(spark):
    df = dashboard.all_rows(spark.createDataFrame([eav_row("a", 1, 7, None, None, wafer=None)], EAV_ROWS))
    got = {r.label: r.fail for r in dashboard.quality_scorecard(df).collect()}
    assert len(got) == 8 and got["missing wafer_id"] == 1 and got["missing part_id"] == 0


def test_page_order_and_marks(spark):
    df = spark.createDataFrame([(1, 5, "b"), (2, None, "A"), (3, -2, None), (4, 5, "c")], "id int, n int, t string")
    ids = lambda *a, **k: [r.id for r in paging.page(df, *a, **k).collect()]
    assert ids("n", ["id"], 0, 4) == [3, 2, 1, 4] and ids("n", ["id"], 0, 4, descending=True) == [1, 4, 2, 3]
    assert ids("t", ["id"], 1, 2) == [2, 1] and ids(None, ["id"], 3, 5) == [4]
    marked = df.withColumns({"passed": F.col("id") != 3, "alarm": F.col("id") == 4})
    marks = paging.annotate(marked, "n", ["id"], F.col("id") == 2, {"n": ">4"})
    assert sorted((r.position, r.failed, r.alarm, r.is_excluded, r.alert) for r in marks.collect()) == [
        (0, True, False, False, False), (1, False, False, True, False), (2, False, False, False, True), (3, False, True, False, True)
    ]
    n = paging.neighbours(marks, 1).first()
    assert (n.previous_annotation, n.next_annotation, n.annotation_count) == (0, 2, 4)
