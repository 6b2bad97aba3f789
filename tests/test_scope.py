"""Selections: filters that exist or raise, ids of any type, exclusions as lists and as tables."""

import pytest

from testfloor.operators import distribution, scope

ROWS = [(f"s:{i:03d}", i % 3, 1 + i % 4, f"t{i % 2}", i % 2 == 0, True, float(i)) for i in range(24)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "attempt string, site int, number long, test string, is_latest boolean, last_execution boolean, value double")


def ids(df):
    return sorted(r.attempt for r in df.collect())


def test_filters_take_effect_or_raise(rows):
    chosen = scope.Selection(population="all", sites=(1,), tests=(2, 4))
    assert ids(scope.in_selection(rows, chosen)) == sorted(r[0] for r in ROWS if r[1] == 1 and r[2] in (2, 4))
    for wrong in (scope.Selection(hard_bins=(1,)), scope.Selection(run=3), scope.Selection(wafer="W")):
        with pytest.raises(ValueError, match="no column"):
            scope.in_selection(rows, wrong)
    with pytest.raises(ValueError, match="no column number"):
        scope.in_selection(rows.drop("number"), chosen)
    with pytest.raises(ValueError, match="DataFrame"):
        scope.in_selection(rows, scope.Selection(attempts=tuple(map(str, range(scope.MAX_LISTED + 1)))))


def test_exclusions_of_text_ids(spark, rows):
    names = ("s:000", "s:002", "s:003")
    as_list = scope.Selection(excluded_devices=names)
    as_table = scope.Selection(excluded_devices=spark.createDataFrame([(n, 1) for n in names] * 2, "attempt string, other int"))
    kept = sorted(r[0] for r in ROWS if r[4] and r[0] not in names)
    for chosen in (as_list, as_table):
        assert ids(scope.analysis_rows(rows, chosen, True)) == kept
        assert tuple(scope.inclusion_counts(rows, chosen).first()) == (len(kept), 2)
    assert tuple(scope.inclusion_counts(rows, scope.Selection()).first()) == (12, 0)


def test_excluded_measurements(spark, rows):
    out = spark.createDataFrame([("s:004", "t0"), ("s:006", "t1"), (None, "t0")], "attempt string, test string")
    chosen = scope.Selection(excluded_devices=("s:000",), excluded_measurements=out)
    assert ids(scope.analysis_rows(rows, chosen, True)) == sorted(r[0] for r in ROWS if r[4] and r[0] not in ("s:000", "s:004"))
    assert tuple(scope.inclusion_counts(rows, chosen, measurements=True).first()) == (10, 2)
    assert tuple(scope.inclusion_counts(rows, chosen).first()) == (11, 1)  # devices know no measurements


def test_points_are_whole_unless_asked(spark):
    data = [(f"a{i % 400}", t, i % 3, float(i), "V", i) for i, t in ((i, ("x", "y")[i // 400]) for i in range(800))]
    df = spark.createDataFrame(data, "attempt string, test string, site int, value double, units string, rec long")
    assert distribution.scatter_points(df, "x", "y").count() == 400 and distribution.scatter_points(df, "x", "y", 30).count() == 30
