"""Column helpers: whole truth tables and hand-written cases."""

from pyspark.sql import functions as F

from testfloor.functions import filters, keys, verdicts
from testfloor.sources.eav import partition_value, safe_cells


def test_all_256_flags(spark):
    flag = F.col("id").cast("int")
    rows = spark.range(256).select(
        flag.alias("f"), verdicts.attempt_verdict(flag).alias("attempt"), verdicts.part_pass(flag).alias("part"),
        verdicts.reliable_test_pass(flag).alias("reliable"), verdicts.parametric_test_pass(flag).alias("ptr"),
        verdicts.functional_class(flag).alias("ftr"),
    ).collect()
    for r in rows:
        f = r.f
        assert r.attempt == ("unknown" if f & 0x14 else "fail" if f & 8 else "pass")
        assert r.part == (not f & 0x18)
        assert r.reliable == (None if f & 0x7E else not f & 0x80)
        assert r.ptr == (None if f & 0x40 else not f & 0x80)
        assert r.ftr == ("not_executed" if f & 0x10 else "unknown" if f & 0x6E else "fail" if f & 0x80 else "pass")


def one(spark, schema, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_clean_ids(spark):
    values = ["W1", " ", "", "a\tb", "x�", None, "ok id"]
    assert one(spark, "v string", values, keys.clean_id(F.col("v"))) == ["W1", None, None, None, None, None, "ok id"]


def test_coordinate_names(spark):
    names = ["DieX", "die_y", "XCoord", "Vmax", "my xy", "posX", "relax Y", "VDD", "HTTPX", "XYpos", "Y", None]
    found = one(spark, "v string", names, keys.coordinate_axis(F.col("v")))
    expected = [("x", 2), ("y", 2), ("x", 2), ("x", 1), None, ("x", 2), ("y", 2), None, ("x", 1), ("x", 2), ("y", 2), None]
    assert [None if f is None else tuple(f) for f in found] == expected


def test_characterisation_ids(spark):
    values = ["0x1F", "0X0a", "42", "x", "", "0x", None]
    assert one(spark, "v string", values, keys.characterization_id(F.col("v"))) == [31, 10, 42, None, None, None, None]


def test_limit_edges_pass(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (2.1, 1.0, 2.0), (float("nan"), 1.0, 2.0), (float("inf"), 1.0, 2.0), (None, 1.0, 2.0), (0.5, None, None)],
        "v double, lo double, hi double",
    )
    args = (F.col("v"), F.col("lo"), F.col("hi"))
    found = rows.select(verdicts.limit_failure(*args), verdicts.row_failure(F.lit(None).cast("boolean"), *args)).collect()
    assert [tuple(r) for r in found] == [
        (False, False), (False, False), (True, True), (False, False), (False, True), (False, False), (False, False)
    ]


def test_filter_expressions(spark):
    df = spark.createDataFrame([(1, "Abc"), (5, None), (None, "x")], "n int, t string")
    count = lambda name, text: df.filter(filters.expression(df, name, text)).count()
    assert [count("n", t) for t in (">=1", "<5", "!=1", "=5", "", "[null]")] == [2, 1, 2, 1, 3, 1]
    assert [count("t", t) for t in ("=Abc", "!=Abc", "ab", ">a", "=[null]")] == [1, 2, 1, 0, 1]


def test_partition_values_never_collide(spark):
    values = ["A-1_b", "", None, "__x", "é", "a"]
    assert one(spark, "v string", values, partition_value(F.col("v"))) == ["A-1_%62", "__empty", None, "%5F_%78", "%C3%A9", "%61"]


def test_formula_cells_are_quoted(spark):
    df = spark.createDataFrame([("=1+1", 1), ("ok", 2), ("\tx", 3), (None, 4)], "t string, n int")
    assert [r.t for r in safe_cells(df).collect()] == ["'=1+1", "ok", "'\tx", None]
