"""Dashboard results over measurement rows.

Every function takes rows with a ``scope`` column and reports per scope:
:func:`all_rows` gives one scope, :func:`all_and_per_lot` one for all rows and
one for each lot. Rows carry ``device``, ``record`` (order) and the EAV columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from testfloor.functions import keys, verdicts
from testfloor.session import materialize

ALL = "(all)"


def all_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scope", F.lit(ALL))


def all_and_per_lot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("scope", F.explode(F.array(F.lit(ALL), F.concat(F.lit("lot "), F.col("lot")))))


def _failed() -> Column:
    return verdicts.row_failure(F.col("test_pass"), F.col("result"), F.col("lo_limit"), F.col("hi_limit"))


def _test_columns() -> list[Column]:
    text = F.when(F.col("test_type") == "MPR", F.col("test_txt"))
    return [F.col("test_num"), F.col("test_type"), text.alias("channel_txt")]


def _entry(dimension: str, label: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), label.alias("label"))


def devices(rows: DataFrame) -> DataFrame:
    """One row per device: passed only if every row did; attributes of its first row.

    Rows are first reduced to attempts, which is where the bulk of them goes.
    """
    attributes = ["wafer", "head", "site", "hard_bin", "soft_bin"]
    attempts = rows.groupBy("scope", "device", "attempt", *attributes).agg(
        F.bool_and("part_pass").alias("part_pass"), F.min("record").alias("record")
    )
    return attempts.groupBy("scope", "device").agg(
        F.bool_and("part_pass").alias("part_pass"),
        F.min_by(F.struct(*attributes), F.struct("record", "attempt")).alias("first"),
    ).select("scope", "device", "part_pass", "first.*")


def test_summary(rows: DataFrame) -> DataFrame:
    """Counts, statistics and first known limits per test.

    Rows are first reduced per test and definition (name, limits, units), with
    numeric buffers only, so the reduction is a hash aggregation on the map side;
    the few definitions of a test are then merged.
    """
    value, definition = F.col("result").cast("double"), ["test_txt", "lo_limit", "hi_limit", "units"]
    finite = F.when(verdicts.is_finite(value), value)
    limit_fail = verdicts.limit_failure(value, F.col("lo_limit"), F.col("hi_limit"))
    test = ["scope", "test_num", "test_type", "channel_txt"]
    parts = rows.groupBy("scope", *_test_columns(), *definition).agg(
        F.min("record").alias("record"), F.count("*").alias("total"),
        F.count_if(F.col("test_pass")).alias("pass"), F.count_if(~F.col("test_pass")).alias("fail"),
        F.count_if(F.col("test_pass").isNull()).alias("unknown"), F.count_if(limit_fail).alias("limit_fail"),
        F.count(finite).alias("n"), F.avg(finite).alias("m"), F.var_pop(finite).alias("v"),
        F.min(finite).alias("min"), F.max(finite).alias("max"),
    )
    # Mean of the test beside each part, for squared deviations around it.
    whole = Window.partitionBy(*test)
    mean = F.sum(F.col("n") * F.col("m")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0))
    centred = parts.withColumn("mean", mean).withColumn(
        "squares", F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    )

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("record"))).alias(name)

    totals = centred.groupBy(*test).agg(
        F.min_by("test_txt", "record").alias("test_txt"),
        *[F.sum(c).alias(c) for c in ("total", "pass", "fail", "unknown", "limit_fail")],
        F.max("mean").alias("mean"), F.sum("n").alias("n"), F.sum("squares").alias("squares"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        first_known("lo_limit"), first_known("hi_limit"), first_known("units"),
    )
    sigma = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return totals.select(
        *test, keys.test_label(F.col("test_num"), F.col("test_txt")).alias("label"),
        *["total", "pass", "fail", "unknown", "limit_fail", "mean"], sigma.alias("sigma"),
        *["min", "max", "lo_limit", "hi_limit", "units"],
        verdicts.percent(F.col("pass"), F.col("pass") + F.col("fail")).alias("yield_percent"),
    )


def _top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each scope; ``df`` is already aggregated."""
    position = F.row_number().over(Window.partitionBy("scope").orderBy(*order))
    return df.withColumn("position", position).filter(F.col("position") <= limit)


def _pareto_order() -> list[Column]:
    return [F.desc("fail"), F.desc("limit_fail"), F.desc("total"), F.asc("label"), F.asc("test_num"), F.asc("test_type")]


def failure_pareto(summary: DataFrame, limit: int) -> DataFrame:
    return _top(summary, _pareto_order(), limit)


def process_windows(summary: DataFrame, limit: int) -> DataFrame:
    """Capability index where both limits are known and the spread is positive."""
    mean, sigma = F.col("mean"), F.col("sigma")
    margin = F.least(F.col("hi_limit") - mean, mean - F.col("lo_limit"))
    both = F.col("lo_limit").isNotNull() & F.col("hi_limit").isNotNull() & (sigma > 0)
    capable = summary.filter(sigma.isNotNull()).withColumn("cp", F.when(both, margin / (F.lit(3.0) * sigma)))
    return _top(capable, [F.desc("limit_fail"), F.asc_nulls_last("cp"), F.asc("label")], limit)


def kpis(rows: DataFrame) -> DataFrame:
    """One row per scope: rows, devices, yield and the number of distinct things seen."""
    seen = rows.groupBy("scope", "lot", "wafer", *_test_columns()).agg(
        F.count("*").alias("n"), F.count_if(~F.col("test_pass")).alias("fail")
    )
    # Distinct counts over the short table of combinations.
    tests = seen.groupBy("scope", "test_num", "test_type", "channel_txt").agg(F.sum("fail").alias("fail")).groupBy(
        "scope"
    ).agg(F.count("*").alias("tests"), F.count_if(F.col("fail") > 0).alias("failing_tests"))
    places = seen.groupBy("scope").agg(
        F.sum("n").alias("rows"), F.count_distinct("lot").alias("lots"), F.count_distinct("wafer").alias("wafers")
    )
    sites = devices(rows).groupBy("scope", "head", "site").agg(
        F.count("*").alias("n"), F.count_if("part_pass").alias("passed")
    )
    parts = sites.groupBy("scope").agg(
        F.sum("n").alias("parts"), F.sum("passed").alias("passed_parts"), F.count("*").alias("sites")
    )
    # One row per scope from each part, laid side by side by aggregation.
    sides = places.unionByName(tests, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True)
    merged = sides.groupBy("scope").agg(*[F.max(c).alias(c) for c in sides.columns if c != "scope"])
    return merged.select(
        "scope", "rows", "parts", "passed_parts",
        (F.col("parts") - F.col("passed_parts")).alias("failed_parts"),
        verdicts.percent(F.col("passed_parts"), F.col("parts")).alias("yield_percent"),
        "tests", "lots", "wafers", "sites", "failing_tests",
    )


def part_yield(rows: DataFrame) -> DataFrame:
    """Device yield by wafer, site, hard and soft bin (the device's first row decides)."""
    counted = devices(rows).groupBy("scope", "wafer", "head", "site", "hard_bin", "soft_bin").agg(
        F.count("*").alias("total"), F.count_if("part_pass").alias("pass")
    )
    dimensions = F.array(
        _entry("wafer", keys.wafer_label(F.col("wafer"))),
        _entry("site", keys.site_label(F.col("head"), F.col("site"))),
        _entry("hard_bin", keys.hard_bin_label(F.col("hard_bin"))),
        _entry("soft_bin", keys.soft_bin_label(F.col("soft_bin"))),
    )
    grouped = (
        counted.select("scope", "total", "pass", F.explode(dimensions).alias("d"))
        .groupBy("scope", "d.dimension", "d.label")
        .agg(F.sum("total").alias("total"), F.sum("pass").alias("pass"))
    )
    return grouped.select(
        "*", (F.col("total") - F.col("pass")).alias("fail"),
        verdicts.percent(F.col("pass"), F.col("total")).alias("yield_percent"),
    )


def commonality(rows: DataFrame, limit: int) -> DataFrame:
    """Failing rows counted on seven dimensions."""
    label = keys.test_label(F.col("test_num"), F.col("test_txt"))
    combined = (
        rows.filter(_failed())
        .groupBy("scope", label.alias("test"), "wafer", "head", "site", "hard_bin", "soft_bin")
        .agg(F.count("*").alias("n"))
    )
    site = keys.site_label(F.col("head"), F.col("site"))
    hard = keys.hard_bin_label(F.col("hard_bin"))
    pair = lambda other: F.concat(F.col("test"), F.lit(" @ "), other)
    dimensions = F.array(
        _entry("test", F.col("test")),
        _entry("wafer", keys.wafer_label(F.col("wafer"))),
        _entry("site", site),
        _entry("hard_bin", hard),
        _entry("soft_bin", keys.soft_bin_label(F.col("soft_bin"))),
        _entry("test_site", pair(site)),
        _entry("test_hard_bin", pair(hard)),
    )
    counted = (
        combined.select("scope", "n", F.explode(dimensions).alias("d"))
        .groupBy("scope", "d.dimension", "d.label")
        .agg(F.sum("n").alias("count"))
    )
    return _top(counted, [F.desc("count"), F.asc("dimension"), F.asc("label")], limit)


def heatmap(rows: DataFrame) -> DataFrame:
    points = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("scope", "x", "y").agg(
        F.count("*").alias("total"), F.count_if(_failed()).alias("fail")
    )
    return points.withColumn(
        "yield_percent", verdicts.percent(F.col("total") - F.col("fail"), F.col("total"))
    )


def quality_scorecard(rows: DataFrame) -> DataFrame:
    """Eight missing-value counters, present even at zero."""
    missing = {
        "missing wafer_id": F.col("wafer").isNull(),
        "missing part_id": F.col("part_id") == "",
        "missing x/y coordinate": F.col("x").isNull() | F.col("y").isNull(),
        "missing test_pass": F.col("test_pass").isNull(),
        "missing result": F.col("result").isNull(),
        "missing limits": F.col("lo_limit").isNull() | F.col("hi_limit").isNull(),
        "missing test_time_ms": F.col("duration_ms").isNull(),
        "unresolved coordinate identity": F.col("part_merge_key").isNull(),
    }
    counted = rows.groupBy("scope").agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in missing.items()]
    )
    return counted.unpivot(["scope", "total"], list(missing), "label", "fail").select(
        "scope", "label", "total", (F.col("total") - F.col("fail")).alias("pass"), "fail",
        verdicts.percent(F.col("total") - F.col("fail"), F.col("total")).alias("yield_percent"),
    )


def correlations(rows: DataFrame, summary: DataFrame, tests: int = 16, limit: int = 60) -> DataFrame:
    """Pearson correlation among the leading tests, on the first value per device and test.

    The tests of a device become columns, so all coefficients come out of one
    aggregation and no pair of rows is ever formed.
    """
    test = ["test_num", "test_type", "channel_txt"]
    usable = summary.filter(F.col("mean").isNotNull() & (F.col("sigma") > 0))
    # A short table, read three times below and counted here.
    chosen = materialize(_top(usable, _pareto_order(), max(tests, 2)).select("scope", *test, "label", "position"), "chosen-tests")
    tests = chosen.agg(F.max("position")).first()[0] or 0
    value = F.col("result").cast("double")
    points = rows.filter(verdicts.is_finite(value)).select(
        "scope", "device", *_test_columns(), "record", "rec", value.alias("value")
    )
    on = [points["scope"] == chosen["scope"], *[points[t].eqNullSafe(chosen[t]) for t in test]]
    ranked = points.join(chosen, on).select(points["scope"], "device", "position", "rec", "value")
    first = ranked.groupBy("scope", "device", "position").agg(F.min(F.struct("rec", "value"))["value"].alias("value"))
    wide = first.groupBy("scope", "device").agg(
        *[F.max(F.when(F.col("position") == k, F.col("value"))).alias(f"v{k}") for k in range(1, max(tests, 2) + 1)]
    )
    pairs = list(combinations(range(1, max(tests, 2) + 1), 2))
    both = {p: F.col(f"v{p[0]}").isNotNull() & F.col(f"v{p[1]}").isNotNull() for p in pairs}
    totals = wide.groupBy("scope").agg(
        *[
            F.struct(
                F.lit(a).alias("left"), F.lit(b).alias("right"),
                F.count_if(both[a, b]).alias("pairs"), F.corr(f"v{a}", f"v{b}").alias("r"),
            ).alias(f"p{a}_{b}")
            for a, b in pairs
        ]
    )
    found = totals.select("scope", F.explode(F.array(*[f"p{a}_{b}" for a, b in pairs])).alias("p")).select("scope", "p.*")
    found = found.filter((F.col("pairs") >= 3) & F.col("r").isNotNull() & ~F.isnan("r"))
    names = chosen.select("scope", "position", "label")
    named = found.join(
        names.select("scope", F.col("position").alias("left"), F.col("label").alias("x_test")), ["scope", "left"]
    ).join(names.select("scope", F.col("position").alias("right"), F.col("label").alias("y_test")), ["scope", "right"])
    return _top(
        named.withColumn("correlation", F.round("r", 6)),
        [F.desc(F.abs("correlation")), F.desc("pairs"), F.asc("left"), F.asc("right")], limit,
    ).select("scope", "x_test", "y_test", "correlation", "pairs", "position")
