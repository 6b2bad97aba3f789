"""Device identity and the first or latest attempt of a device."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.functions import keys
from testfloor.operators.joins import attach


def coordinate_candidates(tests: DataFrame, attempt: list[str]) -> DataFrame:
    """Die coordinates per attempt from the names of its parametric tests.

    Per axis the highest rank wins; a different or unusable value at that rank
    leaves the axis unresolved.
    """
    found = tests.filter(F.col("test_type") == "PTR").select(
        *attempt, keys.coordinate_axis(F.col("test_txt")).alias("c"),
        keys.positive_integer(F.col("result")).alias("value"),
    )
    # One aggregation: per (axis, rank) the extremes, then the best rank of each axis.
    columns, resolved = [], {}
    for axis in ("x", "y"):
        for rank in (2, 1):
            at = (F.col("c.axis") == axis) & (F.col("c.rank") == rank)
            name = f"{axis}{rank}"
            columns += [
                F.count_if(at).alias(f"n_{name}"),
                F.count(F.when(at, F.col("value"))).alias(f"v_{name}"),
                F.min(F.when(at, F.col("value"))).alias(f"lo_{name}"),
                F.max(F.when(at, F.col("value"))).alias(f"hi_{name}"),
            ]
        def agreed(name: str) -> Column:
            same = (F.col(f"lo_{name}") == F.col(f"hi_{name}")) & (F.col(f"v_{name}") == F.col(f"n_{name}"))
            return F.when(same, F.col(f"lo_{name}"))
        resolved[axis] = F.when(F.col(f"n_{axis}2") > 0, agreed(f"{axis}2")).otherwise(agreed(f"{axis}1"))
    totals = found.filter(F.col("c").isNotNull()).groupBy(*attempt).agg(*columns)
    return totals.select(*attempt, resolved["x"].alias("test_x"), resolved["y"].alias("test_y"))


def _run_id(source: str = "source_id", run: str = "run") -> Column:
    return F.concat(F.col(source), F.lit("\x1f"), F.col(run).cast("string"))


def _device_extremes(attempts: DataFrame) -> DataFrame:
    """One row per device: enough to place its first and latest attempt.

    Everything is a mergeable aggregate, so a device that holds a large share of
    all attempts is reduced before the shuffle.
    """
    start = F.coalesce(F.col("start_t"), F.lit(-1)).cast("bigint")
    run, attempt = _run_id(), F.col("attempt")
    return (
        attempts.filter(F.col("ecid").isNotNull())
        .groupBy("ecid")
        .agg(
            F.count("*").alias("n"),
            (F.count("*") == F.count("start_t")).alias("all_timed"),
            F.min(run).alias("run_lo"),
            F.max(run).alias("run_hi"),
            F.max(attempt).alias("attempt_hi"),
            F.max(F.struct(start.alias("s"), run.alias("r"), attempt.alias("a"))).alias("last"),
            F.min(F.struct((-start).alias("s"), run.alias("r"))).alias("last_other"),
            F.min(F.struct(start.alias("s"), run.alias("r"), attempt.alias("a"))).alias("first"),
            F.max(F.struct((-start).alias("s"), run.alias("r"))).alias("first_other"),
        )
    )


def latest_pareto(attempts: DataFrame) -> DataFrame:
    """Add ``is_latest`` and ``issue``: latest start wins, one run must hold the candidates."""
    devices = _device_extremes(attempts).select(
        "ecid", "n",
        F.when(F.col("all_timed"), F.when(F.col("last.r") == F.col("last_other.r"), F.col("last.a")))
        .otherwise(F.when(F.col("run_lo") == F.col("run_hi"), F.col("attempt_hi")))
        .alias("__latest"),
        F.when(
            F.col("all_timed"), F.when(F.col("last.r") == F.col("last_other.r"), F.col("last.r"))
        ).otherwise(F.when(F.col("run_lo") == F.col("run_hi"), F.col("run_lo"))).alias("__run"),
    )
    known = F.col("__latest").isNotNull()
    joined = attach(attempts, devices, ["ecid"], "n", ["attempt"])
    hit = (F.col("attempt") == F.col("__latest")) & (_run_id() == F.col("__run"))
    wafer_issue = F.col("wafer_issue") if "wafer_issue" in attempts.columns else F.lit(None).cast("string")
    return joined.select(
        *attempts.columns,
        F.when(F.col("ecid").isNotNull() & known, hit).alias("is_latest"),
        F.when(F.col("ecid").isNull(), F.coalesce(wafer_issue, F.lit("unresolved_identity")))
        .when(~known, F.lit("ambiguous_latest"))
        .alias("issue"),
    )


def latest_engineering(attempts: DataFrame) -> DataFrame:
    """Add ``is_first``, ``is_latest`` and ``issue``: a missing start sorts lowest,
    a tie between runs or several runs with a missing start leaves the flag NULL."""
    usable = F.col("all_timed") | (F.col("run_lo") == F.col("run_hi"))
    devices = _device_extremes(attempts).select(
        "ecid", "n",
        F.when(usable & (F.col("first.r") == F.col("first_other.r")), F.struct("first.r", "first.a")).alias("__first"),
        F.when(usable & (F.col("last.r") == F.col("last_other.r")), F.struct("last.r", "last.a")).alias("__last"),
    )
    joined = attach(attempts, devices, ["ecid"], "n", ["attempt"])

    def flag(extreme: str) -> Column:
        hit = (F.col("attempt") == F.col(f"{extreme}.a")) & (_run_id() == F.col(f"{extreme}.r"))
        return F.when(F.col(extreme).isNotNull(), hit)

    return joined.select(
        *attempts.columns,
        flag("__first").alias("is_first"),
        flag("__last").alias("is_latest"),
        F.when(F.col("ecid").isNull(), "unresolved_identity")
        .when(F.col("__last").isNull(), "ambiguous_latest")
        .alias("issue"),
    )


def population_counts(flagged: DataFrame) -> DataFrame:
    first = F.coalesce(F.col("is_first"), F.lit(False))
    return flagged.agg(
        F.count_if(F.col("is_latest")).alias("latest"),
        F.count_if(~F.col("is_latest")).alias("earlier"),
        F.count_if(F.col("is_latest").isNull()).alias("unresolved_latest"),
        F.count_if(first).alias("first"),
        F.count_if(~first).alias("not_first"),
    )


def map_aliases(attempts: DataFrame, aliases: DataFrame, identity: str = "identity") -> DataFrame:
    """Replace an identity by its alias; ``aliases`` is (from_key, to_key)."""
    target = aliases.groupBy("from_key").agg(F.min("to_key").alias("__to"))
    renamed = target.withColumnRenamed("from_key", identity)
    joined = attempts.join(renamed, identity, "left")
    return joined.select(
        *[c for c in attempts.columns if c != identity],
        F.coalesce("__to", identity).alias(identity),
        F.col(identity).alias("original_identity"),
    )


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Identities mapped to several targets; must be empty."""
    grouped = aliases.groupBy("from_key").agg(
        F.min("to_key").alias("first_target"), F.max("to_key").alias("other_target")
    )
    return grouped.filter(F.col("first_target") != F.col("other_target"))


def _accepts(selector: dict[str, object]) -> Column:
    wanted = [F.col(name).eqNullSafe(F.lit(value)) for name, value in selector.items() if value is not None]
    if not wanted:
        raise ValueError("a selector needs at least one field")
    return reduce(lambda a, b: a & b, wanted)


def _matching(rules: list[tuple[str, list[dict]]]) -> Column:
    """Names of the rules with a matching selector group, as an array; no join."""
    tests = [
        F.when(reduce(lambda a, b: a | b, [_accepts(s) for s in selectors]), F.lit(name))
        for name, selectors in rules
    ]
    return F.array_compact(F.array(*tests))


def match_step(runs: DataFrame, steps: list[tuple[str, list[dict]]]) -> DataFrame:
    """Add the flow ``step`` of a run: the only step with a matching selector, else NULL."""
    found = _matching(steps)
    return runs.withColumn("step", F.when(F.size(found) == 1, F.element_at(found, 1)))


def route_profiles(runs: DataFrame, routes: list[tuple[str, list[dict]]]) -> DataFrame:
    """Add the check ``profile`` of a run and a ``route_finding`` where it is not unique."""
    found = _matching(routes)
    return runs.withColumn("profile", F.when(F.size(found) == 1, F.element_at(found, 1))).withColumn(
        "route_finding",
        F.when(F.size(found) == 0, "no profile selects the run; its checks were skipped").when(
            F.size(found) > 1, F.concat(F.lit("several profiles select the run: "), F.concat_ws(", ", found))
        ),
    )


def bin_names(attempts: DataFrame, definitions: DataFrame, bin_column: str) -> DataFrame:
    """Add ``bin_name``: the most specific definition for (run, bin), 255 matches any head or site.

    Each row asks for its four (head, site) spellings, so the lookup is an equi join.
    """
    asked = attempts.select(
        "source_id", "attempt", "run", F.col(bin_column).alias("bin"),
        F.explode(
            F.array(
                F.struct(F.col("head").alias("def_head"), F.col("site").alias("def_site")),
                F.struct(F.col("head").alias("def_head"), F.lit(255).cast("bigint").alias("def_site")),
                F.struct(F.lit(255).alias("def_head"), F.col("site").cast("bigint").alias("def_site")),
                F.struct(F.lit(255).alias("def_head"), F.lit(255).cast("bigint").alias("def_site")),
            ).cast("array<struct<def_head:int,def_site:bigint>>")
        ).alias("s"),
    ).select("source_id", "attempt", "run", "bin", "s.def_head", "s.def_site")
    names = definitions.groupBy("run", "bin", "def_head", "def_site").agg(
        F.concat_ws(" / ", F.array_sort(F.collect_set("name"))).alias("name")
    )
    rank = F.when(F.col("def_head") != 255, 2).otherwise(0) + F.when(F.col("def_site") != 255, 1).otherwise(0)
    best = (
        asked.join(names, ["run", "bin", "def_head", "def_site"])
        .groupBy("source_id", "attempt")
        .agg(F.max_by("name", rank).alias("bin_name"))
    )
    return attempts.join(best, ["source_id", "attempt"], "left")
