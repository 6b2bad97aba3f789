"""Failure Paretos by pattern, bin and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.functions import keys, verdicts
from testfloor.functions.filters import shown
from testfloor.operators.executions import collapsed_verdict, last_executions
from testfloor.operators.ordered import running_in_order

GROUP = ["pattern", "run", "lot", "program", "revision", "head", "site", "test_num"]


def _verdict_counts(passed: Column) -> list[Column]:
    return [
        F.count_if(passed).alias("pass"), F.count_if(~passed).alias("fail"), F.count_if(passed.isNull()).alias("unknown")
    ]


def pattern_groups(rows: DataFrame) -> DataFrame:
    """Functional tests per source and (pattern, run, lot, program, head, site, test)."""
    kind = verdicts.functional_class(F.col("test_flg"))
    return rows.groupBy("source_id", *GROUP).agg(
        F.count("*").alias("attempts"),
        *[F.count_if(kind == k).alias(k) for k in ("pass", "fail", "unknown", "not_executed")],
        F.count_if(verdicts.has_bits(F.col("test_flg"), verdicts.FTR_ALARM)).alias("alarms"),
        F.min("record").alias("first_record"), F.max("record").alias("last_record"),
    )


def pattern_pareto(groups: DataFrame) -> DataFrame:
    """Patterns by failures, with their cumulative share. NULL percentages where nothing is known."""
    counts = ["attempts", "pass", "fail", "unknown", "not_executed", "alarms"]
    patterns = groups.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in counts])
    named = patterns.withColumn("label", shown(patterns, "pattern"))
    ranked = running_in_order(named, [], [F.desc("fail"), F.asc("label")], __upto=F.col("fail"))
    joined = ranked.withColumn("__all", patterns.agg(F.sum("fail")).scalar())
    known = F.col("pass") + F.col("fail")
    share = lambda top, bottom: F.when(bottom > 0, top * 100.0 / bottom)
    return joined.select(
        "pattern", *counts, share(F.col("pass"), known).alias("yield_percent"),
        share(F.col("fail"), known).alias("failure_rate"), share(F.col("fail"), F.col("__all")).alias("share"),
        share(F.col("__upto"), F.col("__all")).alias("cumulative"),
    )


def test_modes(tests: DataFrame) -> DataFrame:
    """Verdict of each test per attempt: last execution first, patterns of a test collapsed."""
    keyed = tests.select(
        "attempt", keys.mode_key(F.col("test_type"), F.col("test_num"), F.col("test_txt")).alias("mode"),
        F.concat_ws(" ", "test_type", F.col("test_num").cast("string"), "test_txt").alias("label"),
        "pattern", "rec", verdicts.reliable_test_pass(F.col("test_flg")).alias("passed"),
    )
    last = last_executions(keyed, ["attempt", "mode", "label", "pattern"])
    return last.groupBy("attempt", "mode", "label").agg(collapsed_verdict(F.col("passed")).alias("passed"))


def pattern_modes(tests: DataFrame) -> DataFrame:
    """Verdict of each functional pattern per attempt."""
    ftr = tests.filter("test_type = 'FTR'").select(
        "attempt", "test_num", "pattern", "rec", verdicts.reliable_test_pass(F.col("test_flg")).alias("passed")
    )
    last = last_executions(ftr, ["attempt", "test_num", "pattern"])
    label = F.coalesce("pattern", F.lit("[null] (missing VECT_NAM)"))
    return last.groupBy("attempt", keys.json_string(F.col("pattern")).alias("mode"), label.alias("label")).agg(
        collapsed_verdict(F.col("passed")).alias("passed")
    )


def bin_modes(attempts: DataFrame, level: str) -> DataFrame:
    prefix = {"hard_bin": "HBIN ", "soft_bin": "SBIN "}[level]
    passed = F.when(F.col(level).isNotNull(), verdicts.attempt_passed(F.col("flags")))
    mode = shown(attempts, level)
    return attempts.select("attempt", mode.alias("mode"), F.concat(F.lit(prefix), mode).alias("label"), passed.alias("passed"))


def _split(by: str) -> Column:
    return {
        "lot": F.col("lot"), "wafer": F.coalesce("wafer", F.lit("[null]")),
        "site": F.concat(F.lit("H"), F.col("head").cast("string"), F.lit("/S"), F.col("site").cast("string")),
        "all": F.lit("All"),
    }[by]


def latest_device_pareto(
    latest: DataFrame, modes: DataFrame, bins: bool, by: str = "lot",
    show_passing: bool = False, text: str = "", min_fail: int = 0,
) -> DataFrame:
    """Failure modes of the latest attempts, one row per (mode, group).

    Bins count every device; tests and patterns count failures only.
    """
    rows = latest.select("attempt", _split(by).alias("group")).join(modes, "attempt")
    if not bins:
        rows = rows.filter(~F.col("passed"))
    counted = rows.groupBy("mode", "label", "group").agg(F.count("*").alias("group_count"), *_verdict_counts(F.col("passed")))
    totals = counted.groupBy("mode").agg(
        F.sum("group_count").alias("count"), *[F.sum(c).alias(c) for c in ("pass", "fail", "unknown")]
    )
    wanted = F.col("fail") >= min_fail
    if bins and not show_passing:
        wanted = wanted & ((F.col("fail") > 0) | (F.col("unknown") > 0))
    joined = counted.select("mode", "label", "group", "group_count").join(totals.filter(wanted), "mode")
    return joined.filter(F.contains(F.lower("label"), F.lit(text.lower())))


def engineering_pareto(rows: DataFrame, level: str, color: str = "site", show_pass: bool = False) -> DataFrame:
    """Analysis rows collapsed per (label, attempt), then counted per label and group."""
    bins = level in ("hard_bin", "soft_bin")
    if not bins:
        rows = rows.filter(F.col("channel").isNull())
    if level == "pattern":
        rows = rows.filter("kind = 'FTR'")
    label = (
        shown(rows, level) if bins else F.coalesce("pattern", F.lit("[null]")) if level == "pattern"
        else F.concat_ws(" ", "kind", F.col("number").cast("string"), "name")
    )
    group = {
        "site": F.concat_ws("/", F.col("head").cast("string"), F.col("site").cast("string")),
        "wafer": F.coalesce("wafer", F.lit("[null]")), "lot": F.col("lot"), "all": F.lit("All"),
    }[color]
    collapsed = rows.groupBy("attempt", label.alias("label"), group.alias("group")).agg(
        collapsed_verdict(F.col("passed")).alias("passed")
    )
    counted = F.count("*") if bins else F.count_if(~F.col("passed"))
    per_group = collapsed.groupBy("label", "group").agg(counted.alias("group_count"), *_verdict_counts(F.col("passed")))
    totals = per_group.groupBy("label").agg(
        F.sum("group_count").alias("count"), *[F.sum(c).alias(c) for c in ("pass", "fail", "unknown")]
    )
    if bins:
        kept = totals if show_pass else totals.filter((F.col("fail") != 0) | (F.col("unknown") != 0))
    else:
        kept = totals.filter(F.col("count") != 0)
    return per_group.select("label", "group", "group_count").filter("group_count > 0").join(kept, "label")


def selection_audit(flagged: DataFrame) -> DataFrame:
    """Why attempts are not the latest one, and how many devices that concerns."""
    reason = F.coalesce("issue", F.lit("Earlier attempt"))
    rest = flagged.filter(~F.coalesce(F.col("is_latest"), F.lit(False)))
    per_device = rest.groupBy(reason.alias("reason"), "ecid").agg(F.count("*").alias("n"))
    return per_device.groupBy("reason").agg(F.sum("n").alias("attempts"), F.count("ecid").alias("devices"))
