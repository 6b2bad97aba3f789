"""Tables an engineer pages through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from testfloor.functions.filters import expression, shown
from testfloor.operators.ordered import rank_in_order


def sort_keys(df: DataFrame, name: str | None, ident: list[str], descending: bool = False) -> list[Column]:
    """Sort by one column, ties by the row id. Numbers sort by value with NULL
    between negative and other numbers; text sorts lower-cased as shown."""
    keys: list[Column] = []
    if name is not None:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, NumericType):
            keys = [F.when(value < 0, 0).when(value.isNull(), 1).otherwise(2), value]
        else:
            keys = [F.lower(shown(df, name))]
    ordered = [k.desc() if descending else k.asc() for k in keys]
    return ordered + [F.col(i).asc() for i in ident]


def page(
    df: DataFrame, sort: str | None, ident: list[str], offset: int, limit: int, descending: bool = False
) -> DataFrame:
    return df.orderBy(*sort_keys(df, sort, ident, descending)).offset(offset).limit(limit)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("count"))


def entity_summary(rows: DataFrame, level: str) -> DataFrame:
    """Counts and value statistics per test, wafer or bin."""
    if level == "tests":
        text = F.concat_ws(" ", "kind", F.col("number").cast("string"), "name")
        channel = F.concat(F.lit(" [result "), F.col("channel").cast("string"), F.lit("]"))
        keyed = rows.withColumns({"key": F.col("test"), "label": F.concat(text, F.coalesce(channel, F.lit("")))})
    else:
        column = {"wafers": "wafer", "hard_bin": "hard_bin", "soft_bin": "soft_bin"}[level]
        keyed = rows.withColumns({"key": shown(rows, column), "label": shown(rows, column)})
    value = F.col("value") if "value" in rows.columns else F.lit(None).cast("double")
    return keyed.groupBy("key", "label").agg(
        F.count("*").alias("count"),
        F.count_if("passed").alias("pass"), F.count_if(~F.col("passed")).alias("fail"),
        F.count_if(F.col("passed").isNull()).alias("unknown"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.avg(value).alias("mean"),
    )


def annotate(
    df: DataFrame,
    sort: str | None,
    ident: list[str],
    excluded: Column,
    alerts: dict[str, str] | None = None,
    mark: str = "any",
    descending: bool = False,
) -> DataFrame:
    """Marked rows with their position in the sorted table, 0-based."""
    alert = F.lit(bool(alerts))
    for name, text in (alerts or {}).items():
        alert = alert & expression(df, name, text)
    marks = df.select(
        "*", F.coalesce(~F.col("passed"), F.lit(False)).alias("failed"), excluded.alias("is_excluded"), alert.alias("alert")
    )
    chosen = {
        "failure": F.col("failed"), "alarm": F.col("alarm"), "exclusion": F.col("is_excluded"), "alert": F.col("alert"),
        "any": F.col("failed") | F.col("alarm") | F.col("is_excluded") | F.col("alert"),
    }[mark]
    narrow = marks.select(
        *dict.fromkeys([*ident, *([sort] if sort else [])]), "failed", "alarm", "is_excluded", "alert", chosen.alias("marked")
    )
    ranked = rank_in_order(narrow, [], sort_keys(narrow, sort, ident, descending), "__rank")
    return ranked.withColumn("position", F.col("__rank") - 1).drop("__rank").filter("marked").drop("marked")


def neighbours(marks: DataFrame, offset: int) -> DataFrame:
    """Previous and next mark around a row of the sorted table."""
    position = F.col("position")
    return marks.agg(
        F.count("*").alias("annotation_count"),
        F.max(F.when(position < offset, position)).alias("previous_annotation"),
        F.min(F.when(position > offset, position)).alias("next_annotation"),
    )
