"""Repeated executions of a test inside one attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from testfloor.operators.joins import attach

_LONGEST = (1 << 31) - 1


def last_executions(rows: DataFrame, key: list[str], order: str = "rec", columns: list[str] | None = None) -> DataFrame:
    """The last row per ``key``: a mergeable aggregate, no window over the rows of a key.

    ``columns`` names what is needed of the row; nothing else is carried along.
    """
    payload = [c for c in (columns or rows.columns) if c not in key and c != order]
    last = rows.groupBy(*key).agg(F.max(F.struct(order, *payload)).alias("__last"))
    return last.select(*key, "__last.*")


def mark_last_execution(rows: DataFrame, key: list[str], order: str = "rec") -> DataFrame:
    """Add ``last_execution`` to every row."""
    # A NULL key part is a value of its own here.
    shown = {f"__k_{k}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~")) for k in key}
    keyed = rows.withColumns(shown)
    last = keyed.groupBy(*shown).agg(F.max(order).alias("__last"), F.count("*").alias("__rows"))
    # Texts and whole numbers are told by their shown key and need not travel beside it; the first key is not kept shown.
    told = {
        k: F.when(F.col(f"__k_{k}") != "~", F.substring(f"__k_{k}", 2, _LONGEST).cast(rows.schema[k].dataType))
        for k in key[1:] if isinstance(rows.schema[k].dataType, (T.StringType, T.IntegralType))
    }
    joined = attach(keyed.drop(*told), last, list(shown), "__rows", [order], marked=True)
    columns = [told[c].alias(c) if c in told else F.col(c) for c in rows.columns]
    return joined.select(*columns, (F.col(order) == F.col("__last")).alias("last_execution"))


def collapsed_verdict(passed: Column) -> Column:
    """Aggregate: any fail is a fail, all pass is a pass, anything else is unknown."""
    return F.when(F.bool_or(~passed), False).when(F.count(passed) == F.count("*"), True)
