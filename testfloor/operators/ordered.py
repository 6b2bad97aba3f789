"""Running values over long ordered streams, without one task per stream.

A window over ``partitionBy(source)`` puts a whole source into one task. Here a
stream is cut into bounded chunks: each chunk is summed up first, the short
table of chunk totals is accumulated, and the window then runs inside a chunk
on top of the value carried into it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from testfloor.session import materialize, shuffled, sorting_tasks

CHUNK_ROWS = 1 << 16
_CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``min``, ``max`` or ``last`` (last non-NULL) of a column."""

    kind: str
    value: Column
    include_row: bool = True


def carry(
    df: DataFrame, key: list[str], order: str, chunk_rows: int = CHUNK_ROWS, **running: Running
) -> DataFrame:
    """Add running values per ``key`` in the order of the integer column ``order``.

    ``order`` must be unique within a key, so a chunk holds at most ``chunk_rows`` rows.
    """
    part = [*key, _CHUNK]
    base = df.withColumn(_CHUNK, F.floor(F.col(order) / chunk_rows))

    def summarise(spec: Running) -> Column:
        if spec.kind == "last":
            return F.max_by(spec.value, F.when(spec.value.isNotNull(), F.col(order)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](spec.value)

    def accumulate(spec: Running, value: Column, window) -> Column:
        if spec.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](value).over(window)

    before = Window.partitionBy(*key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*part).agg(*[summarise(s).alias(f"__t_{n}") for n, s in running.items()])
    carried = totals.select(
        *part, *[accumulate(s, F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n, s in running.items()]
    )
    inside = Window.partitionBy(*part).orderBy(order)

    def local(spec: Running) -> Column:
        window = inside.rowsBetween(Window.unboundedPreceding, 0 if spec.include_row else -1)
        return accumulate(spec, spec.value, window)

    def combine(name: str, spec: Running) -> Column:
        own, carried_in = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if spec.kind == "sum":
            return F.coalesce(own, F.lit(0)) + F.coalesce(carried_in, F.lit(0))
        if spec.kind == "last":
            return F.coalesce(own, carried_in)
        return (F.greatest if spec.kind == "max" else F.least)(own, carried_in)

    # The windows come first: their order serves the merge join as well, so the rows are sorted once.
    valued = base.select(*base.columns, *[local(s).alias(f"__l_{n}") for n, s in running.items()])
    joined = valued.join(shuffled(carried), part, "left")
    return joined.select(*df.columns, *[combine(n, s).alias(n) for n, s in running.items()])


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running_in_order(df: DataFrame, group: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """Running sums per ``group`` in any sort order, including the current row.

    The rows are range-partitioned by (group, order), so a large group spreads
    over many tasks; the partition totals give the value at each partition start.
    There are more tasks for more rows, so that what one of them sorts does not grow.
    """
    tasks = sorting_tasks(df.count(), df.sparkSession)
    valued = df.select(*df.columns, *[c.alias(f"__v_{n}") for n, c in sums.items()])
    ranged = valued.repartitionByRange(tasks, *[F.col(g) for g in group], *order)
    ranged = materialize(ranged.withColumn("__pid", F.spark_partition_id()), "ordered")
    part = [*group, "__pid"]
    totals = ranged.groupBy(*part).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(p).alias(f"__k_{p}") for p in part],
        *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
    )
    condition = reduce(lambda a, b: a & b, [ranged[p].eqNullSafe(offsets[f"__k_{p}"]) for p in part])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, condition, "left").repartition(tasks, *part).select(
        *df.columns,
        *[(F.sum(f"__v_{n}").over(inside) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def rank_in_order(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in its group."""
    return running_in_order(df, group, order, **{name: F.lit(1)})
