"""Joining aggregated facts back to the rows they came from, whatever the key sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from testfloor.session import materialize, shuffled

# A key with this many rows is joined by broadcast. There are at most
# (all rows / HOT_ROWS) such keys, which bounds what is broadcast.
HOT_ROWS = 10_000_000
_SALTS = 1023
# A stored table of facts of at most so many rows is broadcast whole, whatever the size of its keys.
FEW_FACTS = 100_000


def attach(
    rows: DataFrame, facts: DataFrame, key: list[str], rows_per_key: str, spread_by: list[str], hot_rows: int = HOT_ROWS,
    marked: bool = False, stored: bool = False,
) -> DataFrame:
    """Left join of ``facts`` (one row per key, with its number of rows) to ``rows``.

    Rows of hot keys get their facts from a broadcast and, like rows with a NULL
    key, are spread over the tasks of the shuffle join instead of meeting in one:
    their join key is replaced by a hash of ``spread_by`` that matches nothing. With ``marked`` the first key is a text
    that never looks like a number and is joined as it is, so that facts grouped by the key are not dealt out again.
    With ``stored`` the facts are a stored table, whose size Spark does not know.
    """
    columns = [c for c in facts.columns if c not in key and c != rows_per_key]
    packed = facts.select(*key, rows_per_key, F.struct(*columns).alias("__facts"))
    hot = packed.filter(F.col(rows_per_key) >= hot_rows).select(*key, F.col("__facts").alias("__hot"))
    first = rows.join(F.broadcast(hot), key, "left")
    done: Column = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key], F.col("__hot").isNotNull())
    own = F.col(key[0]) if marked else F.concat(F.lit("="), F.col(key[0]).cast("string"))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(_SALTS)).cast("string")
    salted = first.withColumn("__key", F.when(done, salt).otherwise(own))
    rest = packed.filter(F.col(rows_per_key) < hot_rows).select(own.alias("__key"), *key[1:], "__facts")
    joined = salted.join(shuffled(rest) if stored else rest, ["__key", *key[1:]], "left").withColumn("__all", F.coalesce("__hot", "__facts"))
    return joined.select(*rows.columns, *[F.col(f"__all.{c}").alias(c) for c in columns])


def attach_few(rows: DataFrame, facts: DataFrame, key: list[str], rows_per_key: str, spread_by: list[str], few: int = FEW_FACTS) -> DataFrame:
    """``attach`` for facts that are mostly short: they are stored and counted, and if they are few, rows are not shuffled."""
    kept = materialize(facts, "facts")
    if kept.count() > few:
        return attach(rows, kept, key, rows_per_key, spread_by, stored=True)
    columns = [c for c in facts.columns if c not in key and c != rows_per_key]
    joined = rows.join(F.broadcast(kept.drop(rows_per_key)), key, "left")
    return joined.select(*rows.columns, *columns)
