"""The measurement table: one row per test result with its part context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from testfloor.functions import keys, verdicts
from testfloor.operators import identity, stream
from testfloor.operators.ordered import rank_in_order
from testfloor.session import materialize, shuffled, sorting_tasks
from testfloor.sources import stdf

# Columns of the measurement table.
EAV = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("lot_id", T.StringType()), ("wafer_id", T.StringType()), ("part_id", T.StringType()), ("head_num", T.ShortType()),
        ("site_num", T.ShortType()), ("x_coord", T.ShortType()), ("y_coord", T.ShortType()), ("hard_bin", T.IntegerType()),
        ("soft_bin", T.IntegerType()), ("part_pass", T.BooleanType()), ("test_num", T.LongType()), ("test_txt", T.StringType()),
        ("test_type", T.StringType()), ("result", T.FloatType()), ("test_pass", T.BooleanType()), ("lo_limit", T.FloatType()),
        ("hi_limit", T.FloatType()), ("units", T.StringType()), ("test_time_ms", T.LongType()), ("part_sequence", T.LongType()),
        ("part_merge_key", T.StringType()),
    )
])
REQUIRED = ("lot_id", "part_id", "head_num", "site_num", "hard_bin", "soft_bin", "part_pass", "test_num", "test_type", "part_sequence")


class SchemaMismatch(ValueError):
    """A file does not have the columns of the measurement table."""


def conform(df: DataFrame) -> DataFrame:
    """Check names and kinds of the columns and cast to the exact types; unsigned 64-bit arrives as decimal."""
    actual, expected = [f.name for f in df.schema], [f.name for f in EAV]
    if actual[: len(expected)] != expected:
        raise SchemaMismatch(f"expected columns {expected}, found {actual}")
    for have, want in zip(df.schema, EAV):
        numeric = isinstance(have.dataType, T.NumericType) and isinstance(want.dataType, T.NumericType)
        if type(have.dataType) is not type(want.dataType) and not numeric:
            raise SchemaMismatch(f"{want.name}: expected {want.dataType}, found {have.dataType}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in EAV], *actual[len(expected):])


def read_eav(spark: SparkSession, *paths: str) -> DataFrame:
    return conform(spark.read.parquet(*paths))


def write_eav(df: DataFrame, path: str, overwrite: bool = True) -> DataFrame:
    """Write one dataset, or keep an existing one; the summary counts its rows and files."""
    conform(df).write.mode("overwrite" if overwrite else "ignore").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    per_file = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    return per_file.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("files"))


def partition_value(value: Column) -> Column:
    """A partition value that no file system confuses with another: '' and NULL stay
    apart, anything but A-Z 0-9 _ - is percent-encoded, and a leading ``__`` is escaped."""
    safe = r"^(4[1-9A-F]|5[0-9A]|3[0-9]|5F|2D)$"
    code = F.hex(F.encode(value, "UTF-8"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(code) / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.substr(code, i * 2 + 1, F.lit(2)),
    )
    reserved = value.startswith("__")
    encoded = F.array_join(
        F.transform(
            pairs,
            lambda p, i: F.when(p.rlike(safe) & ~(reserved & (i == 0)), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("%"), p)),
        ),
        "",
    )
    return F.when(value.isNull(), F.lit(None).cast("string")).when(value == "", "__empty").otherwise(encoded)


def write_partitioned(df: DataFrame, path: str, columns: list[str], rows_per_file: int = 5_000_000) -> None:
    """Hive-style folders by input file, lot or wafer.

    ``rebalance`` sizes the files of a partition and splits a large one over tasks.
    """
    named = df.withColumns({f"{c}_p": partition_value(F.col(c)) for c in columns})
    balanced = named.hint("rebalance", *[f"{c}_p" for c in columns])
    balanced.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*[f"{c}_p" for c in columns]).parquet(path)


def mixed_sources(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sources with more than one lot or wafer, which the one-file-per-source layout rejects."""
    shown = {c: F.coalesce(F.col(c), F.lit("\x00")) for c in columns}
    extremes = df.groupBy("source_id").agg(
        *[f(c).alias(f"{p}_{n}") for n, c in shown.items() for p, f in (("lo", F.min), ("hi", F.max))]
    )
    mixed = F.array_compact(F.array(*[F.when(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(c)) for c in columns]))
    return extremes.select("source_id", F.concat_ws(",", mixed).alias("mixed")).filter("mixed <> ''")


# --- multiset comparison ------------------------------------------------------------

def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the SHA-256 of a row's columns; NULL and the text 'null' differ."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return df.withColumn("digest", F.sha2(F.concat_ws("\x1f", *cells), 256))


# 15 hexadecimal digits of a digest, summed, fit a decimal for 10^18 rows and more.
_PIECES = ((1, 15), (16, 15), (31, 15), (46, 15))


def multiset_digest(digests: DataFrame, key: list[str]) -> DataFrame:
    """Order-independent digest of the rows per ``key``: sums of pieces of the row digests.

    Sums merge map-side, so no group is ever gathered to be sorted.
    """
    piece = lambda start, size: F.conv(F.substr("digest", F.lit(start), F.lit(size)), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(piece(*p)).alias(f"s{i}") for i, p in enumerate(_PIECES)]
    totals = digests.groupBy(*key).agg(F.count("*").alias("rows"), *sums)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(len(_PIECES))])
    return totals.select(*key, "rows", F.sha2(text, 256).alias("multiset_digest"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Digests that occur a different number of times; empty for equal multisets."""
    count = lambda df, name: df.groupBy("digest").agg(F.count("*").alias(name))
    both = count(left, "left_rows").join(count(right, "right_rows"), "digest", "full_outer").fillna(0, ["left_rows", "right_rows"])
    return both.filter(F.col("left_rows") != F.col("right_rows"))


def pair_equal_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pair rows of equal digest by their rank; a digest with very many copies spreads over tasks."""
    ranked_left = rank_in_order(left.select("digest", *left_order), ["digest"], [F.col(c) for c in left_order], "copy")
    ranked_right = rank_in_order(right.select("digest", *right_order), ["digest"], [F.col(c) for c in right_order], "copy")
    tasks = sorting_tasks(left.count() + right.count(), left.sparkSession)
    dealt = [ranked.repartition(tasks, "digest", "copy") for ranked in (ranked_left, ranked_right)]
    return dealt[0].join(dealt[1], ["digest", "copy"], "full_outer")


# --- export -------------------------------------------------------------------------

def safe_cells(df: DataFrame) -> DataFrame:
    """Text cells a spreadsheet would take for a formula get a leading quote."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.regexp_replace(c, r"^([=+@\-\t\r\n])", "'$1") for c in texts})


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows to CSV (formula-safe, with a header) or JSON lines, one file per task."""
    if kind == "csv":
        safe_cells(df).write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").json(path)


# --- conversion ---------------------------------------------------------------------

class Converted(NamedTuple):
    """Measurement rows, and the sources that are not whole in them (``stdf.source_errors``)."""

    rows: DataFrame
    errors: DataFrame


_SITE = ["source_id", "head", "site"]
_PART = ("part_flg", "hard_bin", "soft_bin", "x_coord", "y_coord", "test_t", "part_id")


def _parts(typed: DataFrame, complete: DataFrame) -> DataFrame:
    """Complete attempts with the fields of their PRR, their lot, wafer and merge key."""
    opened = complete.select("source_id", F.col("open_seq").alias("seq"), F.lit("").alias("kind"))
    lots = stream.number_runs(typed.filter("kind = 'MIR'").select("source_id", "seq", "kind", "lot_id").unionByName(opened, allowMissingColumns=True), ("lot_id",))
    lots = lots.filter("kind = ''").select("source_id", F.col("seq").alias("open_seq"), F.coalesce("lot_id", F.lit("")).alias("lot_id"))
    names = typed.filter("kind = 'WIR'").select("source_id", F.col("seq").alias("wafer_seq"), "wafer_id")
    probes = complete.select(*_SITE, F.col("open_seq").alias("seq"))
    wafers = stream.open_wafers(typed, probes).join(names, ["source_id", "wafer_seq"], "left").select("source_id", F.col("seq").alias("open_seq"), "wafer_id")
    # Sessions come from PIR and PRR alone, so of the tests only those that may name a coordinate are put in order.
    axis = F.col("test_txt").rlike("[XYxy]") & keys.coordinate_axis(F.col("test_txt")).isNotNull()
    sited = typed.select(*_SITE, "seq", "kind", "test_txt", "result").filter(F.col("kind").isin("PIR", "PRR") | (F.col("kind") == "PTR") & axis)
    named = stream.sessions(sited).filter("kind = 'PTR'").withColumnRenamed("kind", "test_type")
    places = identity.coordinate_candidates(named, [*_SITE, "session"])
    records = stream.attempt_records(typed.filter("kind = 'PRR'").select(*_SITE, "seq", "kind", *_PART), complete)
    parts = records.join(shuffled(places), [*_SITE, "session"], "left").join(shuffled(lots), ["source_id", "open_seq"]).join(
        shuffled(wafers), ["source_id", "open_seq"], "left"
    )
    key = keys.merge_key(F.col("wafer_id"), F.col("x_coord"), F.col("y_coord"), F.col("lot_id"), F.col("test_x"), F.col("test_y"))
    return parts.select(*_SITE, "open_seq", "close_seq", "part_sequence", "lot_id", "wafer_id", *_PART, key.alias("part_merge_key"))


def convert(records: DataFrame) -> Converted:
    """Typed records (``stdf.read_events``) to measurement rows, with their ``source_id``,
    ``record_sequence`` and ``expansion_index``, and to the errors met on the way.

    The rows of a damaged log are those of its readable records; whoever wants whole logs only leaves out the sources
    among the errors, as ``dataset.ingest`` does.
    """
    read = materialize(records, "records")
    typed = read.filter(~F.col("kind").isin("FAR", *stdf.ERRORS))
    numbered = stream.attempts(stream.sessions(typed.select(*_SITE, "seq", "kind")))
    complete = materialize(numbered.filter("close_seq is not null"), "complete-attempts")
    # The parts with all that their tests show of them, so that the tests are dealt out and sorted only once.
    parts = materialize(_parts(typed, complete), "parts")
    tests = typed.select(
        *_SITE, "seq", "kind", "test_num", "test_txt", "test_flg", "result", "rtn_rslt", "lo_limit", "hi_limit", "units"
    )
    of_part = tuple(c for c in parts.columns if c not in (*_SITE, "open_seq", "close_seq", "part_sequence"))
    owned = stream.owned_tests(tests, parts, context=of_part)
    flat = stream.flatten_measurements(owned, ("source_id", "head", "site", "seq", "test_num", "part_sequence", *of_part))
    renamed = {"head_num": F.col("head"), "site_num": F.col("site"), "test_time_ms": F.col("test_t"), "part_pass": verdicts.part_pass(F.col("part_flg"))}
    rows = flat.withColumns(renamed).select(*[F.col(f.name).cast(f.dataType) for f in EAV], "source_id", F.col("seq").alias("record_sequence"), "expansion_index")
    return Converted(rows, stdf.source_errors(read))
