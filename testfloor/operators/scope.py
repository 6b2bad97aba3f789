"""Which rows a request looks at."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A list typed into a request stays below this; longer lists arrive as a DataFrame.
MAX_LISTED = 10_000


@dataclass(frozen=True)
class Scope:
    """AND of the non-empty lists; an empty list filters nothing."""

    lots: tuple[str, ...] = ()
    wafers: tuple[str, ...] = ()
    sites: tuple[tuple[int, int], ...] = ()
    runs: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Selection:
    """Scope of the engineering views; every list is OR-ed inside, AND-ed outside.

    Attempts are named by whatever identifies them in the rows, numbers or texts. ``excluded_devices`` may be a
    DataFrame with ``attempt``; ``excluded_measurements`` is one whose columns name the rows to leave out.
    """

    population: str = "latest"
    run: int | None = None
    wafer: str | None = None
    sites: tuple[int, ...] = ()
    tests: tuple[int, ...] = ()
    attempts: tuple = ()
    hard_bins: tuple[int, ...] = ()
    soft_bins: tuple[int, ...] = ()
    excluded_devices: tuple | DataFrame = ()
    excluded_measurements: DataFrame | None = None
    filters: dict[str, str] = field(default_factory=dict)


def listed(df: DataFrame, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A short request list as a DataFrame with the types of ``df``."""
    schema = df.select(*columns).schema
    return df.sparkSession.createDataFrame(rows, schema)


def among(df: DataFrame, columns: list[str], rows) -> DataFrame:
    """Rows whose ``columns`` are in the list (a DataFrame, or a bounded Python list)."""
    if isinstance(rows, DataFrame):
        return df.join(rows.select(*columns).distinct(), columns, "left_semi")
    if not rows:
        return df
    if len(rows) > MAX_LISTED:
        raise ValueError(f"pass lists of more than {MAX_LISTED} entries as a DataFrame")
    return df.join(F.broadcast(listed(df, columns, list(rows))), columns, "left_semi")


def in_scope(df: DataFrame, scope: Scope) -> DataFrame:
    if scope.lots:
        df = df.filter(F.col("lot").isin(list(scope.lots)))
    if scope.wafers:
        df = df.filter(F.col("wafer").isin(list(scope.wafers)))
    df = among(df, ["head", "site"], list(scope.sites))
    return among(df, ["source_id", "run"], list(scope.runs))


def mark_excluded(df: DataFrame, excluded=()) -> DataFrame:
    """Add ``excluded`` from a list or DataFrame of (source_id, attempt)."""
    keys = ["source_id", "attempt"]
    if not isinstance(excluded, DataFrame):
        if not excluded:
            return df.withColumn("excluded", F.lit(False))
        if len(excluded) > MAX_LISTED:
            raise ValueError(f"pass lists of more than {MAX_LISTED} entries as a DataFrame")
        excluded = F.broadcast(listed(df, keys, list(excluded)))
    marks = excluded.select(*keys).distinct().withColumn("__mark", F.lit(True))
    marked = df.join(marks, keys, "left")
    return marked.withColumn("excluded", F.col("__mark").isNotNull()).drop("__mark")


def in_population(df: DataFrame, population: str) -> DataFrame:
    """``all``, ``latest`` or ``first``; an unknown flag is in neither of the two."""
    if population == "all":
        return df
    return df.filter(F.col({"latest": "is_latest", "first": "is_first"}[population]))


def _among_values(df: DataFrame, name: str, values) -> Column:
    """Whether the column is one of the listed values, taken as values of its type."""
    if len(values) > MAX_LISTED:
        raise ValueError(f"pass lists of more than {MAX_LISTED} entries as a DataFrame")
    kind = df.schema[name].dataType
    return F.col(name).isin([F.lit(v).cast(kind) for v in values])


def in_selection(df: DataFrame, selection: Selection) -> DataFrame:
    """Rows of the selection; a filter for whose column the rows have none is an error."""
    asked = {
        "run": () if selection.run is None else (selection.run,), "wafer": () if selection.wafer is None else (selection.wafer,),
        "site": selection.sites, "number": selection.tests, "attempt": selection.attempts,
        "hard_bin": selection.hard_bins, "soft_bin": selection.soft_bins,
    }
    condition: Column = F.lit(True)
    for name, accepted in asked.items():
        if accepted:
            if name not in df.columns:
                raise ValueError(f"the rows have no column {name} to select by")
            condition = condition & _among_values(df, name, accepted)
    return df.filter(condition)


def _marked(df: DataFrame, selection: Selection, measurements: bool) -> DataFrame:
    """Rows of the selection and population with ``__out``, whether they are excluded."""
    rows = in_population(in_selection(df, selection), selection.population)
    parts = [selection.excluded_devices] if isinstance(selection.excluded_devices, DataFrame) else []
    out = F.lit(False) if parts or not selection.excluded_devices else F.coalesce(_among_values(df, "attempt", selection.excluded_devices), F.lit(False))
    if measurements and selection.excluded_measurements is not None:
        parts.append(selection.excluded_measurements)
    rows = rows.withColumn("__out", out)
    for part in parts:
        keys = part.columns if part is not selection.excluded_devices else ["attempt"]
        marks = part.select(*[F.col(c).alias(f"__{c}") for c in keys], F.lit(True).alias("__listed")).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}").cast(df.schema[c].dataType)) for c in keys])
        joined = rows.join(marks, same, "left")
        rows = joined.select(*df.columns, (F.col("__out") | F.col("__listed").isNotNull()).alias("__out"))
    return rows


def analysis_rows(df: DataFrame, selection: Selection, measurements: bool) -> DataFrame:
    """Rows an analysis counts: population, no exclusions, last execution of a test."""
    kept = _marked(df, selection, measurements).filter(~F.col("__out")).drop("__out")
    return kept.filter(F.col("last_execution")) if measurements else kept


def display_rows(df: DataFrame, selection: Selection, measurements: bool) -> DataFrame:
    """Rows a table shows: all executions; device and record views keep every attempt."""
    shown = in_selection(df, selection)
    return in_population(shown, selection.population) if measurements else shown


def inclusion_counts(df: DataFrame, selection: Selection, measurements: bool = False) -> DataFrame:
    """How many rows of the selection and population are included and excluded."""
    return _marked(df, selection, measurements).agg(
        F.count_if(~F.col("__out")).alias("included"), F.count_if(F.col("__out")).alias("excluded")
    )


def enrich_records(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """Record rows take the context of their attempt."""
    context = ["site", "head", "wafer", "lot", "hard_bin", "soft_bin", "is_latest", "is_first"]
    present = [c for c in context if c in attempts.columns]
    return records.join(attempts.select("attempt", *present), "attempt", "left")


def unknown_requests(df: DataFrame, columns: list[str], requested: DataFrame) -> DataFrame:
    """Requested keys that do not exist in the selected sources; must be empty."""
    return requested.select(*columns).distinct().join(df.select(*columns).distinct(), columns, "left_anti")


def label_and_failures(df: DataFrame, label: str, text: str, min_fail: int) -> DataFrame:
    """Dashboard row filter: text inside the label, and a minimum number of failures."""
    return df.filter(F.contains(F.lower(F.col(label)), F.lit(text.lower())) & (F.col("fail") >= min_fail))
