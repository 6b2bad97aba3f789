"""Filter expressions typed by an engineer, compiled to Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

_OPERATORS = (">=", "<=", "!=", ">", "<", "=")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def shown(df: DataFrame, name: str) -> Column:
    """The value as the table shows it; NULL is ``[null]``."""
    return F.coalesce(F.col(name).cast("string"), F.lit("[null]"))


def expression(df: DataFrame, name: str, text: str) -> Column:
    """One column filter: a comparison, or a case-insensitive search."""
    text = text.strip()
    if not text:
        return F.lit(True)
    numeric = isinstance(df.schema[name].dataType, NumericType)
    for operator in _OPERATORS:
        if not text.startswith(operator):
            continue
        right = text[len(operator):].strip()
        as_text = {"!=": shown(df, name) != right, "=": shown(df, name) == right}.get(operator, F.lit(False))
        bound = _number(right)
        if not numeric or bound is None:
            return as_text
        value = F.col(name)
        compared = {
            ">=": value >= bound, "<=": value <= bound, ">": value > bound,
            "<": value < bound, "!=": value != bound, "=": value == bound,
        }[operator]
        return F.when(value.isNotNull(), compared).otherwise(as_text)
    return F.contains(F.lower(shown(df, name)), F.lit(text.lower()))


def display(
    df: DataFrame,
    filters: dict[str, str] | None = None,
    values: dict[str, list] | None = None,
    search: str = "",
) -> DataFrame:
    """Column filters AND value sets AND a full-row text search."""
    condition = F.lit(True)
    for name, text in (filters or {}).items():
        condition = condition & expression(df, name, text)
    for name, accepted in (values or {}).items():
        known = [v for v in accepted if v is not None]
        inside = F.coalesce(F.col(name).isin(known), F.lit(False)) if known else F.lit(False)
        if len(known) != len(accepted):
            inside = inside | F.col(name).isNull()
        condition = condition & inside
    if search:
        row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        condition = condition & F.contains(F.lower(row), F.lit(search.lower()))
    return df.filter(condition)
