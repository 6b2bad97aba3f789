"""Identity keys, labels and identifier cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name fragments that mark a test as a die coordinate; {axis} is x or y.
AXIS_FRAGMENTS = (
    "coord{axis}", "{axis}coord", "coordinate{axis}", "position{axis}", "{axis}position",
    "location{axis}", "{axis}location", "die{axis}", "{axis}die", "wafer{axis}", "{axis}wafer",
)


def clean_id(value: Column) -> Column:
    """NULL for a blank identifier or one with a control or replacement character."""
    return F.when((F.trim(value) != "") & ~value.rlike(r"[\p{Cc}\x{FFFD}]"), value)


def json_string(value: Column) -> Column:
    """The value as a JSON string literal, ``null`` for NULL."""
    text = F.to_json(F.array(value.cast("string")))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_array(*parts: Column) -> Column:
    inner = [parts[0]]
    for part in parts[1:]:
        inner += [F.lit(","), part]
    return F.concat(F.lit("["), *inner, F.lit("]"))


def wafer_merge_key(wafer: Column, x: Column, y: Column) -> Column:
    """Wafer and part coordinates, where the wafer id is upper-case alphanumeric (C14)."""
    usable = wafer.rlike("^[A-Z0-9]+$") & (x > 0) & (y > 0)
    return F.when(usable, json_array(F.lit('"wafer-prr"'), json_string(wafer), json_number(x), json_number(y)))


def lot_merge_key(lot: Column, x: Column, y: Column) -> Column:
    usable = (lot != "") & x.isNotNull() & y.isNotNull()
    return F.when(usable, json_array(F.lit('"lot-ptr"'), json_string(lot), json_number(x), json_number(y)))


def merge_key(wafer: Column, x: Column, y: Column, lot: Column, test_x: Column, test_y: Column) -> Column:
    return F.coalesce(wafer_merge_key(wafer, x, y), lot_merge_key(lot, test_x, test_y))


def device_key(merge: Column, source: Column, part_sequence: Column) -> Column:
    return F.coalesce(
        merge, json_array(F.lit('"unresolved"'), json_string(source), json_number(part_sequence))
    )


def ecid(lot: Column, wafer: Column, x: Column, y: Column, ambiguous_wafer: Column | None = None) -> Column:
    """Lot, wafer and coordinates; a NULL wafer is an identity of its own."""
    usable = clean_id(lot).isNotNull() & x.isNotNull() & y.isNotNull()
    if ambiguous_wafer is not None:
        usable = usable & ~ambiguous_wafer
    key = json_array(
        F.lit('"lot-wafer-xy"'), json_string(lot), json_string(wafer), json_number(x), json_number(y)
    )
    return F.when(usable, key)


def positive_integer(value: Column) -> Column:
    whole = (value > 0) & (value == F.floor(value)) & (value < float(2**63))
    return F.when(whole & ~F.isnan(value), value.cast("bigint"))


def _axis_flags(name: Column, tokens: Column, axis: str) -> tuple[Column, Column]:
    fragments = "|".join(part.format(axis=axis) for part in AXIS_FRAGMENTS)
    explicit = tokens.rlike(f"(^|[^a-z]){axis}([^a-z]|$)") | F.lower(name).rlike(fragments)
    return explicit, F.contains(tokens, F.lit(axis))


def coordinate_axis(name: Column) -> Column:
    """``struct(axis, rank)`` of a test name that carries a die coordinate, else NULL."""
    tokens = F.lower(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))
    explicit_x, bare_x = _axis_flags(name, tokens, "x")
    explicit_y, bare_y = _axis_flags(name, tokens, "y")

    def found(axis: str, rank: int) -> Column:
        return F.struct(F.lit(axis).alias("axis"), F.lit(rank).alias("rank"))

    return (
        F.when(explicit_x & explicit_y, F.lit(None))
        .when(explicit_x, found("x", 2))
        .when(explicit_y, found("y", 2))
        .when(bare_x & ~bare_y, found("x", 1))
        .when(bare_y & ~bare_x, found("y", 1))
    )


def characterization_id(value: Column) -> Column:
    """``0x`` hexadecimal or decimal id as a number; NULL if neither."""
    hexadecimal = value.rlike("^0[xX][0-9A-Fa-f]{1,15}$")
    decimal = value.rlike("^[0-9]{1,18}$")
    return F.when(hexadecimal, F.conv(F.substr(value, F.lit(3)), 16, 10).cast("bigint")).when(
        decimal, value.cast("bigint")
    )


def canonical_field(name: Column) -> Column:
    """``AXES[3].X`` becomes ``AXES[].X``."""
    return F.regexp_replace(name, r"\[[^\]]*\]", "[]")


def test_key(number: Column, kind: Column, text: Column) -> Column:
    """Dashboard test key: multi-result channels are told apart by their text."""
    return json_array(json_number(number), json_string(kind), json_string(F.when(kind == "MPR", text)))


def engineering_test_key(kind: Column, number: Column, name: Column, channel: Column) -> Column:
    return json_array(json_string(kind), json_number(number), json_string(name), json_number(channel))


def mode_key(kind: Column, number: Column, name: Column) -> Column:
    return json_array(json_string(kind), json_number(number), json_string(name))


def test_label(number: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(number.cast("string"), F.lit(" - "), text)).otherwise(
        F.concat(F.lit("TEST "), number.cast("string"))
    )


def site_label(head: Column, site: Column) -> Column:
    return F.concat(F.lit("H"), head.cast("string"), F.lit(" / S"), site.cast("string"))


def hard_bin_label(bin_: Column) -> Column:
    return F.concat(F.lit("HBIN "), bin_.cast("string"))


def soft_bin_label(bin_: Column) -> Column:
    return F.concat(F.lit("SBIN "), bin_.cast("string"))


def wafer_label(wafer: Column) -> Column:
    return F.coalesce(wafer, F.lit("(no wafer)"))
