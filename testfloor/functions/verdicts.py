"""Pass/fail verdicts, bins, limits and ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Flag masks of the STDF V4 PART_FLG and TEST_FLG bytes.
PART_UNKNOWN, PART_ABORTED, PART_FAILED = 0x14, 0x10, 0x08
TEST_UNRELIABLE, TEST_FAILED, TEST_NO_INDICATION = 0x7E, 0x80, 0x40
FTR_ALARM, FTR_NOT_EXECUTED, FTR_UNKNOWN = 0x01, 0x10, 0x6E
MAX_BIN = 32767


def has_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def attempt_verdict(flags: Column) -> Column:
    return (
        F.when(has_bits(flags, PART_UNKNOWN), "unknown")
        .when(has_bits(flags, PART_FAILED), "fail")
        .otherwise("pass")
    )


def attempt_passed(flags: Column) -> Column:
    """The attempt verdict as a nullable boolean (unknown is NULL)."""
    return F.when(~has_bits(flags, PART_UNKNOWN), ~has_bits(flags, PART_FAILED))


def part_pass(flags: Column) -> Column:
    """Two-valued part verdict of the measurement table; bit 2 is not looked at."""
    return ~has_bits(flags, PART_ABORTED) & ~has_bits(flags, PART_FAILED)


def reliable_test_pass(flags: Column) -> Column:
    return F.when(~has_bits(flags, TEST_UNRELIABLE), ~has_bits(flags, TEST_FAILED))


def parametric_test_pass(flags: Column) -> Column:
    return F.when(~has_bits(flags, TEST_NO_INDICATION), ~has_bits(flags, TEST_FAILED))


def functional_class(flags: Column) -> Column:
    return (
        F.when(has_bits(flags, FTR_NOT_EXECUTED), "not_executed")
        .when(has_bits(flags, FTR_UNKNOWN), "unknown")
        .when(has_bits(flags, TEST_FAILED), "fail")
        .otherwise("pass")
    )


def valid_bin(bin_: Column) -> Column:
    return F.when(bin_ <= MAX_BIN, bin_)


def is_finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _outside(value: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(value < lo, F.lit(False)) | F.coalesce(value > hi, F.lit(False))


def row_failure(test_pass: Column, value: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(~test_pass, F.lit(False)) | (~F.isnan(F.coalesce(value, F.lit(0.0))) & _outside(value, lo, hi))


def limit_failure(value: Column, lo: Column, hi: Column) -> Column:
    return is_finite(value) & _outside(value, lo, hi)


def percent(part: Column, total: Column) -> Column:
    """Dashboard percentage: 0.0 for an empty population."""
    return F.when(total > 0, part * F.lit(100.0) / total).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Exact ratio as a double, NULL for a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def null_reason(denominator: Column, reason: str) -> Column:
    return F.when(denominator == 0, F.lit(reason))


def alarm(test_flags: Column, alarm_id: Column) -> Column:
    return has_bits(test_flags, FTR_ALARM) | (F.coalesce(alarm_id, F.lit("")) != "")


def value_state(kind: Column, channel: Column, value: Column, raw: Column, flags: Column, parm_flags: Column) -> Column:
    """State of a numeric result."""
    masked = has_bits(flags, 0x3F)
    usable = is_finite(value) & ~masked & ~has_bits(parm_flags, 0x07)
    return (
        F.when(F.coalesce(usable, F.lit(False)), "valid")
        .when((kind == "FTR") | ((kind == "MPR") & channel.isNull()), "not_numeric")
        .when(masked, "invalid")
        .when(raw.isNotNull() & ~is_finite(raw), "nonfinite")
        .when(raw.isNull(), "missing")
        .otherwise("unknown")
    )


def effective_result(value: Column, flags: Column, parm_flags: Column) -> Column:
    """NULL when TEST_FLG or PARM_FLG marks the result as unusable."""
    return F.when(~has_bits(flags, 0x3F) & ~has_bits(parm_flags, 0x07) & is_finite(value), value)
