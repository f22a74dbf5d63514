"""Column expressions shared by the models; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double; null when the denominator is zero or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def elapsed(later: Column, earlier: Column, seconds_per_unit: int = 1) -> Column:
    """Time between two instants in the given unit, as a double; null if either is missing."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0 * seconds_per_unit)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def or_false(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def sum_where(value: Column, condition: Column) -> Column:
    """Sum over the rows meeting ``condition``; null when there are none."""
    return F.sum(F.when(condition, value))


def avg_where(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def is_false(flag: Column) -> Column:
    """True only for a definite false: an unknown flag is not false."""
    return flag.eqNullSafe(F.lit(False))


def blank_to(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def instant(text: Column) -> Column:
    """ISO-8601 text, with ``Z`` or a numeric offset, as an instant; null if unreadable."""
    return F.try_to_timestamp(text)


def tolerant_int(text: Column) -> Column:
    """The integer a property holds, or null when it holds something else."""
    return text.try_cast("int")


def tolerant_bool(text: Column) -> Column:
    """True for any spelling of ``true``, false for other text, null when absent."""
    return F.lower(F.trim(text)) == "true"


def offset_text(minutes: Column) -> Column:
    """Minutes after the fault as ``+HH:MM``, with a leading day count from the first day on."""
    days = F.floor(minutes / 1440)
    clock = F.format_string(
        "%02d:%02d", F.floor(minutes % 1440 / 60).cast("int"), (minutes % 60).cast("int")
    )
    return F.when(days > 0, F.concat(F.lit("+"), days.cast("string"), F.lit("d "), clock)).otherwise(
        F.concat(F.lit("+"), clock)
    )


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that depend only on the natural key's parts and their order."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256), 1, 16)
