"""Time columns. The exact coordinate of a date and time is its microseconds since 1970, UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: Spellings of a missing value, lower case.
MISSING = ("", "nan", "none", "nat", "<na>")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_datetime(text: Column) -> Column:
    """Timestamp of a text: the exact pattern first, then a lenient reading, else null."""
    text = F.trim(text)
    known = F.when(~F.lower(text).isin(*MISSING), text)
    return F.coalesce(F.try_to_timestamp(known, F.lit(ISO_MICROS)), F.try_to_timestamp(known))


def format_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, ISO_MICROS), F.lit(""))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / 1e6


def from_epoch_seconds(seconds: Column) -> Column:
    """Timestamp of epoch seconds, rounded half-even to microseconds."""
    return F.timestamp_micros(F.bround(finite(seconds) * 1e6).cast("long"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(micros(ts) + F.bround(seconds * 1e6).cast("long"))


def timeline_values(times: DataFrame, keys: list[str]) -> DataFrame:
    """times with `t` (seconds) and `time_basis` by the rule of whole timelines.

    A timeline with any date and time is `datetime` in all its rows; else, with any
    finite number of seconds, `numeric`; else `missing` and t is null.
    """
    kind = times.groupBy(keys).agg(F.bool_or(F.col("time_value_datetime").isNotNull()).alias("_dated"), F.bool_or(finite(F.col("time_value_sec")).isNotNull()).alias("_numbered"))
    basis = F.when(F.col("_dated"), "datetime").when(F.coalesce("_numbered", F.lit(False)), "numeric").otherwise("missing")
    t = F.when(F.col("_dated"), epoch_seconds(F.col("time_value_datetime"))).otherwise(finite(F.col("time_value_sec")))
    return times.join(kind, keys).withColumns({"t": t, "time_basis": basis}).drop("_dated", "_numbered")
