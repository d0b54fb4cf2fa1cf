"""Timestamp functions as Column expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_iso(ts: Column) -> Column:
    """ISO 8601 with Z; fractions only where there are any, then six digits."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def from_iso(text: Column) -> Column:
    """Null for what is no ISO 8601 timestamp; without a zone it is UTC."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(text))


def valid_iso(text: Column) -> Column:
    return from_iso(text).isNotNull()


def days_between(a: Column, b: Column) -> Column:
    """Whole days from b to a, rounded down."""
    return F.floor((F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000))


def reasonable(ts: Column, as_of: Column, max_years_in_future: int = 0) -> Column:
    """Not over 36500 days past, not a whole day (or the given years) ahead."""
    return (days_between(as_of, ts) <= 36_500) & (days_between(ts, as_of) <= 365 * max_years_in_future)


def components(ts: Column) -> Column:
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
    return F.struct(*[f(ts).alias(n) for n, f in parts.items()], F.second(ts).alias("second"), to_iso(ts).alias("iso"))
