"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000


def is_true(text: Column) -> Column:
    """Text flag: `true` in any case; anything else, also null, is false."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def short_date(iso: Column) -> Column:
    """`2024-01-05` as `05JAN24`."""
    return F.upper(F.date_format(F.to_date(iso), "ddMMMyy"))


def leg_key(airline: Column, number: Column, date: Column, station: Column, dup: Column | None = None) -> Column:
    """Flight key text: airline, number, date, station, duplicate code, live snapshot."""
    return F.concat(airline, number, date, station, F.coalesce(dup, F.lit("0")) if dup is not None else F.lit("0"), F.lit("0"))


def effective_ms(source: Column, hub: Column, now_ms: Column) -> Column:
    """Source time, else hub time, else now."""
    return F.coalesce(source, hub, now_ms)


def changed(new: Column, old: Column) -> Column:
    """New value is present and not the old one."""
    return new.isNotNull() & ~new.eqNullSafe(old)


def local_to_utc(ms: Column, offset_min: Column) -> Column:
    """Local clock time to UTC by the station's offset in minutes."""
    return ms - offset_min * MINUTE
