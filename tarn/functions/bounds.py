"""Column forms of file statistics: truncated strings, times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a string bound keeps, and what follows a cut maximum.
KEPT, TIE = 32, "�"


def string_min(c: Column) -> Column:
    return F.substring(c, 1, KEPT)


def string_max(c: Column) -> Column:
    """A bound not below any string that starts like c: characters beyond the tie-breaker are kept before it."""
    beyond = F.regexp_extract(F.substring(c, KEPT + 1, 1 << 30), r"^[\x{FFFE}-\x{10FFFF}]*", 0)
    return F.when(F.char_length(c) >= KEPT, F.concat(F.substring(c, 1, KEPT), beyond, F.lit(TIE))).otherwise(c)


def timestamp_text(c: Column) -> Column:
    """UTC, milliseconds, the rest cut off."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Microseconds in a unit of time, or units in a microsecond.
UNITS = {"millis": 1_000, "micros": 1, "nanos": -1_000}


def instant_micros(value: Column, unit: str) -> Column:
    """Microseconds since 1970, or since midnight, of a number of units; nanoseconds are cut."""
    n = UNITS[unit]
    return value.cast("long") * n if n > 0 else F.floor(value / -n)


def time_text(value: Column, unit: str) -> Column:
    """HH:mm:ss.SSS of a time of the day given as a number of units, the rest cut off; null outside the day."""
    ms = F.floor(instant_micros(value, unit) / 1000)
    part = lambda size, most: F.pmod(F.floor(ms / size), F.lit(most)).cast("int")
    text = F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))
    return F.when(ms.between(0, 86_399_999), text)


def bound(c: Column, kind: T.DataType, largest: bool) -> Column | None:
    """min or max of c as the statistics show it; None for types without bounds."""
    agg = F.max(c) if largest else F.min(c)
    if isinstance(kind, T.StringType):
        return string_max(agg) if largest else string_min(agg)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(agg)
    if isinstance(kind, T.DateType):
        return F.date_format(agg, "yyyy-MM-dd")
    return agg if isinstance(kind, T.NumericType) else None
