"""Table properties and interval texts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigValidation

# The protocol's table properties.
PROPERTIES = (
    "delta.appendOnly", "delta.checkpointInterval", "delta.autoOptimize.autoCompact", "delta.autoOptimize.optimizeWrite",
    "delta.checkpoint.writeStatsAsJson", "delta.checkpoint.writeStatsAsStruct", "delta.columnMapping.mode", "delta.dataSkippingNumIndexedCols",
    "delta.deletedFileRetentionDuration", "delta.enableChangeDataFeed", "delta.isolationLevel", "delta.logRetentionDuration",
    "delta.enableExpiredLogCleanup", "delta.minReaderVersion", "delta.minWriterVersion", "delta.randomizeFilePrefixes",
    "delta.randomPrefixLength", "delta.setTransactionRetentionDuration", "delta.targetFileSize", "delta.tuneFileSizesForRewrites",
)
APPEND_ONLY, FILE_RETENTION, LOG_RETENTION, LOG_CLEANUP = (PROPERTIES[i] for i in (0, 8, 11, 12))
DEFAULT_FILE_RETENTION, DEFAULT_LOG_RETENTION = timedelta(days=7), timedelta(days=30)

# Microseconds of each unit; a month has 31 days and a year 365.
UNITS = {"nanosecond": 0.001, "microsecond": 1, "millisecond": 1e3, "second": 1e6, "minute": 60e6, "hour": 3600e6, "day": 86400e6, "week": 604800e6, "month": 2678400e6, "year": 31536000e6}


def parse_interval(text: str) -> timedelta:
    """'[interval ]N unit [N unit ...]', integers, any case."""
    words = text.lower().split()
    if words[:1] == ["interval"]:
        words = words[1:]
    if not words or len(words) % 2:
        raise ConfigValidation(f"not an interval: {text!r}")
    total = 0.0
    for n, unit in zip(words[::2], words[1::2], strict=True):
        scale = UNITS.get(unit.removesuffix("s"))
        try:
            number = int(n)
        except ValueError:
            raise ConfigValidation(f"not a whole number: {n!r}") from None
        if scale is None:
            raise ConfigValidation(f"unknown unit {unit!r}")
        total += number * scale
    return timedelta(microseconds=total)


def interval_micros(c: Column) -> Column:
    """The same over a column: microseconds, or null where it isn't an interval."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"^interval\s+", "")
    pairs = F.regexp_extract_all(plain, F.lit(r"([+-]?\d+\s+[a-z]+)"), F.lit(1))
    scale = F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, float(v))))

    def one(p: Column) -> Column:
        words = F.split(p, r"\s+")
        return F.get(words, F.lit(0)).cast("double") * F.element_at(scale, F.regexp_replace(F.get(words, F.lit(1)), "s$", ""))

    whole = plain.rlike(r"^[+-]?\d+\s+[a-z]+(\s+[+-]?\d+\s+[a-z]+)*$")
    return F.when(whole, F.aggregate(pairs, F.lit(0.0), lambda a, p: a + one(p)).cast("long"))


def boolean(configuration: dict, key: str, default: bool = False) -> bool:
    return str(configuration.get(key, default)).lower() == "true"


def retention(configuration: dict, key: str, default: timedelta) -> timedelta:
    return parse_interval(configuration[key]) if configuration.get(key) else default
