"""File-name grammar of the log, for strings and for columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the protocol prescribes.
LOG, HINT = "_delta_log", "_last_checkpoint"
COMMIT = r"^(\d{20})\.json$"
CHECKPOINT = r"^(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet$"
COMMIT_OR_CHECKPOINT = r"^(\d{20})\.(?:json|checkpoint(?:\.\d{10}\.\d{10})?\.parquet)$"


def commit_name(version: int) -> str:
    return f"{version:020d}.json"


def checkpoint_names(version: int, parts: int | None) -> list[str]:
    if not parts or parts == 1:
        return [f"{version:020d}.checkpoint.parquet"]
    return [f"{version:020d}.checkpoint.{k:010d}.{parts:010d}.parquet" for k in range(1, parts + 1)]


def version_of(name: str, pattern: str = COMMIT) -> int | None:
    m = re.match(pattern, name.rsplit("/", 1)[-1])
    return int(m[1]) if m else None


def checkpoint_of(name: str) -> tuple[int, int, int] | None:
    """(version, part, parts)."""
    m = re.match(CHECKPOINT, name.rsplit("/", 1)[-1])
    return (int(m[1]), int(m[2] or 1), int(m[3] or 1)) if m else None


def version_column(name: Column, pattern: str = COMMIT) -> Column:
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).cast("long"))


def part_column(name: Column, group: int) -> Column:
    """Part (2) or parts (3) of a checkpoint's name; 1 for one file."""
    return F.when(name.rlike(CHECKPOINT), F.coalesce(F.nullif(F.regexp_extract(name, CHECKPOINT, group), F.lit("")).cast("int"), F.lit(1)))
