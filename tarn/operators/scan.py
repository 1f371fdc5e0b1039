"""Scans of a snapshot's rows: partition pruning and data skipping before Spark plans the file scan."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import P, stats_schema


def matching_files(snapshot, predicate: P | None = None) -> DataFrame:
    """Active files that may have rows of the predicate."""
    files = snapshot.files
    if predicate is not None:
        m = snapshot.metadata
        keep = predicate.files(m.schema, m.partition_columns)
        files = files.withColumn("s", F.from_json("stats", stats_schema(m.schema, m.partition_columns))).where(F.coalesce(keep, F.lit(True))).drop("s")
    return files


def read_files(snapshot, paths: list[str]) -> DataFrame:
    schema = snapshot.metadata.schema
    if not paths:
        return snapshot.spark.createDataFrame([], schema)
    full = [snapshot.store.uri(unquote(p)) for p in paths]
    rows = snapshot.spark.read.schema(schema).option("basePath", snapshot.store.uri()).option("timeZone", "UTC").parquet(*full)
    return rows.select(*(F.col(f"`{n}`") for n in schema.fieldNames()))


def scan(snapshot, predicate: P | None = None) -> DataFrame:
    """The rows at the snapshot's version; the predicate filters files first, then rows."""
    paths = [r.path for r in matching_files(snapshot, predicate).select("path").collect()]
    rows = read_files(snapshot, paths)
    return rows if predicate is None else rows.where(predicate.rows())
