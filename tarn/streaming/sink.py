"""Structured Streaming into and out of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import names
from ..operators import actions as A
from ..operators.scan import read_files
from ..operators.snapshot import Snapshot, read_commits
from ..operators.table import LakeTable


def write_stream(rows: DataFrame, table: LakeTable, app: str, mode: str = "append") -> DataStreamWriter:
    """A writer that appends each micro-batch once: its number stands in the same commit as its files."""

    def batch(df: DataFrame, number: int) -> None:
        LakeTable(df.sparkSession, table.store, table.lock, table.state).append(df, (app, number), A.streaming_info(mode, app, number))

    return rows.writeStream.outputMode(mode).foreachBatch(batch)


def read_stream(table: LakeTable, handle, max_commits: int = 100) -> DataStreamWriter:
    """Tail the log: handle(rows, number) gets the rows that new commits add as new data, a micro-batch of commits at a time.

    Spark's file source remembers the commits that it has handed on, so a restart goes on where the last run ended.
    """
    lines = table.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_commits).text(table.store.uri(names.LOG))

    def batch(df: DataFrame, number: int) -> None:
        add = F.from_json(F.get_json_object("value", "$.add"), "path string, dataChange boolean")
        paths = [r.path for r in df.select(add.alias("a")).where("a.dataChange").select("a.path").distinct().collect()]
        if paths:
            handle(read_files(table.snapshot(), paths), number)

    return lines.writeStream.foreachBatch(batch)


def changes(table: LakeTable, after: int, until: int | None = None) -> DataFrame:
    """Rows of files that commits after version `after` added as new data; rearranged files (dataChange false) are left out."""
    s: Snapshot = table.snapshot(until)
    versions = list(range(after + 1, s.version + 1))
    if not versions:
        return read_files(s, [])
    added = read_commits(table.spark, table.store, versions).where(F.col("add.dataChange")).select("add.path").distinct()
    return read_files(s, [r.path for r in added.collect()])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key under a watermark; for streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
