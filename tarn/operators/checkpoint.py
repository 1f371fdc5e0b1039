"""Checkpoints: the state in pages of Parquet, and what they let the log forget."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CheckpointAlreadyExists, CheckpointRowCountMismatch, MissingMetadata
from ..functions import names, settings
from ..sources.coordination import Lock, NoLock
from .actions import KINDS, LOG_SCHEMA, now_ms
from .snapshot import Listing, Snapshot

MAX_ROWS = 50_000


def retained(time: Column, cutoff: int) -> Column:
    """Whether a tombstone of that time stays: one after the cut-off, in the same unit, or without a time."""
    return time.isNull() | (time > cutoff)


def kept_tombstones(snapshot: Snapshot, now: int | None = None) -> DataFrame:
    """Tombstones younger than the retention; those without a time stay. If one has no extended metadata, none claims it."""
    cutoff = (now_ms() if now is None else now) - int(snapshot.file_retention.total_seconds() * 1000)
    kept = snapshot.tombstones.where(retained(F.col("deletionTimestamp"), cutoff))
    every = kept.agg(F.bool_and(F.coalesce("extendedFileMetadata", F.lit(False))).alias("all")).first()["all"]
    return kept if every else kept.withColumn("extendedFileMetadata", F.lit(False))


def checkpoint_rows(snapshot: Snapshot, now: int | None = None) -> DataFrame:
    """section, key and one record a row: protocol, metadata, application versions, removes, adds."""
    if snapshot.metadata is None:
        raise MissingMetadata(str(snapshot.version))
    null = {k: F.lit(None).cast(LOG_SCHEMA[k].dataType).alias(k) for k in KINDS}

    def row(df: DataFrame, kind: str, section: int, key: Column) -> DataFrame:
        body = F.struct(*(F.col(c).cast(LOG_SCHEMA[kind].dataType[c].dataType).alias(c) for c in LOG_SCHEMA[kind].dataType.fieldNames()))
        return df.select(F.lit(section).alias("section"), key.alias("key"), *(body.alias(k) if k == kind else null[k] for k in KINDS))

    spark = snapshot.spark
    one = lambda kind, value: spark.createDataFrame([value], LOG_SCHEMA[kind].dataType)
    adds = snapshot.files.withColumn("dataChange", F.lit(False)).withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(F.raise_error(F.lit("an add of size 0")).cast("long")))
    full = lambda kind, d: {c: d.get(c) for c in LOG_SCHEMA[kind].dataType.fieldNames()}
    parts = [
        row(one("protocol", full("protocol", snapshot.protocol or {})), "protocol", 0, F.lit("")),
        row(one("metaData", full("metaData", snapshot.metadata.action()["metaData"])), "metaData", 1, F.lit("")),
        row(snapshot.txns, "txn", 2, F.col("appId")),
        row(kept_tombstones(snapshot, now), "remove", 3, F.col("path")),
        row(adds, "add", 4, F.col("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paged(rows: DataFrame, max_rows: int, staging: str) -> tuple[DataFrame, int, int]:
    """(rows with part, from 1, in pages of max_rows by section and key; rows; parts).

    A range partitioning sorts in parallel; the sizes of its partitions, a number each, give every row its place.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = rows.repartitionByRange(n, "section", "key").sortWithinPartitions("section", "key").withColumn("_id", F.monotonically_increasing_id())
    local.write.parquet(staging)
    local = spark.read.parquet(staging).withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["_p"], r["count"]) for r in local.groupBy("_p").count().collect())
    total, starts = 0, []
    for p, c in sizes:
        starts.append((p, total))
        total += c
    at = F.create_map(*(F.lit(x).cast("long") for s in starts for x in s))
    return local.withColumn("part", (F.floor((F.element_at(at, F.col("_p")) + F.col("_i")) / max_rows) + 1).cast("int")), total, -(-total // max_rows)


def create_checkpoint(snapshot: Snapshot, lock: Lock | None = None, max_rows: int = MAX_ROWS, now: int | None = None, cleanup: bool = True) -> dict:
    """Write the snapshot's checkpoint and _last_checkpoint; then clean the log if the table wants it."""
    store, v = snapshot.store, snapshot.version
    with lock or NoLock():
        if v in Listing(store).checkpoints:
            raise CheckpointAlreadyExists(str(v))
        temp = f"{names.LOG}/.tmp/checkpoint-v{v}-{uuid.uuid4()}"
        rows, total, parts = paged(checkpoint_rows(snapshot, now), max_rows, store.uri(f"{temp}/sorted"))
        out = store.uri(f"{temp}/parts")
        rows.repartition(parts, "part").sortWithinPartitions("part", "_id").select("part", *KINDS).write.option("compression", "snappy").partitionBy("part").parquet(out)
        written = {int(m.path.split("/part=")[1].split("/")[0]): m for m in store.list(f"{temp}/parts/") if "/part=" in m.path and m.path.endswith(".parquet")}
        check = snapshot.spark.read.schema(LOG_SCHEMA).parquet(out)
        adds = F.count("add.path").alias("adds")
        got, n_adds = check.agg(F.count("*"), adds).first()
        if got != total or len(written) != parts:
            raise CheckpointRowCountMismatch(f"{got} of {total} rows, {len(written)} of {parts} parts")
        for k, name in enumerate(names.checkpoint_names(v, parts), 1):
            store.rename_if_absent(written[k].path, f"{names.LOG}/{name}")
        info = {"version": v, "size": total, "sizeInBytes": sum(m.size for m in written.values()), "numOfAddFiles": n_adds} | ({"parts": parts} if parts > 1 else {})
        store.put(f"{names.LOG}/{names.HINT}", json.dumps(info).encode())
        store.delete_folder(temp)
        if cleanup and settings.boolean(snapshot.metadata.configuration, settings.LOG_CLEANUP):
            clean_log(snapshot, now)
    return info


def adjusted_times(files: DataFrame) -> DataFrame:
    """files (version, modified in ms) with `adjusted`: times that rise by version, each at least 1 ms after the one before."""
    w = Window.orderBy("version")
    rank = F.row_number().over(w)
    return files.withColumn("_r", rank).withColumn("adjusted", F.col("_r") + F.max(F.col("modified") - F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def clean_log(snapshot: Snapshot, now: int | None = None) -> list[str]:
    """Delete commits and checkpoints before the snapshot's version whose adjusted time is past the log's retention."""
    store, v = snapshot.store, snapshot.version
    Snapshot(snapshot.spark, store, v)  # it must load
    if v not in Listing(store).checkpoints:
        return []
    cutoff = (int(time.time() * 1000) if now is None else now) - int(snapshot.log_retention.total_seconds() * 1000)
    # File names of the log's folder, already on the driver.
    named = [(x, m) for m in store.folder(names.LOG) if (x := names.version_of(m.path, names.COMMIT_OR_CHECKPOINT)) is not None]
    modified: dict[int, int] = {}
    for version, m in named:
        modified[version] = max(modified.get(version, 0), m.modified_ms)
    times = adjusted_times(snapshot.spark.createDataFrame(sorted(modified.items()), "version long, modified long"))
    old = {r.version for r in times.where((F.col("version") < v) & (F.col("adjusted") <= cutoff)).select("version").toLocalIterator()}
    gone = [m.path for version, m in sorted(named, key=lambda p: (p[0], p[1].path)) if version in old]
    for path in gone:
        store.delete(path)
    return gone
