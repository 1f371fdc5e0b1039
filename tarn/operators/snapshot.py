"""Log replay: a table's state at a version as DataFrames.

The driver lists file names and picks a checkpoint; the records themselves are read, reduced and
kept by Spark. Commits are read by line, so one commit may be of any size.
"""

from __future__ import annotations

import json
import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CheckpointEntryMultipleActions, CheckpointIncomplete, CheckpointInvalidName, InvalidVersion, NotATable, ObjectDoesNotExist, TableError, UnableToLoadVersion
from ..functions import names, settings
from ..sources.store import ObjectStore
from .actions import KINDS, LOG_SCHEMA, Metadata, parsed


class Listing:
    """Versions and checkpoints that a log folder has, from version `since` on."""

    def __init__(self, store: ObjectStore, since: int = 0):
        self.store, self.since, self.commits, parts = store, since, {}, {}
        for m in store.folder(names.LOG, names.commit_name(since)[:20]):
            base = os.path.basename(m.path)
            v = names.version_of(base)
            if v is not None and m.size:
                self.commits[v] = m
            c = names.checkpoint_of(base)
            if c:
                parts.setdefault(c[0], {}).setdefault(c[2], set()).add(c[1])
        #: version -> parts of its complete checkpoint
        self.checkpoints = {v: p for v, by in parts.items() for p, got in by.items() if len(got) == p}
        self.partial = {v for v in parts if v not in self.checkpoints}
        self.any_parts = parts

    def latest(self) -> int:
        """The end of the run of commits that starts at the last checkpoint, or at the first commit."""
        if not self.commits and not self.checkpoints:
            raise NotATable(self.store.uri())
        start = max((v for v in self.checkpoints if v in self.commits), default=min(self.commits, default=-1))
        if start < 0:
            raise NotATable(self.store.uri())
        while start + 1 in self.commits:
            start += 1
        return start


def recent(store: ObjectStore) -> Listing:
    """The listing from the checkpoint that _last_checkpoint names, if that is whole; else of the whole log."""
    hint = last_checkpoint(store)
    version = hint.get("version") if isinstance(hint, dict) else None
    if isinstance(version, int) and version > 0:
        found = Listing(store, version)
        if version in found.checkpoints and version in found.commits:
            return found
    return Listing(store)


def checkpoint_exists(store: ObjectStore, version: int, validate_parts: bool = True) -> bool:
    found = Listing(store)
    if version not in found.any_parts:
        return False
    if len(found.any_parts[version]) > 1:
        raise CheckpointInvalidName(f"checkpoint {version} has files of different part counts")
    if validate_parts and version not in found.checkpoints:
        raise CheckpointIncomplete(str(version))
    return True


def read_commits(spark: SparkSession, store: ObjectStore, versions: list[int]) -> DataFrame:
    """LOG_SCHEMA's columns, version, and (block, pos): the place in the commit."""
    paths = [store.uri(f"{names.LOG}/{names.commit_name(v)}") for v in versions]
    lines = spark.read.text(paths).select(
        names.version_column(F.col("_metadata.file_name")).alias("version"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )
    return parsed(lines)


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the columns of order."""
    w = Window.partitionBy(key).orderBy(*map(F.desc, order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Snapshot:
    """files, tombstones, txns (DataFrames); protocol, metadata, and counts."""

    def __init__(self, spark: SparkSession, store: ObjectStore, version: int | None = None):
        self.spark, self.store = spark, store
        found = recent(store) if version is None else Listing(store)
        if version is None:
            version = found.latest()
        if version not in found.commits:
            raise InvalidVersion(str(version)) if found.commits or found.checkpoints else NotATable(store.uri())
        self.version = version
        try:
            self._load(found)
        except (TableError, PySparkException, Py4JJavaError):
            if not found.since:
                raise
            self._load(Listing(store))  # what the hint names can't be read: an earlier state may do
        moves = self.log.where("add is not null or remove is not null").select(
            F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().cast("int").alias("is_add"), "version", "block", "pos", "add", "remove"
        )
        last = newest(moves, "path", "version", "is_add", "block", "pos")
        self.files = last.where("is_add = 1").select("add.*")
        self.tombstones = last.where("is_add = 0").select("remove.*")
        self.txns = newest(self.log.where("txn is not null"), "txn.appId", "version", "block", "pos").select("txn.*")

    def _load(self, found: Listing) -> None:
        version, spoilt = self.version, None
        for base in [*sorted((v for v in found.checkpoints if v <= version), reverse=True), None]:
            tail = list(range((-1 if base is None else base) + 1, version + 1))
            missing = [v for v in tail if v not in found.commits]
            if missing:
                if base is None:
                    raise spoilt or UnableToLoadVersion(f"version {version} needs commit {missing[0]}")
                continue
            try:
                self.log = self._records(base, found.checkpoints.get(base), tail)
                self._scalars(base, found.checkpoints.get(base))
                break
            except (PySparkException, Py4JJavaError, CheckpointIncomplete, CheckpointEntryMultipleActions) as e:  # a checkpoint that can't be read: an earlier one may do
                if base is None or "unknown log record" in str(e):
                    raise
                spoilt = e
        self.checkpoint_version = base

    def _records(self, base: int | None, parts: int | None, tail: list[int]) -> DataFrame:
        out = read_commits(self.spark, self.store, tail) if tail else None
        if base is not None:
            paths = [self.store.uri(f"{names.LOG}/{n}") for n in names.checkpoint_names(base, parts)]
            rows = self.spark.read.schema(LOG_SCHEMA).parquet(*paths).select(F.lit(base).cast("long").alias("version"), F.lit(-1).cast("long").alias("block"), F.crc32(F.col("_metadata.file_name")).alias("pos"), *KINDS)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _scalars(self, base: int | None, parts: int | None) -> None:
        """The last protocol and metadata: a handful of records among all. A checkpoint's rows have one record each, and each part has rows."""
        place = F.struct("version", "block", "pos")
        kinds = sum((F.col(k).isNotNull().cast("int") for k in KINDS), F.lit(0))
        row = self.log.agg(
            F.count_if((F.col("block") == -1) & (kinds > 1)).alias("several"),
            F.count_distinct(F.when(F.col("block") == -1, F.col("pos"))).alias("parts"),
            F.max_by("protocol", F.when(F.col("protocol.minReaderVersion") > 0, place)).alias("protocol"),
            F.max_by("metaData", F.when(F.col("metaData").isNotNull(), place)).alias("metaData"),
        ).first()
        if row.several:
            raise CheckpointEntryMultipleActions(f"checkpoint {base}")
        if base is not None and row.parts < parts:
            raise CheckpointIncomplete(f"checkpoint {base} has empty parts")
        self.protocol = row.protocol.asDict(True) if row.protocol else None
        self.metadata = Metadata.from_action(row.metaData.asDict(True)) if row.metaData else None

    @property
    def file_retention(self):
        return settings.retention(self.metadata.configuration if self.metadata else {}, settings.FILE_RETENTION, settings.DEFAULT_FILE_RETENTION)

    @property
    def log_retention(self):
        return settings.retention(self.metadata.configuration if self.metadata else {}, settings.LOG_RETENTION, settings.DEFAULT_LOG_RETENTION)

    def file_count(self) -> int:
        return self.files.count()

    def tombstone_count(self) -> int:
        return self.tombstones.count()

    def app_version(self, app: str) -> int | None:
        row = self.txns.where(F.col("appId") == app).first()
        return row.version if row else None

    def row_count(self) -> int:
        """From statistics alone, where every file has them; else from the data's own footers through Spark."""
        row = self.files.agg(F.sum(F.get_json_object("stats", "$.numRecords").cast("long")), F.count_if(F.get_json_object("stats", "$.numRecords").isNull())).first()
        if row[1]:
            from .scan import scan

            return scan(self).count()
        return row[0] or 0


def history(spark: SparkSession, store: ObjectStore) -> DataFrame:
    """version, timestamp, operation, parameters of the commits that the log still has."""
    found = sorted(Listing(store).commits)
    lines = spark.read.text([store.uri(f"{names.LOG}/{names.commit_name(v)}") for v in found])
    info = F.get_json_object("value", "$.commitInfo")
    return lines.where(F.col("value").startswith('{"commitInfo"')).select(
        names.version_column(F.col("_metadata.file_name")).alias("version"), F.get_json_object(info, "$.timestamp").cast("long").alias("timestamp"), F.get_json_object(info, "$.operation").alias("operation"), F.get_json_object(info, "$.operationParameters").alias("parameters")
    )


def last_checkpoint(store: ObjectStore) -> dict | None:
    try:
        return json.loads(store.get(f"{names.LOG}/{names.HINT}"))
    except (ObjectDoesNotExist, ValueError):
        return None
