"""The table: create, write, change, maintain. Every job over rows is a DataFrame plan; only commits run on the driver."""

from __future__ import annotations

import contextlib
import os
import threading
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AddGenerateStats, AddZeroSize, AlreadyCommitted, AmbiguousMerge, AppendOnly, NotATable, ObjectDoesNotExist, ProtocolTooHigh
from ..functions import names, settings
from ..sources.coordination import Lock, MemoryState, NoLock, StateStore
from ..sources.store import ObjectStore, store_of
from . import actions as A
from .commit import Options, Transaction
from .scan import matching_files, read_files, scan
from .snapshot import Listing, Snapshot, recent
from .stats import P, file_stats


#: Size of the files that optimize() makes.
TARGET_BYTES = 128 << 20
#: Files of partitions that a task has open at once; the rows of more of them are sorted first.
OPEN_FILES = 16


_WRITERS: dict[int, tuple[int, dict[str, str]]] = {}
_GUARD = threading.Lock()


@contextlib.contextmanager
def writing(spark: SparkSession):
    """Data files have UTC texts and microsecond timestamps, whatever the session says, and tasks keep the files of a few partitions open instead of sorting
    their rows; the session gets its settings back when the last of its threads has written."""
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
    with _GUARD:
        n, before = _WRITERS.get(id(spark), (0, {}))
        before = before or {k: spark.conf.get(k) for k in wanted}
        _WRITERS[id(spark)] = (n + 1, before)
        for k, v in wanted.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _GUARD:
            n, _ = _WRITERS[id(spark)]
            _WRITERS[id(spark)] = (n - 1, before)
            if n == 1:
                del _WRITERS[id(spark)]
                for k, v in before.items():
                    spark.conf.set(k, v)


@dataclass
class Head:
    """What a blind append needs to know of the last version."""

    version: int
    metadata: A.Metadata
    apps: dict[str, int | None] = field(default_factory=dict)


class LakeTable:
    def __init__(self, spark: SparkSession, path: str | ObjectStore, lock: Lock | None = None, state: StateStore | None = None):
        self.spark = spark
        self.store = path if isinstance(path, ObjectStore) else store_of(spark, path)
        self.lock, self.state, self.version = lock or NoLock(), state or MemoryState(), -1
        self._head: Head | None = None

    # Life cycle

    def exists(self) -> bool:
        found = Listing(self.store)
        return bool(found.commits or found.any_parts)

    def create(self, metadata: A.Metadata, protocol: dict | None = None, info: dict | None = None, adds: list[dict] = ()) -> LakeTable:
        """Version 0. A protocol beyond this engine is written, then ProtocolTooHigh is raised with the table."""
        protocol = protocol or A.protocol()
        t = Transaction(self).add_actions({"commitInfo": {"timestamp": A.now_ms(), "clientVersion": A.CLIENT_VERSION} | (info or A.create_info(metadata))}, protocol, metadata.action(), *adds)
        self.store.rename_if_absent(t.prepare(), f"{names.LOG}/{names.commit_name(0)}")
        self.version = 0
        self.state.put(0)
        self._check_protocol(protocol["protocol"])
        return self

    def _check_protocol(self, p: dict | None) -> None:
        if p and ((p.get("minReaderVersion") or 0) > A.READER_VERSION or (p.get("minWriterVersion") or 0) > A.WRITER_VERSION):
            raise ProtocolTooHigh(f"reader {p.get('minReaderVersion')}, writer {p.get('minWriterVersion')}", self)

    def snapshot(self, version: int | None = None, unsafe: bool = False) -> Snapshot:
        s = Snapshot(self.spark, self.store, version)
        self.version = max(self.version, s.version) if version is None else self.version
        if not unsafe:
            self._check_protocol(s.protocol)
        return s

    def latest_version(self) -> int:
        return recent(self.store).latest()

    def sync_state(self) -> None:
        """Under the lock: no commit moves the state meanwhile."""
        with self.lock:
            try:
                self.state.put(self.latest_version())
            except NotATable:
                self.state.put(-1)

    def head(self, app: str | None = None) -> Head:
        """The last version's schema and settings. The log is replayed again only if others have committed since, or if an application is asked for the first time."""
        h = self._head
        if h is None or (app is not None and app not in h.apps) or Listing(self.store, h.version).latest() != h.version:
            s = self.snapshot()
            h = self._head = Head(s.version, s.metadata, {} if app is None else {app: s.app_version(app)})
        return h

    def advanced(self, version: int, actions: list[dict]) -> None:
        """This table's own commit has made the version."""
        h = self._head
        if h is not None and version == h.version + 1 and not any("metaData" in a or "protocol" in a for a in actions):
            h.version = version
            h.apps.update({a["txn"]["appId"]: a["txn"]["version"] for a in actions if "txn" in a})
        else:
            self._head = None

    def transaction(self, options: Options | None = None) -> Transaction:
        return Transaction(self, options)

    def read(self, version: int | None = None, where: P | None = None) -> DataFrame:
        return scan(self.snapshot(version), where)

    # Writes

    def stage(self, rows: DataFrame, partition_columns: list[str]) -> list[dict]:
        """Write rows as data files and return their adds, statistics from one aggregate over the new files."""
        staging = f"_staging/{uuid.uuid4().hex}"
        stats = {}
        with writing(self.spark):
            writer = rows.write
            if partition_columns:
                writer = writer.partitionBy(*partition_columns)
            writer.parquet(self.store.uri(staging))
            kind = T.StructType([f for f in rows.schema.fields if f.name not in partition_columns])
            data = self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(self.store.uri(staging))
            for r in file_stats(data).collect():  # a row a file, as many as the adds of the commit
                stats[unquote(r.path).split(staging + "/", 1)[1]] = (r.numRecords, r.stats)
        adds = []
        for m in self.store.list(staging + "/"):
            inner = m.path[len(staging) + 1 :]
            if not inner.endswith(".parquet"):
                continue
            n, text = stats.get(inner, stats.get(unquote(inner), (0, "")))
            if not n:  # no rows: not a file of the table
                continue
            values = dict(p.split("=", 1) for p in os.path.dirname(inner).split("/") if "=" in p)
            values = {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in values.items()}
            self.store.rename(m.path, inner)
            adds.append(A.add(quote(inner, safe="/=-_.~ "), m.size, values, text, m.modified_ms))  # the log has the file's name as a URI
        self.store.delete_folder(staging)
        return adds

    def register(self, paths: list[str]) -> int:
        """Add Parquet files that lie in the table's folder already, by their paths in it; partition values come from the paths.

        A file of no bytes raises AddZeroSize, one that can't be read AddGenerateStats.
        """
        s = self.head()
        found = {p: self.store.head(p) for p in paths}
        for p, m in found.items():
            if not m.size:
                raise AddZeroSize(p)
        kind = T.StructType([f for f in s.metadata.schema.fields if f.name not in s.metadata.partition_columns])
        try:
            with writing(self.spark):
                data = self.spark.read.schema(kind).parquet(*map(self.store.uri, paths))
                rows = file_stats(data).collect()  # a row a file, as many as the adds of the commit
        except (PySparkException, Py4JJavaError) as e:
            raise AddGenerateStats(str(e)) from e
        stats = {unquote(r.path): r.stats for r in rows}
        adds = []
        for p, m in found.items():
            values = dict(x.split("=", 1) for x in os.path.dirname(p).split("/") if "=" in x)
            values = {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in values.items()}
            text = next((x for at, x in stats.items() if at.endswith("/" + unquote(p))), '{"numRecords":0}')
            adds.append(A.add(quote(p, safe="/=-_.~ "), m.size, values, text, m.modified_ms))
        return self.transaction().add_actions(*adds).set_operation(A.write_info("Append", s.metadata.partition_columns)).commit()

    def append(self, rows: DataFrame, txn: tuple[str, int] | None = None, info: dict | None = None) -> int:
        """A blind append; with txn (application, version), once only."""
        s = self.head(txn[0] if txn else None)
        if txn and (seen := s.apps[txn[0]]) is not None and seen >= txn[1]:
            return s.version
        read, columns = s.version, s.metadata.partition_columns
        adds = self.stage(self._conform(rows, s), columns)
        t = self.transaction().add_actions(*adds, *([A.txn(*txn)] if txn else []))
        if txn:
            t.only_once(*txn, read)
        try:
            return t.set_operation(info or A.write_info("Append", columns)).commit()
        except AlreadyCommitted:  # another writer was first with the same version of the application
            for a in adds:
                self.store.delete(unquote(a["add"]["path"]))
            return self.latest_version()

    def _conform(self, rows: DataFrame, s: Snapshot | Head) -> DataFrame:
        return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in s.metadata.schema.fields))

    def save(self, rows: DataFrame, mode: str = "errorifexists", partition_columns: list[str] | None = None, configuration: dict | None = None, replace_where: P | None = None) -> int:
        """append, overwrite (all, or replace_where), errorifexists, ignore."""
        mode = mode.lower()
        if not self.exists():
            self.create(A.Metadata(rows.schema, partition_columns or [], configuration or {}))
            return self.append(rows)
        if mode == "ignore":
            return self.latest_version()
        if mode == "errorifexists":
            from ..errors import ObjectAlreadyExists

            raise ObjectAlreadyExists(self.store.uri())
        return self.append(rows) if mode == "append" else self.overwrite(rows, replace_where)

    def _removes(self, files: list, data_change: bool = True) -> list[dict]:
        return [A.remove(r.path, r.size, r.partitionValues, data_change=data_change) for r in files]

    def _change(self, s: Snapshot, touched: list, rows: DataFrame | None, info: dict, data_change: bool = True, everything: bool = True, optimize: bool = False) -> int:
        if not optimize and settings.boolean(s.metadata.configuration, settings.APPEND_ONLY):
            raise AppendOnly(self.store.uri())
        adds = self.stage(rows, s.metadata.partition_columns) if rows is not None else []
        for a in adds:
            a["add"]["dataChange"] = data_change
        t = self.transaction().add_actions(*self._removes(touched, data_change), *adds).set_operation(info)
        return t.reading(s, [r.path for r in touched], everything).commit()

    def overwrite(self, rows: DataFrame, replace_where: P | None = None) -> int:
        s = self.snapshot()
        if replace_where is None:
            return self._change(s, s.files.collect(), self._conform(rows, s), A.write_info("Overwrite", s.metadata.partition_columns))
        touched = matching_files(s, replace_where).collect()
        rest = read_files(s, [r.path for r in touched]).where(~F.coalesce(replace_where.rows(), F.lit(False)))
        return self._change(s, touched, rest.unionByName(self._conform(rows, s)), A.write_info("Overwrite", s.metadata.partition_columns, [str(replace_where)]))

    def delete(self, where: P) -> int:
        """Rewrite the files that may have matching rows without them."""
        s = self.snapshot()
        touched = matching_files(s, where).collect()
        rest = read_files(s, [r.path for r in touched]).where(~F.coalesce(where.rows(), F.lit(False)))
        return self._change(s, touched, rest, A.write_info("Delete"))

    def update(self, where: P, **values) -> int:
        s = self.snapshot()
        touched = matching_files(s, where).collect()
        rows, hit = read_files(s, [r.path for r in touched]), F.coalesce(where.rows(), F.lit(False))
        new = {c: F.when(hit, v if not isinstance(v, (int, float, str)) else F.lit(v)).otherwise(F.col(c)).cast(s.metadata.schema[c].dataType) for c, v in values.items()}
        return self._change(s, touched, rows.withColumns(new), A.write_info("Update"))

    def merge(self, source: DataFrame, on: list[str]) -> int:
        """Upsert: source rows replace the table's rows of equal keys, others are added. Only files whose statistics allow a key of the source are rewritten.

        A key that the source has twice raises AmbiguousMerge; a key with a null matches nothing.
        """
        s = self.snapshot()
        twice = source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on)).groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").first()
        if twice:
            raise AmbiguousMerge(f"the source has {twice['_n']} rows of {[twice[k] for k in on]}")
        bounded = [k for k in on if isinstance(s.metadata.schema[k].dataType, (T.IntegralType, T.StringType, T.DateType))]
        where = None
        if bounded:
            ends = source.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(bounded) for n, f in (("a", F.min), ("b", F.max)))).first()
            for i, k in enumerate(bounded):
                if ends[f"a{i}"] is not None:
                    inside = (P(k) >= ends[f"a{i}"]) & (P(k) <= ends[f"b{i}"])
                    where = inside if where is None else where & inside
        touched = matching_files(s, where).collect()
        kept = read_files(s, [r.path for r in touched]).join(source.select(*on).distinct(), on, "left_anti")
        rows = self._conform(kept, s).unionByName(self._conform(source, s))
        return self._change(s, touched, rows, A.write_info("Merge"))

    def optimize(self, target_bytes: int = TARGET_BYTES) -> int:
        """Rewrite files below the target size into files of about that size, each partition's apart; no data changes."""
        s = self.snapshot()
        small = s.files.where(F.col("size") < target_bytes)
        parts = small.groupBy(F.to_json("partitionValues").alias("values")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
        parts = parts.where(F.col("files") > F.ceil(F.col("bytes") / target_bytes))
        touched = small.withColumn("values", F.to_json("partitionValues")).join(parts.select("values"), "values", "left_semi").drop("values").collect()
        if not touched:
            return s.version
        files = max(1, -(-sum(r.size for r in touched) // target_bytes))
        rows, columns = read_files(s, [r.path for r in touched]), s.metadata.partition_columns
        # A partition's rows meet in one task up to the target size, and in several beyond it; different partitions are dealt to as many tasks.
        rows = rows.repartition(files + len({str(r.partitionValues) for r in touched}) - 1, *columns, F.pmod(F.xxhash64(*rows.columns), F.lit(files))) if columns else rows.repartition(files)
        return self._change(s, touched, rows, A.write_info("Optimize"), data_change=False, everything=False, optimize=True)

    def restore(self, version: int) -> int:
        """Make the files of an earlier version the table's again: one commit of removes and adds."""
        s, old = self.snapshot(), self.snapshot(version)
        gone = s.files.join(old.files.select("path"), "path", "left_anti").collect()
        back = old.files.join(s.files.select("path"), "path", "left_anti").collect()
        adds = [A.add(r.path, r.size, dict(r.partitionValues or {}), r.stats, r.modificationTime) for r in back]
        changed = [old.metadata.action()] if old.metadata.action() != s.metadata.action() else []
        t = self.transaction().add_actions(*changed, *self._removes(gone), *adds).set_operation({"operation": "tarn.Restore", "operationParameters": {"version": str(version)}})
        return t.reading(s, [r.path for r in gone], True).commit()

    def remove_files(self, paths: list[str]) -> int:
        s = self.snapshot()
        files = s.files.where(F.col("path").isin(paths)).collect()
        return self._change(s, files, None, A.write_info("Delete"), everything=False)

    def vacuum(self, now: int | None = None, dry_run: bool = False) -> list[str]:
        """Delete data files that neither the last version nor a tombstone within the retention names."""
        from .checkpoint import kept_tombstones

        s = self.snapshot()
        kept = s.files.select("path").unionByName(kept_tombstones(s, now).select("path"))
        cutoff = (A.now_ms() if now is None else now) - int(s.file_retention.total_seconds() * 1000)
        old = [(quote(m.path, safe="/=-_.~ "), m.path) for m in self.store.iterate() if not m.path.startswith((f"{names.LOG}/", "_staging/")) and m.path.endswith(".parquet") and m.modified_ms <= cutoff]
        listed = self.spark.createDataFrame(old, "path string, name string")
        gone = [r.name for r in listed.join(kept, "path", "left_anti").orderBy("name").toLocalIterator()]
        for path in [] if dry_run else gone:
            try:
                self.store.delete(path)
            except ObjectDoesNotExist:
                continue
        return gone
