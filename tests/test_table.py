import json
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import errors as E
from tarn.functions import names
from tarn.operators import actions as A
from tarn.operators import checkpoint as C
from tarn.operators import table as T_
from tarn.operators.actions import KINDS, LOG_SCHEMA
from tarn.operators.snapshot import Listing, Snapshot, checkpoint_exists, recent
from tarn.operators.stats import P
from tarn.operators.table import LakeTable
from tarn.sources.coordination import FileLock, FileLogStore, FileState, MemoryLogStore
from tarn.sources.keyvalue import CacheLock, CacheState, MemoryCache, MemoryTable, TableLock, TableLogStore, TableState
from tarn.sources.store import FaultyStore, FileStore, HadoopStore

ONE = T.StructType([T.StructField("x", T.LongType())])


@pytest.fixture
def table(spark, tmp_path):
    return LakeTable(spark, str(tmp_path / "t")).create(A.Metadata(ONE))


def commit(table, *actions):
    return table.transaction().add_actions(*actions).commit()


def test_log_of_plain_lines(spark, tmp_path):
    """A log as another writer may leave it: lines with keys in any order, no stats, no data files."""
    log = tmp_path / names.LOG
    log.mkdir()
    fields = [{"name": n, "type": k, "nullable": True, "metadata": {}} for n, k in (("v", "string"), ("day", "string"))]
    meta = {"id": "x", "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": ["day"], "configuration": {}, "createdTime": 1}
    (log / names.commit_name(0)).write_text("\n".join(json.dumps(x) for x in ({"commitInfo": {"timestamp": 1}}, {"protocol": {"minWriterVersion": 1, "minReaderVersion": 1}}, {"metaData": meta})))
    for v in range(1, 13):
        add = {"size": 9, "path": f"day=d{v}/f.parquet", "partitionValues": {"day": f"d{v}"}, "modificationTime": v, "dataChange": True}
        (log / names.commit_name(v)).write_text(json.dumps({"add": add}) + "\n" + json.dumps({"commitInfo": {"timestamp": v}}))
    store = FileStore(str(tmp_path))
    s = Snapshot(spark, store, 2)
    assert (s.file_count(), s.protocol["minReaderVersion"], s.metadata.partition_columns) == (2, 1, ["day"])
    assert Listing(store).latest() == 12
    with pytest.raises(E.InvalidVersion):
        Snapshot(spark, store, 20)
    C.create_checkpoint(Snapshot(spark, store, 10), cleanup=False)
    assert recent(store).since == 10 and sorted(recent(store).commits) == [10, 11, 12]
    assert Snapshot(spark, store).file_count() == 12
    store.put(f"{names.LOG}/{names.HINT}", b"no json")
    assert recent(store).since == 0 and Snapshot(spark, store).file_count() == 12


def test_spoilt_checkpoints(spark, table):
    """A part without rows, or a row with several records, is no checkpoint: earlier states serve, or the error shows."""
    commit(table, A.add("a", 1))
    C.create_checkpoint(table.snapshot())
    name = f"{names.LOG}/{names.checkpoint_names(1, 1)[0]}"
    table.store.put("whole/part.parquet", table.store.get(name))
    rows = spark.read.schema(LOG_SCHEMA).parquet(table.store.uri("whole"))
    both = rows.agg(*(F.first(k, True).alias(k) for k in KINDS))
    for spoilt, error in ((rows.limit(0), E.CheckpointIncomplete), (both, E.CheckpointEntryMultipleActions)):
        spoilt.coalesce(1).write.mode("overwrite").parquet(table.store.uri("_other"))
        part = next(m.path for m in table.store.list("_other/") if m.path.endswith(".parquet"))
        table.store.put(name, table.store.get(part))
        assert table.snapshot().file_count() == 1
        first = table.store.get(f"{names.LOG}/{names.commit_name(0)}")
        table.store.delete(f"{names.LOG}/{names.commit_name(0)}")
        with pytest.raises(error):
            table.snapshot()
        table.store.put(f"{names.LOG}/{names.commit_name(0)}", first)


def test_appends_replay_once(spark, table, monkeypatch):
    seen = []
    monkeypatch.setattr(T_, "Snapshot", lambda *a, **b: seen.append(1) or Snapshot(*a, **b))
    for _ in range(3):
        table.append(spark.range(2).select(F.col("id").alias("x")))
    assert len(seen) == 1
    LakeTable(spark, table.store).append(spark.range(2).select(F.col("id").alias("x")))
    table.append(spark.range(2).select(F.col("id").alias("x")))  # another writer has been there
    assert len(seen) == 3 and table.read().count() == 10


def test_partition_values_and_session(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        t = LakeTable(spark, str(tmp_path / "t"))
        rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS at, id AS _p, concat('a/b %2F=', id) AS v FROM range(4)")
        t.save(rows, partition_columns=["_p", "v"])
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert sorted(map(tuple, t.read().select("at", "_p", "v").collect())) == sorted(map(tuple, rows.collect()))
        t.delete(P("_p") == 1)
        gone = t.vacuum(now=A.now_ms() + 8 * 86_400_000)
        assert len(gone) == 1 and gone[0].startswith("_p=1/") and t.read().count() == 3
        t.overwrite(rows.where("_p = 2"), (P("_p") == 2) | (P("v") == "x'y"))
        assert "(_p = 2) OR (v = 'x''y')" in t.store.get(f"{names.LOG}/{names.commit_name(t.latest_version())}").decode()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_merge_rewrites_only_files_in_reach(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path)).create(A.Metadata(ONE))
    for k in range(3):
        t.append(spark.range(10 * k, 10 * k + 10).coalesce(1).select(F.col("id").alias("x")))
    before = {r.path for r in t.snapshot().files.collect()}
    t.merge(spark.createDataFrame([(12,), (13,)], "x long"), ["x"])
    assert len(before - {r.path for r in t.snapshot().files.collect()}) == 1
    assert sorted(r.x for r in t.read().collect()) == list(range(30))


def test_hadoop_store(spark, tmp_path):
    """The file system's client for a local folder, by a scheme that os doesn't know."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./in", f"file://{tmp_path}")
    t = LakeTable(spark, "viewfs://lake/in/t")
    assert isinstance(t.store, HadoopStore) and not t.exists()
    t.create(A.Metadata(ONE))
    with pytest.raises(E.ObjectAlreadyExists):
        t.create(A.Metadata(ONE))
    for _ in range(2):
        t.append(spark.range(5).select(F.col("id").alias("x")))
    C.create_checkpoint(t.snapshot())
    t.append(spark.range(5).select(F.col("id").alias("x")))
    assert t.read().count() == 15 and t.latest_version() == 3
    t.store.put("k/a", b"0123456789")
    t.store.put("k/a", b"abcdefghij")
    assert t.store.read_at("k/a", 2, 3) == b"cde" and t.store.head("k/a").size == 10
    assert [m.path for m in t.store.list("k/")] == ["k/a"]
    t.store.rename("k/a", "k/b")
    with pytest.raises(E.ObjectDoesNotExist):
        t.store.get("k/a")
    t.store.delete("k/b")
    with pytest.raises(E.ObjectDoesNotExist):
        t.store.delete("k/b")


def test_replay_equals_a_fold(table):
    """Random adds and removes against a plain fold of them."""
    rng, files, dead = random.Random(5), {}, {}
    for v in range(1, 9):
        acts = []
        for _ in range(rng.randint(1, 6)):
            p = f"f{rng.randint(0, 6)}"
            acts.append(A.add(p, v, modified=v) if rng.random() < 0.6 else A.remove(p, v, deleted=v))
        commit(table, *acts)
        for a in acts:
            if "remove" in a:
                files.pop(a["remove"]["path"], None)
                dead[a["remove"]["path"]] = v
        for a in acts:
            if "add" in a:
                dead.pop(a["add"]["path"], None)
                files[a["add"]["path"]] = v
        if v == 4:
            C.create_checkpoint(table.snapshot(), max_rows=3)
    s = table.snapshot()
    assert {r.path: r.size for r in s.files.collect()} == files
    assert {r.path for r in s.tombstones.collect()} == set(dead)


def test_unknown_record_stops_replay(table):
    table.store.put(f"{names.LOG}/{names.commit_name(1)}", b'{"what":{}}')
    with pytest.raises(Exception, match="unknown log record"):
        table.snapshot()


def test_protocol_too_high(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path))
    with pytest.raises(E.ProtocolTooHigh):
        t.create(A.Metadata(ONE), A.protocol(3, 7))
    with pytest.raises(E.ProtocolTooHigh):
        t.snapshot()
    assert t.snapshot(unsafe=True).version == 0


def test_checkpoint_parts_and_fallback(table):
    commit(table, *(A.add(f"a{i}", 1) for i in range(10)))
    commit(table, A.remove("a0"), A.txn("app", 3))
    info = C.create_checkpoint(table.snapshot(), max_rows=5)
    assert (info["size"], info["parts"], info["numOfAddFiles"]) == (13, 3, 9)
    with pytest.raises(E.CheckpointAlreadyExists):
        C.create_checkpoint(table.snapshot())
    table.store.delete(f"{names.LOG}/{names.commit_name(1)}")
    s = table.snapshot()
    assert (s.file_count(), s.tombstone_count(), s.app_version("app")) == (9, 1, 3)
    assert not any(r.dataChange for r in s.files.collect())
    table.store.delete(f"{names.LOG}/{names.checkpoint_names(2, 3)[1]}")
    with pytest.raises(E.CheckpointIncomplete):
        checkpoint_exists(table.store, 2)
    with pytest.raises(E.UnableToLoadVersion):
        table.snapshot(2)


def test_tombstone_retention_and_cleanup(spark, tmp_path):
    conf = {"delta.deletedFileRetentionDuration": "interval 1 minute", "delta.logRetentionDuration": "interval 10 minutes", "delta.enableExpiredLogCleanup": "true"}
    t = LakeTable(spark, str(tmp_path)).create(A.Metadata(ONE, configuration=conf))
    now = A.now_ms()
    commit(t, A.add("a", 1), A.add("b", 1))
    commit(t, A.remove("a", deleted=now - 300_000), A.remove("b", deleted=now))
    assert {r.path for r in C.kept_tombstones(t.snapshot(), now).collect()} == {"b"}
    C.create_checkpoint(t.snapshot(), now=now + 3_600_000)
    assert sorted(Listing(t.store).commits) == [2]
    assert t.snapshot().file_count() == 0


def test_catalogue_queries_use_the_engine(spark, tmp_path, monkeypatch):
    from tarn.plans import catalogue

    rows = [(1, 7, "2024-01-14 23:59:59"), (2, 7, "2024-01-15 00:00:00"), (3, 7, "2024-01-15 00:00:00.000001"), (4, 8, "2024-01-16 00:00:00"), (5, 8, "2024-01-16 00:00:00"), (6, 8, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    ids = lambda q: sorted(r.event_id for r in catalogue.QUERIES[q](spark, str(tmp_path)).collect())
    assert ids("retention_filter") == [3, 4, 5] and ids("log_replay_events") == [3, 5]
    from tarn.operators import snapshot

    assert catalogue.newest is snapshot.newest  # and a fault of either shows
    monkeypatch.setattr(C, "retained", lambda time, cutoff: time < cutoff)
    monkeypatch.setattr(catalogue, "newest", lambda rows, key, *order: rows.limit(0))
    assert ids("retention_filter") == [1, 6] and ids("log_replay_events") == []


@pytest.mark.parametrize("kind", ["file", "table", "cache"])
def test_concurrent_writers(spark, tmp_path, kind):
    LakeTable(spark, str(tmp_path)).create(A.Metadata(ONE))
    store = FileStore(str(tmp_path))
    rows, cache = MemoryTable(), MemoryCache()
    state = {"file": lambda: FileState(store), "table": lambda: TableState(rows, "states", "t"), "cache": lambda: CacheState(cache, "t")}[kind]()
    lock = {"file": lambda: FileLock(str(tmp_path), "_commit.lock"), "table": lambda: TableLock(rows, "locks", "t", pause=0.01), "cache": lambda: CacheLock(cache, "lock", pause=0.01)}[kind]

    def write(i):
        t = LakeTable(spark, str(tmp_path), lock(), state)
        for k in range(5):
            commit(t, A.add(f"{i}-{k}", 1))

    ts = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [x.start() for x in ts], [x.join() for x in ts]
    assert Listing(store).latest() == 40


@pytest.mark.parametrize("kind", ["memory", "file", "table"])
def test_log_store_repairs(spark, tmp_path, kind):
    store = FaultyStore(str(tmp_path / "t"))
    log = {"memory": MemoryLogStore, "file": lambda: FileLogStore(str(tmp_path / "kv")), "table": lambda: TableLogStore(MemoryTable(), "log")}[kind]()
    t = LakeTable(spark, store).create(A.Metadata(ONE))
    t.transaction().add_actions(A.add("a", 1)).commit_with_log_store(log)
    store.fail_copy = True
    with pytest.raises(E.CopyObject):
        t.transaction().add_actions(A.add("b", 1)).commit_with_log_store(log)
    store.fail_copy = False
    assert not log.latest(store.uri()).complete
    assert t.transaction().add_actions(A.add("c", 1)).commit_with_log_store(log) == 3
    assert {r.path for r in t.snapshot().files.collect()} == {"a", "b", "c"}


def test_changes_and_conflicts(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path)).create(A.Metadata(T.StructType([T.StructField("k", T.LongType()), T.StructField("p", T.StringType())]), ["p"]))
    t.append(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("p")))
    assert t.snapshot().row_count() == 100
    t.delete(P("k") < 10)
    t.update(P("p") == "1", p="9")
    assert t.read(where=P("p") == "9").count() == 30
    assert t.read(1).count() == 100
    s = t.snapshot()
    t.append(spark.createDataFrame([(1, "0")], "k long, p string"))
    with pytest.raises(E.ConcurrentModification):
        t.transaction().reading(s, [], True).commit()


def test_register_refuses(spark, table):
    table.store.put("none.parquet", b"")
    table.store.put("spoilt.parquet", b"no parquet")
    with pytest.raises(E.AddZeroSize):
        table.register(["none.parquet"])
    with pytest.raises(E.AddGenerateStats):
        table.register(["spoilt.parquet"])
    with pytest.raises(E.ObjectDoesNotExist):
        table.register(["absent.parquet"])
    assert table.latest_version() == 0


def test_objects_as_files(tmp_path):
    store = FileStore(str(tmp_path))
    with store.writer("a/b") as f:
        f.write(b"0123456789")
    with store.open("a/b") as f:
        assert f.read(3) == b"012" and f.seek(-2, 2) == 8 and f.read() == b"89" and f.read() == b""
        f.seek(1)
        assert f.read(2) == b"12" and f.tell() == 3
    with pytest.raises(RuntimeError), store.writer("a/c"):
        raise RuntimeError
    assert [m.path for m in store.list("a/")] == ["a/b"] and store.ordered
    with pytest.raises(E.ObjectDoesNotExist):
        store.open("a/c")


def test_leases_end(tmp_path):
    """A holder that hangs loses its lock; it can't take away the next one's."""
    now = [100.0]
    rows, cache = MemoryTable(), MemoryCache(lambda: now[0])
    for make in (lambda: TableLock(rows, "locks", "k", 60, 2, 0, lambda: now[0]), lambda: CacheLock(cache, "k", 60, 2, 0)):
        one, two = make(), make()
        assert one.try_lock() and not two.try_lock() and one.sibling("other").try_lock()
        now[0] += 61
        assert two.try_lock()
        with pytest.raises(E.UnableToUnlock):
            one.unlock()
        two.unlock()
        with pytest.raises(E.LockNotObtained), make(), make():
            pass
        now[0] += 61
    one, two = FileLock(str(tmp_path), "k", lease=0.2), FileLock(str(tmp_path), "k")
    assert one.try_lock() and two.try_lock()  # the second waits for the lease
    with pytest.raises(E.UnableToUnlock):
        one.unlock()
    two.unlock()
    assert TableState(rows, "states", "new").get() == CacheState(cache, "new").get() == -1
    cache.set("new", "x")
    with pytest.raises(E.StateUnreadable):
        CacheState(cache, "new").get()


def test_append_only(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path)).create(A.Metadata(ONE, configuration={"delta.appendOnly": "true"}))
    t.append(spark.range(3).select(F.col("id").alias("x")))
    with pytest.raises(E.AppendOnly):
        t.delete(P("x") == 1)
