"""Queries of the catalogue over tables of several files and tasks."""

import re

import pytest

from tarn.operators import actions as A
from tarn.operators import table as tables
from tarn.operators.stats import file_stats
from tarn.plans import catalogue


@pytest.fixture
def made(monkeypatch):
    """The tables that queries make."""
    found, new = [], catalogue.new_table
    monkeypatch.setattr(catalogue, "new_table", lambda spark: found.append(new(spark)) or found[-1])
    return found


@pytest.fixture
def plans(spark):
    """Plans of what has run since the last call."""
    seen = set()

    def since() -> list[str]:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        fresh = [x for x in (found.apply(i) for i in range(found.size())) if x.executionId() not in seen]
        seen.update(x.executionId() for x in fresh)
        return [x.physicalPlanDescription() for x in fresh]

    since()
    return since


def put(spark, path, name: str, rows: int, tasks: int, **columns: str) -> str:
    """A table of so many rows and files; columns are SQL over id."""
    spark.range(0, rows, 1, tasks).selectExpr(*(f"{c} AS {n}" for n, c in columns.items())).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_files_of_a_compacted_table(spark, tmp_path):
    """beyond the target size a table has several files, one for each target size of its data."""
    d = put(spark, tmp_path, "orders", 4000, 4, o_orderkey="id", o_comment="sha2(string(id), 256)")
    found = catalogue.optimize_compaction(spark, d, target_bytes=100_000)
    assert found.count() == 4000 and len(found.inputFiles()) > 1
    assert [tuple(r) for r in found.select("fewer", "files").distinct().collect()] == [(True, 1)]


def test_statistics_of_slices_in_many_files(spark, tmp_path, made):
    """no task gathers a slice; its statistics are those of its files together."""
    d = put(spark, tmp_path, "lineitem", 4001, 8, l_orderkey="4000 - id", l_extendedprice="double(id)", l_tax="if(id % 5 = 0, NULL, 0.1D)")
    found = catalogue.file_stats_numeric(spark, d).orderBy("slice").collect()
    of = {k: [x for x in range(4001) if (4000 - x) % 4 == k] for k in range(4)}
    assert [tuple(r) for r in found] == [(k, len(v), 4000 - max(v), 4000 - min(v), float(min(v)), float(max(v)), sum(x % 5 == 0 for x in v)) for k, v in of.items()]
    assert made[0].snapshot().file_count() == 4 * spark.read.parquet(f"{d}/lineitem.parquet").rdd.getNumPartitions() > 4


def test_bounds_of_texts_in_many_files(spark, tmp_path, made):
    """the outermost bound of the files is the bound of all texts, cut or not."""
    x = "x" * 32
    texts = ["a", "", x[1:], x, x + "\ufffd", x + "\U0001f600", x + "\U0001f600a", x + "\U0001f600\U0001f601", x + "b", "x" * 31 + "y", "x" * 31 + "\U0001f600", "\u00e9" * 40]
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a file a task
    try:
        for n in range(1, len(texts) + 1):
            rows = spark.createDataFrame([(4 * i, t) for i, t in enumerate(texts[:n])], "doc_id long, text string")
            rows.repartition(n, "doc_id").write.parquet(f"{tmp_path}/{n}/documents.parquet")
            got = catalogue.file_stats_string_trunc(spark, f"{tmp_path}/{n}").collect()
            low, high = (f((t.encode() for t in texts[:n])).decode() for f in (min, max))
            beyond = re.match("[\ufffe-\U0010ffff]*", high[32:])[0]
            assert [tuple(r) for r in got] == [(0, low[:32], high[:32] + beyond + "\ufffd" if len(high) >= 32 else high)]
        assert made[-1].snapshot().file_count() > 1
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


LINES = {"l_orderkey": "id", "l_quantity": "double(id % 7)", "l_returnflag": "substr('ANR', id % 3 + 1, 1)", "l_linestatus": "if(id % 2 = 0, 'F', 'O')"}
EVENTS = {"event_id": "id", "ts": "timestamp_micros(id * 1234567)", "user_id": "id % 11", "event_type": "elt(1 + id % 3, 'view', 'click', 'error')"}


def test_statistics_without_a_sort(spark, tmp_path, made):
    """bounds of texts need no sort of the rows, and ranges grow in number with what is read."""
    d = put(spark, tmp_path, "lineitem", 6000, 24, **LINES)
    stats = file_stats(catalogue.lines(spark, d))
    assert "Sort" not in stats._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.numRecords for r in stats.collect()) == [250] * 24
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # two files a task
    try:
        row = catalogue.data_skipping(spark, d).first()
        tasks = catalogue.lines(spark, d).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tuple(row) == (400, float(sum(x % 7 for x in range(100, 500))), True)
    assert made[0].snapshot().file_count() == 2 * tasks > 8


def written(plans: list[str]) -> list[str]:
    return [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p]


def test_more_partitions_than_open_files(spark, tmp_path, plans):
    """files of few partitions are open at once and no rows sorted; of more partitions, the rest is sorted by the task, and no row is lost."""
    n = 3 * tables.OPEN_FILES
    rows = spark.range(0, 5000, 1, 2).selectExpr("id", f"id % {n} AS p")
    t = tables.LakeTable(spark, str(tmp_path / "t")).create(A.Metadata(rows.schema, ["p"]))
    t.append(rows)
    assert written(plans()) and sorted(tuple(r) for r in t.read().collect()) == [(x, x % n) for x in range(5000)]
    assert t.snapshot().file_count() == 2 * n and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def unsorted(spark, plans, query, d: str) -> list:
    plans()
    rows = [tuple(r) for r in query(spark, d).collect()]
    seen = written(plans())
    assert seen and not any(re.search(r"\bSort\b", p) for p in seen)
    return rows


def test_nulls_of_slices(spark, tmp_path, plans):
    """the writing of slices sorts nothing."""
    d = put(spark, tmp_path, "events", 4000, 4, **EVENTS)
    of = {k: [x for x in range(4000) if x % 4 == k] for k in range(4)}
    assert sorted(unsorted(spark, plans, catalogue.file_stats_nulls, d)) == [(k, 1000, sum(x % 3 == 1 for x in v)) for k, v in of.items()]


def test_times_of_slices(spark, tmp_path, plans):
    """nor with bounds of times, cut to milliseconds, of several files."""
    d = put(spark, tmp_path, "events", 40, 4, **EVENTS)
    found = sorted(unsorted(spark, plans, catalogue.file_stats_timestamp_ms, d))
    assert found == [(k, *(f"1970-01-01T00:00:{us // 1_000_000:02d}.{us // 1000 % 1000:03d}Z" for us in (k * 1234567, (36 + k) * 1234567))) for k in range(4)]


def test_commit_info(spark, tmp_path, plans):
    """nor does the writing of a partitioned table whose commit is read."""
    d = put(spark, tmp_path, "lineitem", 600, 4, **LINES)
    assert unsorted(spark, plans, catalogue.commit_info_json, d) == [("tarn.Write", "Append", '["l_returnflag"]', "[]")]


def test_pruned_partition(spark, tmp_path, plans):
    """F8: nor of one that is read by partition."""
    d = put(spark, tmp_path, "lineitem", 600, 4, **LINES)
    of = [[x % 7 for x in range(600) if x % 3 == 2 and x % 2 == k] for k in (0, 1)]
    assert sorted(unsorted(spark, plans, catalogue.partition_prune, d)) == [(s, 100, float(sum(v)), "R") for s, v in zip("FO", of)]


def test_tombstones(spark, tmp_path, plans):
    """nor of one whose files are removed."""
    d = put(spark, tmp_path, "lineitem", 600, 4, **LINES)
    assert sorted(unsorted(spark, plans, catalogue.tombstone_list, d)) == [("A", 200), ("N", 200)]


def test_partitions_compacted_apart(spark, tmp_path, plans, made):
    """nor of values that need escapes, and partitions below the target size don't all meet in one task."""
    d = put(spark, tmp_path, "events", 900, 4, **EVENTS | {"user_id": "id DIV 3 % 3"})
    plans()
    found = catalogue.partition_escapes(spark, d)
    seen = written(plans())
    assert len(seen) == 3 and not any(re.search(r"\bSort\b|SinglePartition", p) for p in seen)
    assert sorted(tuple(r) for r in found.collect()) == [(x, f"{('view', 'click', 'error')[x % 3]}/a=b c%2F{x // 3 % 3}") for x in range(900)]
    assert made[0].snapshot().file_count() == 9
