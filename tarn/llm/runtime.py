"""Session plumbing shared by the operators: code shipping, shared scratch tables, sizes."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_GAVE_BACK: dict[str, float] = {}
#: Seconds between two calls of give_back() that collect.
COLLECT_S = 15
#: Most words of 64 bits in a Bitmap: 8 MB.
MOST_WORDS = 1 << 20
#: Bytes of rows that a Python worker is handed at once, where the session doesn't say.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, target = os.path.dirname(package), os.path.join(tempfile.mkdtemp(), "tarn_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def give_back(spark: SparkSession, every: float = COLLECT_S) -> None:
    """Executors collect their garbage and hand the heap that is free then back to the system; not more often than `every` seconds.

    A heap that one step has blown up would stand, empty, beside the next step's Python workers. A task for each core: all executors get some.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _GAVE_BACK.get(app, -every) < every:
        return
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where(F.java_method(F.lit("java.lang.System"), F.lit("gc")) == "").write.format("noop").mode("overwrite").save()
    _GAVE_BACK[app] = time.monotonic()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where it is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tarn-scratch-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        give_back(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a Parquet table and read it back. Nothing reads the shuffles behind it again: the driver lets go of them, so that executors delete their files."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.java.lang.System.gc()
        give_back(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Free a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Bitmap:
    """A set of ids that may hold too many, never too few: 256 bits or more an id, within 8 MB. Beyond a few million ids it holds
    back less, and what stands behind it gets more rows; results are the same.
    """

    def __init__(self, ids: DataFrame, column: str):
        place = F.pmod(F.xxhash64(column), F.lit(MOST_WORDS * 64))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        rows = ids.select(F.call_function("shiftrightunsigned", place, F.lit(6)).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.size = min(MOST_WORDS, max(64, 1 << (4 * len(rows)).bit_length()))
        words = np.zeros(self.size, np.int64)
        np.bitwise_or.at(words, rows.w.to_numpy(np.int64) % self.size, rows.b.to_numpy(np.int64))
        self.row = ids.sparkSession.createDataFrame(pa.table({"words": pa.array([words], pa.list_(pa.int64()))}))

    def has(self, column: str) -> Column:
        """Whether an id may be in the set; evaluated where the row is."""
        place = F.pmod(F.xxhash64(column), F.lit(self.size * 64))
        return F.getbit(F.get(self.row.scalar(), F.call_function("shiftrightunsigned", place, F.lit(6)).cast("int")), (place % 64).cast("int")) == 1


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of the rows at the most, chosen by a hash of the key: what goes to the driver is bounded before it is sent."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(97)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession, least: int = 0) -> int:
    """Partitions for Python stages behind a shuffle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least, 1)
