"""Many writers, one table: each appends under a file lock, now and then one writes a checkpoint.  python examples/many_writers.py [FOLDER [WRITERS]]"""

import random
import sys
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.errors import CheckpointAlreadyExists, LockNotObtained
from tarn.operators.actions import Metadata
from tarn.operators.checkpoint import create_checkpoint
from tarn.operators.table import LakeTable
from tarn.sources.coordination import FileLock, FileState
from tarn.sources.store import FileStore


def main(folder: str, writers: int = 12) -> int:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    store = FileStore(folder)
    state = FileState(store)
    LakeTable(spark, store).create(Metadata(spark.range(0).select("id", F.lit(0).alias("writer")).schema))

    def write(k: int) -> int:
        rows = random.Random(k).randint(1, 50)
        table = LakeTable(spark, store, FileLock(folder, "_commit.lock"), state)
        table.append(spark.range(rows).select("id", F.lit(k).alias("writer")))
        if random.Random(-k).random() < 0.05:
            try:
                create_checkpoint(table.snapshot(), FileLock(folder, "_checkpoint.lock", block=False))
            except (CheckpointAlreadyExists, LockNotObtained):
                pass
        return rows

    with ThreadPoolExecutor(8) as pool:
        total = sum(pool.map(write, range(writers)))
    table = LakeTable(spark, store)
    print("version", table.latest_version(), "rows", table.read().count(), "written", total)
    return table.read().count() - total


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp() + "/table", *map(int, sys.argv[2:3])))
