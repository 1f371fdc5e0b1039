"""A table from nothing: create, append, change, look back.  python examples/simple.py [FOLDER]"""

import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.operators.actions import Metadata
from tarn.operators.checkpoint import create_checkpoint
from tarn.operators.snapshot import history
from tarn.operators.stats import P
from tarn.operators.table import LakeTable


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    rows = spark.range(1000).select("id", F.uuid().alias("label"), F.rand(3).alias("value"), F.when(F.col("id") % 2 == 0, F.rand(4)).alias("other"))
    table = LakeTable(spark, folder).create(Metadata(rows.schema))
    for part in rows.randomSplit([1.0, 1.0, 1.0], seed=1):
        table.append(part)
    table.delete(P("id") < 100)
    create_checkpoint(table.snapshot())
    print("rows now", table.read().count(), "and after the first append", table.read(version=1).count())
    history(spark, table.store).orderBy("version").show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp() + "/table")
