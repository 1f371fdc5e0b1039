"""Connected components by alternating large-star and small-star steps.

Nothing is collected; a hub's edges are never gathered, only their minimum. Each step is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every vertex of edges (a, b) that isn't its component's smallest; component: the smallest id."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(e, f"{name}-0")
    state, step = _state(e), 0
    while state[0]:
        step += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.table(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
