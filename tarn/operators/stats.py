"""Statistics of data files, and what they let a scan skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bounds import bound


def file_stats(rows: DataFrame, partition_columns: list[str] | None = None, by: list[Column] | None = None) -> DataFrame:
    """path (or `by`), numRecords and stats (JSON) of each file of a Parquet scan: one aggregate, partial before the shuffle."""
    data = [f for f in rows.schema.fields if f.name not in (partition_columns or [])]
    low, high, nulls = [], [], []
    counts = [F.count("*").alias("numRecords")]
    for i, f in enumerate(data):
        c = F.col(f"`{f.name}`")
        counts.append(F.count_if(c.isNull()).alias(f"n{i}"))
        for name, largest, into in (("a", False, low), ("b", True, high)):
            x = bound(c, f.dataType, largest)
            if x is not None:
                counts.append(x.alias(f"{name}{i}"))
                into.append(F.col(f"{name}{i}").alias(f.name))
        nulls.append(F.col(f"n{i}").alias(f.name))
    keys = by or [F.col("_metadata.file_path").alias("path")]
    out = rows.groupBy(*keys)
    if any(isinstance(f.dataType, T.StringType) for f in data):
        # Spark sorts all rows by file for bounds of texts, unless an aggregate of objects, here of none, stands beside them: then files are kept in a hash table.
        out = out.agg(*counts, F.size(F.collect_list(F.lit(None).cast("int"))).alias("objects")).where("objects = 0").drop("objects")
    else:
        out = out.agg(*counts)
    none = F.create_map().cast("map<string,string>")
    part = lambda cols: F.struct(*cols) if cols else none
    body = F.struct("numRecords", F.lit(False).alias("tightBounds"), part(low).alias("minValues"), part(high).alias("maxValues"), part(nulls).alias("nullCount"))
    return out.select(*[c for c in out.columns if c == "path" or by and not (c == "numRecords" or c[0] in "abn" and c[1:].isdigit())], "numRecords", F.to_json(body).alias("stats"))


def stats_schema(schema: T.StructType, partition_columns: list[str]) -> T.StructType:
    data = [f for f in schema.fields if f.name not in partition_columns]
    bounded = [f for f in data if bound(F.lit(None), f.dataType, False) is not None]
    # Numbers come back as texts too: infinities and NaN are texts in JSON.
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in bounded])
    return T.StructType([T.StructField("numRecords", T.LongType()), T.StructField("minValues", texts), T.StructField("maxValues", texts), T.StructField("nullCount", T.StructType([T.StructField(f.name, T.LongType()) for f in data]))])


class P:
    """A predicate that can be a row filter and a file filter: P("x") >= 3, combined by & and |."""

    def __init__(self, column: str, op: str = "", value=None, parts: tuple = ()):
        self.column, self.op, self.value, self.parts = column, op, value, parts

    def __eq__(self, v):  # noqa: D105
        return P(self.column, "=", v)

    def __lt__(self, v):
        return P(self.column, "<", v)

    def __le__(self, v):
        return P(self.column, "<=", v)

    def __gt__(self, v):
        return P(self.column, ">", v)

    def __ge__(self, v):
        return P(self.column, ">=", v)

    __hash__ = None

    def isin(self, *v):
        return P(self.column, "in", v)

    def is_null(self):
        return P(self.column, "null")

    def __and__(self, o):
        return P("", "and", parts=(self, o))

    def __or__(self, o):
        return P("", "or", parts=(self, o))

    def rows(self) -> Column:
        c = F.col(f"`{self.column}`") if self.column else None
        if self.op in ("and", "or"):
            a, b = (p.rows() for p in self.parts)
            return a & b if self.op == "and" else a | b
        v = F.lit(self.value) if self.op not in ("in", "null") else None
        return {"=": lambda: c == v, "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v, "in": lambda: c.isin(*self.value), "null": lambda: c.isNull()}[self.op]()

    def __str__(self) -> str:
        if self.op in ("and", "or"):
            return f" {self.op.upper()} ".join(f"({p})" for p in self.parts)
        if self.op == "null":
            return f"{self.column} IS NULL"
        shown = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
        return f"{self.column} IN ({', '.join(map(shown, self.value))})" if self.op == "in" else f"{self.column} {self.op} {shown(self.value)}"

    def columns(self) -> set[str]:
        return {self.column} if self.column else set().union(*(p.columns() for p in self.parts))

    def files(self, schema: T.StructType, partition_columns: list[str]) -> Column:
        """True or null for every file that may have a matching row. Expects columns partitionValues and s (parsed stats)."""
        if self.op in ("and", "or"):
            a, b = (p.files(schema, partition_columns) for p in self.parts)
            return a & b if self.op == "and" else a | b
        kind = schema[self.column].dataType
        if self.column in partition_columns:
            value = F.col("partitionValues")[self.column].cast(kind)
            v = F.lit(self.value) if self.op not in ("in", "null") else None
            return {"=": lambda: value == v, "<": lambda: value < v, "<=": lambda: value <= v, ">": lambda: value > v, ">=": lambda: value >= v, "in": lambda: value.isin(*self.value), "null": lambda: value.isNull()}[self.op]()
        if bound(F.lit(None), kind, False) is None:
            return F.lit(True)
        if self.op == "null":
            return F.coalesce(F.col("s.nullCount")[self.column] > 0, F.lit(True))
        low, high = (F.col(f"s.{side}")[self.column] for side in ("minValues", "maxValues"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            # Bounds are cut to milliseconds: the largest may be up to one more.
            low, high = (F.to_timestamp(F.rtrim(F.regexp_replace(x, "[TZ]", " "))).cast(kind) for x in (low, high))
            high = high + F.expr("interval 1 millisecond")
        elif not isinstance(kind, T.StringType):
            nan = F.lower(low).isin("nan") | F.lower(high).isin("nan")
            low, high = (F.when(~nan, x.try_cast(kind)) for x in (low, high))
        v = None if self.op == "in" else F.lit(self.value)
        inside = lambda x: (low <= x) & (high >= x)
        found = {"=": lambda: inside(v), "<": lambda: low < v, "<=": lambda: low <= v, ">": lambda: high > v, ">=": lambda: high >= v, "in": lambda: F.exists(F.array(*map(F.lit, self.value)), inside)}[self.op]()
        some = F.coalesce(F.col("s.nullCount")[self.column] < F.col("s.numRecords"), F.lit(True))
        return F.coalesce(found, F.lit(True)) & some
