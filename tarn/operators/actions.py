"""Log records: their schema, JSON lines, commit information."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ActionJSONFormat, ActionUnknown, CDCNotSupported
from ..functions import schema as S

CLIENT, CLIENT_VERSION = "tarn", "tarn.0.1"
READER_VERSION, WRITER_VERSION = 1, 2
# Save modes of writes; other changes go by their own name.
SAVE_MODES = ("Append", "Overwrite", "ErrorIfExists", "Ignore")

_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "map": T.MapType(T.StringType(), T.StringType()), "list": T.ArrayType(T.StringType())}


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k] if isinstance(k, str) else k) for n, k in fields.items()])


LOG_SCHEMA = _struct(
    txn=_struct(appId="s", version="l", lastUpdated="l"),
    add=_struct(path="s", partitionValues="map", size="l", modificationTime="l", dataChange="b", tags="map", stats="s"),
    remove=_struct(path="s", deletionTimestamp="l", dataChange="b", extendedFileMetadata="b", partitionValues="map", size="l", tags="map"),
    metaData=_struct(id="s", name="s", description="s", format=_struct(provider="s", options="map"), schemaString="s", partitionColumns="list", configuration="map", createdTime="l"),
    protocol=_struct(minReaderVersion="i", minWriterVersion="i", readerFeatures="list", writerFeatures="list"),
)
KINDS = tuple(LOG_SCHEMA.fieldNames())
#: In the order in which a record's one key is looked for.
KNOWN = ("add", "remove", "commitInfo", "protocol", "metaData", "format", "txn")


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def add(path: str, size: int, partition_values: dict | None = None, stats: str = "", modified: int | None = None, data_change: bool = True, tags: dict | None = None) -> dict:
    body = {"path": path, "partitionValues": partition_values or {}, "size": size, "modificationTime": now_ms() if modified is None else modified, "dataChange": data_change, "stats": stats}
    return {"add": body | ({"tags": tags} if tags else {})}


def remove(path: str, size: int | None = None, partition_values: dict | None = None, deleted: int | None = None, data_change: bool = True, extended: bool = True) -> dict:
    return {"remove": {"path": path, "deletionTimestamp": now_ms() if deleted is None else deleted, "dataChange": data_change, "extendedFileMetadata": extended, "partitionValues": partition_values or {}, "size": size}}


def txn(app: str, version: int) -> dict:
    return {"txn": {"appId": app, "version": version, "lastUpdated": now_ms()}}


def protocol(reader: int = 1, writer: int = 1, reader_features: list | None = None, writer_features: list | None = None) -> dict:
    body = {"minReaderVersion": reader, "minWriterVersion": writer}
    return {"protocol": body | ({"readerFeatures": reader_features} if reader_features else {}) | ({"writerFeatures": writer_features} if writer_features else {})}


@dataclass
class Metadata:
    """A table's metadata in the user's form."""

    schema: T.StructType
    partition_columns: list[str] = field(default_factory=list)
    configuration: dict[str, str] = field(default_factory=dict)
    name: str = ""
    description: str = ""
    provider: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created: int = field(default_factory=now_ms)

    def action(self) -> dict:
        return {"metaData": {"id": self.id, "name": self.name, "description": self.description, "format": {"provider": self.provider, "options": self.options}, "schemaString": S.render(self.schema), "partitionColumns": self.partition_columns, "configuration": self.configuration, "createdTime": self.created}}

    @staticmethod
    def from_action(m: dict) -> Metadata:
        f = m.get("format") or {}
        return Metadata(S.parse(m["schemaString"]), list(m.get("partitionColumns") or []), dict(m.get("configuration") or {}), m.get("name") or "", m.get("description") or "", f.get("provider") or "parquet", dict(f.get("options") or {}), m.get("id") or "", m.get("createdTime") or 0)


def create_info(metadata: Metadata, mode: str = "ErrorIfExists") -> dict:
    return {"operation": f"{CLIENT}.Create", "operationParameters": {"mode": mode, "metaData": json.dumps(metadata.action()["metaData"]), "location": ""}}


def write_info(mode: str = "Append", partition_by: list[str] | None = None, predicate: list[str] | None = None) -> dict:
    """Lists stand as JSON texts, '[]' for none."""
    text = lambda x: json.dumps(x or [], separators=(",", ":"))
    name = "Write" if mode in SAVE_MODES else mode
    return {"operation": f"{CLIENT}.{name}", "operationParameters": {"mode": mode, "partitionBy": text(partition_by), "predicate": text(predicate)}}


def streaming_info(mode: str, query: str, epoch: int) -> dict:
    return {"operation": f"{CLIENT}.StreamingUpdate", "operationParameters": {"outputMode": mode, "queryId": query, "epochId": str(epoch)}}


def encode(actions: list[dict]) -> str:
    """JSON lines without a last newline."""
    return "\n".join(json.dumps(a, separators=(",", ":"), ensure_ascii=False) for a in actions)


def decode_line(line: str) -> dict:
    try:
        record = json.loads(line)
    except ValueError as e:
        raise ActionJSONFormat(line[:200]) from e
    if not isinstance(record, dict) or len(record) != 1:
        raise ActionJSONFormat(f"one key is needed: {line[:200]}")
    key = next(iter(record))
    if key == "cdc":
        raise CDCNotSupported(line[:200])
    if key not in KNOWN:
        raise ActionUnknown(key)
    return record


def decode(text: str) -> list[dict]:
    return [decode_line(x) for x in text.split("\n") if x]


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with LOG_SCHEMA's columns; a line that isn't one known record raises when it is read."""
    keys = F.json_object_keys(value)
    fine = (F.size(keys) == 1) & F.get(keys, F.lit(0)).isin(*KNOWN)
    record: Column = F.from_json(value, LOG_SCHEMA)
    checked = F.when(fine, record).otherwise(F.raise_error(F.concat(F.lit("unknown log record: "), F.substring(value, 1, 200))).cast(LOG_SCHEMA))
    return lines.where(F.length(value) > 0).withColumn("_r", checked).select(*(c for c in lines.columns if c != value), "_r.*")
