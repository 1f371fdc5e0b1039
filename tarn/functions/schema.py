"""Schema documents: strict validation, StructType and ordered JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from ..errors import ParseSchema

# Primitive type names of a schema document.
PRIMITIVES = ("string", "long", "integer", "short", "byte", "float", "double", "boolean", "binary", "date", "timestamp", "variant", "timestamp_ntz")
_DECIMAL = re.compile(r"decimal\(\d{1,2},\s*-?\d{1,2}\)")


def _boolean(x: object, what: str) -> bool:
    if isinstance(x, bool):
        return x
    if x in ("true", "false"):
        return x == "true"
    raise ParseSchema(f"{what} must be a boolean, not {x!r}")


def validate_type(t: object) -> object:
    """The type as StructType.fromJson wants it; ParseSchema if it isn't one."""
    if isinstance(t, str):
        if t in PRIMITIVES or _DECIMAL.fullmatch(t):
            return t
        raise ParseSchema(f"unknown type {t!r}")
    if not isinstance(t, dict):
        raise ParseSchema(f"a type must be a name or an object, not {t!r}")
    kind = t.get("type")
    if kind == "struct":
        if not isinstance(t.get("fields"), list):
            raise ParseSchema("a struct needs a list of fields")
        return {"type": "struct", "fields": [validate_field(f) for f in t["fields"]]}
    if kind == "array":
        return {"type": "array", "elementType": validate_type(t.get("elementType")), "containsNull": _boolean(t.get("containsNull"), "containsNull")}
    if kind == "map":
        return {"type": "map", "keyType": validate_type(t.get("keyType")), "valueType": validate_type(t.get("valueType")), "valueContainsNull": _boolean(t.get("valueContainsNull"), "valueContainsNull")}
    raise ParseSchema(f"unknown type {kind!r}")


def validate_field(f: object) -> dict:
    if not isinstance(f, dict):
        raise ParseSchema(f"a field must be an object, not {f!r}")
    if not isinstance(f.get("name"), str) or not f["name"]:
        raise ParseSchema("a field needs a name")
    if not isinstance(f.get("nullable"), bool):
        raise ParseSchema(f"{f['name']}: nullable must be a boolean")
    if not isinstance(f.get("metadata"), dict):
        raise ParseSchema(f"{f['name']}: metadata must be an object")
    if not f.get("type"):
        raise ParseSchema(f"{f['name']}: a field needs a type")
    return {"name": f["name"], "type": validate_type(f["type"]), "nullable": f["nullable"], "metadata": f["metadata"]}


def parse(document: str) -> T.StructType:
    try:
        raw = json.loads(document)
    except ValueError as e:
        raise ParseSchema(str(e)) from e
    checked = validate_type(raw)
    if not isinstance(checked, dict) or checked["type"] != "struct":
        raise ParseSchema("a schema must be a struct")
    return T.StructType.fromJson(checked)


def render(schema: T.StructType) -> str:
    """JSON in the protocol's order of keys."""

    def ordered(t):
        if isinstance(t, dict) and t.get("type") == "struct":
            return {"type": "struct", "fields": [{"name": f["name"], "type": ordered(f["type"]), "nullable": f["nullable"], "metadata": f["metadata"]} for f in t["fields"]]}
        if isinstance(t, dict) and t.get("type") == "array":
            return {"type": "array", "elementType": ordered(t["elementType"]), "containsNull": t["containsNull"]}
        if isinstance(t, dict) and t.get("type") == "map":
            return {"type": "map", "keyType": ordered(t["keyType"]), "valueType": ordered(t["valueType"]), "valueContainsNull": t["valueContainsNull"]}
        return t

    return json.dumps(ordered(json.loads(schema.json())), separators=(",", ":"))
