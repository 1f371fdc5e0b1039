import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import ActionJSONFormat, ActionUnknown, CDCNotSupported, ConfigValidation, ParseSchema
from tarn.functions import bounds, names, schema, settings
from tarn.operators import actions as A


def test_names():
    assert names.commit_name(7) == "00000000000000000007.json"
    assert names.version_of("_delta_log/00000000000000000007.json") == 7
    assert names.version_of("0000007.json") is None
    assert names.checkpoint_of("00000000000000000010.checkpoint.0000000002.0000000003.parquet") == (10, 2, 3)
    assert names.checkpoint_of("00000000000000000010.checkpoint.parquet") == (10, 1, 1)
    assert names.checkpoint_names(1, 2)[1] == "00000000000000000001.checkpoint.0000000002.0000000002.parquet"


@pytest.mark.parametrize(("text", "want"), [("interval 2 weeks", timedelta(weeks=2)), ("1 day 2 HOURS", timedelta(days=1, hours=2)), ("-3 minutes", timedelta(minutes=-3)), ("interval 1 month", timedelta(days=31)), ("2 years", timedelta(days=730))])
def test_interval(text, want):
    assert settings.parse_interval(text) == want


@pytest.mark.parametrize("text", ["", "interval", "1", "1 fortnight", "1.5 days", "1 day 2"])
def test_interval_rejects(text):
    with pytest.raises(ConfigValidation):
        settings.parse_interval(text)


def test_schema_round_trip_and_order():
    s = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.ArrayType(T.LongType()))]), False), T.StructField("m", T.MapType(T.StringType(), T.DecimalType(5, 2)))])
    assert schema.parse(schema.render(s)) == s
    assert schema.render(s).startswith('{"type":"struct","fields":[{"name":"a","type":{"type":"struct"')


@pytest.mark.parametrize("change", [{"name": ""}, {"name": None}, {"type": None}, {"type": "unknown"}, {"nullable": 3}, {"metadata": None}, {"type": {"type": "array", "elementType": "long"}}])
def test_schema_rejects(change):
    field = {"name": "x", "type": "long", "nullable": True, "metadata": {}} | change
    with pytest.raises(ParseSchema):
        schema.parse(json.dumps({"type": "struct", "fields": [field]}))


def test_records():
    info = A.write_info("ErrorIfExists")
    assert A.encode([{"commitInfo": info}]) == '{"commitInfo":{"operation":"tarn.Write","operationParameters":{"mode":"ErrorIfExists","partitionBy":"[]","predicate":"[]"}}}'
    assert A.decode('{"txn":{"appId":"a","version":1}}\n\n') == [{"txn": {"appId": "a", "version": 1}}]
    for line, error in (("{", ActionJSONFormat), ('{"a":1}', ActionUnknown), ('{"cdc":{}}', CDCNotSupported), ('{"add":{},"remove":{}}', ActionJSONFormat)):
        with pytest.raises(error):
            A.decode(line)


def test_string_bounds(spark):
    d, high, tie = "ab" * 16, "\U0001f40b", chr(0xFFFD)
    # 31, 32 and 33 characters; characters beyond the tie-breaker where the cut falls.
    rows = [(d[1:], d[1:], d[1:]), (d, d, d + tie), (d + "a", d, d + tie), ("", "", ""), (high * 3, high * 3, high * 3), (d + high + "zz", d, d + high + tie)]
    df = spark.createDataFrame(rows, "s string, lo string, hi string").select("lo", "hi", bounds.string_min(F.col("s")).alias("a"), bounds.string_max(F.col("s")).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == (r.lo, r.hi)
