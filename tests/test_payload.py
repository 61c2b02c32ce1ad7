"""JSON payloads of any shape."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from txnwatch.sources.payload import flatten_any, payload_profile, payload_quality, payload_schema

ROWS = [
    ("c1", '{"a":1,"b":{"x":[1,2],"y":"q"},"c":"2024-01-01","d e":1.5,"m":1,"transaction_date":"03/02/2024","transaction_amount":" 12.50 ","customer_id":"other"}'),
    ("c2", '{"a":2.5,"b":{"x":[],"z":true},"m":"x","n":null,"big":12345678901234567890,"transaction_amount":"n/a"}'),
    ("c3", ' {"m":{"k":1},"`q`":1,"e":1e300,"D":1,"d":2,"Customer_ID":"z","transaction_amount":7,"l":[{"p":1},{"p":2.5}]}'),
    ("c4", "broken"), ("c5", None), ("c6", "[1,2]"), ("c7", '"s"'), ("c8", '{"a":1,"a":2}'), ("c9", "{}"), ("c10", '{"flag":false,"a":3}'),
]


def table(spark):
    return spark.createDataFrame(ROWS, "customer_id string, raw_data string")


def test_schema_covers_all_payloads(spark):
    kinds = {f.name: f.dataType.simpleString() for f in payload_schema(table(spark)).fields}
    assert kinds["a"] == "decimal(21,1)" and kinds["big"] == "decimal(20,0)" and kinds["e"] == "double" and kinds["flag"] == "boolean"
    assert kinds["b"] == "struct<x:array<bigint>,y:string,z:boolean>" and kinds["m"] == "string" and kinds["n"] == "string"
    assert kinds["l"] == "array<struct<p:decimal(21,1)>>" and {"D", "d", "`q`", "d e"} <= kinds.keys()


def test_values_keep_their_types(spark):
    rows = {r.customer_id: r for r in flatten_any(table(spark)).collect()}
    assert len(rows) == len(ROWS)
    one, two, three = rows["c1"], rows["c2"], rows["c3"]
    assert one.a == Decimal("1.0") and two.a == Decimal("2.5") and rows["c10"].a == 3 and rows["c10"].flag is False
    assert one.b.x == [1, 2] and one.b.y == "q" and two.b.x == [] and two.b.z is True and one["d e"] == Decimal("1.5")
    assert (one.m, two.m, three.m) == ("1", "x", '{"k":1}')
    assert two.big == 12345678901234567890 and three.e == 1e300 and three["`q`"] == 1
    assert [x.p for x in three.l] == [Decimal("1.0"), Decimal("2.5")]
    assert one.transaction_date == dt.datetime(2024, 2, 3) and (one.transaction_amount, two.transaction_amount, three.transaction_amount) == (12.5, None, 7.0)
    # Keys that differ in case only, and one that looks like a system column.
    assert three.D == 1 and three["d_2"] == 2 and three["Customer_ID_2"] == "z"
    for key in ("c4", "c5", "c6", "c7", "c8", "c9"):
        assert all(v is None for v in rows[key][1:])


def test_profile_and_quality(spark):
    got = {r.field_name: (r.kind, r.payloads, r.nulls) for r in payload_profile(table(spark)).collect()}
    assert got["m"] == ("MIXED", 3, 0) and got["n"] == ("VOID", 1, 1) and got["a"] == ("DECIMAL(21,1)", 3, 0)
    assert got["b"][0] == "OBJECT<x: ARRAY<BIGINT>, y: STRING, z: BOOLEAN>" and got["customer_id"] == ("STRING", 1, 0)
    assert tuple(payload_quality(table(spark)).first()) == (1, 5, 4)


def test_empty_and_given_schema(spark):
    empty = table(spark).limit(0)
    assert payload_schema(empty) == T.StructType([]) and flatten_any(empty).columns == ["customer_id"]
    assert payload_profile(empty).count() == 0 and tuple(payload_quality(empty).first()) == (0, 0, 0)
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("m", T.LongType())])
    got = {r.customer_id: (r.a, r.m) for r in flatten_any(table(spark), schema=schema).collect()}
    assert got["c2"] == (2.5, None) and got["c1"] == (1.0, 1)
