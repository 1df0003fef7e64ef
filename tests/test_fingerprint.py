"""Golden fingerprints, and what they tell apart."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fingerprint as fp


def prints(spark, rows, schema, **kw):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(fp.row_fingerprint(df, **kw)).collect()]


@pytest.mark.parametrize(
    ("row", "schema", "want"),
    [
        ((1, None), "id bigint, data string", "7dfce9db8fc0f2475d2ff8ac3a5382e9"),
        ((1, "NULL"), "id bigint, data string", "dc4cca2441c365c72466c75076782022"),
        ((1, None, "data"), "id bigint, a string, b string", "8e8e0931b9b2e5cb422a76d63160bbf3"),
        ((1, "data", None), "id bigint, a string, b string", "503b2de936a8da9e8d67b0d4594117d9"),
        ((1, 0.0), "id bigint, data float", "2888f4944da0fba0d5a5c7a7de2346f3"),
        ((1, -0.0), "id bigint, data float", "2888f4944da0fba0d5a5c7a7de2346f3"),
        ((1, 1.0), "id bigint, data float", "2fa7e7e5e76005ffd8bfa5082da9f2f9"),
        ((2, "data"), "id bigint, data string", "ced197ee28c2e73cc737242eb0e8c49c"),
    ],
)
def test_golden(spark, row, schema, want):
    assert prints(spark, [row], schema) == [want]


def test_nulls_empty_and_the_text_null_differ(spark):
    got = prints(spark, [(1, None), (1, ""), (1, "NULL")], "id bigint, a string")
    assert len(set(got)) == 3


def test_the_older_form_confuses_null_and_its_text(spark):
    a, b = prints(spark, [(1, None), (1, "NULL")], "id bigint, a string", null_text=fp.OLD_NULL_TEXT)
    assert a == b


def test_ignored_columns(spark):
    a, b = prints(spark, [(1, "x", "y"), (1, "x", "z")], "id bigint, a string, b string", ignored=["b"])
    assert a == b


def test_exact_decimals_booleans_and_bytes(spark):
    rows = [(Decimal("-96.78850375986021"), True, bytearray(b"a\x00")), (Decimal("-96.78850375986022"), True, bytearray(b"a\x00")), (Decimal("-96.78850375986021"), True, bytearray(b"a"))]
    assert len(set(prints(spark, rows, "d decimal(18,14), f boolean, b binary"))) == 3


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError):
        fp.row_fingerprint(df)


def test_json_values(spark):
    df = spark.createDataFrame([("52.0", "52"), ('{"a": 1,"b":2}', '{"a":1, "b":2}'), ("", "null")], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(fp.canonical_json(F.col("a")), fp.canonical_json(F.col("b"))).collect())


def test_md5_of_values(spark):
    df = spark.createDataFrame([("Leszek",), ("Steve",)], "a string")
    assert [r[0] for r in df.select(fp.column_md5(F.col("a"), T.StringType())).collect()] == ["e356a972989f87a1531252cfa2152797", "81b8a1b77068d06e1c8190825253066f"]


def test_checksum_ignores_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert fp.table_checksum(df).first() == fp.table_checksum(df.repartition(3, "v")).first()
    assert fp.table_checksum(df).first() != fp.table_checksum(df.where("id <> 5")).first()
