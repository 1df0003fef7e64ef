"""Keys, statements, batch sizes, compressed values."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import batch_size, keys, snappy, statements


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(column).first()[0]


@pytest.mark.parametrize(("size", "want"), [(1, 2000), (100, 2000), (200, 1981), (500, 1927), (1000, 1836), (2000, 1654), (3500, 1381), (5000, 1108), (10000, 200), (15000, 200), (20000, 200)])
def test_batch_size_points(spark, size, want):
    assert one(spark, batch_size.interpolated(F.col("s"), {100: 2000, 10000: 200}), s=size) == want


def test_batch_size_cap(spark):
    assert one(spark, batch_size.batch_rows(F.col("s"), F.col("c"), {100: 2000, 10000: 200}), s=100, c=100) == 655


def test_unsigned(spark):
    df = spark.createDataFrame([(-1, 8), (-1, 64), (5, 64)], "v bigint, b int")
    assert [int(r[0]) for r in df.where("b = 64").select(keys.unsigned(F.col("v"), 64)).collect()] == [2**64 - 1, 5]
    assert [int(r[0]) for r in df.where("b = 8").select(keys.unsigned(F.col("v"), 8)).collect()] == [255]


def test_binary_keys(spark):
    df = spark.createDataFrame([(bytearray(b"\x01"),), (bytearray(b"\xff" * 16),), (bytearray(b""),), (bytearray(range(16)),)], "k binary")
    got = df.select(keys.numeric_position(F.col("k"), True), keys.is_max(F.col("k"), True), keys.to_hex(F.col("k"))).collect()
    assert [r[0] for r in got] == [float(1 << 56), float(2**64 - 1), 0.0, float(int.from_bytes(bytes(range(8)), "big"))]
    assert [r[1] for r in got] == [False, True, False, False]
    assert got[3][2] == bytes(range(16)).hex()


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"abcdef"),)], "k binary")
    assert [bytes(r[0]) for r in df.select(keys.padded(F.col("k"), 4)).collect()] == [b"ab\x00\x00", b"abcdef"]


def test_max_keys(spark):
    assert one(spark, keys.is_max(keys.max_key(), False)) is True
    assert len(one(spark, keys.max_key(16))) == 16


def test_key_json_round_trip(spark):
    text = one(spark, keys.key_json("id", F.col("k").cast(keys.UNSIGNED), False), k="18446744073709551615")
    assert json.loads(text) == {"type": "uint64", "value": "18446744073709551615", "column": "id"}
    assert one(spark, keys.key_of_json(F.col("t"))["value"], t=text) == "18446744073709551615"


def test_compare(spark):
    assert [one(spark, keys.compare(F.lit(a), F.lit(b))) for a, b in ((1, 2), (2, 2), (3, 2))] == [-1, 0, 1]


@pytest.mark.parametrize(
    ("op", "old", "new", "want"),
    [
        ("I", None, (1000, "val1", True), "INSERT IGNORE INTO `target_schema`.`target_table` (`col1`,`col2`,`col3`) VALUES (1000,CAST('val1' AS JSON),1)"),
        ("U", (1000, "val1", True), (1000, "val2", False), "UPDATE `target_schema`.`target_table` SET `col1`=1000,`col2`=CAST('val2' AS JSON),`col3`=0 WHERE `col1`=1000 AND `col2`=CAST('val1' AS JSON) AND `col3`=1"),
        ("D", (1000, None, True), None, "DELETE FROM `target_schema`.`target_table` WHERE `col1`=1000 AND `col2` IS NULL AND `col3`=1"),
    ],
)
def test_statements(spark, op, old, new, want):
    row = "struct<col1: bigint, col2: string, col3: boolean>"
    df = spark.createDataFrame([(op, old, new)], f"op string, old {row}, new {row}")
    assert df.select(statements.statement(df.schema["new"].dataType, "target_schema", "target_table", ("col2",))).first()[0] == want


def test_escapes(spark):
    assert one(spark, statements.literal(F.col("s"), T.StringType()), s="it's \\n") == "'it''s \\n'"
    assert one(spark, statements.literal(F.lit(b"a'b"), T.BinaryType(), fixed_size=5)) == "_binary'a''b\x00\x00'"
    assert one(spark, statements.literal(F.lit(""), T.StringType(), json=True)) == "CAST('null' AS JSON)"


@pytest.mark.parametrize(("sql", "want"), [("/*a:b*/ UPDATE t", "a:b"), ("UPDATE t /*a:b*/", ""), (" /*a*/ x", ""), ("/*a*/ /*b*/ x", "a")])
def test_annotations(spark, sql, want):
    assert one(spark, statements.annotation(F.col("q")), q=sql) == want


def test_quoting():
    assert statements.quoted("a", "b`c") == "`a`.`b``c`"


def test_snappy_round_trip_and_errors(spark):
    plain = [b"", b"x", b"hello " * 200, None]
    df = spark.createDataFrame([(None if p is None else bytearray(pa.compress(p, codec="snappy", asbytes=True)),) for p in plain], "b binary")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(snappy.decompressed("b", "snappy")).collect()] == plain
    with pytest.raises(ValueError):
        snappy.decompressed("b", "zip")
