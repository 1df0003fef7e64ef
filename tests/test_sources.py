"""Catalog, keys, metrics and the command line."""

import pytest
from pyspark.sql import types as T

from tidemark.__main__ import main
from tidemark.metrics import Metrics, observed
from tidemark.operators.selection import StaticTableFilter
from tidemark.sources import catalog

SCHEMA = T.StructType().add("id", "long").add("name", "string").add("v", "double")


def test_key_resolution_order():
    of = lambda **k: catalog.resolve_key("d.t", SCHEMA, k.get("chosen", {}), k.get("primary", {}), k.get("fallback"))
    assert of(chosen={"d.t": "name"}, primary={"d.t": ["id"]}) == "name"
    assert of(primary={"d.t": ["id"]}, fallback="name") == "id"
    assert of(primary={"d.t": ["id", "name"]}, fallback="name") == "name"
    for bad in ({}, {"primary": {"d.t": ["id", "name"]}}, {"chosen": {"d.t": "v"}}, {"chosen": {"d.t": "nothing"}}, {"fallback": "nothing"}):
        with pytest.raises(catalog.SchemaError):
            of(**bad)


def test_a_key_in_another_collation_is_refused():
    schema = T.StructType([T.StructField("id", T.StringType("UTF8_LCASE"))])
    with pytest.raises(catalog.SchemaError):
        catalog.resolve_key("d.t", schema, {"d.t": "id"}, {})


def test_tables_are_loaded_and_made_under_new_names(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.range(5).write.mode("overwrite").saveAsTable("src.a")
    spark.range(5).selectExpr("id % 2 AS id").write.mode("overwrite").saveAsTable("src.b")
    specs = catalog.load_tables(spark, StaticTableFilter(dbs=("src",), tables=("a",)), fallback="id")
    assert list(specs) == ["src.a"] and specs["src.a"].key == "id"
    with pytest.raises(catalog.SchemaError, match="repeat"):
        catalog.load_tables(spark, StaticTableFilter(dbs=("src",), tables=("b",)), fallback="id")
    spark.sql("DROP DATABASE IF EXISTS dst CASCADE")
    assert catalog.create_like(spark, list(specs.values()), {"src": "dst"}, {"a": "c"}) == ["dst.c"]
    assert spark.table("dst.c").count() == 0
    assert catalog.create_like(spark, list(specs.values()), {"src": "dst"}, {"a": "c"}, allow_existing=True) == ["dst.c"]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_like(spark, list(specs.values()), {"src": "dst"}, {"a": "c"})
    spark.sql("DROP DATABASE src CASCADE")
    spark.sql("DROP DATABASE dst CASCADE")


def test_arity_and_event_types(spark):
    with pytest.raises(catalog.SchemaError, match="3 columns but event has 1 columns"):
        catalog.check_columns(spark.range(1), SCHEMA, "test_table")
    with pytest.raises(catalog.SchemaError):
        catalog.handled(spark.range(1), {"nothing": lambda d: d})
    raw = spark.createDataFrame([("rows", 1), ("ddl", 2)], "event_type string, position int")
    assert [d.count() for d in catalog.handled(raw, {"ddl": lambda d: d})] == [1]


def test_metrics(spark):
    m, got = Metrics("p.", {"env": "t"}, size=2), []
    m.count("a")
    with m.measure("b", {"x": "y"}):
        pass
    m.gauge("dropped", 1.0)
    assert m.drain(got.append) == 2 and [g.name for g in got] == ["p.a", "p.b"] and got[1].tags == {"env": "t", "x": "y"}
    df, seen = observed(spark.range(7), "seven")
    df.collect()
    assert seen.get["rows"] == 7


def test_command_line(spark, tmp_path, capsys):
    spark.range(20).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/t.parquet")
    where = ["--source", str(tmp_path), "--target", f"file://{tmp_path}/out", "--table", "t:id"]
    assert main(["copy", *where, "--dry-run"]) == 0 and "20 rows" in capsys.readouterr().out
    assert main(["copy", *where]) == 0
    assert main(["diff", *where]) == 0
    spark.range(21).selectExpr("id", "id * 2 AS v").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert main(["diff", *where]) == 1
