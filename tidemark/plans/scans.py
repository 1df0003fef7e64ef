"""Queries over scans, table order and row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statements
from ..operators import scan, selection
from ..session import table
from ..sources import catalog, fixtures
from .register import ORDERS, SOURCE, plain, plain_sql, query

TENANT = 41
COPIED = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200"))
def scan_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 200 rows after key 1000."""
    return plain(scan.keyset_page(fixtures.orders(spark, sf_dir), "o_orderkey", 1000, 200))


@query(f"SELECT o_orderkey FROM {ORDERS} ORDER BY o_orderkey LIMIT 200")
def scan_first_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the first page; without a bound, so that key 0 is in it."""
    return scan.keyset_page(fixtures.orders(spark, sf_dir), "o_orderkey", None, 200, ["o_orderkey"])


_BATCHES = f"""SELECT (n // 200)::BIGINT AS batch, count(*) AS row_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM {SOURCE}) GROUP BY 1"""


@query(_BATCHES)
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in batches of 200 rows, with the keys they begin and end with."""
    return scan.key_batches(fixtures.source_orders(spark, sf_dir), "o_orderkey", 200)


@query(f"""SELECT count(*) AS batches, count(*) FILTER (WHERE last_key <= before) AS not_advancing
FROM (SELECT last_key, lag(last_key) OVER (ORDER BY batch) AS before FROM ({_BATCHES}))""")
def scan_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every batch ends beyond the one before."""
    batches = scan.key_batches(fixtures.source_orders(spark, sf_dir), "o_orderkey", 200)
    bad = scan.not_advancing(batches).agg(F.count("*").alias("n"))
    return batches.agg(F.count("*").alias("batches")).withColumn("not_advancing", F.lit(bad.first()["n"]).cast("bigint"))


_KEYS = {"customer": "c_custkey", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}


def _tables(spark: SparkSession, sf_dir: str) -> dict:
    return {n: (table(spark, sf_dir, n), k) for n, k in _KEYS.items()} | {"empty": (table(spark, sf_dir, "orders").where("o_orderkey < 0"), "o_orderkey")}


_MAX_KEYS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, max({k})::BIGINT AS max_key, count(*) AS row_count FROM {n}" for n, k in _KEYS.items())
_MAX_KEYS += " UNION ALL SELECT 'empty', max(o_orderkey)::BIGINT, count(*) FROM orders WHERE o_orderkey < 0"


@query(_MAX_KEYS)
def max_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest key and row count of every table; null for an empty one."""
    return scan.max_keys(_tables(spark, sf_dir))


@query(f"SELECT * FROM ({_MAX_KEYS}) WHERE max_key IS NULL")
def empty_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that have nothing to copy."""
    return scan.split_empty(scan.max_keys(_tables(spark, sf_dir)))[1]


@query(f"SELECT * FROM ({_MAX_KEYS}) WHERE table_name NOT IN ('orders', 'part')")
def remaining_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables left after a resume that finds two of them completed."""
    done = spark.createDataFrame([("orders",), ("part",)], "table_name string")
    return scan.remaining(scan.max_keys(_tables(spark, sf_dir)), done)


@query(f"SELECT table_name, row_count, row_number() OVER (ORDER BY row_count DESC, table_name) AS place FROM ({_MAX_KEYS})")
def table_order_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, the largest first, with their place."""
    from pyspark.sql import Window

    tables = scan.by_largest(scan.max_keys(_tables(spark, sf_dir)), "row_count")
    return tables.select("table_name", "row_count", F.row_number().over(Window.orderBy(F.col("row_count").desc(), "table_name")).cast("bigint").alias("place"))


@query(f"SELECT * FROM ({_MAX_KEYS}) ORDER BY max_key DESC NULLS LAST, table_name")
def table_order_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, the largest key first."""
    return scan.by_largest(scan.max_keys(_tables(spark, sf_dir)), "max_key")


@query(f"SELECT *, nullif(list_position(['part', 'nothing', 'customer'], table_name), 0)::BIGINT AS place FROM ({_MAX_KEYS})")
def table_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in a given order, then the rest."""
    return scan.by_priority(scan.max_keys(_tables(spark, sf_dir)), ["part", "nothing", "customer"])


@query("SELECT count(*) AS row_count, count(DISTINCT (l_orderkey, l_linenumber)) AS key_count, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS usable FROM lineitem")
def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two columns of ``lineitem`` name its rows."""
    return scan.uniqueness(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"))
def key_set_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a set of keys in which keys repeat."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return plain(scan.with_keys(fixtures.orders(spark, sf_dir), "o_orderkey", keys))


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey IN (1, 5, 5, 77, 999999999)"))
def key_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a short list of keys."""
    return plain(scan.with_keys(fixtures.orders(spark, sf_dir), "o_orderkey", [1, 5, 5, 77, 999999999]))


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_custkey = {TENANT}"))
def tenant_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a tenant."""
    return plain(selection.tenant_rows(fixtures.orders(spark, sf_dir), "o_custkey", TENANT))


_PAGE = f"SELECT * FROM {ORDERS} WHERE o_custkey = {TENANT} AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 5"


@query(plain_sql(_PAGE))
def tenant_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five rows of a tenant."""
    return plain(selection.tenant_page(fixtures.orders(spark, sf_dir), "o_custkey", TENANT, "o_orderkey", 100, 5))


@query(plain_sql(_PAGE))
def tenant_select_late_mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page, keys first and rows by a join."""
    return plain(selection.tenant_page_late(fixtures.orders(spark, sf_dir), "o_custkey", TENANT, "o_orderkey", 100, 5).select(*fixtures.orders(spark, sf_dir).columns))


def _links(spark: SparkSession, sf_dir: str) -> list[selection.JoinTable]:
    return [selection.JoinTable(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey"), selection.JoinTable(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")]


_JOINED = "SELECT l_orderkey AS k FROM lineitem WHERE l_suppkey = 7 UNION SELECT o_orderkey FROM orders WHERE o_custkey = 7"


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey IN ({_JOINED})"))
def joined_table_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two link tables name for a tenant."""
    return plain(selection.joined_rows(fixtures.orders(spark, sf_dir), "o_orderkey", _links(spark, sf_dir), 7))


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey IN (SELECT k FROM ({_JOINED}) WHERE k > 100 ORDER BY k LIMIT 20)"))
def joined_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty of those."""
    return plain(selection.joined_rows(fixtures.orders(spark, sf_dir), "o_orderkey", _links(spark, sf_dir), 7, last=100, rows=20))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey = {TENANT}")
def pk_table_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenant's own row."""
    return selection.primary_key_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", TENANT)


def _schema_sql() -> str:
    return f"SELECT 'tpch' AS db, table_name, column_name FROM information_schema.columns WHERE table_name IN {COPIED}"


@query(f"SELECT DISTINCT db, table_name FROM ({_schema_sql()}) WHERE table_name NOT IN ('events', 'region')")
def static_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables but those not wanted."""
    tables = fixtures.catalog_columns(spark, sf_dir, COPIED).select("db", "table_name").distinct()
    return selection.StaticTableFilter(dbs=("tpch",), not_tables=("events", "region")).apply(tables)


@query(f"""SELECT db, table_name, CASE WHEN table_name = 'lineitem' THEN 'joined' WHEN table_name = 'customer' THEN 'primary_key' ELSE 'tenant' END AS kind
FROM ({_schema_sql()}) WHERE NOT regexp_matches(table_name, '^part') GROUP BY 1, 2
HAVING table_name IN ('lineitem', 'customer') OR bool_or(column_name = 'o_custkey')""")
def sharded_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that hold a tenant's rows, and why."""
    return selection.ShardedTableFilter("tpch", "o_custkey", joined=("lineitem",), primary_key=("customer",), ignored=("^part",)).apply(fixtures.catalog_columns(spark, sf_dir, COPIED))


@query("SELECT n_nationkey, n_name, CASE n_name WHEN 'NATION_1' THEN 'first' WHEN 'NATION_2' THEN 'second' ELSE n_name END AS new_name FROM nation")
def rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names rewritten by a map."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", selection.renamed(F.col("n_name"), {"NATION_1": "first", "NATION_2": "second"}).alias("new_name"))


@query(f"SELECT table_name, floor(65535 / count(*))::BIGINT AS max_batch FROM ({_schema_sql()}) GROUP BY 1")
def max_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one statement can take, by table."""
    from ..operators.progress import most_batch_rows

    return most_batch_rows(fixtures.catalog_columns(spark, sf_dir, COPIED)).select("table_name", "max_batch")


@query("""SELECT 'tpch' AS db, table_name, count(DISTINCT column_name)::BIGINT AS foreign_keys
FROM (VALUES ('orders', 'o_custkey'), ('lineitem', 'l_orderkey'), ('lineitem', 'l_partkey'), ('lineitem', 'l_suppkey'), ('customer', 'c_nationkey'),
             ('supplier', 's_nationkey'), ('nation', 'n_regionkey')) AS c(table_name, column_name) GROUP BY 1, 2""")
def foreign_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys by table, each listed twice."""
    columns = fixtures.catalog_columns(spark, sf_dir, ("orders", "lineitem", "customer", "supplier", "nation"))
    kind = F.when(F.col("column_name").isin("o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "c_nationkey", "s_nationkey", "n_regionkey"), "FOREIGN KEY").otherwise("PRIMARY KEY")
    listed = columns.where(F.col("column_name").rlike("key$")).select("db", "table_name", F.col("column_name").alias("constraint_name"), kind.alias("constraint_type"))
    return catalog.foreign_keys(listed.unionByName(listed), ["tpch"])


@query("""SELECT (n_nationkey // 10)::INT AS batch, count(*) AS row_count,
  'INSERT IGNORE INTO `tpch`.`nation` (`n_nationkey`,`n_name`,`n_regionkey`) VALUES ' ||
  string_agg('(' || n_nationkey || ',' || chr(39) || n_name || chr(39) || ',' || n_regionkey || ')', ',' ORDER BY n_nationkey) AS statement
FROM nation GROUP BY 1""")
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement for each ten rows."""
    return statements.insert_rows(table(spark, sf_dir, "nation"), "tpch", "nation", F.floor(F.col("n_nationkey") / 10).cast("int"), "n_nationkey")


@query(f"""SELECT table_name, rank() OVER (ORDER BY row_count DESC) AS place FROM (
  SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region)""")
def table_order_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by the bytes of their files, the largest first; here that is their order by rows too."""
    found = catalog.sizes(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("lineitem", "orders", "region")})
    names = [r["table_name"] for r in scan.by_largest(found, "bytes").collect()]
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "table_name string, place bigint")
