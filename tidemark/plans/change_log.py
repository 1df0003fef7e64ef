"""Queries over the change log: decoding, filtering, applying, re-verifying."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statements
from ..functions.keys import UNSIGNED
from ..operators import changes, scan
from ..session import table
from ..sources import fixtures
from .register import BALANCES, LOG, ORDERS, plain, plain_sql, query


def _flat(events: DataFrame, *more: str) -> DataFrame:
    return events.select("position", *more, "op", F.col("old.k").alias("old_k"), F.col("old.v").alias("old_v"), F.col("new.k").alias("new_k"), F.col("new.v").alias("new_v"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row events of two rows each, as a server logs them: two inserts, two deletes, or one update's before and after."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", fixtures.cents("value").alias("v"))
    row = lambda d: F.struct((F.col("user_id") + d).alias("k"), (F.col("v") + d).alias("v"))
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select(F.col("event_id").alias("position"), F.lit("tpch").alias("db"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("table_name"), op.alias("op"), F.array(row(0), row(1)).alias("rows"))


_RAW = """(SELECT event_id AS position, 'tpch' AS db, 't' || event_id % 3 AS table_name, user_id AS k, (value::DECIMAL(18,2) * 100)::BIGINT AS v,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events)"""
_DECODED = f"""SELECT position, 0 AS row_at, table_name, op, k AS old_k, v AS old_v, k + 1 AS new_k, v + 1 AS new_v FROM {_RAW} WHERE op = 'U'
UNION ALL SELECT position, d, table_name, op, NULL, NULL, k + d, v + d FROM {_RAW}, (VALUES (0), (1)) t(d) WHERE op = 'I'
UNION ALL SELECT position, d, table_name, op, k + d, v + d, NULL, NULL FROM {_RAW}, (VALUES (0), (1)) t(d) WHERE op = 'D'"""


@query(_DECODED)
def cdc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row events as one event per changed row; updates pair their rows."""
    return _flat(changes.decoded(_raw(spark, sf_dir)), "row_at", "table_name")


@query(f"SELECT * FROM ({_DECODED}) WHERE table_name <> 't2'")
def cdc_known_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the tables that are copied."""
    catalog = spark.createDataFrame([("tpch", "t0"), ("tpch", "t1"), ("tpch", "orders")], "db string, table_name string")
    return _flat(changes.of_known_tables(changes.decoded(_raw(spark, sf_dir)), catalog), "row_at", "table_name")


@query(f"SELECT position, op, CASE WHEN op <> 'I' THEN key END AS old_k, old_v, CASE WHEN op <> 'D' THEN key END AS new_k, new_v FROM {LOG} WHERE key = 41")
def cdc_tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's events; none moves it."""
    return _flat(changes.of_tenant(fixtures.change_log(spark, sf_dir), "k", 41))


@query(f"SELECT count(*) AS moved FROM ({_DECODED}) WHERE op = 'U' AND old_k <> new_k")
def cdc_tenant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many updates move a row to another tenant."""
    return changes.tenant_changes(changes.decoded(_raw(spark, sf_dir)), "k").agg(F.count("*").alias("moved"))


@query(f"""SELECT position, row_at, 'D' AS op, old_k, old_v, NULL AS new_k, NULL AS new_v FROM ({_DECODED}) WHERE op = 'U'
UNION ALL SELECT position, row_at, 'I', NULL, NULL, new_k, new_v FROM ({_DECODED}) WHERE op = 'U'
UNION ALL SELECT position, row_at, op, old_k, old_v, new_k, new_v FROM ({_DECODED}) WHERE op <> 'U'""")
def cdc_key_changes_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of the key as a delete and an insert."""
    return _flat(changes.key_changes_split(changes.decoded(_raw(spark, sf_dir)), "k"), "row_at")


def _fold_sql(base: str) -> str:
    """Each key's events one after another, from its row in ``base``."""
    return f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS n FROM {LOG}),
f AS (
  SELECT k.key, 0::BIGINT AS n, b.k IS NOT NULL AS there, b.v FROM (SELECT key FROM ev UNION SELECT k FROM {base}) k LEFT JOIN {base} b ON b.k = k.key
  UNION ALL
  SELECT f.key, ev.n,
    CASE WHEN ev.op = 'I' THEN true WHEN ev.op = 'D' AND f.there AND f.v IS NOT DISTINCT FROM ev.old_v THEN false ELSE f.there END,
    CASE WHEN ev.op = 'I' AND NOT f.there THEN ev.new_v WHEN ev.op = 'U' AND f.there AND f.v IS NOT DISTINCT FROM ev.old_v THEN ev.new_v
         WHEN ev.op = 'D' AND f.there AND f.v IS NOT DISTINCT FROM ev.old_v THEN NULL ELSE f.v END
  FROM f JOIN ev ON ev.key = f.key AND ev.n = f.n + 1)
SELECT key AS k, arg_max(v, n) AS v FROM (SELECT key, n, coalesce(v, -1) AS v, there FROM f) GROUP BY key HAVING arg_max(there, n)"""


_NOTHING = "(SELECT 0::BIGINT AS k, 0::BIGINT AS v WHERE false)"


@query(_fold_sql(_NOTHING))
def cdc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log applied to an empty table, compare and set."""
    nothing = spark.createDataFrame([], "k bigint, v bigint")
    return changes.apply_changes(nothing, fixtures.change_log(spark, sf_dir), "k")


@query(_fold_sql(BALANCES))
def cdc_apply_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log applied to a table that has rows."""
    return changes.apply_changes(fixtures.balances(spark, sf_dir), fixtures.change_log(spark, sf_dir), "k")


@query(_fold_sql(BALANCES))
def cdc_apply_long_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the way that keys with very many events go."""
    return changes.apply_changes(fixtures.balances(spark, sf_dir), fixtures.change_log(spark, sf_dir), "k", at_once=50)


def _typed(v):
    """Columns of several types made of a number."""
    micros = F.timestamp_micros(v * 1000 + 123456)
    return [v.alias("v"), micros.alias("at"), (v / 8).cast("double").alias("d"), v.cast("decimal(20,4)").alias("amount"), v.cast("string").cast("binary").alias("raw")]


@query(f"SELECT k, v, v * 1000 + 123456 AS at, v / 8 AS d, v::VARCHAR || '.0000' AS amount, hex(v::VARCHAR) AS raw, 0::DOUBLE AS zero FROM ({_fold_sql(BALANCES)})")
def cdc_apply_long_histories_of_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories of rows with times, fractions, decimals and bytes; old rows say minus zero where the table says zero."""
    def row(c: str, zero: str):
        v = F.col(f"{c}.v")
        return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.k").alias("k"), *_typed(v), F.lit(float(zero)).alias("zero"))).alias(c)

    log = fixtures.change_log(spark, sf_dir).select("position", "op", "key", row("old", "-0.0"), row("new", "0.0"))
    base = fixtures.balances(spark, sf_dir).select("k", *_typed(F.col("v")), F.lit(0.0).alias("zero"))
    done = changes.apply_changes(base, log, "k", at_once=50)
    return done.select("k", "v", F.unix_micros("at").alias("at"), "d", F.col("amount").cast("string").alias("amount"), F.hex("raw").alias("raw"), "zero")


@query(f"SELECT key AS k, v FROM (SELECT key, arg_max(op, position) AS op, arg_max(coalesce(new_v, -1), position) AS v FROM {LOG} GROUP BY key) WHERE op <> 'D'")
def cdc_latest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's last row."""
    return changes.latest_images(fixtures.change_log(spark, sf_dir)).select(F.col("key").alias("k"), "new.v")


@query(plain_sql(f"SELECT * FROM {ORDERS} WHERE o_orderkey % 97 = 3"))
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load adds to a target that has some of its rows, differing or not, and gets each row twice."""
    orders = fixtures.orders(spark, sf_dir)
    return plain(changes.insert_ignore(fixtures.damaged_orders(spark, sf_dir), orders.unionByName(orders), "o_orderkey"))


def _named_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.change_log(spark, sf_dir).withColumn("db", F.lit("tpch")).withColumn("table_name", F.concat(F.lit("t"), (F.col("position") % 3).cast("string")))


_COUNTS = f"SELECT 'tpch' AS db, 't' || position % 3 AS table_name, key, count(*) AS changes FROM {LOG} GROUP BY 1, 2, 3"


@query(_COUNTS)
def reverify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key changed."""
    return changes.changes_by_key(_named_log(spark, sf_dir))


@query(f"SELECT count(*) AS entries, sum(changes)::BIGINT AS row_count FROM ({_COUNTS})")
def reverify_store_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and changes to verify again."""
    return changes.store_size(changes.changes_by_key(_named_log(spark, sf_dir)))


@query(f"SELECT db, table_name, key, changes - 1 AS changes FROM ({_COUNTS}) WHERE changes > 1")
def reverify_decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after one change of every key was verified."""
    store = changes.changes_by_key(_named_log(spark, sf_dir))
    return changes.after_verifying(store, store.withColumn("changes", F.lit(1).cast("bigint")))


@query(f"SELECT db, table_name, key, ((row_number() OVER (PARTITION BY table_name ORDER BY key) - 1) // 20)::BIGINT AS batch FROM ({_COUNTS})")
def reverify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys to verify again, in batches of each table."""
    return scan.set_batches(_named_log(spark, sf_dir), ["db", "table_name"], "key", 20)


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: annotated, annotated by someone else, annotated at the end, not at all, missing."""
    sql = F.concat(F.lit("UPDATE t SET v="), fixtures.cents("value").cast("string"))
    kind = F.col("event_id") % 5
    query_ = F.when(kind == 0, statements.annotated(sql, "app:ours")).when(kind == 1, statements.annotated(sql, "app:theirs")).when(kind == 2, F.concat(sql, F.lit(" /*app:ours*/"))).when(kind == 3, sql)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), query_.alias("query"))


_ANNOTATED = """(SELECT event_id AS position, CASE event_id % 5 WHEN 0 THEN '/*app:ours*/ ' || q WHEN 1 THEN '/*app:theirs*/ ' || q WHEN 2 THEN q || ' /*app:ours*/' WHEN 3 THEN q END AS query
FROM (SELECT event_id, 'UPDATE t SET v=' || (value::DECIMAL(18,2) * 100)::BIGINT AS q FROM events))"""


@query(f"SELECT * FROM {_ANNOTATED} WHERE query IS NULL OR regexp_extract(query, '^/\\*(.*?)\\*/', 1) <> 'app:ours'")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that someone else wrote to the target."""
    return changes.unannotated(_annotated(spark, sf_dir), "app:ours")


@query(f"SELECT position, regexp_extract(query, '^/\\*(.*?)\\*/', 1) AS annotation FROM {_ANNOTATED}")
def annotation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's leading annotation."""
    return _annotated(spark, sf_dir).select("position", statements.annotation(F.col("query")).alias("annotation"))


@query("""SELECT position, last_value(query IGNORE NULLS) OVER (PARTITION BY position // 10 ORDER BY position) AS query
FROM (SELECT event_id AS position, CASE WHEN event_id % 4 = 0 THEN 'Q' || event_id END AS query FROM events)""")
def query_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's statement within its transaction."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.floor(F.col("event_id") / 10).alias("xid"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Q"), F.col("event_id").cast("string"))).alias("query"))
    return changes.with_query(e).select("position", "query")


@query("SELECT event_id, least(nullif(event_id % 3, 0), nullif(user_id % 4, 0)) AS resume_at FROM events")
def resume_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to resume: the least position that there is."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", changes.resume_position(F.col("event_id") % 3, F.col("user_id") % 4).alias("resume_at"))


@query("SELECT max(event_id) AS position, max(event_id) FILTER (WHERE event_id % 10 = 9) AS resumable_position FROM events")
def log_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's end, and its last transaction's."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 10 == 9, F.col("event_id")).alias("resumable_position"))
    return changes.log_end(e)


@query(f"""SELECT position, CASE op
  WHEN 'I' THEN 'INSERT IGNORE INTO `tpch`.`t` (`k`,`v`) VALUES (' || key || ',' || coalesce(new_v::VARCHAR, 'NULL') || ')'
  WHEN 'U' THEN 'UPDATE `tpch`.`t` SET `k`=' || key || ',`v`=' || coalesce(new_v::VARCHAR, 'NULL') || ' WHERE `k`=' || key || ' AND ' || CASE WHEN old_v IS NULL THEN '`v` IS NULL' ELSE '`v`=' || old_v END
  ELSE 'DELETE FROM `tpch`.`t` WHERE `k`=' || key || ' AND ' || CASE WHEN old_v IS NULL THEN '`v` IS NULL' ELSE '`v`=' || old_v END END AS statement
FROM {LOG}""")
def dml_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements."""
    log = fixtures.change_log(spark, sf_dir)
    return log.select("position", statements.statement(log.schema["new"].dataType, "tpch", "t").alias("statement"))


@query("""SELECT event_id, '''' || replace(replace(event_type, 'e', ''''), '''', '''''') || '''' AS quoted, 'CAST(''' || coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE props END, ''), 'null') || ''' AS JSON)' AS json,
CASE WHEN event_id % 2 = 0 THEN 'NULL' ELSE (event_id % 7 = 1)::INT::VARCHAR END AS flag FROM events""")
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as literals: quotes doubled, empty JSON null, booleans as numbers."""
    from pyspark.sql import types as T

    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", statements.literal(F.replace("event_type", F.lit("e"), F.lit("'")), T.StringType()).alias("quoted"),
        statements.literal(F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("props")), T.StringType(), json=True).alias("json"),
        statements.literal(F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 7 == 1), T.BooleanType()).alias("flag"),
    )


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 18446744073709551616::HUGEINT - event_id - 1 ELSE event_id END::VARCHAR AS key FROM events")
def unsigned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed readings of unsigned 64-bit keys, put right."""
    from ..functions.keys import unsigned

    signed = F.when(F.col("event_id") % 2 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", unsigned(signed, 64).cast(UNSIGNED).cast("string").alias("key"))
