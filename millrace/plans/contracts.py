"""Contract checks: events stand for the outbox, line items for stock movements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract as ct
from .base import ORACLE_SQL, query, table

AS_OF = datetime(2024, 1, 31)
REQUIRED = {"click": ["k"], "view": ["k"], "purchase": ["k", "amount"], "signup": ["k"]}
LIMITS = {"min_24h": 10, "max_24h": 200}
TABLES = {"events": ["event_id", "ts", "user_id", "event_type", "payload"], "orders": ["o_orderkey", "o_custkey"], "returns": ["return_id"]}


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Published so many seconds after creation as the value says; every 50th is pending, every 400th has a bad time."""
    e, k = table(spark, d, "events"), F.col("event_id")
    created = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    published = F.date_format(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1_000_000)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(
        "event_id", "event_type", F.col("user_id").alias("aggregate_id"), F.col("props").alias("payload"), F.when(k % 50 == 0, "PENDING").otherwise("PUBLISHED").alias("status"),
        F.when(k % 400 == 7, "not a time").otherwise(created).alias("created_at"), F.when(k % 50 != 0, published).alias("published_at"),
    )


OUTBOX = "SELECT event_id, event_type, user_id, props, ts, value, CASE WHEN event_id % 400 <> 7 THEN ts END AS c, CASE WHEN event_id % 50 <> 0 THEN make_timestamp(epoch_us(ts) + floor(value * 1000000)::BIGINT) END AS p, event_id % 50 = 0 AS pending FROM events"
NOW = "TIMESTAMP '2024-01-31'"
STATUS = "CASE WHEN {m} > {f} THEN 'FAIL' WHEN {m} > {w} THEN 'WARN' ELSE 'OK' END"


SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT 'schema.{t}' AS \"check\", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*)::DOUBLE AS metric FROM unnest([{', '.join(f"'{c}'" for c in columns)}]) x(c) WHERE c NOT IN (SELECT column_name FROM duckdb_columns() WHERE table_name = '{t}')"
    for t, columns in TABLES.items()
)


@query("g01_schema", SCHEMA_SQL)
def g01(spark, d):
    return ct.schema_check(spark, {"events": table(spark, d, "events"), "orders": table(spark, d, "orders")}, TABLES).select("check", "status", "metric")


def _types() -> str:
    return ", ".join(f"'{k}'" for k in REQUIRED)


@query("g02_payload_contract", f"SELECT 'event.payload_contract' AS \"check\", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*)::DOUBLE AS metric FROM events WHERE event_type NOT IN ({_types()}) OR event_type = 'purchase'")
def g02(spark, d):
    return ct.payload_check(outbox(spark, d), REQUIRED).select("check", "status", "metric")


@query("g03_timestamp_parse", "SELECT 'time.timestamp_parse' AS \"check\", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*)::DOUBLE AS metric FROM events WHERE event_id % 400 = 7")
def g03(spark, d):
    return ct.timestamp_check(outbox(spark, d)).select("check", "status", "metric")


def times(spark: SparkSession, d: str) -> DataFrame:
    return ct.time_checks(outbox(spark, d), AS_OF, LIMITS).select("check", "status", F.round("metric", 3).alias("metric"))


SKEW = f"greatest(max(epoch_us(c)) - epoch_us({NOW}), 0) / 1000000.0"
AGE = f"(epoch_us({NOW}) - max(epoch_us(c))) / 60000000.0"
LAG = f"(epoch_us({NOW}) - min(epoch_us(c)) FILTER (pending)) / 60000000.0"
DELAY = "max(epoch_us(p) - epoch_us(c)) / 1000000.0"
VOLUME = f"count(*) FILTER (c >= {NOW} - INTERVAL 24 HOUR AND c <= {NOW})"
TIME_SQL = {
    "time.clock_skew": (STATUS.format(m=SKEW, f=300, w=60), SKEW),
    "freshness.outbox_latest_event": (f"CASE WHEN {AGE} > 1440 THEN 'FAIL' ELSE 'OK' END", AGE),
    "lag.outbox_pending": (STATUS.format(m=LAG, f=120, w=30), LAG),
    "lag.publish_delay": (STATUS.format(m=DELAY, f=300, w=60), DELAY),
    "volume.outbox_events_24h": (f"CASE WHEN {VOLUME} BETWEEN {LIMITS['min_24h']} AND {LIMITS['max_24h']} THEN 'OK' ELSE 'WARN' END", VOLUME),
}
for name, check in (("g04_clock_skew", "time.clock_skew"), ("g05_freshness", "freshness.outbox_latest_event"), ("g06_pending_lag", "lag.outbox_pending"), ("g07_publish_delay", "lag.publish_delay"), ("g08_volume", "volume.outbox_events_24h")):
    status, metric = TIME_SQL[check]
    query(name, f"SELECT '{check}' AS \"check\", {status} AS status, round(({metric})::DOUBLE, 3) AS metric FROM ({OUTBOX})")(lambda spark, d, check=check: times(spark, d).filter(F.col("check") == check))


@query("a22_time_bounds", "SELECT max(ts) AS latest, min(ts) FILTER (event_id % 50 = 0) AS oldest_pending FROM events")
def a22(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("latest"), F.min(F.when(F.col("event_id") % 50 == 0, F.col("ts"))).alias("oldest_pending"))


@query("a23_last_day_count", f"SELECT count(*) FILTER (ts >= {NOW} - INTERVAL 24 HOUR AND ts <= {NOW}) AS n FROM events")
def a23(spark, d):
    now = F.lit(AS_OF)
    return table(spark, d, "events").agg(F.count_if((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now)).alias("n"))


@query("a29_largest_delay", f"SELECT round({DELAY}, 3) AS delay_seconds FROM ({OUTBOX})")
def a29(spark, d):
    rows = ct.time_checks(outbox(spark, d), AS_OF, LIMITS).filter("check = 'lag.publish_delay'")
    return rows.select(F.round("metric", 3).alias("delay_seconds"))


@query("p17_pending_events", "SELECT event_id, user_id AS aggregate_id FROM events WHERE event_id % 50 = 0")
def p17(spark, d):
    return outbox(spark, d).filter((F.col("status") == "PENDING") & F.col("published_at").isNull()).select("event_id", "aggregate_id")


DUPLICATES = "SELECT event_type, user_id AS aggregate_id, sha256(props) AS digest, count(*) AS times FROM events GROUP BY ALL HAVING count(*) > 1"


@query("a21_semantic_duplicates", DUPLICATES)
def a21(spark, d):
    o = outbox(spark, d)
    return o.groupBy("event_type", "aggregate_id", F.sha2("payload", 256).alias("digest")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


@query("g09_duplicate_events", f"SELECT 'idempotency.duplicate_semantic_event' AS \"check\", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*)::DOUBLE AS metric FROM ({DUPLICATES})")
def g09(spark, d):
    return ct.duplicate_check(outbox(spark, d)).select("check", "status", "metric")


def movements(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "RESERVE").when(F.col("l_returnflag") == "A", "COMMIT").otherwise("RELEASE")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("sku_id"), kind.alias("movement_type"), F.col("l_quantity").alias("quantity"))


def stock(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Baseline and stock; stock follows the movements but for every 97th part, where 99 too many are sold."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("sku_id"), (F.col("p_size") * 100).alias("base"))
    m = ct.movement_pivot(movements(spark, d))
    s = base.join(m, "sku_id", "left").fillna(0, ["reserved_q", "committed_q", "released_q"])
    r, c, b = F.col("reserved_q"), F.col("committed_q"), F.col("released_q")
    odd = F.when(F.col("sku_id") % 97 == 0, 99).otherwise(0)
    return base, s.select("sku_id", (F.col("base") - r + b).alias("available_stock"), (r - c - b).alias("reserved_stock"), (c + odd).alias("sold_stock"))


PIVOT = "SELECT l_partkey AS sku_id, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS reserved_q, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS committed_q, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS released_q FROM lineitem GROUP BY 1"


@query("a16_movement_pivot", PIVOT)
def a16(spark, d):
    return ct.movement_pivot(movements(spark, d))


@query("j11_reconciliation", f"SELECT p_partkey AS sku_id, 'sold' AS field, coalesce(committed_q, 0) AS expected, coalesce(committed_q, 0) + 99 AS actual FROM part LEFT JOIN ({PIVOT}) ON p_partkey = sku_id WHERE p_partkey % 97 = 0")
def j11(spark, d):
    base, s = stock(spark, d)
    return ct.reconciliation(base, movements(spark, d), s)


@query("g10_reconciliation", "SELECT 'reconciliation.inventory_movements' AS \"check\", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*)::DOUBLE AS metric FROM part WHERE p_partkey % 97 = 0")
def g10(spark, d):
    base, s = stock(spark, d)
    return ct.reconciliation_check(base, movements(spark, d), s).select("check", "status", "metric")


@query("a17_pending_reserved", "SELECT l_partkey AS sku_id, sum(l_quantity) AS pending FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def a17(spark, d):
    return movements(spark, d).filter("movement_type = 'RESERVE'").groupBy("sku_id").agg(F.sum("quantity").alias("pending"))


@query("g11_threshold_status", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'FAIL' WHEN o_totalprice > 300000 THEN 'WARN' ELSE 'OK' END AS status FROM orders")
def g11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ct.status_of(F.col("o_totalprice"), 300000, 400000).alias("status"))


@query("g12_details_preview", "SELECT n, (SELECT string_agg(event_id::VARCHAR, '; ' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5)) || CASE WHEN n > 5 THEN '; ... +' || (n - 5) || ' more' ELSE '' END AS details FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error')")
def g12(spark, d):
    bad = table(spark, d, "events").filter("event_type = 'error'")
    return ct.preview(bad, F.col("event_id").cast("string"), F.col("event_id"))


@query("w06_first_violations", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5")
def w06(spark, d):
    return ct.first_per_group(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


def everything(spark: SparkSession, d: str) -> DataFrame:
    o = outbox(spark, d)
    base, s = stock(spark, d)
    tables = {"events": table(spark, d, "events"), "orders": table(spark, d, "orders")}
    return ct.run_all([ct.schema_check(spark, tables, TABLES), ct.payload_check(o, REQUIRED), ct.timestamp_check(o), ct.time_checks(o, AS_OF, LIMITS), ct.duplicate_check(o), ct.reconciliation_check(base, movements(spark, d), s)])


#: The rows of all twelve checks, from the SQL of each.
CHECKS = " UNION ALL ".join(f'SELECT "check", status, round(metric, 3) AS metric FROM ({ORACLE_SQL[k]})' for k in sorted(ORACLE_SQL) if k[:3] in {f"g{i:02d}" for i in range(1, 11)})


@query("g13_gate", f"SELECT count(*) FILTER (status = 'FAIL') = 0 AS passed, count(*)::INT AS checks FROM ({CHECKS})")
def g13(spark, d):
    return ct.gate(everything(spark, d)).select("passed", F.col("checks").cast("int").alias("checks"))


@query("g14_gauges", f"SELECT \"check\", CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END AS gauge FROM ({CHECKS})")
def g14(spark, d):
    return ct.gauges(everything(spark, d))


@query("v_check_statuses", CHECKS)
def v_statuses(spark, d):
    """Status and metric of each check; v_check_results has their details besides."""
    return everything(spark, d).select("check", "status", F.round("metric", 3).alias("metric"))
