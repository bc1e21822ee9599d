"""Order queries: reads of the order system, history, dimensions, snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import money
from ..operators import orders as od
from ..operators import quality as dq
from .base import query, table


@query("a13_status_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a13(spark, d):
    return od.status_histogram(table(spark, d, "orders"), "o_orderstatus")


@query("a14_captured_revenue", "SELECT coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS revenue FROM orders")
def a14(spark, d):
    o = table(spark, d, "orders")
    return od.captured_revenue(o, F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") == "F").select(F.col("revenue").cast("double").alias("revenue"))


@query("a15_stock_totals", "SELECT count(*) AS skus, sum(p_size) AS units FROM part")
def a15(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("skus"), F.sum("p_size").alias("units"))


@query("p16_optional_filter", "SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def p16(spark, d):
    """A filter that is there only if its parameter is."""
    c, segment, nation = table(spark, d, "customer"), "building", None
    if segment:
        c = c.filter(F.upper("c_mktsegment") == segment.upper())
    if nation is not None:
        c = c.filter(F.col("c_nationkey") == nation)
    return c.select("c_custkey")


@query("p18_expired_reservations", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-01-01'")
def p18(spark, d):
    """The limit is moved to the literal side, so that the scan can skip files."""
    as_of = datetime(1998, 1, 1)
    late = F.col("o_orderdate") <= F.lit(as_of) - F.expr("INTERVAL 30 DAYS")
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & late).select("o_orderkey")


LINES = "SELECT l_orderkey, upper(trim(' sku-' || (l_partkey % 5) || ' ')) AS sku, sum(l_quantity) AS qty FROM lineitem WHERE l_partkey % 5 <> 4 AND l_quantity > 2 GROUP BY ALL"


@query("p19_order_lines", LINES)
def p19(spark, d):
    l = table(spark, d, "lineitem")
    sku = F.when(F.col("l_partkey") % 5 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" sku-"), (F.col("l_partkey") % 5).cast("string"), F.lit(" ")))
    orders = l.groupBy("l_orderkey").agg(F.collect_list(F.struct(sku.alias("sku"), F.when(F.col("l_quantity") > 2, F.col("l_quantity")).otherwise(0).alias("qty"))).alias("items"))
    return od.merged_lines(orders, "l_orderkey", "items")


@query("p20_money", "SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT / 100)::DOUBLE AS total FROM orders")
def p20(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders").select("o_orderkey", money(cents).cast("double").alias("total"))


@query("j02_fact_dimension", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j02(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("j03_three_way_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j03(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    history = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("event"))
    return od.documents(o, "o_orderkey", {"items": items, "history": history})


@query("j12_order_documents", "SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS items, coalesce(n, 0) AS history, coalesce(first_part, -1) AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def j12(spark, d):
    rows = order_documents(spark, d)
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).alias(c)
    return rows.withColumn("items", F.coalesce("items", F.array().cast(rows.schema["items"].dataType))).withColumn("history", F.coalesce("history", F.array().cast(rows.schema["history"].dataType))).select("o_orderkey", "o_orderstatus", n("items"), n("history"), F.coalesce(F.get("items", F.lit(0))["l_partkey"], F.lit(-1)).alias("first_part"))


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """Status facts of each user: the events in order of time."""
    return table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))


HISTORY = "SELECT user_id, event_id AS seq, lag(event_type) OVER w AS from_status, event_type AS to_status, epoch_us(lead(ts) OVER w) // 1000000 - epoch_us(ts) // 1000000 AS dwell_seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("w04_status_history", HISTORY)
def w04(spark, d):
    return od.transitions(statuses(spark, d), "user_id", "status", "ts", "event_id").drop("at")


@query("w05_illegal_transitions", f"SELECT user_id, seq FROM ({HISTORY}) WHERE NOT coalesce((from_status IS NULL AND to_status = 'signup') OR (from_status = 'signup' AND to_status = 'view') OR (from_status = 'view' AND to_status = 'click') OR (from_status = 'click' AND to_status = 'purchase'), FALSE)")
def w05(spark, d):
    allowed = [(None, "signup"), ("signup", "view"), ("view", "click"), ("click", "purchase")]
    return od.illegal_transitions(od.transitions(statuses(spark, d), "user_id", "status", "ts", "event_id"), allowed).select("user_id", "seq")


@query("o01_mixed_order", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey")
def o01(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy(F.desc("c_nationkey"), F.asc("c_acctbal"), "c_custkey")


SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query("o02_severity_order", f"SELECT o_orderkey, {SEVERITY} AS rank FROM orders ORDER BY rank, o_orderkey")
def o02(spark, d):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).otherwise(3)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("rank")).orderBy("rank", "o_orderkey")


@query("o03_issue_severity_order", "SELECT o_orderkey, severity FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM orders) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderkey")
def o03(spark, d):
    """By rank; sorting the words themselves would put low before high."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("severity"))
    return rows.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "o_orderkey")


@query("o04_latest_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def o04(spark, d):
    """A top-k report."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


def owner_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each customer: the priority of its orders, in order of time."""
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("ts"))


CHANGES = "SELECT o_custkey, o_orderpriority, o_orderdate, lag(o_orderpriority) OVER w AS b, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
VERSIONS = f"SELECT o_custkey, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM ({CHANGES}) WHERE b IS NULL OR b <> o_orderpriority"


def customer_versions(spark: SparkSession, d: str) -> DataFrame:
    return od.versions(owner_changes(spark, d), "o_custkey", "ts", ["o_orderpriority"], "o_orderkey")


@query("x01_dimension_versions", f"SELECT o_custkey, o_orderpriority, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, valid_to IS NULL AS is_current FROM ({VERSIONS})")
def x01(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return customer_versions(spark, d).select("o_custkey", "o_orderpriority", day("valid_from"), day("valid_to"), "is_current")


@query("x01_dimension_batches", f"SELECT o_custkey, o_orderpriority, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, valid_to IS NULL AS is_current FROM ({VERSIONS})")
def x01_batches(spark, d):
    """The same versions from three batches of changes that come out of order, one of them twice."""
    from ..operators.dimensions import Dimension
    from ..sources import layers as ly

    changes = owner_changes(spark, d)
    dim = Dimension(spark, ly.work_folder(spark, "dimension"), "o_custkey", "ts", "o_orderkey", ["o_orderpriority"], changes.schema, buckets=8)
    for number, part in enumerate((2, 0, 1, 1)):
        dim.apply(changes.filter(F.col("o_orderkey") % 3 == part), min(number, 2))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return dim.table().select("o_custkey", "o_orderpriority", day("valid_from"), day("valid_to"), "is_current")


@query("x02_dimension_overwrite", "SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def x02(spark, d):
    return dq.latest_by(owner_changes(spark, d), ["o_custkey"], [F.desc("ts"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority")


@query("j13_as_of_join", f"SELECT o.o_orderkey, v.o_orderpriority AS priority_then FROM orders o LEFT JOIN ({VERSIONS}) v ON o.o_custkey = v.o_custkey AND v.valid_from <= o.o_orderdate AND (v.valid_to IS NULL OR o.o_orderdate < v.valid_to)")
def j13(spark, d):
    facts = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return od.as_of(facts, "o_custkey", "ts", customer_versions(spark, d)).select("o_orderkey", F.col("o_orderpriority").alias("priority_then"))


@query("x03_daily_snapshot", "WITH m AS (SELECT user_id, ts::DATE AS day, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) AS change FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM m GROUP BY user_id) SELECT user_id, day, 100 + sum(coalesce(change, 0)) OVER (PARTITION BY user_id ORDER BY day) AS stock FROM s LEFT JOIN m USING (user_id, day)")
def x03(spark, d):
    moves = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "purchase", -1).otherwise(1).alias("q"))
    return od.daily_snapshot(moves, "user_id", "day", "q", moves.select("user_id").distinct().withColumn("base", F.lit(100)))


@query("x04_funnel", "SELECT user_id, epoch_us(min(ts) FILTER (event_type = 'purchase')) // 1000000 - epoch_us(min(ts) FILTER (event_type = 'view')) // 1000000 AS cycle_seconds FROM events GROUP BY 1")
def x04(spark, d):
    return od.funnel(statuses(spark, d), "user_id", "status", "ts", ["view", "click", "purchase"]).select("user_id", "cycle_seconds")


@query("x05_idempotent_facts", "SELECT event_id, user_id FROM events")
def x05(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return dq.latest_by(e.unionByName(e), ["event_id"], [F.desc("ts")]).select("event_id", "user_id")


@query("x06_replay_safe_load", "SELECT ts::DATE AS business_date, count(*) AS n FROM events GROUP BY 1")
def x06(spark, d):
    """The same batch loaded twice leaves one copy: its partitions are overwritten."""
    from ..sources import layers as ly

    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("business_date"))
    path = ly.work_folder(spark, "replay")
    for _ in range(2):
        ly.write_partitioned(rows, path, ["business_date"])
    return spark.read.parquet(path).groupBy("business_date").agg(F.count(F.lit(1)).alias("n"))


@query("x11_shift_minutes", "WITH i AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS e FROM events), x AS (SELECT user_id, s, e, unnest(range(s // 43200 * 43200, (e - 1) // 43200 * 43200 + 1, 43200)) AS b FROM i WHERE e > s) SELECT user_id, b AS shift, round(sum(least(e, b + 43200) - greatest(s, b)) / 60.0, 3) AS minutes FROM x GROUP BY ALL")
def x11(spark, d):
    h = od.transitions(statuses(spark, d), "user_id", "status", "ts", "event_id").filter("dwell_seconds > 0")
    whole = F.timestamp_seconds(F.unix_seconds("at"))
    rows = h.select("user_id", whole.alias("s"), F.timestamp_seconds(F.unix_seconds("at") + F.col("dwell_seconds")).alias("e"))
    out = od.shift_minutes(rows, ["user_id"], "s", "e")
    return out.select("user_id", F.unix_seconds("shift_start").alias("shift"), F.round("minutes", 3).alias("minutes"))
