"""Stream queries: the events table read as a stream of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import layers as ly
from ..streaming import cdc, late, merge, segments
from .base import query, table
from .customers import FEATURES, customer_base

RAW = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def change_events(spark: SparkSession, d: str, stream: bool) -> DataFrame:
    """Purchases are orders, clicks are cart events; every tenth user has no key of its own, and every hundredth none at all."""
    # a stream reads a folder or a pattern, and the table may be a single file
    rows = spark.readStream.schema(RAW).parquet(f"{d}/events.parquet*") if stream else table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "orders").when(F.col("event_type") == "click", "cart_events")
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    after = F.struct(F.lit("USER").alias("id_type"), F.col("user_id").cast("string").alias("id_value"), F.get_json_object("props", "$.k").alias("product"), key.alias("unified_customer_key"), F.col("value").alias("amount"))
    return rows.select(F.col("event_id").cast("string").alias("event_id"), kind.alias("table"), F.lit("c").alias("op"), F.col("ts").cast("timestamp").alias("event_ts"), after.alias("after")).filter("table IS NOT NULL")


def bridge(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct().filter("user_id % 100 <> 0")
    return users.select(F.lit("USER").alias("id_type"), F.col("user_id").cast("string").alias("id_value"), F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("bridge_key"))


def keyed(spark: SparkSession, d: str, stream: bool) -> DataFrame:
    rows = cdc.resolved(change_events(spark, d, stream), bridge(spark, d))
    return rows.select("event_id", "table", "op", "event_ts", "customer", F.col("after.product").alias("product"), F.col("after.amount").alias("amount"))


KEYED = "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'orders' ELSE 'cart_events' END AS kind, ts, CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR WHEN user_id % 100 <> 0 THEN 'B' || user_id END AS customer, json_extract_string(props, '$.k') AS product, value FROM events WHERE event_type IN ('purchase', 'click')"
SUMS = "count(*) FILTER (kind = 'orders') AS orders, coalesce(sum(value::DECIMAL(18,2)) FILTER (kind = 'orders'), 0)::DOUBLE AS order_amount, count(*) FILTER (kind = 'cart_events') AS carts, coalesce(sum(value::DECIMAL(18,2)) FILTER (kind = 'cart_events'), 0)::DOUBLE AS cart_value, arg_max(product, (ts, event_id::VARCHAR)) AS last_product"
ALL_TIME = f"SELECT customer, {SUMS} FROM ({KEYED}) WHERE customer IS NOT NULL GROUP BY 1"
PICKED = ["customer", "orders", "order_amount", "carts", "cart_value", "last_product"]


@query("t01_daily_stream_features", f"SELECT customer, strftime(ts, '%Y-%m-%d') AS day, {SUMS} FROM ({KEYED}) WHERE customer IS NOT NULL GROUP BY ALL")
def t01(spark, d):
    out = cdc.into_table(spark, cdc.features(keyed(spark, d, True)), ["window_start", "customer"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *PICKED)


@query("t02_last_product", f"SELECT customer, last_product FROM ({ALL_TIME})")
def t02(spark, d):
    return cdc.into_table(spark, cdc.features(keyed(spark, d, True), None), ["customer"]).select("customer", "last_product")


@query("t03_unresolved_events", f"SELECT count(*) AS n, count(*) AS observed, (SELECT count(*) FROM ({KEYED})) AS events FROM ({KEYED}) WHERE customer IS NULL")
def t03(spark, d):
    """Unresolved events go to a sink of their own and are counted as they pass; the stream goes on."""
    sink = cdc.UnresolvedSink(spark, ly.work_folder(spark, "unresolved"), ["event_id"])
    cdc.run_available(keyed(spark, d, True).select("event_id", "table", "customer"), sink, ly.work_folder(spark, "checkpoint"), "append")
    total = lambda k: F.lit(sum(c[k] for c in sink.counts.values())).cast("long")
    return sink.table().agg(F.count(F.lit(1)).alias("n")).withColumn("observed", total("unresolved")).withColumn("events", total("events"))


@query("t04_key_resolution", f"SELECT event_id::VARCHAR AS event_id, customer FROM ({KEYED})")
def t04(spark, d):
    sink = cdc.VersionedSink(spark, ly.work_folder(spark, "resolved"), ["event_id"])
    cdc.run_available(keyed(spark, d, True).select("event_id", "customer"), sink, ly.work_folder(spark, "checkpoint"), "append")
    return sink.table().select("event_id", "customer")


@query("t05_op_code_ignored", f"SELECT customer, orders FROM ({ALL_TIME})")
def t05(spark, d):
    """Updates count again, whatever their op code: the plain mode. latest_versions is the other."""
    rows = keyed(spark, d, False).withColumn("op", F.when(F.col("event_id").cast("long") % 3 == 0, "u").otherwise("c"))
    return cdc.features(rows, None).select("customer", "orders")


@query("t06_stream_dedup", f"SELECT customer, orders, carts FROM ({ALL_TIME})")
def t06(spark, d):
    """Every event comes twice."""
    rows = keyed(spark, d, True).withColumn("_", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_")
    return cdc.into_table(spark, cdc.features(rows, None), ["customer"]).select("customer", "orders", "carts")


SERVED = f"SELECT coalesce(g.customer, r.customer) AS customer, monetary_30d, orders, carts FROM (SELECT customer::VARCHAR AS customer, monetary_30d FROM ({FEATURES})) g FULL JOIN ({ALL_TIME}) r ON g.customer = r.customer"


@query("t07_micro_batch_upsert", SERVED)
def t07(spark, d):
    realtime = cdc.into_table(spark, cdc.features(keyed(spark, d, True), None), ["customer"]).select("customer", "orders", "carts")
    gold = customer_base(spark, d).select(F.col("customer").cast("string").alias("customer"), "monetary_30d")
    return cdc.serve(gold, realtime)


@query("t08_rocksdb_state", f"SELECT customer, orders, carts FROM ({ALL_TIME})")
def t08(spark, d):
    return cdc.into_table(spark, cdc.features(keyed(spark, d, True), None), ["customer"], rocksdb=True).select("customer", "orders", "carts")


MERGED = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'"


@query("t09_cdc_merge", MERGED)
def t09(spark, d):
    """Errors stand for deletes."""
    rows = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u"))
    return cdc.latest_versions(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("t09_stream_merge", MERGED)
def t09_stream(spark, d):
    """The same rows by a stream that merges each batch."""
    events = spark.readStream.schema(RAW).parquet(f"{d}/events.parquet*")
    sink = cdc.MergeSink(spark, ly.work_folder(spark, "merged"), "user_id", "ts", "event_id")
    cdc.run_available(events.withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u")), sink, ly.work_folder(spark, "checkpoint"), "append")
    return sink.table().select("user_id", "event_id", "event_type")


@query("t09_stateful_merge", MERGED)
def t09_stateful(spark, d):
    """The same rows by a stream with state: it knows of each user the newest version, so that only newer ones reach the table."""
    events = spark.readStream.schema(RAW).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    changes = events.withColumn("op", F.when(F.col("event_type") == "error", "d").otherwise("u"))
    out = merge.merged(spark, changes, ly.work_folder(spark, "merged"), ly.work_folder(spark, "checkpoint"), "user_id", "ts", "event_id")
    return out.select("user_id", "event_id", "event_type")


@query("t10_lateness", "SELECT CASE WHEN l <= 60 THEN 'up to 60 s' WHEN l <= 300 THEN 'up to 300 s' WHEN l <= 3600 THEN 'up to 3600 s' WHEN l <= 86400 THEN 'up to 86400 s' ELSE 'over 86400 s' END AS bucket, count(*) AS n FROM (SELECT floor(value * 20)::BIGINT AS l FROM events) GROUP BY 1")
def t10(spark, d):
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").select(F.timestamp_seconds(F.unix_seconds(ts)).alias("event_ts"), F.timestamp_seconds(F.unix_seconds(ts) + F.floor(F.col("value") * 20)).alias("ingest_ts"))
    return cdc.lateness(rows, "event_ts", "ingest_ts")


LATE = "WITH b AS (SELECT event_id, epoch_us(ts) AS us, event_id % 3 AS batch FROM events), m AS (SELECT n.batch, max(b.us) AS latest FROM (SELECT unnest(range(3)) AS batch) n LEFT JOIN b ON b.batch < n.batch GROUP BY 1) SELECT event_id, coalesce(us < latest - 86400000000, FALSE) AS late FROM b JOIN m USING (batch)"


@query("t10_late_rows", LATE)
def t10_late(spark, d):
    """Events come in three batches, each through a restart: those a day behind the latest event before their batch are kept apart."""
    rows = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    log = ly.work_folder(spark, "log")
    sink, checkpoint = late.LateSplit(spark, ly.work_folder(spark, "late"), "ts", 86400), ly.work_folder(spark, "checkpoint")
    for batch in range(3):
        segments.append(rows.filter(F.col("event_id") % 3 == batch), log, ly.work_folder(spark, "staging"))
        events = segments.decoded_log(segments.log(spark, log), "event_id long, us long")
        cdc.run_available(events.select("event_id", F.timestamp_micros("us").alias("ts")), sink, checkpoint, "append")
    return sink.on_time().select("event_id", F.lit(False).alias("late")).unionByName(sink.late().select("event_id", F.lit(True).alias("late")))


@query("t11_batch_stream_view", f"SELECT customer, monetary_30d IS NOT NULL AS in_batch, orders IS NOT NULL AS in_stream FROM ({SERVED})")
def t11(spark, d):
    return t07(spark, d).select("customer", F.col("monetary_30d").isNotNull().alias("in_batch"), F.col("orders").isNotNull().alias("in_stream"))


@query("d13_intent", f"SELECT customer, round(least(1.0, 0.18::DOUBLE * carts + 0.25::DOUBLE * orders + order_amount / 5000), 3) AS intent FROM ({ALL_TIME})")
def d13(spark, d):
    return cdc.features(keyed(spark, d, False), None).select("customer", "intent")


def _replayed(spark: SparkSession, d: str) -> str:
    path = ly.work_folder(spark, "cdc")
    change_events(spark, d, False).write.json(path)
    return path


@query("s18_cdc_replay", f"SELECT kind AS table_name, count(*) AS n FROM ({KEYED}) GROUP BY 1")
def s18(spark, d):
    return cdc.json_replay(spark, _replayed(spark, d)).groupBy(F.col("table").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))


@query("s17_cdc_stream_source", f"SELECT event_id::VARCHAR AS event_id, kind AS table_name FROM ({KEYED})")
def s17(spark, d):
    """A broker's topic is replaced by files of its values; kafka_source decodes records by the same step."""
    sink = cdc.VersionedSink(spark, ly.work_folder(spark, "topic"), ["event_id"])
    records = spark.readStream.text(_replayed(spark, d)).select(F.encode("value", "UTF-8").alias("value"))
    cdc.run_available(cdc.decoded(records).select("event_id", F.col("table").alias("table_name")), sink, ly.work_folder(spark, "checkpoint"), "append")
    return sink.table()


@query("s17_offset_source", f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id::VARCHAR AS event_id FROM ({KEYED})")
def s17_offsets(spark, d):
    """Events from log segments by offset, in two runs; the second takes up where the first stopped. A place is the rank of an offset."""
    log, checkpoint = ly.work_folder(spark, "log"), ly.work_folder(spark, "checkpoint")
    rows = change_events(spark, d, False).select("event_id", F.col("event_id").cast("long").alias("n"))
    half = rows.agg(F.percentile_approx("n", 0.5)).first()[0]
    sink = cdc.VersionedSink(spark, ly.work_folder(spark, "topic"), ["offset"])
    for part in (F.col("n") <= half, F.col("n") > half):
        segments.append(rows.filter(part).repartitionByRange(2, "n").sortWithinPartitions("n").select("event_id"), log, ly.work_folder(spark, "staging"))
        cdc.run_available(segments.decoded_log(segments.log(spark, log), "event_id string"), sink, checkpoint, "append")
    return sink.table().select(F.col("offset").alias("place"), "event_id")
