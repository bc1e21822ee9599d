"""Landing, bronze, keyed writes and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import quality as dq
from ..sources import clustering as cl
from ..sources import layers as ly
from .base import query, table
from .customers import BANDED, PROPENSITY_SCALE, customer_base
from ..operators import features as fe

EVENT_JSON = "SELECT event_id, user_id, event_type, props FROM events"
EVENT_SCHEMA = "event_id long, user_id long, event_type string, props string"


def _landed(spark: SparkSession, d: str) -> str:
    path = ly.work_folder(spark, "landing")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "props").write.json(path)
    return path


@query("s01_json_scan", EVENT_JSON)
def s01(spark, d):
    return ly.read_json(spark, _landed(spark, d), EVENT_SCHEMA)


@query("s02_json_scan_pinned", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s02(spark, d):
    """The schema is pinned to two columns; the rest of each line isn't read into rows."""
    return ly.read_json(spark, _landed(spark, d), "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s03_catalog_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s03(spark, d):
    df = table(spark, d, "nation")
    return ly.register(spark, "millrace_bronze", "nation", f"{d}/nation.parquet", df.schema).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


UUID5 = """
lower(substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || printf('%02x', ((('0x' || substr(h,17,2))::INT & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12))"""
SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"


def bronze(spark: SparkSession, d: str) -> DataFrame:
    """Two feeds in one envelope."""
    o = ly.envelope(table(spark, d, "orders"), "order", "crm", F.col("o_orderkey"), ["o_orderkey", "o_custkey", "o_orderstatus"])
    c = ly.envelope(table(spark, d, "customer"), "customer", "crm", F.col("c_custkey"), ["c_custkey", "c_name", "c_mktsegment"])
    return o.unionByName(c)


BRONZE_RAW = """
SELECT 'order' AS event_type, o_orderkey::VARCHAR AS idx, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload FROM orders
UNION ALL SELECT 'customer', c_custkey::VARCHAR, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' FROM customer"""


@query("s04_bronze_envelope", f"SELECT {UUID5} AS event_id, event_type, 'crm' AS source, payload FROM (SELECT *, {SHA.format("event_type || '|' || idx || '|' || payload")} AS h FROM ({BRONZE_RAW}))")
def s04(spark, d):
    return bronze(spark, d)


@query("s05_two_site_landing", f"SELECT {UUID5} AS event_id, event_type, source, payload FROM (SELECT *, {SHA.format("event_type || '|' || idx || '|' || payload")} AS h FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'east' ELSE 'west' END AS source, 'shift' AS event_type, row_number() OVER () AS r, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS idx, '{{\"l_partkey\":' || l_partkey || ',\"l_suppkey\":' || l_suppkey || ',\"l_linenumber\":' || l_linenumber || '}}' AS payload FROM lineitem))")
def s05(spark, d):
    rows = table(spark, d, "lineitem")
    idx = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    site = lambda name, rest: ly.envelope(rows.filter(F.col("l_linenumber") % 2 == rest), "shift", name, idx, ["l_partkey", "l_suppkey", "l_linenumber"])
    return site("east", 0).unionByName(site("west", 1))


@query("s06_payload_decode", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s06(spark, d):
    return ly.decode(bronze(spark, d), "order", "o_orderkey long, o_custkey long, o_orderstatus string").drop("event_id")


@query("s07_bronze_metadata", "SELECT n_nationkey, 'nation_feed' AS source_name, sha256(n_nationkey || '||' || n_name || '||' || n_regionkey) AS record_hash, TRUE AS has_file FROM nation")
def s07(spark, d):
    rows = ly.with_bronze_metadata(table(spark, d, "nation"), "nation_feed")
    return rows.select("n_nationkey", "source_name", "record_hash", F.col("source_file").contains("nation.parquet").alias("has_file"))


@query("s08_csv_export", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s08(spark, d):
    path = ly.work_folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").csv(path, header=True)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("business_date"))


@query("s09_partitioned_json", "SELECT business_date, count(*) AS n FROM (SELECT ts::DATE AS business_date FROM events) GROUP BY 1")
def s09(spark, d):
    path = ly.work_folder(spark, "json-by-date")
    ly.write_partitioned(_dated(spark, d), path, ["business_date"], "json")
    return spark.read.schema("event_id long, event_type string, business_date date").json(path).groupBy("business_date").agg(F.count(F.lit(1)).alias("n"))


@query("s10_partition_overwrite", "SELECT ts::DATE AS business_date, count(*) FILTER (ts::DATE <> (SELECT max(ts)::DATE FROM events) OR event_type = 'click') AS n FROM events GROUP BY 1 HAVING n > 0")
def s10(spark, d):
    """The last date is written again with clicks only; the other dates stay."""
    path, rows = ly.work_folder(spark, "silver"), _dated(spark, d)
    ly.write_partitioned(rows, path, ["business_date"])
    last = rows.agg(F.max("business_date")).first()[0]
    ly.write_partitioned(rows.filter((F.col("business_date") == F.lit(last)) & (F.col("event_type") == "click")), path, ["business_date"])
    return spark.read.parquet(path).groupBy("business_date").agg(F.count(F.lit(1)).alias("n"))


@query("s11_table_registration", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s11(spark, d):
    path, rows = ly.work_folder(spark, "registered"), table(spark, d, "customer")
    rows.write.parquet(path)
    return ly.register(spark, "millrace_silver", "customer", path, rows.schema).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("s12_compaction", "SELECT count(*) AS n, sum(o_orderkey) AS keys FROM orders")
def s12(spark, d):
    path = ly.work_folder(spark, "compact")
    ly.compact(spark, f"{d}/orders.parquet", path, "o_custkey", 4)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


CURVE_BITS = 6
_SHARES = ", ".join(f"{i}/{1 << CURVE_BITS}.0" for i in range(1, 1 << CURVE_BITS))
_RANKS = f"""WITH b AS (SELECT quantile_disc(o_custkey, [{_SHARES}]) AS ks, quantile_disc(o_orderdate, [{_SHARES}]) AS ds FROM orders),
r AS (SELECT o_orderkey, len(list_filter(list_distinct(ks), lambda x: x < o_custkey)) AS k, len(list_filter(list_distinct(ds), lambda x: x < o_orderdate)) AS t FROM orders, b)"""


@query("s12_curve_key", f"{_RANKS} SELECT o_orderkey, list_sum(list_transform(range({CURVE_BITS}), lambda i: (((k >> i) & 1) * 2 + ((t >> i) & 1)) << (2 * i)))::BIGINT AS curve_key FROM r")
def s12_curve(spark, d):
    """Ranks of customer and date among 64 ranges each, their bits in turn."""
    return cl.with_curve_key(table(spark, d, "orders"), ["o_custkey", "o_orderdate"], CURVE_BITS).select("o_orderkey", "curve_key")


@query("s12_clustered_lookups", "SELECT 'customer' AS lookup, o_orderkey FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'date', o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def s12_lookups(spark, d):
    """A table clustered by two columns serves lookups by either."""
    path = ly.work_folder(spark, "curve")
    cl.cluster(spark, f"{d}/orders.parquet", path, ["o_custkey", "o_orderdate"], 16, CURVE_BITS)
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("o_orderdate")).first()[0]
    by = lambda name, condition: rows.filter(condition).select(F.lit(name).alias("lookup"), "o_orderkey")
    return by("customer", F.col("o_custkey") == 42).unionByName(by("date", F.col("o_orderdate") == F.lit(last)))


@query("s20_point_lookup", "SELECT * FROM orders WHERE o_custkey = 42")
def s20(spark, d):
    path = ly.work_folder(spark, "lookup")
    ly.compact(spark, f"{d}/orders.parquet", path, "o_custkey", 4)
    return spark.read.parquet(path).filter("o_custkey = 42")


LATEST_ORDER = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query("s13_keyed_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def s13(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ly.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("s14_insert_if_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 2")
def s14(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return ly.insert_if_absent(c.filter("c_custkey % 3 <> 2"), c.withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("s15_serving_export", f"SELECT customer, monetary_30d, propensity, band, 'gold_batch' AS feature_source FROM ({BANDED})")
def s15(spark, d):
    scores = fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE)
    rows = customer_base(spark, d).join(scores.select("customer", "propensity", "band"), "customer", "left")
    return rows.select("customer", "monetary_30d", "propensity", "band", F.lit("gold_batch").alias("feature_source"))


@query("s16_field_merge", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment, c_name, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS online FROM customer")
def s16(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    update = c.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"), F.lit(1).alias("online"))
    return ly.merge_fields(c, update, "c_custkey")


@query("s19_generator", "SELECT product, count(*) AS n, sum(label) AS outliers, max(amount) AS most FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'CARD' WHEN 1 THEN 'INVESTMENT' WHEN 2 THEN 'TRAVEL_INSURANCE' ELSE 'PREMIUM_FINANCING' END AS product, (o_orderkey % 997 = 0)::INT AS label, CASE WHEN o_orderkey % 997 = 0 THEN 25000.0::DOUBLE END AS amount FROM orders) GROUP BY 1")
def s19(spark, d):
    rows = ly.generated_transactions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1500)
    return rows.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("outliers"), F.max(F.when(F.col("label") == 1, F.col("amount"))).alias("most"))


NORMAL = "regexp_replace(upper(c_name), '[^\\p{L}\\p{N}]', '', 'g')"


@query("p01_identifier_normalise", f"SELECT c_custkey, upper(trim(' ' || lower(c_mktsegment) || ' ')) AS id_type, {NORMAL} AS id_value FROM customer")
def p01(spark, d):
    kind = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", nz.id_type(kind).alias("id_type"), nz.id_value(F.col("c_name")).alias("id_value"))


@query("p02_identity_label", f"SELECT c_custkey, c_mktsegment || '_' || substr(sha1(c_mktsegment || '|' || {NORMAL}), 1, 12) AS label, sha256(c_mktsegment || '|' || {NORMAL}) AS identity_key FROM customer")
def p02(spark, d):
    k, v = F.col("c_mktsegment"), F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", nz.identity_label(k, v).alias("label"), nz.identity_key(k, v).alias("identity_key"))


@query("p03_stable_id", f"SELECT c_custkey, {UUID5} AS id FROM (SELECT c_custkey, {SHA.format("'customer|' || c_custkey")} AS h FROM customer)")
def p03(spark, d):
    return table(spark, d, "customer").select("c_custkey", nz.stable_id(F.lit("customer"), F.col("c_custkey").cast("string")).alias("id"))


@query("p04_name_normalise", "SELECT p_partkey, trim(regexp_replace(regexp_replace(upper('  ' || p_name || ' -- ' || p_type), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def p04(spark, d):
    return table(spark, d, "part").select("p_partkey", nz.person_name(F.concat(F.lit("  "), "p_name", F.lit(" -- "), "p_type")).alias("name"))


@query("p05_contact_normalise", "SELECT c_custkey, regexp_replace(upper(trim(' ' || c_name || '@Example.com ')), '[^A-Z0-9@.]', '', 'g') AS contact FROM customer")
def p05(spark, d):
    return table(spark, d, "customer").select("c_custkey", nz.contact(F.concat(F.lit(" "), "c_name", F.lit("@Example.com "))).alias("contact"))


@query("p07_validity_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 0 AND l_discount BETWEEN 0 AND 0.05 AND l_shipdate IS NOT NULL")
def p07(spark, d):
    ok = (F.col("l_quantity") > 0) & F.col("l_discount").between(0, 0.05) & F.col("l_shipdate").isNotNull()
    return table(spark, d, "lineitem").filter(ok).select("l_orderkey", "l_linenumber", "l_quantity")


ORDER_ISSUE = "CASE WHEN o_custkey % 10 = 0 THEN 'unmapped_identity' WHEN o_totalprice < 1500 THEN 'invalid_amount' WHEN o_orderstatus NOT IN ('O', 'F', 'P') THEN 'invalid_status' END"


def checked_orders(spark: SparkSession, d: str) -> DataFrame:
    rules = [("unmapped_identity", F.col("o_custkey") % 10 == 0), ("invalid_amount", F.col("o_totalprice") < 1500), ("invalid_status", ~F.col("o_orderstatus").isin("O", "F", "P"))]
    return table(spark, d, "orders").withColumn("issue_type", dq.first_failing(rules))


@query("p08_first_failing_rule", f"SELECT o_orderkey, {ORDER_ISSUE} AS issue_type FROM orders")
def p08(spark, d):
    return checked_orders(spark, d).select("o_orderkey", "issue_type")


REJECTS = f"SELECT 'orders' AS source, o_custkey::VARCHAR AS entity_id, {ORDER_ISSUE} AS issue_type, o_orderdate AS event_ts FROM orders"


@query("p09_rejects", f"SELECT *, sha256(source || '|' || entity_id || '|' || issue_type) AS reject_id FROM ({REJECTS}) WHERE issue_type IS NOT NULL")
def p09(spark, d):
    return dq.rejects(checked_orders(spark, d), "orders", F.col("o_custkey"), F.col("issue_type"), F.col("o_orderdate"))


@query("p10_issue_records", f"SELECT source, entity_id, issue_type, times, {UUID5} AS issue_id FROM (SELECT *, {SHA.format("'silver|' || entity_id || '|' || issue_type")} AS h FROM (SELECT source, entity_id, issue_type, count(*) AS times FROM ({REJECTS}) WHERE issue_type IS NOT NULL GROUP BY ALL))")
def p10(spark, d):
    rows = dq.rejects(checked_orders(spark, d), "orders", F.col("o_custkey"), F.col("issue_type"), F.col("o_orderdate"))
    return dq.issues(rows, "silver")


@query("p11_ratio_clamp", "SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, least(1.25::DOUBLE, l_quantity / 30)) AS share FROM lineitem")
def p11(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nz.clamp(F.col("l_quantity") / 30, 0.0, 1.25).alias("share"))


@query("p14_enum_pick", "SELECT c_custkey, ['APP', 'WEB', 'BRANCH'][c_custkey % 3 + 1] AS channel FROM customer")
def p14(spark, d):
    return table(spark, d, "customer").select("c_custkey", nz.pick(["APP", "WEB", "BRANCH"], F.col("c_custkey")).alias("channel"))


@query("a24_key_dedup", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) = 1")
def a24(spark, d):
    order = [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    return dq.latest_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("w03_last_write_wins", LATEST_ORDER)
def w03(spark, d):
    return dq.latest_by(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("a25_first_survivor", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50, c_custkey) = 1")
def a25(spark, d):
    rows = table(spark, d, "customer").withColumn("seen", F.col("c_custkey") % 50)
    return dq.survivor(rows.withColumn("arrival", F.col("c_custkey")), "c_nationkey", "seen", "arrival", ["c_custkey", "c_name"])


@query("u03_missing_fields", "SELECT event_id, CASE event_type WHEN 'click' THEN 'page' WHEN 'purchase' THEN 'amount,currency' ELSE '' END AS missing FROM events")
def u03(spark, d):
    required = {"click": ["k", "page"], "purchase": ["amount", "currency", "k"]}
    rows = table(spark, d, "events")
    return rows.select("event_id", F.array_join(dq.missing_fields(F.col("props"), required, F.col("event_type")), ",").alias("missing"))


@query("a12_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events")))
def a12(spark, d):
    out = None
    for t in ("customer", "orders", "lineitem", "events"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
