"""Customer queries: orders stand for transactions, events for campaign events, customers for policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import features as fe
from .base import query, table

#: Amounts of the supplied orders are about a hundred times those the scores are made for.
SCALE, PROPENSITY_SCALE = 2_000_000.0, 250_000.0


def transactions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("txn_ts"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("channel"))


def customer_base(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return fe.customer_features(t, fe.anchor_of(t, "txn_ts"))


FEATURES = """
SELECT o_custkey AS customer, count(*) FILTER (o_orderdate >= a - INTERVAL 30 DAY) AS tx_count_30d,
  coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderdate >= a - INTERVAL 30 DAY), 0)::DOUBLE AS monetary_30d,
  count(DISTINCT o_orderpriority) AS product_diversity, count(*) FILTER (o_orderdate >= a - INTERVAL 7 DAY) AS velocity_7d,
  date_diff('day', max(o_orderdate)::DATE, any_value(a)::DATE) AS recency_days
FROM orders, (SELECT max(o_orderdate) AS a FROM orders) GROUP BY o_custkey"""
RISK = f"round(least(1.0, 0.08::DOUBLE * velocity_7d + 0.05::DOUBLE * product_diversity + monetary_30d / {SCALE}::DOUBLE), 3)"
PROPENSITY = f"round(1 / (1 + exp(-(-1.2::DOUBLE + monetary_30d / {PROPENSITY_SCALE}::DOUBLE + 0.18::DOUBLE * velocity_7d + 0.12::DOUBLE * product_diversity - 0.04::DOUBLE * recency_days))), 3)"


@query("a01_customer_features", FEATURES)
def a01(spark, d):
    return customer_base(spark, d)


def _recent(grain: str) -> str:
    ts = "o_orderdate::DATE" if grain == "date" else "o_orderdate"
    a = "a::DATE" if grain == "date" else "a"
    return f"""
SELECT o_custkey AS customer, count(*) AS tx_count_30d, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS monetary_30d, count(DISTINCT o_orderpriority) AS product_diversity,
  count(*) FILTER ({ts} >= {a} - INTERVAL 7 DAY) AS velocity_7d, date_diff('day', max(o_orderdate)::DATE, any_value(a)::DATE) AS recency_days
FROM orders, (SELECT max(o_orderdate) AS a FROM orders) WHERE {ts} >= {a} - INTERVAL 30 DAY GROUP BY o_custkey"""


@query("a02_recent_features_by_date", _recent("date"))
def a02(spark, d):
    t = transactions(spark, d)
    return fe.recent_features(t, fe.anchor_of(t, "txn_ts"))


@query("a03_recent_features_by_time", _recent("ts"))
def a03(spark, d):
    t = transactions(spark, d)
    return fe.recent_features(t, fe.anchor_of(t, "txn_ts"), by_date=False)


def campaign_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("customer"), F.col("ts").alias("event_ts"), F.col("event_type").alias("kind"))


ENGAGEMENT = """
SELECT user_id AS customer, sum((event_type = 'click')::INT) AS clicks_30d, sum((event_type = 'purchase')::INT) AS conversions_30d
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY user_id"""


@query("a04_campaign_engagement", ENGAGEMENT)
def a04(spark, d):
    e = campaign_events(spark, d)
    return fe.engagement(e, fe.anchor_of(e, "event_ts"))


@query("d01_customer_risk", f"SELECT *, {RISK} AS risk_score FROM ({FEATURES})")
def d01(spark, d):
    return fe.with_risk(customer_base(spark, d), SCALE)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Features with engagement; customers without any have zeros."""
    e = campaign_events(spark, d)
    seen = fe.engagement(e, fe.anchor_of(e, "event_ts"))
    return customer_base(spark, d).join(seen, "customer", "left").fillna(0, ["clicks_30d", "conversions_30d"])


ENRICHED = f"SELECT f.*, coalesce(clicks_30d, 0) AS clicks_30d, coalesce(conversions_30d, 0) AS conversions_30d FROM ({FEATURES}) f LEFT JOIN ({ENGAGEMENT}) e USING (customer)"


@query("j04_left_enrich", ENRICHED)
def j04(spark, d):
    return enriched(spark, d)


@query("p13_null_fill", f"SELECT customer, clicks_30d FROM ({ENRICHED})")
def p13(spark, d):
    return enriched(spark, d).select("customer", "clicks_30d")


POLICIES = """
SELECT c_custkey AS policy_id, c_custkey AS customer, DATE '1995-01-01' + (c_custkey % 900)::INT AS effective_date,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 4)::INT END AS claim_count_12m, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 120)::INT END AS renewal_due_days,
  abs(c_acctbal) AS premium_amount, CASE WHEN c_custkey % 11 = 0 THEN 'PENDING_RENEWAL' ELSE 'ACTIVE' END AS policy_status, c_mktsegment AS policy_type FROM customer"""


def policies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("policy_id"), k.alias("customer"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).alias("effective_date"),
        F.when(k % 7 != 0, (k % 4).cast("int")).alias("claim_count_12m"), F.when(k % 5 != 0, (k % 120).cast("int")).alias("renewal_due_days"),
        F.abs("c_acctbal").alias("premium_amount"), F.when(k % 11 == 0, "PENDING_RENEWAL").otherwise("ACTIVE").alias("policy_status"), F.col("c_mktsegment").alias("policy_type"),
    )


LAPSE = f"""
SELECT policy_id, customer, date_diff('day', effective_date, (SELECT max(o_orderdate) FROM orders)::DATE) AS tenure_days,
  round(least(1.0, 0.18::DOUBLE * coalesce(claim_count_12m, 0) + greatest(0.0, 60.0::DOUBLE - coalesce(renewal_due_days, 999)) / 120 + coalesce(premium_amount, 0) / 20000), 3) AS lapse_risk
FROM ({POLICIES})"""


@query("d02_policy_lapse_risk", LAPSE)
def d02(spark, d):
    return fe.policy_features(policies(spark, d), fe.anchor_of(table(spark, d, "orders"), "o_orderdate"))


SCORED = f"SELECT *, {PROPENSITY} AS propensity FROM ({FEATURES})"
BANDED = f"SELECT *, CASE WHEN propensity >= 0.72 THEN 'high' WHEN propensity >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM ({SCORED})"


@query("d03_propensity", SCORED)
def d03(spark, d):
    return fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE).drop("band")


@query("d04_risk_band", BANDED)
def d04(spark, d):
    return fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE)


#: Baselines of the drift check, at the scale of the supplied amounts.
BASELINES = (("monetary_30d", 90000.0), ("tx_count_30d", 0.5), ("product_diversity", 4.0), ("propensity", 0.38))
MEANS = " UNION ALL ".join(f"SELECT '{k}' AS feature, avg({k}::DOUBLE) AS mean FROM b" for k, _ in BASELINES)


def means(spark: SparkSession, d: str) -> DataFrame:
    rows = fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE)
    one = rows.agg(*[F.avg(F.col(k).cast("double")).alias(k) for k, _ in BASELINES])
    return one.unpivot([], [k for k, _ in BASELINES], "feature", "mean")


ROUNDED = "SELECT feature, round(mean, 4) AS mean FROM"


@query("a20_feature_means", f"WITH b AS ({BANDED}) {ROUNDED} ({MEANS})")
def a20(spark, d):
    return means(spark, d).withColumn("mean", F.round("mean", 4))


@query("p12_unpivot_metrics", f"WITH b AS ({BANDED}) SELECT feature, round(mean, 3) AS mean FROM ({MEANS})")
def p12(spark, d):
    return means(spark, d).select("feature", F.round("mean", 3).alias("mean"))


DRIFT = (
    f"WITH b AS ({BANDED}), m AS ({MEANS}), k(feature, baseline) AS (VALUES {', '.join(repr(x) for x in BASELINES)}) "
    "SELECT feature, round(mean, 4) AS mean, baseline::DOUBLE AS baseline, round(abs(mean - baseline) / baseline, 4) AS drift, "
    "CASE WHEN abs(mean - baseline) / baseline >= 0.5 THEN 'high' WHEN abs(mean - baseline) / baseline >= 0.25 THEN 'medium' ELSE 'low' END AS severity FROM m JOIN k USING (feature)"
)


@query("d05_feature_drift", DRIFT)
def d05(spark, d):
    base = spark.createDataFrame(list(BASELINES), "feature string, baseline double")
    return fe.drift(means(spark, d), base).withColumn("mean", F.round("mean", 4)).withColumn("drift", F.round("drift", 4))


RULES = (("CMP-A", 50000.0, "1-URGENT", None), ("CMP-B", 0.0, None, "2-HIGH"))


def held(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).groupBy("customer").agg(F.array_sort(F.collect_set("product")).alias("products"))


HELD = "SELECT o_custkey AS customer, list_sort(list(DISTINCT o_orderpriority)) AS products FROM orders GROUP BY 1"
ELIGIBLE = f"""
SELECT customer, campaign_id, monetary_30d >= min_m AND NOT coalesce(list_contains(products, excl), FALSE) AND NOT (req IS NOT NULL AND NOT list_contains(products, req)) AS eligible,
  CASE WHEN req IS NOT NULL AND NOT list_contains(products, req) THEN 'missing_required_product' WHEN coalesce(list_contains(products, excl), FALSE) THEN 'excluded_existing_product'
    WHEN monetary_30d < min_m THEN 'below_min_monetary' ELSE 'eligible' END AS reason
FROM ({FEATURES}) JOIN ({HELD}) USING (customer), (VALUES ('CMP-A', 50000.0, '1-URGENT', NULL), ('CMP-B', 0.0, NULL, '2-HIGH')) r(campaign_id, min_m, excl, req)"""


@query("a27_products_held", f"SELECT customer, array_to_string(products, ',') AS products FROM ({HELD})")
def a27(spark, d):
    return held(spark, d).withColumn("products", F.array_join("products", ","))


def eligible(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "campaign_id string, min_monetary_30d double, exclude_existing_product string, required_product string")
    return fe.eligibility(customer_base(spark, d), held(spark, d), rules)


@query("d06_campaign_eligibility", ELIGIBLE)
def d06(spark, d):
    return eligible(spark, d)


@query("j08_customers_by_rules", f"SELECT campaign_id, count(*) AS customers, count(*) FILTER (eligible) AS eligible FROM ({ELIGIBLE}) GROUP BY 1")
def j08(spark, d):
    return eligible(spark, d).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("customers"), F.count_if("eligible").alias("eligible"))


OWNERS = f"SELECT DISTINCT customer FROM ({POLICIES}) WHERE policy_type = '{{}}'"


@query(
    "d07_policy_eligibility",
    f"SELECT c_custkey AS customer, 'BUILDING_OFFER' AS campaign_id, b.customer IS NULL AND m.customer IS NOT NULL AS eligible FROM customer LEFT JOIN ({OWNERS.format('BUILDING')}) b ON c_custkey = b.customer LEFT JOIN ({OWNERS.format('MACHINERY')}) m ON c_custkey = m.customer "
    f"UNION ALL SELECT c_custkey, 'FURNITURE_OFFER', f.customer IS NOT NULL FROM customer LEFT JOIN ({OWNERS.format('FURNITURE')}) f ON c_custkey = f.customer",
)
def d07(spark, d):
    p = policies(spark, d)
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"))
    owns = lambda kind, name: p.filter(F.col("policy_type") == kind).select("customer").distinct().withColumn(name, F.lit(True))
    first = every.join(owns("BUILDING", "b"), "customer", "left").join(owns("MACHINERY", "m"), "customer", "left")
    first = first.select("customer", F.lit("BUILDING_OFFER").alias("campaign_id"), (F.col("b").isNull() & F.col("m").isNotNull()).alias("eligible"))
    second = every.join(owns("FURNITURE", "f"), "customer", "left").select("customer", F.lit("FURNITURE_OFFER").alias("campaign_id"), F.col("f").isNotNull().alias("eligible"))
    return first.unionByName(second)


@query("j05_has_orders", "SELECT c_custkey AS customer, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def j05(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = c["c_custkey"] == o["o_custkey"]
    rows = c.join(o, key, "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).unionByName(c.join(o, key, "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))
    return rows.withColumnRenamed("c_custkey", "customer")


@query("u02_distinct_keys", "SELECT DISTINCT o_custkey AS customer FROM orders")
def u02(spark, d):
    return transactions(spark, d).select("customer").distinct()


@query("u01_union_by_name", f"SELECT campaign_id, customer FROM ({ELIGIBLE}) WHERE eligible UNION ALL SELECT 'ALL', c_custkey FROM customer")
def u01(spark, d):
    some = eligible(spark, d).filter("eligible").select("customer", "campaign_id")
    return some.unionByName(table(spark, d, "customer").select(F.lit("ALL").alias("campaign_id"), F.col("c_custkey").alias("customer")))


@query("d08_rule_segments", f"SELECT customer, CASE WHEN monetary_30d >= 300000 AND velocity_7d >= 1 THEN 'high_value_active' WHEN recency_days <= 7 THEN 'recently_active' WHEN monetary_30d >= 150000 THEN 'high_value_slow' ELSE 'nurture' END AS segment FROM ({FEATURES})")
def d08(spark, d):
    f = customer_base(spark, d)
    m, v, r = F.col("monetary_30d"), F.col("velocity_7d"), F.col("recency_days")
    return f.select("customer", scores.rule_segment(m, v, r, 300000.0, 150000.0, 1).alias("segment"))


@query("a28_high_band_share", f"SELECT round(avg((band = 'high')::INT), 6) AS precision_at_20, count(*) AS rows_scored FROM ({BANDED})")
def a28(spark, d):
    rows = fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE)
    return rows.agg(F.round(F.avg((F.col("band") == "high").cast("double")), 6).alias("precision_at_20"), F.count(F.lit(1)).alias("rows_scored"))


@query("d15_model_run", f"SELECT 'propensity' AS model, 'v1' AS version, count(*) AS rows_scored, round(avg((band = 'high')::INT), 6) AS high_share, 0.81::DOUBLE AS stated_auc FROM ({BANDED})")
def d15(spark, d):
    """The AUC is stated by configuration, not computed."""
    return a28(spark, d).select(F.lit("propensity").alias("model"), F.lit("v1").alias("version"), "rows_scored", F.col("precision_at_20").alias("high_share"), F.lit(0.81).alias("stated_auc"))


RUN = "SELECT '{v}' AS version, count(*) AS rows_scored, round(avg((band = 'high')::INT), 6) AS high_share FROM ({b}) WHERE {w}"


@query("d15_model_runs", RUN.format(v="v2", b=BANDED, w="customer % 2 = 0") + " UNION ALL " + RUN.format(v="v1", b=BANDED, w="TRUE"))
def d15_runs(spark, d):
    """A run of all customers is recorded, then one of another version over half of them, then the first again, which replaces its row."""
    from ..operators.runs import ModelRuns
    from ..sources.layers import work_folder

    runs, run = ModelRuns(spark, work_folder(spark, "runs")), d15(spark, d)
    scored = fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE).filter("customer % 2 = 0")
    half = scored.agg(F.count(F.lit(1)).alias("rows_scored"), F.round(F.avg((F.col("band") == "high").cast("double")), 6).alias("high_share"))
    half = half.select(F.lit("propensity").alias("model"), F.lit("v2").alias("version"), "rows_scored", "high_share", F.lit(0.81).alias("stated_auc"))
    for number, rows in enumerate((run, half, run)):
        runs.record(rows, number)
    return runs.table().select("version", "rows_scored", "high_share")


@query("p15_lookback_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY")
def p15(spark, d):
    o = table(spark, d, "orders")
    return o.filter(fe.since(F.col("o_orderdate"), fe.anchor_of(o, "o_orderdate"), 30)).select("o_orderkey", "o_orderdate")


@query("j07_global_statistics", "SELECT o_orderkey, round(o_totalprice - m, 2) AS above_mean FROM orders, (SELECT avg(o_totalprice::DECIMAL(18,2)) AS m FROM orders)")
def j07(spark, d):
    """The aggregate is one row; it enters as a literal."""
    o = table(spark, d, "orders")
    mean = o.agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")).first()[0]
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - F.lit(mean), 2).alias("above_mean"))
