"""Customer and policy features, scores, eligibility and drift.

Transactions have the columns customer, txn_ts, amount, product. Anchors are literals, so that filters reach the scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import customer_risk, drift_band, lapse_risk, propensity, risk_band


def anchor_of(df: DataFrame, column: str) -> datetime | None:
    """The latest timestamp; one aggregate, taken from Parquet where it can be."""
    return df.agg(F.max(column)).first()[0]


def since(ts: Column, anchor: datetime, days: int) -> Column:
    return ts >= F.lit(anchor) - F.expr(f"INTERVAL {days} DAYS")


def money_sum(amount: Column) -> Column:
    """Sums in decimal: the same whatever the order of rows."""
    return F.sum(amount.cast("decimal(18,2)"))


def customer_features(txns: DataFrame, anchor: datetime, days: int = 30, short_days: int = 7) -> DataFrame:
    """All customers with any transaction; idle ones have zeros. Diversity counts all history. One shuffle."""
    recent, latest = since(F.col("txn_ts"), anchor, days), since(F.col("txn_ts"), anchor, short_days)
    out = txns.groupBy("customer").agg(
        F.max("txn_ts").alias("last_ts"),
        F.count_if(recent).alias("tx_count_30d"),
        F.coalesce(money_sum(F.when(recent, F.col("amount"))), F.lit(0)).cast("double").alias("monetary_30d"),
        F.countDistinct("product").alias("product_diversity"),
        F.count_if(latest).alias("velocity_7d"),
    )
    return out.withColumn("recency_days", F.datediff(F.lit(anchor), F.col("last_ts"))).drop("last_ts")


def recent_features(txns: DataFrame, anchor: datetime, days: int = 30, short_days: int = 7, by_date: bool = True) -> DataFrame:
    """Only customers with a transaction in the window; at date grain, or at timestamp grain and then without rounding."""
    ts = F.to_date("txn_ts") if by_date else F.col("txn_ts")
    edge = lambda n: (F.date_sub(F.lit(anchor).cast("date"), n) if by_date else F.lit(anchor) - F.expr(f"INTERVAL {n} DAYS"))
    out = txns.filter(ts >= edge(days)).groupBy("customer").agg(
        F.max("txn_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("tx_count_30d"),
        money_sum(F.col("amount")).cast("double").alias("monetary_30d"),
        F.countDistinct("product").alias("product_diversity"),
        F.count_if(ts >= edge(short_days)).alias("velocity_7d"),
    )
    return out.withColumn("recency_days", F.datediff(F.lit(anchor), F.col("last_ts"))).drop("last_ts")


def engagement(events: DataFrame, anchor: datetime, days: int = 30) -> DataFrame:
    """Clicks and conversions of each customer; events (customer, event_ts, kind)."""
    return events.filter(since(F.col("event_ts"), anchor, days)).groupBy("customer").agg(
        F.sum(F.when(F.col("kind") == "click", 1).otherwise(0)).alias("clicks_30d"),
        F.sum(F.when(F.col("kind") == "purchase", 1).otherwise(0)).alias("conversions_30d"),
    )


def with_risk(features: DataFrame, monetary_scale: float = 10000.0) -> DataFrame:
    clicks = F.col("clicks_30d") if "clicks_30d" in features.columns else None
    return features.withColumn("risk_score", customer_risk(F.col("velocity_7d"), F.col("product_diversity"), F.col("monetary_30d"), clicks, monetary_scale))


def with_propensity(features: DataFrame, monetary_scale: float = 2500.0) -> DataFrame:
    score = propensity(F.col("monetary_30d"), F.col("velocity_7d"), F.col("product_diversity"), F.col("recency_days"), monetary_scale)
    return features.withColumn("propensity", score).withColumn("band", risk_band(F.col("propensity")))


def policy_features(policies: DataFrame, anchor: datetime) -> DataFrame:
    return policies.select(
        "policy_id", "customer", F.datediff(F.lit(anchor), F.col("effective_date")).alias("tenure_days"),
        lapse_risk(F.col("claim_count_12m"), F.col("renewal_due_days"), F.col("premium_amount")).alias("lapse_risk"),
    )


def eligibility(features: DataFrame, held: DataFrame, rules: DataFrame) -> DataFrame:
    """Every customer against every campaign rule (a small table of configuration).

    A later reason overrides an earlier one; low spend alone has a reason of its own.
    held (customer, products). The rules' size is their number, fixed by configuration, whatever the data.
    """
    rows = features.join(held, "customer", "left").crossJoin(F.broadcast(rules))
    products = F.coalesce("products", F.array().cast("array<string>"))
    enough = F.col("monetary_30d") >= F.col("min_monetary_30d")
    excluded = F.coalesce(F.array_contains(products, F.col("exclude_existing_product")), F.lit(False))
    missing = F.col("required_product").isNotNull() & ~F.coalesce(F.array_contains(products, F.col("required_product")), F.lit(False))
    reason = F.when(missing, "missing_required_product").when(excluded, "excluded_existing_product").when(~enough, "below_min_monetary").otherwise("eligible")
    return rows.select("customer", "campaign_id", (enough & ~excluded & ~missing).alias("eligible"), reason.alias("reason"))


def drift(means: DataFrame, baselines: DataFrame) -> DataFrame:
    """means (feature, mean) against baselines (feature, baseline)."""
    share = F.abs(F.col("mean") - F.col("baseline")) / F.col("baseline")
    return means.join(baselines, "feature").withColumn("drift", share).withColumn("severity", drift_band(F.col("drift")))
