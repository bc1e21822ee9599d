"""Transaction and customer anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import ratio
from ..functions.ranks import percentile


# fixed values: the published reason codes
LABEL, ABOVE_P99, AMOUNT_Z = "synthetic_fraud_label", "above_product_p99", "amount_z_score_high"
HIGH_RISK = "high_risk_score"
OUTLIERS = {"monetary_30d": "monetary_outlier", "tx_count_30d": "transaction_count_outlier", "velocity_7d": "velocity_outlier"}


def amount_statistics(txns: DataFrame, exact: bool = False, accuracy: int = 10000, interpolated: bool = True) -> DataFrame:
    """Mean, sample deviation (0 for one row) and 99th percentile of each product.

    The percentile is approximate, or exact: interpolated between two amounts or the amount of the nearest rank. Both take bounded memory, the exact one more passes.
    """
    moments = [F.avg("amount").alias("mean"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std")]
    if not exact:
        return txns.groupBy("product").agg(*moments, F.percentile_approx("amount", 0.99, accuracy).alias("p99"))
    means, p99 = txns.groupBy("product").agg(*moments), percentile(txns, "amount", 0.99, "product", interpolated)
    return means.join(p99, means["product"].eqNullSafe(p99["g"]), "left").select("product", "mean", "std", F.col("p").alias("p99"))


def transaction_anomalies(txns: DataFrame, stats: DataFrame, z_min: float = 3.0) -> DataFrame:
    """Label first, then above the product's p99, then z. stats has a row for each product; a product without one has labels only."""
    rows = txns.join(stats, "product", "left")
    z = F.when(F.col("std") > 0, (F.col("amount") - F.col("mean")) / F.col("std")).otherwise(0.0)
    kind = F.when(F.col("label") == 1, LABEL).when(F.col("amount") > F.col("p99"), ABOVE_P99).when(z >= z_min, AMOUNT_Z)
    rows = rows.select("txn_id", "product", "amount", z.alias("z"), kind.alias("anomaly_type")).filter("anomaly_type IS NOT NULL")
    return rows.withColumn("anomaly_id", F.sha2(F.concat_ws("|", F.lit("txn"), F.col("txn_id").cast("string"), "anomaly_type"), 256))


def metric_statistics(features: DataFrame, metrics: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of every metric, in one pass: a single row to the driver."""
    aggs = [f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    row = features.agg(*aggs).first()
    return {m: (row[f"{m}_mean"] or 0.0, row[f"{m}_std"] or 0.0) for m in metrics}


def customer_anomalies(features: DataFrame, risk_min: float = 0.85, z_min: float = 3.0) -> DataFrame:
    """Risk first, then the z score of spend, count and velocity; statistics enter as literals."""
    stats = metric_statistics(features, list(OUTLIERS))
    z = {m: ratio(F.col(m) - F.lit(mean), F.lit(std)) for m, (mean, std) in stats.items()}
    kind = F.when(F.col("risk_score") >= risk_min, HIGH_RISK)
    for m, reason in OUTLIERS.items():
        kind = kind.when(z[m] >= z_min, reason)
    scores = [F.round(z[m], 3).alias(f"{m}_z") for m in OUTLIERS]
    return features.select("customer", "risk_score", *OUTLIERS, *scores, kind.alias("anomaly_type")).filter("anomaly_type IS NOT NULL")
