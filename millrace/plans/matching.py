"""Identity, anomaly and segmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..operators import features as fe
from ..operators import identity as idy
from ..operators import segments as sg
from ..sources import layers as ly
from .base import query, table
from .customers import FEATURES, RISK, SCALE, customer_base, transactions


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth customer is missing; three customers share a key."""
    c = table(spark, d, "customer").filter("c_custkey % 10 <> 0")
    return c.select("c_custkey", F.floor(F.col("c_custkey") / 3).alias("unified_key"))


BRIDGE = "SELECT c_custkey, (c_custkey // 3)::BIGINT AS unified_key FROM customer WHERE c_custkey % 10 <> 0"


@query("j01_identity_bridge", f"SELECT o_orderkey, unified_key FROM orders LEFT JOIN ({BRIDGE}) ON o_custkey = c_custkey")
def j01(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return idy.resolve(rows, bridge(spark, d), ["c_custkey"]).select("o_orderkey", "unified_key")


def people(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(bridge(spark, d), "c_custkey", "left")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"), "unified_key", F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), (F.floor(k / 2) % 400).cast("string").alias("phone"),
        F.concat(F.lit("u"), (F.floor(k / 2) % 500).cast("string"), F.lit("@example.com")).alias("email"), (k % 365).cast("string").alias("dob"), F.col("c_nationkey").cast("string").alias("postal"),
    )


PEOPLE = "SELECT c_custkey AS seq, unified_key, trim(regexp_replace(upper(c_name || ' ' || c_mktsegment), '[^\\p{L}\\p{N}\\s]', '', 'g')) AS name, ((c_custkey // 2) % 400)::VARCHAR AS phone, 'U' || ((c_custkey // 2) % 500) || '@EXAMPLE.COM' AS email, (c_custkey % 365)::VARCHAR AS dob, c_nationkey::VARCHAR AS postal FROM customer LEFT JOIN (" + BRIDGE + ") USING (c_custkey)"
PAIRS = f"WITH p AS ({PEOPLE}), j AS (SELECT l.seq AS l_seq, r.seq AS r_seq, l.unified_key AS lk, r.unified_key AS rk, l.name AS ln, r.name AS rn, l.phone = r.phone AS phone, l.email = r.email AS email FROM p l, p r WHERE l.seq < r.seq AND (l.seq = (SELECT min(f.seq) FROM p f WHERE f.unified_key = r.unified_key) OR (l.phone = r.phone AND l.email = r.email AND coalesce(l.unified_key <> r.unified_key, TRUE))))"


@query("j06_identity_pairs", f"{PAIRS} SELECT l_seq, r_seq FROM j")
def j06(spark, d):
    """Names differ here, so that no two records are alike: a key's rows are paired with its first, other links are all there."""
    return idy.candidate_pairs(people(spark, d)).select("l_seq", "r_seq")


@query("d09_identity_scores")
def d09(spark, d):
    """All pairs of different records, those of one key too."""
    return idy.scored_pairs(people(spark, d), idy.name_ratio, signature=idy.name_signature, bound=idy.ratio_bound, links=True, path=ly.work_folder(spark, "records"))


SHORT = f"""{PAIRS}, s AS (SELECT *, 1 - levenshtein(ln, rn) / greatest(length(ln), length(rn))::DOUBLE AS sim FROM j),
t AS (SELECT *, round(least(1.0, CASE WHEN sim >= 0.72 THEN sim * 0.25 ELSE 0 END + CASE WHEN lk = rk THEN 0.5 ELSE 0 END + CASE WHEN phone THEN 0.18 ELSE 0 END + CASE WHEN email THEN 0.18 ELSE 0 END), 3) AS score FROM s),
c AS (SELECT *, CASE WHEN lk = rk THEN 'deterministic_merge_confirmed' WHEN score >= 0.74 AND (lk IS NULL) <> (rk IS NULL) THEN 'review_attach_to_known_customer' WHEN score >= 0.68 THEN 'manual_review' END AS action FROM t)"""


def short_scores(spark: SparkSession, d: str) -> DataFrame:
    """Phone, email and name together don't reach the review threshold, so that only pairs of one key are made."""
    return idy.scored_pairs(people(spark, d), idy.levenshtein_similarity, idy.SHORT_WEIGHTS)


@query("d10_short_identity_scores", f"{SHORT} SELECT l_seq, r_seq, round(score, 2) AS score FROM c WHERE action IS NOT NULL")
def d10(spark, d):
    return short_scores(spark, d).select("l_seq", "r_seq", F.round("score", 2).alias("score"))


@query("d11_resolution_action", f"{SHORT} SELECT action, count(*) AS n FROM c WHERE action IS NOT NULL GROUP BY 1")
def d11(spark, d):
    return short_scores(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("d12_match_reasons", f"{SHORT} SELECT l_seq, r_seq, concat_ws(', ', CASE WHEN lk = rk THEN 'same_unified_key' END, CASE WHEN sim >= 0.72 THEN 'name_similarity=' || printf('%.2f', sim) END, CASE WHEN phone THEN 'same_phone' END, CASE WHEN email THEN 'same_email' END) AS reasons FROM c WHERE action IS NOT NULL")
def d12(spark, d):
    return short_scores(spark, d).select("l_seq", "r_seq", "reasons")


@query("o05_top_identity_scores", f"{SHORT} SELECT l_seq, r_seq, round(score, 2) AS score FROM c WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_seq ORDER BY score DESC, r_seq) <= 1")
def o05(spark, d):
    """The best candidate of each customer."""
    from ..operators.quality import latest_by

    return latest_by(short_scores(spark, d), ["l_seq"], [F.desc("score"), F.asc("r_seq")]).select("l_seq", "r_seq", F.round("score", 2).alias("score"))


def labelled_transactions(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).withColumn("label", (F.col("txn_id") % 997 == 0).cast("int"))


STATS = "SELECT o_orderpriority AS product, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS std, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1"


@query("a18_amount_statistics", f"SELECT product, round(mean, 2) AS mean, round(std, 2) AS std, round(p99, 2) AS p99 FROM ({STATS.replace('quantile_disc', 'quantile_cont')})")
def a18(spark, d):
    """The percentile is interpolated; anomalies go by the amount of the nearest rank."""
    return an.amount_statistics(transactions(spark, d), exact=True).select("product", *[F.round(c, 2).alias(c) for c in ("mean", "std", "p99")])


ANOMALY = f"SELECT o_orderkey AS txn_id, o_orderpriority AS product, round(CASE WHEN std > 0 THEN (o_totalprice - mean) / std ELSE 0 END, 3) AS z, CASE WHEN o_orderkey % 997 = 0 THEN 'synthetic_fraud_label' WHEN o_totalprice > p99 THEN 'above_product_p99' WHEN std > 0 AND (o_totalprice - mean) / std >= 3 THEN 'amount_z_score_high' END AS anomaly_type FROM orders LEFT JOIN ({STATS}) ON o_orderpriority = product"


@query("n01_transaction_anomalies", f"SELECT *, sha256('txn|' || txn_id || '|' || anomaly_type) AS anomaly_id FROM ({ANOMALY}) WHERE anomaly_type IS NOT NULL")
def n01(spark, d):
    t = labelled_transactions(spark, d)
    return an.transaction_anomalies(t, an.amount_statistics(t, exact=True, interpolated=False)).select("txn_id", "product", F.round("z", 3).alias("z"), "anomaly_type", "anomaly_id")


@query("j09_group_statistics", f"SELECT product, anomaly_type, count(*) AS n FROM ({ANOMALY}) WHERE anomaly_type IS NOT NULL GROUP BY ALL")
def j09(spark, d):
    return n01(spark, d).groupBy("product", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))


METRICS = ["monetary_30d", "tx_count_30d", "velocity_7d"]


@query("a19_metric_statistics", "WITH f AS (" + FEATURES + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 3) AS mean, round(stddev_samp({m}), 3) AS std FROM f" for m in METRICS))
def a19(spark, d):
    stats = an.metric_statistics(customer_base(spark, d), METRICS)
    return spark.createDataFrame([(m, round(a, 3), round(s, 3)) for m, (a, s) in stats.items()], "metric string, mean double, std double")


@query(
    "n02_customer_anomalies",
    f"WITH f AS (SELECT *, {RISK} AS risk_score FROM ({FEATURES})), s AS (SELECT avg(monetary_30d) AS mm, stddev_samp(monetary_30d) AS ms, avg(tx_count_30d) AS cm, stddev_samp(tx_count_30d) AS cs, avg(velocity_7d) AS vm, stddev_samp(velocity_7d) AS vs FROM f) "
    "SELECT * FROM (SELECT customer, risk_score, round((monetary_30d - mm) / ms, 3) AS monetary_30d_z, round((tx_count_30d - cm) / cs, 3) AS tx_count_30d_z, round((velocity_7d - vm) / vs, 3) AS velocity_7d_z, CASE WHEN risk_score >= 0.85 THEN 'high_risk_score' WHEN (monetary_30d - mm) / ms >= 3 THEN 'monetary_outlier' WHEN (tx_count_30d - cm) / cs >= 3 THEN 'transaction_count_outlier' WHEN (velocity_7d - vm) / vs >= 3 THEN 'velocity_outlier' END AS anomaly_type FROM f, s) WHERE anomaly_type IS NOT NULL",
)
def n02(spark, d):
    return an.customer_anomalies(fe.with_risk(customer_base(spark, d), SCALE)).select("customer", "risk_score", "monetary_30d_z", "tx_count_30d_z", "velocity_7d_z", "anomaly_type")


@query("m01_fixed_kmeans")
def m01(spark, d):
    return sg.fixed_kmeans(customer_base(spark, d), ["tx_count_30d", "monetary_30d", "velocity_7d"], "monetary_30d", "customer").select("customer", "cluster")


@query("m02_scaled_kmeans")
def m02(spark, d):
    return sg.scaled_kmeans(customer_base(spark, d), ["recency_days", "tx_count_30d", "monetary_30d", "product_diversity", "velocity_7d"]).select("customer", "cluster")


@query("m03_cluster_labels")
def m03(spark, d):
    rows = sg.fixed_kmeans(customer_base(spark, d), ["tx_count_30d", "monetary_30d", "velocity_7d"], "monetary_30d", "customer")
    return sg.labelled(rows, "monetary_30d").select("customer", "segment")


@query("w02_cluster_ranks")
def w02(spark, d):
    return m03(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


SCALED = ("tx_count_30d", "monetary_30d", "velocity_7d")


@query("m04_scaled_vectors", f"WITH f AS ({FEATURES}) SELECT customer, " + ", ".join(f"round({m} / (SELECT max(abs({m})) FROM f)::DOUBLE, 6) AS {m}" for m in SCALED) + " FROM f")
def m04(spark, d):
    from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(SCALED), outputCol="raw").transform(customer_base(spark, d))
    out = MaxAbsScaler(inputCol="raw", outputCol="scaled").fit(rows).transform(rows)
    return out.withColumn("scaled", vector_to_array("scaled")).select("customer", *[F.round(F.col("scaled")[i], 6).alias(m) for i, m in enumerate(SCALED)])
