"""Customer segments by k-means."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.layers import work_folder

LABELS = ("Value Watch", "Growth", "Priority")


def fixed_kmeans(features: DataFrame, metrics: list[str], by: str, key: str, k: int = 3, rounds: int = 12) -> DataFrame:
    """Lloyd's algorithm on max-scaled metrics from k seeds spread over the rows in order of (by, key).

    All that goes to the driver is k centres a round; each round is one aggregate over the rows. The lowest cluster wins ties,
    an empty one keeps its centre.
    """
    top = features.agg(*[F.max(m).alias(m) for m in metrics]).first()
    scaled = features.withColumns({f"_{m}": F.col(m) / F.lit(float(top[m]) if top[m] else 1.0) for m in metrics}).persist()
    n = scaled.count()
    if not n:
        return features.withColumn("cluster", F.lit(0))
    step = max(1, n // k)
    # the rows are dealt in ranges of (by, key) once; counts by range say where a seed's place lies, so that no task orders all rows
    path = work_folder(features.sparkSession, "seeds")
    scaled.repartitionByRange(by, key).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = features.sparkSession.read.parquet(path)
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each range
    seeds = []
    for i in range(k):
        at = min(n - 1, i * step)
        for part in sorted(sizes):
            if at < sizes[part]:
                break
            at -= sizes[part]
        row = dealt.filter(F.col("_range") == part).orderBy(by, key).offset(at).limit(1).first()
        seeds.append([float(row[f"_{m}"]) for m in metrics])

    def nearest(centres: list[list[float]]):
        distances = [sum((F.col(f"_{m}") - F.lit(c)) ** 2 for m, c in zip(metrics, centre)) for centre in centres]
        best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances)]))
        return best["i"]

    for _ in range(rounds):
        sums = scaled.groupBy(nearest(seeds).alias("cluster")).agg(*[F.avg(f"_{m}").alias(m) for m in metrics]).collect()  # k rows
        new = list(seeds)
        for row in sums:
            new[row["cluster"]] = [row[m] for m in metrics]
        if new == seeds:
            break
        seeds = new
    return scaled.withColumn("cluster", nearest(seeds)).drop(*[f"_{m}" for m in metrics])


def scaled_kmeans(features: DataFrame, metrics: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """MLlib k-means over standardised metrics. Cluster numbers are arbitrary: rank them before publishing."""
    stages = [VectorAssembler(inputCols=metrics, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True), KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster")]
    rows = features.persist()
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_raw", "_scaled")


def labelled(clustered: DataFrame, by: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Names clusters by rank of their total; as many rows as clusters are ranked."""
    totals = clustered.groupBy("cluster").agg(F.sum(by).alias("total")).collect()  # one row for each cluster
    order = {row["cluster"]: i for i, row in enumerate(sorted(totals, key=lambda r: (r["total"], r["cluster"])))}
    out = F.lit(labels[-1])
    for cluster, rank in order.items():
        out = F.when(F.col("cluster") == cluster, labels[min(rank, len(labels) - 1)]).otherwise(out)
    return clustered.withColumn("segment", out)
