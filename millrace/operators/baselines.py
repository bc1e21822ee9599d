"""Baselines that grow with their days: moments by machine, merged with each batch of days in place of a look at all days before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.layers import exists


def merged_moments(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two sets together, from those of each; an empty set has count 0."""
    (n, mean, m2), (k, mean_k, m2_k) = a, b
    both, delta = n + k, mean_k - mean
    share = F.when(both > 0, k / both).otherwise(0.0)
    return both, mean + delta * share, m2 + m2_k + delta * delta * n * share


class Baselines:
    """For each key its latest day with its metrics, and count, mean and squared deviations of all its days before that, below path.

    Batch n holds days later than those of the batches before, in any number; it reads itself and the rows of version n - 1 or below, one a key, never the days that these
    stand for. Written again, it replaces itself. Null metrics count as days but not in their own moments.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], day: str, metrics: Sequence[str]):
        self.spark, self.path, self.keys, self.day, self.metrics = spark, path, list(keys), day, list(metrics)

    def _state(self, below: int | None = None) -> DataFrame | None:
        """The last version, or the last one below a batch."""
        if not exists(self.spark, f"{self.path}/state"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/state")
        found = rows.filter(F.col("version") < below) if below is not None else rows
        last = found.agg(F.max("version")).first()[0]
        return None if last is None else rows.filter(F.col("version") == last).drop("version")

    def _batch(self, daily: DataFrame) -> DataFrame:
        """The latest day of each key in a batch, and the moments of its days before."""
        last = F.max(self.day).over(Window.partitionBy(*self.keys))
        rows = daily.select(*self.keys, self.day, *[F.col(m).cast("double").alias(m) for m in self.metrics]).filter(F.col(self.day).isNotNull()).withColumn("_last", last)
        before, latest = F.col(self.day) < F.col("_last"), F.col(self.day) == F.col("_last")
        of = lambda m: F.when(before, F.col(m))
        aggs = [F.max("_last").alias(self.day), F.count_if(before).alias("n_before")]
        for m in self.metrics:
            aggs += [F.max(F.when(latest, F.col(m))).alias(m), F.count(of(m)).alias(f"{m}_n"), F.coalesce(F.avg(of(m)), F.lit(0.0)).alias(f"{m}_mean")]
            aggs.append(F.coalesce(F.var_pop(of(m)) * F.count(of(m)), F.lit(0.0)).alias(f"{m}_m2"))
        return rows.groupBy(*self.keys).agg(*aggs)

    def update(self, daily: DataFrame, number: int) -> None:
        new, old = self._batch(daily), self._state(number)
        if old is not None:
            named = lambda df, s: df.select(*self.keys, F.lit(True).alias(f"{s}_"), *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in self.keys])
            rows = named(old, "o").join(named(new, "n"), self.keys, "full")
            pick = lambda both: F.when(F.col("o_").isNull(), F.col(both.replace("*", "n"))).otherwise(F.col(both.replace("*", "o")))
            out = {self.day: F.coalesce(f"n_{self.day}", f"o_{self.day}")}
            joined = F.col("o_").isNotNull() & F.col("n_").isNotNull()
            # the old latest day is now one of those before
            out["n_before"] = F.when(joined, F.col("o_n_before") + 1 + F.col("n_n_before")).otherwise(pick("*_n_before"))
            for m in self.metrics:
                known = F.col(f"o_{m}").isNotNull().cast("long")
                one = (known, F.coalesce(f"o_{m}", F.lit(0.0)), F.lit(0.0))
                parts = merged_moments(merged_moments(tuple(F.col(f"o_{m}_{p}") for p in ("n", "mean", "m2")), one), tuple(F.col(f"n_{m}_{p}") for p in ("n", "mean", "m2")))
                out[m] = F.when(F.col("n_").isNotNull(), F.col(f"n_{m}")).otherwise(F.col(f"o_{m}"))
                out |= {f"{m}_{p}": F.when(joined, value).otherwise(pick(f"*_{m}_{p}")) for p, value in zip(("n", "mean", "m2"), parts)}
            new = rows.select(*self.keys, *[v.alias(k) for k, v in out.items()])
        new.write.mode("overwrite").parquet(f"{self.path}/state/version={number}")

    def latest(self, least_rows: int = 3) -> DataFrame:
        """The latest day of each key that has least_rows days before, with n_before and mean and population deviation of each metric."""
        rows = self._state()
        if rows is None:
            raise ValueError("no batch has been taken in")
        n = lambda m: F.nullif(F.col(f"{m}_n"), F.lit(0))
        stats = [c for m in self.metrics for c in (F.when(n(m).isNotNull(), F.col(f"{m}_mean")).alias(f"{m}_mean"), F.sqrt(F.col(f"{m}_m2") / n(m)).alias(f"{m}_std"))]
        return rows.filter(F.col("n_before") >= least_rows).select(*self.keys, self.day, *self.metrics, "n_before", *stats)
