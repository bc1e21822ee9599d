"""Model runs as a table that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import stable_id
from ..streaming.cdc import VersionedSink


class ModelRuns:
    """Runs below path by a stable id of model and version: a run that is recorded again replaces its row, others are added.

    Records are numbered by the caller; one that is written again under its number replaces itself. The rows are folded now and then (see VersionedSink).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.sink = VersionedSink(spark, path, ["run_id"])

    def record(self, run: DataFrame, number: int) -> None:
        """run: model, version and whatever else a run states."""
        self.sink(run.withColumn("run_id", stable_id(F.lit("model_run"), F.col("model"), F.col("version"))).withColumn("recorded", F.lit(number)), number)

    def table(self) -> DataFrame:
        """All runs, the last recorded first."""
        return self.sink.table().orderBy(F.desc("recorded"))
