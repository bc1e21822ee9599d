"""Late rows as data: what comes behind the watermark goes to a table of its own, and what Spark itself drops is counted."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.layers import exists


class LateSplit:
    """A sink that parts each batch by the watermark: delay_seconds behind the latest ts of the batches before.

    On-time and late rows go to version n of their tables and the batch's latest ts to its mark, so that a batch that is replayed after a
    restart is parted as before. On-time and late rows together are all rows; rows without ts are on time.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, delay_seconds: int):
        self.spark, self.path, self.ts, self.delay = spark, path, ts, delay_seconds

    def watermark(self, number: int) -> int | None:
        """In microseconds, for batch number; none before the first mark."""
        if not exists(self.spark, f"{self.path}/marks"):
            return None
        marks = self.spark.read.schema("latest long, sink_version int").parquet(f"{self.path}/marks")
        latest = marks.filter(F.col("sink_version") < number).agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.delay * 1_000_000

    def __call__(self, batch: DataFrame, number: int) -> None:
        mark = self.watermark(number)
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        late = F.lit(False) if mark is None else F.coalesce(us < mark, F.lit(False))
        rows = batch.withColumn("is_late", late)
        # one write, one pass over the batch
        rows.write.mode("overwrite").partitionBy("is_late").parquet(f"{self.path}/rows/sink_version={number}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/sink_version={number}")
        written.agg(F.max(us).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/sink_version={number}")

    def _part(self, late: bool) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.filter(F.col("is_late") == F.lit(late)).drop("is_late", "sink_version")

    def on_time(self) -> DataFrame:
        return self._part(False)

    def late(self) -> DataFrame:
        return self._part(True)


class DroppedRows(StreamingQueryListener):
    """Counts, by the name of a query, the rows that its stateful operators dropped behind the watermark, from its progress.

    Rows that a task has aggregated before the operator count as one; LateSplit has the rows themselves.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = defaultdict(int)
        self._seen: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if (str(p.runId), p.batchId) not in self._seen:
            self._seen.add((str(p.runId), p.batchId))
            self.dropped[p.name or str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
