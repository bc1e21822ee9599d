"""Slowly changing dimensions that take in batches of changes, in whatever order these come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layers import exists
from .orders import versions
from .quality import latest_by


class Dimension:
    """Versions of type 2 below path, for changes with key, time ts, whole number seq and tracked columns.

    Keys are dealt into buckets. A batch rewrites the buckets of its keys alone: their changes so far and those of the batch are ordered again, so
    that a late change closes the version before it, takes its place between others, splits a version whose later change had said the
    same, or vanishes beside an equal neighbour. Batches in any order and any cut thus give what all changes at once would. Changes are
    kept besides versions, since one that changes nothing now may once an earlier one comes.

    Batch n writes to version n, so that a batch that is applied again replaces itself; a manifest of one row a bucket says where each bucket
    was last written, and is written last: readers see whole batches. Of changes with one key, ts and seq, that of the last batch holds. Changes without key or ts are skipped.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, seq: str, tracked: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.ts, self.seq, self.tracked, self.buckets = spark, path.rstrip("/"), key, ts, seq, list(tracked), buckets
        self.schema = spark.createDataFrame([], schema).select(key, ts, seq, *tracked).schema

    def _where(self, below: int) -> dict[int, int]:
        """Batch that wrote each bucket last, as of the batches before below."""
        notes = f"{self.path}/manifest"
        if not exists(self.spark, notes):
            return {}
        rows = self.spark.read.schema("at int, of int, batch int").parquet(notes).filter(F.col("batch") < below)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r["at"]: r["of"] for r in rows.filter(F.col("batch") == last).collect()}  # a row a bucket

    def _read(self, kind: str, where: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={n}/bucket={b}" for b, n in sorted(where.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def apply(self, changes: DataFrame, number: int) -> None:
        """Takes in batch number; numbers grow. Fits foreachBatch."""
        rows = changes.select(*self.schema.names).filter(F.col(self.key).isNotNull() & F.col(self.ts).isNotNull())
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        where = self._where(number)
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # numbers below buckets
        old = self._read("changes", {b: n for b, n in where.items() if b in touched}, self.schema)
        both = old.withColumn("_batch", F.lit(0)).unionByName(rows.withColumn("_batch", F.lit(1)))
        # of a batch's own rows with one key, ts and seq, the last in order of all columns
        both = latest_by(both, [self.key, self.ts, self.seq], [F.desc("_batch"), F.desc(F.to_json(F.struct(*self.tracked)))]).drop("_batch")
        to = f"{self.path}/changes/batch={number}"
        both.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
        now = {b: number for b in touched}
        made = versions(self._read("changes", now, self.schema), self.key, self.ts, self.tracked, self.seq)
        made.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/batch={number}")
        note = [(b, n, number) for b, n in (where | now).items()]
        self.spark.createDataFrame(note, "at int, of int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/note={number}")

    def table(self) -> DataFrame:
        """All versions: key, tracked columns, valid_from, valid_to, is_current."""
        empty = versions(self.spark.createDataFrame([], self.schema), self.key, self.ts, self.tracked, self.seq)
        return self._read("versions", self._where(1 << 31), empty.schema)
