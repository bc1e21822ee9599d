"""A merge of change events that keeps state by source row: versions in any order, deletes that later older versions don't undo, marks that expire."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .cdc import VersionedSink, rocksdb_state, run_available


class NewestVersion(StatefulProcessor):
    """Lets a version of a source row pass if none at or after its (ts, seq) has passed yet.

    The state of a row is the order of its newest version, three numbers, never its fields. That of a deleted row is a mark with a
    timer: keep_ms after the delete in event time it goes. By then the watermark has passed the delete, so that any older version that still
    comes is behind the watermark and refused by Spark itself; deleted rows thus take no room for ever.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, seq long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r["us"], r["seq"]))
        order = (best["us"], best["seq"])
        if self.newest.exists() and tuple(self.newest.get())[:2] >= order:
            return
        gone = best["gone"]
        self.newest.update((*order, gone))
        if gone:
            self.handle.registerTimer(best["us"] // 1000 + self.keep_ms)
        yield Row(k=key[0], row=best["row"], gone=gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            us, _, gone = self.newest.get()
            # a row that came back, or was deleted again since, keeps its state
            if gone and us // 1000 + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame, key: str, ts: str, seq: str, op: str = "op", delay: str = "1 day", keep_seconds: int = 0) -> DataFrame:
    """The rows of a change stream that are newer than all before them of the same key, in the stream's columns and with gone, true for deletes.

    Of one batch the newest version of a key passes alone. Versions older than the watermark (delay behind the latest ts) are refused. ts is a
    timestamp and seq a whole number; rows without key, ts or seq are skipped. Of versions with one (ts, seq) the first to come holds.
    Needs state in RocksDB: see merged.
    """
    rows = stream.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(seq).isNotNull()).withWatermark(ts, delay)
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns]).alias("row")
    rows = rows.select(F.col(key).alias("k"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(op) == "d", F.lit(False)).alias("gone"), row)
    kind, fields = stream.schema[key].dataType.simpleString(), stream.schema.simpleString()
    passed = rows.groupBy("k").transformWithState(NewestVersion(keep_seconds * 1000), f"k {kind}, row {fields}, gone boolean", "update", "EventTime")
    return passed.select("row.*", "gone")


def merged(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, key: str, ts: str, seq: str, op: str = "op", delay: str = "1 day", keep_seconds: int = 0, fold: int = 16) -> DataFrame:
    """Merges what a change stream holds now into the keyed table below path, and returns the table; run again with the same checkpoint, it goes on.

    What passes the state of a key is newer each time, so that the sink needs no order but that of the batches, and deletes leave its base.
    """
    sink = VersionedSink(spark, path, [key], fold, forget=F.col("gone"))
    with rocksdb_state(spark):
        run_available(newest_changes(stream, key, ts, seq, op, delay, keep_seconds), sink, checkpoint)
    return sink.table().drop("gone")
