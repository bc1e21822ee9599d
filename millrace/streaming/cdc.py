"""Change-event streams: sources, per-customer features, keyed sinks that survive replays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import intent
from ..operators.quality import latest_by
from ..sources.layers import exists, make_folder, merge_fields, remove, work_folder

#: One change event; after holds the union of the tables' columns.
CDC_SCHEMA = "event_id string, `table` string, op string, event_ts timestamp, after struct<order_id:string, cart_id:string, id_type:string, id_value:string, product:string, unified_customer_key:string, amount:double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kafka_source(spark: SparkSession, servers: str, topics: str, schema: str = CDC_SCHEMA, max_per_trigger: int = 1_000_000) -> DataFrame:
    """Change events from broker topics; needs Spark's Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_per_trigger).load()
    return decoded(raw, schema)


def decoded(raw: DataFrame, schema: str = CDC_SCHEMA) -> DataFrame:
    """Change events from a broker's records, whose value holds JSON; values that are none, or have no event id, are skipped."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*").filter("event_id IS NOT NULL")


def json_replay(spark: SparkSession, path: str, schema: str = CDC_SCHEMA, stream: bool = False) -> DataFrame:
    """Change events from JSON lines; blank lines are skipped. A path that isn't there has no events; a stream makes it a folder and waits for some."""
    if not any(c in path for c in "*?[{") and not exists(spark, path):
        if not stream:
            return spark.createDataFrame([], schema)
        make_folder(spark, path)
    return (spark.readStream if stream else spark.read).schema(schema).json(path).filter("event_id IS NOT NULL")


def resolved(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """Explicit key, else the bridge's; a key stays null if neither knows it. bridge: id_type, id_value, bridge_key."""
    rows = events.withColumns({"id_type": F.col("after.id_type"), "id_value": F.col("after.id_value")}).join(bridge, ["id_type", "id_value"], "left")
    return rows.withColumn("customer", F.coalesce("after.unified_customer_key", "bridge_key"))


def _measures(rows_of: str) -> list:
    order, cart, amount = F.col(rows_of) == "orders", F.col(rows_of) == "cart_events", F.coalesce("amount", F.lit(0.0))
    zero = F.lit(0).cast("decimal(18,2)")
    money = amount.cast("decimal(18,2)")
    last = F.struct("event_ts", "event_id")
    return [
        F.count_if(order).alias("orders"), F.sum(F.when(order, money).otherwise(zero)).cast("double").alias("order_amount"), F.count_if(cart).alias("carts"),
        F.sum(F.when(cart, money).otherwise(zero)).cast("double").alias("cart_value"), F.max("event_ts").alias("last_event_ts"), F.max_by("product", last).alias("last_product"),
    ]


def features(events: DataFrame, window: str | None = "1 day", watermark: str = "1 day", dedup: bool = True) -> DataFrame:
    """Orders, carts, amounts, last product and intent by customer, in daily windows or (None) over all time.

    events: event_id, table, event_ts, customer, product, amount; a stream or not. The op code is carried but not read: see latest_versions.
    Duplicate events are dropped within the watermark on a stream, and altogether in a batch.
    """
    rows = events.filter("customer IS NOT NULL")
    if rows.isStreaming:
        rows = rows.withWatermark("event_ts", watermark)
        rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if dedup else rows
    elif dedup:
        rows = latest_by(rows, ["event_id"], [F.desc("event_ts")])
    keys = ["customer"] if window is None else [F.window("event_ts", window).alias("w"), "customer"]
    out = rows.groupBy(*keys).agg(*_measures("table"))
    out = out if window is None else out.withColumn("window_start", F.col("w.start")).drop("w")
    return out.withColumn("intent", intent(F.col("carts"), F.col("orders"), F.col("order_amount")))


def latest_versions(events: DataFrame, key: str, ts: str, seq: str, op: str = "op") -> DataFrame:
    """The newest version of each source row; a row whose newest version is a delete goes."""
    return latest_by(events, [key], [F.desc(ts), F.desc(seq)]).filter(F.col(op) != "d")


def lateness(events: DataFrame, event_ts: str, ingest_ts: str, bounds: tuple[int, ...] = (60, 300, 3600, 86400)) -> DataFrame:
    """Events by how many seconds they came late."""
    late = F.unix_seconds(ingest_ts) - F.unix_seconds(event_ts)
    bucket = F.lit(f"over {bounds[-1]} s")
    for b in reversed(bounds):
        bucket = F.when(late <= b, f"up to {b} s").otherwise(bucket)
    return events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


class VersionedSink:
    """A keyed table as a base and the batches since.

    Batch n writes absolute values to version n, so that a replayed batch overwrites itself. Every fold batches, base and changes become a new
    base, the rows of each key being ranked by order and then by version; a note says that the base is whole, and only then do readers use it.
    A read thus ranks the rows of the base and of fold batches at most. The last base but one and the batches folded into it stay for readers
    that have begun; older ones go. Rows for which forget holds are left out of a base: only for changes that arrive in order.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: int = 16, order: Sequence[Column] = (), forget: Column | None = None):
        self.spark, self.path, self.keys, self.fold, self.order, self.forget = spark, path, keys, fold, [*order, F.desc("sink_version")], forget

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/sink_version={number}")
        if self.fold and (number + 1) % self.fold == 0:
            self._fold(number)

    def _bases(self, below: int) -> list[int]:
        """Versions of the bases that are whole, in order."""
        notes = f"{self.path}/notes"
        if not exists(self.spark, notes):
            return []
        return sorted(r["base"] for r in self.spark.read.schema("base long").parquet(notes).distinct().collect() if r["base"] < below)

    def _ranked(self, below: int) -> DataFrame:
        bases = self._bases(below)
        since = bases[-1] if bases else -1
        rows = self.spark.read.parquet(f"{self.path}/changes").filter((F.col("sink_version") > since) & (F.col("sink_version") <= below))
        if bases:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/base/{since}"))
        return latest_by(rows, self.keys, self.order)

    def _fold(self, number: int) -> None:
        rows = self._ranked(number)
        rows = rows if self.forget is None else rows.filter(~F.coalesce(self.forget, F.lit(False)))
        rows.withColumn("sink_version", F.col("sink_version").cast("int")).write.mode("overwrite").parquet(f"{self.path}/base/{number}")
        self.spark.createDataFrame([(number,)], "base long").write.mode("overwrite").parquet(f"{self.path}/notes/of={number}")
        bases = self._bases(number)  # those before the new one
        for old in bases[:-1]:
            remove(self.spark, f"{self.path}/notes/of={old}")
            remove(self.spark, f"{self.path}/base/{old}")
        if bases:
            for gone in range(bases[-2] + 1 if len(bases) > 1 else 0, bases[-1] + 1):
                remove(self.spark, f"{self.path}/changes/sink_version={gone}")

    def table(self) -> DataFrame:
        rows = self._ranked(1 << 62)
        return (rows if self.forget is None else rows.filter(~F.coalesce(self.forget, F.lit(False)))).drop("sink_version")


class UnresolvedSink(VersionedSink):
    """Keeps the events without a customer; counts holds, for each batch, how many came and how many of them had none, observed as they pass."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        super().__init__(spark, path, keys)
        self.counts: dict[int, dict[str, int]] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("events"), F.count_if(F.col("customer").isNull()).alias("unresolved"))
        super().__call__(rows.filter("customer IS NULL").drop("customer"), number)
        self.counts[number] = seen.get


class MergeSink(VersionedSink):
    """The newest version of each source row by (ts, seq), whatever the order of arrival; a delete stays as a mark, so that a late older version doesn't revive the row."""

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, seq: str, op: str = "op", fold: int = 16):
        super().__init__(spark, path, [key], fold, [F.desc(ts), F.desc(seq)])
        self.op = op

    def __call__(self, batch: DataFrame, number: int) -> None:
        super().__call__(latest_by(batch, self.keys, self.order[:-1]), number)

    def table(self) -> DataFrame:
        return super().table().filter(F.col(self.op) != "d")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Processes what is there and ends; started again with the same checkpoint, it goes on where it stopped."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, with changes logged to the checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def into_table(spark: SparkSession, stream: DataFrame, keys: list[str], mode: str = "update", rocksdb: bool = False) -> DataFrame:
    """The final table of a stream over what is there now."""
    sink = VersionedSink(spark, work_folder(spark, "stream-table"), keys)
    with rocksdb_state(spark) if rocksdb else nullcontext():
        run_available(stream, sink, work_folder(spark, "stream-checkpoint"), mode)
    return sink.table()


def serve(gold: DataFrame, realtime: DataFrame, key: str = "customer") -> DataFrame:
    """Batch and stream features in one row per key, merged field by field."""
    return merge_fields(gold, realtime, key)
