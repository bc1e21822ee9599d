"""Readers and writers of the layered tables: landing, bronze envelopes, keyed upserts, compaction, generators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import pick, record_hash, stable_id

_own_folder: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else (local runs) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, on whatever file system Spark knows, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad ones give nulls."""
    return spark.read.schema(schema).json(path)


def envelope(df: DataFrame, event_type: str, source: str, index: Column, payload: Sequence[str]) -> DataFrame:
    """Bronze rows: an id that depends on type, index and payload alone, and the payload as JSON text."""
    body = F.to_json(F.struct(*payload))
    rows = df.select(F.lit(event_type).alias("event_type"), F.lit(source).alias("source"), index.cast("string").alias("idx"), body.alias("payload"))
    return rows.select(stable_id(F.col("event_type"), F.col("idx"), F.col("payload")).alias("event_id"), "event_type", "source", "payload")


def decode(bronze: DataFrame, event_type: str, schema: str) -> DataFrame:
    rows = bronze.filter(F.col("event_type") == event_type)
    return rows.select("event_id", F.from_json("payload", schema).alias("p")).select("event_id", "p.*")


def with_bronze_metadata(df: DataFrame, source: str, ingest_ts: Column | None = None) -> DataFrame:
    """source, file name, hash of all columns, and the ingest time given (now if none)."""
    extra = {"record_hash": record_hash(*[F.col(c) for c in df.columns]), "source_name": F.lit(source), "source_file": F.input_file_name(), "ingest_ts": F.current_timestamp() if ingest_ts is None else ingest_ts}
    return df.withColumns(extra)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Last writer wins by sequence; of equal sequences, the new row, and of several new ones the last in order of all columns. One shuffle by key."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(sequence), F.desc("_new"), F.desc(F.to_json(F.struct(*existing.columns))))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """existing, and the rows of new whose keys it lacks: of several with the same keys the first by order (by all columns if none is given)."""
    first = Window.partitionBy(*keys).orderBy(*([order] if order else []), F.to_json(F.struct(*existing.columns)))
    new = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return existing.unionByName(new.join(existing, list(keys), "left_anti").select(*existing.columns))


def merge_fields(existing: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Field by field: a field that the update carries replaces the old one; columns only one side has stay.

    A null in the update leaves the old value, unless the update has a boolean column <field>_present that is true.
    """
    flags = [c for c in update.columns if c.endswith("_present")]
    fields = [c for c in dict.fromkeys([*existing.columns, *update.columns]) if c != key and c not in flags]
    joined = existing.alias("o").join(update.alias("n"), key, "full")

    def merged(c: str) -> Column:
        if c not in update.columns:
            return F.col(f"o.{c}")
        if c not in existing.columns:
            return F.col(f"n.{c}")
        value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(F.col(f"n.{c}_present"), F.col(f"n.{c}")).otherwise(value) if f"{c}_present" in flags else value

    return joined.select(key, *[merged(c).alias(c) for c in fields])


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], form: str = "parquet", mode: str = "overwrite") -> None:
    """Overwrites only the partitions that df has; rows of a partition come from few tasks, so files stay few."""
    df.repartition(*by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def compact(spark: SparkSession, path: str, to: str, key: str, files: int) -> None:
    """Rewrites a table in few files, clustered by key, so that lookups skip files by their minima and maxima."""
    spark.read.parquet(path).repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(to)


def register(spark: SparkSession, database: str, name: str, path: str, schema: StructType) -> DataFrame:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING PARQUET LOCATION '{path}'")
    return spark.read.table(f"{database}.{name}")


def generated_transactions(keys: DataFrame, key: str, customers: int, days: int = 90) -> DataFrame:
    """Made-up transactions for the given keys. All values follow from the key, so that partitioning doesn't change them.

    Every 997th is an outlier with a fraud label.
    """
    k = F.col(key)
    noise = F.pmod(F.xxhash64(k), F.lit(100000)) / 100.0
    odd = k % 997 == 0
    return keys.select(
        k.alias("txn_id"), (k % customers).alias("customer_id"), F.date_add(F.lit("2026-01-01").cast("date"), (k % days).cast("int")).alias("business_date"),
        pick(["CARD", "INVESTMENT", "TRAVEL_INSURANCE", "PREMIUM_FINANCING"], k).alias("product"), pick(["APP", "WEB", "BRANCH"], k).alias("channel"),
        F.when(odd, F.lit(25000.0)).otherwise(noise).alias("amount"), odd.cast("int").alias("label"),
    )
