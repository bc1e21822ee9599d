"""Event-contract monitor: every check is one row (check, status, severity, metric, threshold, details)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import first_failing, missing_fields

SCHEMA = "check string, status string, severity string, metric double, threshold double, details string"
GAUGE = {"OK": 0, "WARN": 1, "FAIL": 2}


def status_of(metric: Column, warn: float | None, fail: float | None) -> Column:
    """FAIL and WARN where the metric is strictly above; a null metric is OK."""
    out = F.when(metric > fail, "FAIL") if fail is not None else F.when(F.lit(False), "FAIL")
    return (out.when(metric > warn, "WARN") if warn is not None else out).otherwise("OK")


def _result(one: DataFrame, check: str, status: Column, severity: str, metric: Column, threshold: float | None, details: Column) -> DataFrame:
    return one.select(
        F.lit(check).alias("check"), status.alias("status"), F.lit(severity).alias("severity"), metric.cast("double").alias("metric"),
        F.lit(threshold).cast("double").alias("threshold"), details.alias("details"),
    )


def preview(violations: DataFrame, text: Column, order: Column, keep: int = 5) -> DataFrame:
    """One row (n, details): the first violations and how many more there are. Only those few go to one task."""
    n = violations.agg(F.count(F.lit(1)).alias("n"))
    first = violations.select(text.alias("t"), order.alias("o")).orderBy("o", "t").limit(keep)
    shown = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "; ").alias("shown"))
    more = F.when(F.col("n") > keep, F.concat(F.lit("; ... +"), (F.col("n") - keep).cast("string"), F.lit(" more"))).otherwise("")
    return n.crossJoin(F.broadcast(shown)).select("n", F.concat("shown", more).alias("details"))  # one row each


def schema_check(spark: SparkSession, tables: Mapping[str, DataFrame | None], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """A missing table lacks all its columns."""
    rows = []
    for name, columns in required.items():
        df = tables.get(name)
        missing = [c for c in columns if df is None or c not in df.columns]
        rows.append((f"schema.{name}", "FAIL" if missing else "OK", "critical", float(len(missing)), 0.0, ", ".join(missing)))
    return spark.createDataFrame(rows, SCHEMA)


def payload_check(outbox: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Unknown type first, then bad JSON, then missing fields."""
    kind = F.col("event_type")
    missing = missing_fields(F.col("payload"), required, kind)
    rules = [("unknown_type", ~kind.isin(*required) | kind.isNull()), ("invalid_json", F.json_object_keys("payload").isNull()), ("missing_fields", F.size(missing) > 0)]
    bad = outbox.withColumn("problem", first_failing(rules)).filter("problem IS NOT NULL")
    one = preview(bad, F.concat_ws(":", F.col("event_id").cast("string"), "problem"), F.col("event_id"))
    return _result(one, "event.payload_contract", F.when(F.col("n") > 0, "FAIL").otherwise("OK"), "critical", F.col("n"), 0.0, F.col("details"))


def timestamp_check(outbox: DataFrame) -> DataFrame:
    """Texts that are no timestamps; null is fine."""
    raw = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")) for c in ("created_at", "published_at")]))
    rows = outbox.select("event_id", raw.alias("x")).filter(F.col("x.raw").isNotNull() & F.try_to_timestamp("x.raw").isNull())
    one = preview(rows, F.concat_ws(":", F.col("event_id").cast("string"), "x.field"), F.col("event_id"))
    return _result(one, "time.timestamp_parse", F.when(F.col("n") > 0, "FAIL").otherwise("OK"), "critical", F.col("n"), 0.0, F.col("details"))


def time_checks(outbox: DataFrame, as_of: datetime, limits: Mapping[str, float]) -> DataFrame:
    """Clock skew, freshness, pending lag, publish delay and volume from one scan and one aggregate. Unparsable times are left out."""
    t = outbox.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in ("created_at", "published_at")})
    now, seconds = F.lit(as_of), lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    pending = F.when((F.col("status") == "PENDING") & F.col("published_at").isNull(), F.col("created_at"))
    one = t.agg(
        F.max(F.greatest(seconds(F.col("created_at"), now), F.lit(0.0))).alias("skew"), F.max("created_at").alias("latest"), F.min(pending).alias("oldest"),
        F.max(seconds(F.col("published_at"), F.col("created_at"))).alias("delay"), F.count_if((F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= now)).alias("volume"),
    )
    age, lag = seconds(now, F.col("latest")) / 60, seconds(now, F.col("oldest")) / 60
    volume_ok = F.col("volume").between(limits["min_24h"], limits["max_24h"])
    row = lambda check, status, severity, metric, threshold: F.struct(
        F.lit(check).alias("check"), status.alias("status"), F.lit(severity).alias("severity"), metric.cast("double").alias("metric"), F.lit(float(threshold)).alias("threshold"), F.lit("").alias("details")
    )
    return one.select(
        F.inline(
            F.array(
                row("time.clock_skew", status_of(F.col("skew"), 60, 300), "critical", F.col("skew"), 300),
                row("freshness.outbox_latest_event", F.when(age.isNull() | (age > 1440), "FAIL").otherwise("OK"), "critical", age, 1440),
                row("lag.outbox_pending", status_of(lag, 30, 120), "high", F.coalesce(lag, F.lit(0.0)), 120),
                row("lag.publish_delay", status_of(F.col("delay"), 60, 300), "high", F.coalesce("delay", F.lit(0.0)), 300),
                row("volume.outbox_events_24h", F.when(volume_ok, "OK").otherwise("WARN"), "medium", F.col("volume"), limits["max_24h"]),
            )
        )
    )


def duplicate_check(outbox: DataFrame) -> DataFrame:
    """Events of equal type, aggregate and payload; the payload is grouped by its digest."""
    groups = outbox.groupBy("event_type", "aggregate_id", F.sha2("payload", 256).alias("digest")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    one = preview(groups, F.concat_ws(":", "event_type", F.col("aggregate_id").cast("string"), F.col("times").cast("string")), F.col("aggregate_id"))
    return _result(one, "idempotency.duplicate_semantic_event", F.when(F.col("n") > 0, "FAIL").otherwise("OK"), "high", F.col("n"), 0.0, F.col("details"))


def movement_pivot(movements: DataFrame) -> DataFrame:
    q = lambda kind: F.sum(F.when(F.col("movement_type") == kind, F.col("quantity")).otherwise(0))
    return movements.groupBy("sku_id").agg(q("RESERVE").alias("reserved_q"), q("COMMIT").alias("committed_q"), q("RELEASE").alias("released_q"))


def reconciliation(baseline: DataFrame, movements: DataFrame, stock: DataFrame) -> DataFrame:
    """(sku_id, field, expected, actual) of every mismatch. No movement counts 0; a missing stock row is a mismatch."""
    m = movement_pivot(movements)
    rows = baseline.join(m, "sku_id", "left").fillna(0, ["reserved_q", "committed_q", "released_q"]).join(stock, "sku_id", "left")
    r, c, b = F.col("reserved_q"), F.col("committed_q"), F.col("released_q")
    field = lambda name, expected: F.struct(F.lit(name).alias("field"), expected.cast("double").alias("expected"), F.col(f"{name}_stock").cast("double").alias("actual"))
    rows = rows.select("sku_id", F.inline(F.array(field("available", F.col("base") - r + b), field("reserved", r - c - b), field("sold", c))))
    return rows.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def reconciliation_check(baseline: DataFrame, movements: DataFrame, stock: DataFrame) -> DataFrame:
    bad = reconciliation(baseline, movements, stock)
    one = preview(bad, F.concat_ws(":", F.col("sku_id").cast("string"), "field"), F.col("sku_id"))
    empty = baseline.isEmpty()
    status = F.lit("WARN") if empty else F.when(F.col("n") > 0, "FAIL").otherwise("OK")
    return _result(one, "reconciliation.inventory_movements", status, "critical", F.col("n"), 0.0, F.lit("no baseline") if empty else F.col("details"))


def run_all(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def gate(results: DataFrame) -> DataFrame:
    """One row: passed is false if any check failed."""
    return results.agg((~F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("checks"))


def gauges(results: DataFrame) -> DataFrame:
    value = F.create_map(*[x for k, v in GAUGE.items() for x in (F.lit(k), F.lit(v))])
    return results.select("check", value[F.col("status")].alias("gauge"))


def first_per_group(rows: DataFrame, group: str, order: str, keep: int = 5) -> DataFrame:
    """The first violations of each group, as rows."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
