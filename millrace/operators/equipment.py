"""Equipment analytics: two feed schemas, daily effectiveness, downtime, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import effectiveness

#: The common schema of machine events.
COLUMNS = ("site_code", "shift_date", "shift_code", "machine_number", "produced_qty", "good_qty", "runtime_minutes", "downtime_minutes", "downtime_reason")


def _shift(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).startswith("DAY") | (F.upper(F.trim(c)) == "D"), "D").otherwise("N")


def _text(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def from_flat(rows: DataFrame, site: Column) -> DataFrame:
    """A feed with flat upper-case columns; missing numbers are 0, missing texts have defaults."""
    return rows.select(
        site.alias("site_code"), F.col("SHIFT_DATE").cast("string").try_cast("date").alias("shift_date"), _shift(F.col("SHIFT_CODE")).alias("shift_code"),
        F.upper(_text(F.col("MACHINE_NUMBER"), "UNKNOWN")).alias("machine_number"), _number(F.col("PRODUCED_QTY")).alias("produced_qty"), _number(F.col("GOOD_QTY")).alias("good_qty"),
        _number(F.col("RUN_TIME_MIN")).alias("runtime_minutes"), _number(F.col("DOWN_TIME_MIN")).alias("downtime_minutes"), _text(F.col("DOWN_TIME_REASON"), "Unknown").alias("downtime_reason"),
    )


def from_nested(rows: DataFrame, site: Column) -> DataFrame:
    """A feed with camel-case columns and a nested downtime, which may be null."""
    return rows.select(
        site.alias("site_code"), F.col("shiftDate").cast("string").try_cast("date").alias("shift_date"), _shift(F.col("shift")).alias("shift_code"),
        F.upper(_text(F.col("machineNo"), "UNKNOWN")).alias("machine_number"), _number(F.col("outputQty")).alias("produced_qty"), _number(F.col("okQty")).alias("good_qty"),
        _number(F.col("runtime_minutes")).alias("runtime_minutes"), _number(F.col("downtime.minutes")).alias("downtime_minutes"), _text(F.col("downtime.reason"), "Unknown").alias("downtime_reason"),
    )


def event_issue(known_machine: Column) -> list[tuple[str, Column]]:
    """Ordered rules; the first that fails names the issue."""
    return [
        ("missing_shift_date", F.col("shift_date").isNull()),
        ("unknown_machine", ~known_machine),
        ("negative_quantity", (F.col("produced_qty") < 0) | (F.col("good_qty") < 0)),
        ("invalid_good_quantity", F.col("good_qty") > F.col("produced_qty")),
    ]


def daily_effectiveness(events: DataFrame, machines: DataFrame, digits: int | None = 4) -> DataFrame:
    """One row for each (site, date, machine). Planned minutes and cycle are maxima, so two shifts don't double them."""
    rows = events.join(machines, ["site_code", "machine_number"])
    rows = rows.groupBy("site_code", "shift_date", "machine_number").agg(
        F.sum("produced_qty").alias("produced_qty"), F.sum("good_qty").alias("good_qty"), F.sum("runtime_minutes").alias("runtime_minutes"),
        F.sum("downtime_minutes").alias("downtime_minutes"), F.max("planned_minutes_per_shift").alias("planned"), F.max("ideal_cycle_seconds").alias("cycle"),
    )
    parts = effectiveness(F.col("runtime_minutes"), F.col("planned"), F.col("produced_qty"), F.col("good_qty"), F.col("cycle"))
    return rows.select("site_code", "shift_date", "machine_number", *[(c if digits is None else F.round(c, digits)).alias(k) for k, c in parts.items()], "produced_qty", "good_qty", "downtime_minutes")


def latest_against_baseline(daily: DataFrame, least_rows: int = 3) -> DataFrame:
    """The latest day of each machine beside mean and population deviation of all days before it."""
    w = Window.partitionBy("site_code", "machine_number").orderBy("shift_date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = daily.withColumns(
        {"n_before": F.count(F.lit(1)).over(before)}
        | {f"{c}_mean": F.avg(c).over(before) for c in ("oee", "downtime_minutes")}
        | {f"{c}_std": F.stddev_pop(c).over(before) for c in ("oee", "downtime_minutes")}
    )
    last = Window.partitionBy("site_code", "machine_number").orderBy(F.desc("shift_date"))
    return rows.withColumn("_n", F.row_number().over(last)).filter((F.col("_n") == 1) & (F.col("n_before") >= least_rows)).drop("_n")


#: A z score within so much of its limit is at the limit: moments depend on the order of their rows in the last bits.
TIE = 1e-12


def alerts(latest: DataFrame, oee_z: float = -2.0, downtime_z: float = 2.0) -> DataFrame:
    """At most two alerts a machine, for z scores beyond the limits; a deviation of 0 counts as 0.01 and 1.0."""
    z = lambda c, least: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, least).otherwise(F.col(f"{c}_std"))
    row = lambda metric, c, score, level: F.struct(F.lit(metric).alias("metric"), F.col(c).alias("value"), F.round(score, 2).alias("z"), F.lit(level).alias("severity"))
    o, t = z("oee", 0.01), z("downtime_minutes", 1.0)
    found = F.array_compact(F.array(F.when(o < oee_z - TIE, row("oee", "oee", o, "high")), F.when(t > downtime_z + TIE, row("downtime_minutes", "downtime_minutes", t, "medium"))))
    return latest.select("site_code", "machine_number", "shift_date", F.inline(found))
