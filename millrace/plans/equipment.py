"""Equipment queries: suppliers stand for machines, line items for shift events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines as bl
from ..operators import equipment as eq
from ..operators import quality as dq
from ..sources import layers as ly
from .base import query, table


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Odd line numbers come as a flat feed, even ones as a nested one; the machine gives the site."""
    l = table(spark, d, "lineitem")
    day, shift = F.to_date("l_shipdate").cast("string"), F.when(F.col("l_linenumber") < 4, "DAY").otherwise("NIGHT")
    good, down = F.col("l_quantity") * (1 - F.col("l_discount")), 20 * F.col("l_linenumber")
    machine = F.concat(F.lit("m-"), F.col("l_suppkey").cast("string"))
    site = F.col("site")
    keyed = l.withColumn("site", (F.col("l_suppkey") % 5).cast("string"))
    flat = keyed.filter("l_linenumber % 2 = 1").select(
        "site", day.alias("SHIFT_DATE"), shift.alias("SHIFT_CODE"), machine.alias("MACHINE_NUMBER"), F.col("l_quantity").alias("PRODUCED_QTY"), good.alias("GOOD_QTY"),
        (480 - down).alias("RUN_TIME_MIN"), down.alias("DOWN_TIME_MIN"), F.col("l_returnflag").alias("DOWN_TIME_REASON"),
    )
    nested = keyed.filter("l_linenumber % 2 = 0").select(
        "site", day.alias("shiftDate"), F.initcap(shift).alias("shift"), machine.alias("machineNo"), F.col("l_quantity").alias("outputQty"), good.alias("okQty"),
        (480 - down).alias("runtime_minutes"), F.struct(down.alias("minutes"), F.col("l_returnflag").alias("reason")).alias("downtime"),
    )
    return eq.from_flat(flat, site).unionByName(eq.from_nested(nested, site))


EVENTS = """
SELECT (l_suppkey % 5)::VARCHAR AS site_code, l_shipdate::DATE AS shift_date, CASE WHEN l_linenumber < 4 THEN 'D' ELSE 'N' END AS shift_code, 'M-' || l_suppkey AS machine_number,
  l_quantity AS produced_qty, l_quantity * (1 - l_discount) AS good_qty, (480 - 20 * l_linenumber)::DOUBLE AS runtime_minutes, (20 * l_linenumber)::DOUBLE AS downtime_minutes, l_returnflag AS downtime_reason
FROM lineitem"""


@query("p06_standardised_events", f"SELECT site_code, shift_date, shift_code, machine_number, produced_qty, round(good_qty, 4) AS good_qty, runtime_minutes, downtime_minutes, downtime_reason FROM ({EVENTS})")
def p06(spark, d):
    return feeds(spark, d).withColumn("good_qty", F.round("good_qty", 4))


def machines(spark: SparkSession, d: str) -> DataFrame:
    """Machine master; every 13th supplier is missing from it."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").filter(k % 13 != 0)
    return rows.select((k % 5).cast("string").alias("site_code"), F.concat(F.lit("M-"), k.cast("string")).alias("machine_number"), (600 + k % 300).cast("double").alias("ideal_cycle_seconds"), F.lit(480).alias("planned_minutes_per_shift"))


MACHINES = "SELECT (s_suppkey % 5)::VARCHAR AS site_code, 'M-' || s_suppkey AS machine_number, (600 + s_suppkey % 300)::DOUBLE AS cycle, 480 AS planned FROM supplier WHERE s_suppkey % 13 <> 0"


@query("j10_unknown_machines", f"SELECT machine_number, count(*) AS n FROM ({EVENTS}) e WHERE NOT EXISTS (SELECT 1 FROM ({MACHINES}) m WHERE m.machine_number = e.machine_number) GROUP BY 1")
def j10(spark, d):
    known = machines(spark, d).select("site_code", "machine_number", F.lit(True).alias("known"))
    rows = feeds(spark, d).join(known, ["site_code", "machine_number"], "left")
    rows = rows.withColumn("issue_type", dq.first_failing(eq.event_issue(F.coalesce("known", F.lit(False)))))
    return rows.filter("issue_type = 'unknown_machine'").groupBy("machine_number").agg(F.count(F.lit(1)).alias("n"))


OEE = f"""
WITH g AS (SELECT site_code, shift_date, machine_number, sum(produced_qty) AS produced_qty, sum(good_qty) AS good_qty, sum(runtime_minutes) AS run, sum(downtime_minutes) AS downtime_minutes, max(planned) AS planned, max(cycle) AS cycle
  FROM ({EVENTS}) JOIN ({MACHINES}) USING (site_code, machine_number) GROUP BY ALL),
p AS (SELECT *, greatest(0, least(1.25, coalesce(run / nullif(planned, 0), 0)))::DOUBLE AS a, greatest(0, least(1.25, coalesce(produced_qty * cycle / nullif(run * 60, 0), 0)))::DOUBLE AS f, greatest(0, least(1.25, coalesce(good_qty / nullif(produced_qty, 0), 0)))::DOUBLE AS q FROM g),
oee AS (SELECT site_code, shift_date, machine_number, a AS availability, f AS performance, q AS quality, a * least(f, 1) * least(q, 1) AS oee, produced_qty, good_qty, downtime_minutes FROM p)"""


def oee(spark: SparkSession, d: str) -> DataFrame:
    """Unrounded: ties would round apart elsewhere."""
    return eq.daily_effectiveness(feeds(spark, d), machines(spark, d), digits=None)


@query("a05_daily_effectiveness", f"{OEE} SELECT site_code, shift_date, machine_number, availability, performance, round(quality + 1e-9, 4) AS quality, round(oee + 1e-9, 4) AS oee, produced_qty, downtime_minutes FROM oee")
def a05(spark, d):
    """Sums of quantities with fractions depend on their order in the last bits, and exact ties would round apart: both are rounded a little above."""
    above = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
    return oee(spark, d).select("site_code", "shift_date", "machine_number", "availability", "performance", above("quality"), above("oee"), "produced_qty", "downtime_minutes")


@query("d14_effectiveness_parts", f"{OEE} SELECT machine_number, count(*) AS days, max(availability) AS best_availability, max(performance) AS best_performance, max(quality) AS best_quality, round(avg(availability), 6) AS mean_availability, round(avg(quality), 6) AS mean_quality FROM oee GROUP BY 1")
def d14(spark, d):
    return oee(spark, d).groupBy("machine_number").agg(F.count(F.lit(1)).alias("days"), F.max("availability").alias("best_availability"), F.max("performance").alias("best_performance"), F.max("quality").alias("best_quality"), F.round(F.avg("availability"), 6).alias("mean_availability"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("a06_downtime_by_reason", f"SELECT site_code, shift_date, downtime_reason, sum(downtime_minutes) AS minutes FROM ({EVENTS}) GROUP BY ALL")
def a06(spark, d):
    return feeds(spark, d).groupBy("site_code", "shift_date", "downtime_reason").agg(F.sum("downtime_minutes").alias("minutes"))


@query("a07_downtime_pareto", f"SELECT downtime_reason, minutes, round(sum(minutes) OVER (ORDER BY minutes DESC, downtime_reason) / sum(minutes) OVER (), 6) AS running_share FROM (SELECT downtime_reason, sum(downtime_minutes) AS minutes FROM ({EVENTS}) WHERE site_code = '3' GROUP BY 1) ORDER BY minutes DESC")
def a07(spark, d):
    """The running share is taken over one row for each reason code."""
    from pyspark.sql import Window

    rows = feeds(spark, d).filter("site_code = '3'").groupBy("downtime_reason").agg(F.sum("downtime_minutes").alias("minutes"))
    one = Window.partitionBy(F.lit(1))
    share = F.sum("minutes").over(one.orderBy(F.desc("minutes"), "downtime_reason")) / F.sum("minutes").over(one)
    return rows.withColumn("running_share", F.round(share, 6)).orderBy(F.desc("minutes"))


@query("a08_site_summary", f"{OEE} SELECT site_code, round(avg(oee), 3) AS mean_oee, sum(downtime_minutes) AS downtime FROM oee GROUP BY 1")
def a08(spark, d):
    return oee(spark, d).groupBy("site_code").agg(F.round(F.avg("oee"), 3).alias("mean_oee"), F.sum("downtime_minutes").alias("downtime"))


@query("a09_machine_ranking", f"{OEE} SELECT machine_number, round(avg(oee), 3) AS mean_oee FROM oee GROUP BY 1 ORDER BY 2, 1")
def a09(spark, d):
    return oee(spark, d).groupBy("machine_number").agg(F.round(F.avg("oee"), 3).alias("mean_oee")).orderBy("mean_oee", "machine_number")


@query("a26_site_dimension", "SELECT site_code, any_value(s_suppkey)::BIGINT AS first_supplier FROM (SELECT (s_suppkey % 5)::VARCHAR AS site_code, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) = 1) GROUP BY 1")
def a26(spark, d):
    rows = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("string").alias("site_code"), "s_suppkey", F.col("s_suppkey").alias("seen"), F.lit(0).alias("arrival"))
    return dq.survivor(rows, "site_code", "seen", "arrival", ["s_suppkey"]).withColumnRenamed("s_suppkey", "first_supplier")


LATEST = """,
w AS (SELECT *, count(*) OVER b AS n_before, avg(oee) OVER b AS om, stddev_pop(oee) OVER b AS os, avg(downtime_minutes) OVER b AS dm, stddev_pop(downtime_minutes) OVER b AS ds,
  row_number() OVER (PARTITION BY machine_number ORDER BY shift_date DESC) AS rn FROM oee WINDOW b AS (PARTITION BY machine_number ORDER BY shift_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT * FROM w WHERE rn = 1 AND n_before >= 3)"""


MOMENTS = f"{OEE}{LATEST} SELECT machine_number, shift_date, n_before, round(om + 1e-9, 6) AS oee_mean, round(os + 1e-9, 6) AS oee_std, round(dm + 1e-9, 3) AS downtime_mean, round(ds + 1e-9, 3) AS downtime_std FROM l"


def grown_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Baselines from three batches of days, the last of which comes twice."""
    path, daily = ly.work_folder(spark, "baselines"), ly.work_folder(spark, "daily")
    oee(spark, d).write.parquet(daily)
    rows = spark.read.parquet(daily)
    first, second = (r.isoformat() for r in rows.agg(F.percentile_approx("shift_date", F.array(F.lit(0.5), F.lit(0.9)))).first()[0])
    base = bl.Baselines(spark, path, ["site_code", "machine_number"], "shift_date", ["oee", "downtime_minutes"])
    day = F.col("shift_date")
    for number, part in ((0, day <= first), (1, (day > first) & (day <= second)), (2, day > second), (2, day > second)):
        base.update(rows.filter(part), number)
    return base.latest()


def rounded_moments(rows: DataFrame) -> DataFrame:
    """Rounded a little above: exact ties would round apart with the order in which moments are added."""
    up = lambda c, digits, name: F.round(F.col(c) + 1e-9, digits).alias(name)
    means = [up("oee_mean", 6, "oee_mean"), up("oee_std", 6, "oee_std"), up("downtime_minutes_mean", 3, "downtime_mean"), up("downtime_minutes_std", 3, "downtime_std")]
    return rows.select("machine_number", "shift_date", "n_before", *means)


@query("w01_latest_against_baseline", MOMENTS)
def w01(spark, d):
    return rounded_moments(eq.latest_against_baseline(oee(spark, d)))


@query("w01_grown_baselines", MOMENTS)
def w01_grown(spark, d):
    """The same latest days and moments without a look at the days before the last batch."""
    return rounded_moments(grown_baselines(spark, d))


#: A score that is the limit itself is not beyond it, whatever the last bits of the moments.
ALERTS = f"{OEE}{LATEST} SELECT machine_number, shift_date, 'oee' AS metric, 'high' AS severity FROM l WHERE (oee - om) / CASE WHEN os = 0 THEN 0.01 ELSE os END < -0.5 - {eq.TIE} UNION ALL SELECT machine_number, shift_date, 'downtime_minutes', 'medium' FROM l WHERE (downtime_minutes - dm) / CASE WHEN ds = 0 THEN 1.0 ELSE ds END > 0.5 + {eq.TIE}"


@query("n03_grown_alerts", ALERTS)
def n03_grown(spark, d):
    return eq.alerts(grown_baselines(spark, d), -0.5, 0.5).select("machine_number", "shift_date", "metric", "severity")


@query("n03_equipment_alerts", ALERTS)
def n03(spark, d):
    """At half a deviation, as the supplied data have few outliers."""
    return eq.alerts(eq.latest_against_baseline(oee(spark, d)), -0.5, 0.5).select("machine_number", "shift_date", "metric", "severity")


ISSUE = f"SELECT e.site_code, CASE WHEN shift_date IS NULL THEN 'missing_shift_date' WHEN m.machine_number IS NULL THEN 'unknown_machine' WHEN produced_qty < 0 OR good_qty < 0 THEN 'negative_quantity' WHEN good_qty > produced_qty THEN 'invalid_good_quantity' END AS issue_type FROM ({EVENTS}) e LEFT JOIN ({MACHINES}) m ON e.site_code = m.site_code AND e.machine_number = m.machine_number"


@query("v_equipment_issues", f"SELECT site_code, issue_type, count(*) AS n FROM ({ISSUE}) WHERE issue_type IS NOT NULL GROUP BY ALL")
def v_equipment_issues(spark, d):
    """Rejected machine events by site and first failing rule."""
    m = machines(spark, d).select("site_code", "machine_number").withColumn("known", F.lit(True))
    rows = feeds(spark, d).join(m, ["site_code", "machine_number"], "left").withColumn("issue_type", dq.first_failing(eq.event_issue(F.coalesce("known", F.lit(False)))))
    return rows.filter("issue_type IS NOT NULL").groupBy("site_code", "issue_type").agg(F.count(F.lit(1)).alias("n"))
