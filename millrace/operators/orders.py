"""Order analytics over facts and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import work_folder


def status_histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def captured_revenue(payments: DataFrame, amount: Column, captured: Column) -> DataFrame:
    return payments.agg(F.coalesce(F.sum(F.when(captured, amount)), F.lit(0)).alias("revenue"))


def merged_lines(orders: DataFrame, key: str, items: str) -> DataFrame:
    """Lines of an array of (sku, qty): SKU trimmed and upper-cased, without SKU or with qty <= 0 dropped, equal SKUs summed."""
    lines = orders.select(key, F.explode(items).alias("i")).select(key, F.upper(F.trim("i.sku")).alias("sku"), F.col("i.qty").alias("qty"))
    return lines.filter((F.col("sku") != "") & (F.col("qty") > 0)).groupBy(key, "sku").agg(F.sum("qty").alias("qty"))


def transitions(events: DataFrame, key: str, status: str, ts: str, seq: str) -> DataFrame:
    """(key, from_status, to_status, at, dwell_seconds) from status facts, in order of time and sequence."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    dwell = F.unix_seconds(F.lead(ts).over(w)) - F.unix_seconds(F.col(ts))
    return events.select(key, F.lag(status).over(w).alias("from_status"), F.col(status).alias("to_status"), F.col(ts).alias("at"), dwell.alias("dwell_seconds"), F.col(seq).alias("seq"))


def illegal_transitions(history: DataFrame, allowed: Sequence[tuple[str | None, str]]) -> DataFrame:
    ok = F.lit(False)
    for a, b in allowed:
        start = F.col("from_status").isNull() if a is None else F.col("from_status") == a
        ok = ok | F.coalesce(start & (F.col("to_status") == b), F.lit(False))
    return history.filter(~ok)


def documents(orders: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Orders with an array column for each kind of child, grouped before the join so that kinds don't multiply."""
    out = orders
    for name, rows in children.items():
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        out = out.join(grouped, key, "left")
    return out


def versions(changes: DataFrame, key: str, ts: str, tracked: Sequence[str], seq: str) -> DataFrame:
    """Slowly changing dimension of type 2: a version for each change of the tracked columns, valid from, to and current."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    h = F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in tracked]), 256)
    rows = changes.withColumn("_h", h).withColumn("_before", F.lag("_h").over(w)).filter("_before IS NULL OR _before <> _h")
    return rows.select(key, *tracked, F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def time_cuts(rows: DataFrame, key: str, at: str, most: int, fractions: int = 1000) -> DataFrame | None:
    """(key, bounds) for each key of more than most rows: times that cut its rows into pieces of about most rows (fractions pieces at most). None if no key has so many.

    All bounds together are no more than the rows by most.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & F.col(key).isNotNull())
    if hot.isEmpty():
        return None
    hot = _written(hot, "hot-keys")
    shares = F.array(*[F.lit(i / fractions) for i in range(1, fractions)])  # of which a key takes as many as it needs
    found = rows.join(hot.select(key), key, "left_semi").groupBy(key).agg(F.percentile_approx(at, shares, 10_000).alias("all"), F.count(F.lit(1)).alias("n"))
    pieces = F.least(F.ceil(F.col("n") / most), F.lit(fractions)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("all", (i * fractions / pieces).cast("int") - 1))
    return _written(found.select(key, F.array_distinct(picked).alias("bounds")), "time-cuts")


def _carried(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(_key, cut, carried): for each cut of a cut key the last version of the cuts before it."""
    place = F.struct("at", F.col("version.valid_to").isNull().alias("open"), F.col("version.valid_to").alias("to"))
    # each cut of a cut key, whether it has versions or not
    cuts = rows.join(bounds.select("_key"), "_key", "left_semi").groupBy("_key", "cut").agg(F.max_by("version", F.when(F.col("kind") == 0, place)).alias("left"))
    before = Window.partitionBy("_key").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.select("_key", "cut", F.last("left", ignorenulls=True).over(before).alias("carried")).filter("carried IS NOT NULL")


def as_of(facts: DataFrame, key: str, ts: str, dimension: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Facts with the version valid at their time, or nulls if there is none: facts and versions in one order by key and time, the last version carried forward.

    A key costs a sort of its rows, not a product of facts and versions. Keys of more than most rows are cut by time, and what the cuts before
    have left is passed on to a cut in a row of its own. The intervals of a key must not overlap, as those of versions() don't; of several
    that start at one time the last to end holds. Facts without key or time get nulls; versions without key or start are skipped.
    """
    names = [c for c in dimension.columns if c != key]
    whole = lambda columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    no = lambda df, columns: F.lit(None).cast(df.select(whole(columns).alias("s")).schema["s"].dataType)
    f = facts.select(F.col(key).alias("_key"), F.col(ts).alias("at"), F.lit(1).alias("kind"), whole(facts.columns).alias("fact"), no(dimension, names).alias("version"))
    v = dimension.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull())
    v = v.select(F.col(key).alias("_key"), F.col("valid_from").alias("at"), F.lit(0).alias("kind"), no(facts, facts.columns).alias("fact"), whole(names).alias("version"))
    rows = f.unionByName(v)
    bounds = time_cuts(rows.select("_key", "at"), "_key", "at", most)
    # a null time comes before all bounds
    place = F.lit(0) if bounds is None else F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("at"))), F.lit(0))
    # null keys are never matched, and so can be dealt at will
    place = F.when(F.col("_key").isNull(), F.pmod(F.xxhash64("fact"), F.lit(1024)).cast("int")).otherwise(place)
    rows = rows.withColumn("cut", place) if bounds is None else rows.join(bounds, "_key", "left").withColumn("cut", place).drop("bounds")

    order = [F.asc("at"), F.asc("kind"), F.asc_nulls_last("version.valid_to")]
    sofar = Window.partitionBy("_key", "cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("held", F.last("version", ignorenulls=True).over(sofar)).filter("kind = 1").select("_key", "cut", "at", "fact", "held")
    if bounds is not None:
        held = held.join(_carried(rows, bounds), ["_key", "cut"], "left").withColumn("held", F.coalesce("held", "carried"))
    valid = (F.col("held.valid_from") <= F.col("at")) & (F.col("held.valid_to").isNull() | (F.col("at") < F.col("held.valid_to")))
    # nulls and not the version where none is valid
    held = held.withColumn("held", F.when(valid & F.col("_key").isNotNull(), F.col("held")))
    return held.select("fact.*", *[F.col(f"held.`{c}`").alias(c) for c in names])


def daily_snapshot(movements: DataFrame, key: str, day: str, quantity: str, base: DataFrame) -> DataFrame:
    """Stock of each key on each of its days from the first to the last movement: base plus all movements so far."""
    per_day = movements.groupBy(key, day).agg(F.sum(quantity).alias("change"))
    span = per_day.groupBy(key).agg(F.sequence(F.min(day), F.max(day), F.expr("INTERVAL 1 DAY")).alias("days")).select(key, F.explode("days").alias(day))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    rows = span.join(per_day, [key, day], "left").join(base, key)
    return rows.select(key, day, (F.col("base") + F.sum(F.coalesce("change", F.lit(0))).over(w)).alias("stock"))


def funnel(events: DataFrame, key: str, kind: str, ts: str, steps: Sequence[str]) -> DataFrame:
    """First time of each step and seconds from the first step to the last, per key."""
    rows = events.groupBy(key).agg(*[F.min(F.when(F.col(kind) == s, F.col(ts))).alias(s) for s in steps])
    return rows.withColumn("cycle_seconds", F.unix_seconds(steps[-1]) - F.unix_seconds(steps[0]))


def shift_minutes(intervals: DataFrame, keys: Sequence[str], start: str, end: str, hours: int = 12) -> DataFrame:
    """Minutes of each interval that fall in each shift of the given hours, across days."""
    size = hours * 3600
    first = F.floor(F.unix_seconds(start) / size) * size
    last = F.floor((F.unix_seconds(end) - 1) / size) * size
    rows = intervals.filter(F.col(end) > F.col(start)).withColumn("_shift", F.explode(F.sequence(first, last, F.lit(size).cast("long"))))
    minutes = (F.least(F.unix_seconds(end), F.col("_shift") + size) - F.greatest(F.unix_seconds(start), F.col("_shift"))) / 60
    return rows.groupBy(*keys, F.timestamp_seconds("_shift").alias("shift_start")).agg(F.sum(minutes).alias("minutes"))
