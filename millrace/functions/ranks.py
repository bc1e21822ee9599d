"""Values at exact ranks, found in bounded memory: approximate percentiles only say where to look."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the percentiles that cut the rows: a rank is looked up among about 4 / ACCURACY of them.
ACCURACY = 10_000


def range_rank(column: Column, bounds: Sequence) -> Column:
    """How many of the sorted bounds are below the value, as nested comparisons: log2 of them a row. Nulls have rank 0."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column > F.lit(bounds[mid]), below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(bounds))


def values_at(rows: DataFrame, value: str, shares: Sequence[float], ranks: Callable[[Column], Sequence[Column]], by: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(g, n, i, x): for each value g of by, of which there are few (one group without by), its number n of values and those at ranks(n), counted from 1, numbered i.

    Values just below and above the shares cut the rows into buckets, whose sizes tell exactly which of them hold the ranks; only these are sorted. ranks
    near the shares lie in small buckets; others are as right, and cost more. Nulls take no part.
    """
    rows = rows.select((F.col(by) if by else F.lit(0)).alias("g"), F.col(value).alias("x")).filter("x IS NOT NULL")
    at = sorted({min(max(s + e, 0.0), 1.0) for s in shares for e in (-2 / accuracy, 2 / accuracy)})
    known = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*map(F.lit, at)), accuracy).alias("cuts"))
    same = F.col("g").eqNullSafe(F.col("own"))
    if by:
        placed = rows.join(F.broadcast(known.select(F.col("g").alias("own"), "cuts")), same).select("g", "x", F.size(F.filter("cuts", lambda c: F.col("x") > c)).alias("bucket"))
    else:
        one = known.first()
        placed = rows.withColumn("bucket", range_rank(F.col("x"), sorted(set(one["cuts"])) if one else []))
    before = F.sum("m").over(Window.partitionBy("g").orderBy("bucket")) - F.col("m")
    sizes = placed.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("m")).withColumn("before", before)
    wanted = known.select(F.col("g").alias("own"), "n", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("i", "rank"))
    wanted = sizes.join(wanted, same & (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("m")))
    # few rows: one for each group and rank
    wanted = F.broadcast(wanted.select("own", "n", "i", F.col("bucket").alias("own_bucket"), (F.col("rank") - F.col("before")).alias("rank")))
    here = same & (F.col("bucket") == F.col("own_bucket"))
    upto = F.sum("m").over(Window.partitionBy("g", "bucket").orderBy("x"))
    held = placed.join(wanted, here, "left_semi").groupBy("g", "bucket", "x").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", upto)
    return held.join(wanted, here & (F.col("upto") - F.col("m") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select("g", "n", "i", "x")


def nearest_rank(n: Column, share: float) -> Column:
    """The least rank that the share of n values doesn't exceed; in decimals, since 0.99 is no double."""
    return F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(share))) * n.cast("decimal(20,0)")))


def percentile(rows: DataFrame, value: str, share: float, by: str, interpolated: bool = True, accuracy: int = ACCURACY) -> DataFrame:
    """(g, p): the share's percentile of each group's values, exactly; interpolated between two values, or the value of the nearest rank."""
    place = (F.col("n") - 1) * F.lit(share)
    ranks = (lambda n: [F.floor((n - 1) * F.lit(share)) + 1, F.ceil((n - 1) * F.lit(share)) + 1]) if interpolated else lambda n: [nearest_rank(n, share)]
    found = values_at(rows, value, [share], ranks, by, accuracy)
    if not interpolated:
        return found.select("g", F.col("x").alias("p"))
    low, high = (F.max(F.when(F.col("i") == i, F.col("x"))) for i in (0, 1))
    both = found.groupBy("g").agg(F.max("n").alias("n"), low.alias("low"), high.alias("high"))
    return both.select("g", (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("p"))


def cut_values(rows: DataFrame, value: str, shares: Sequence[float], accuracy: int = ACCURACY) -> list:
    """The distinct values of the nearest ranks of the shares, in order."""
    found = values_at(rows, value, shares, lambda n: [nearest_rank(n, s) for s in shares], accuracy=accuracy)
    return sorted({r["x"] for r in found.select("x").collect()})  # at most one for each share
