"""Exact ranks where approximate percentiles miss them."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import ranks as rk
from millrace.operators import anomaly as an
from millrace.sources import clustering as cl

from .oracle import connect


@pytest.fixture(scope="module")
def amounts(spark, tmp_path_factory):
    """Distinct amounts, one group of a few rows, a null group, null amounts and a group of equal ones."""
    r = random.Random(5)
    rows = [(g, float(x)) for g, n in (("a", 4001), ("b", 3), (None, 700)) for x in r.sample(range(10**6), n)] + [("c", 7.0)] * 50 + [("a", None), ("d", None)]
    path = str(tmp_path_factory.mktemp("ranks") / "t.parquet")
    spark.createDataFrame(rows, "product string, amount double").coalesce(1).write.parquet(path)
    return path


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("interpolated", [True, False])
def test_percentiles_are_exact(spark, amounts, accuracy, interpolated):
    kind = "cont" if interpolated else "disc"
    want = connect().execute(f"SELECT product, quantile_{kind}(amount, 0.99) FROM '{amounts}/*.parquet' WHERE amount IS NOT NULL GROUP BY 1").fetchall()
    got = rk.percentile(spark.read.parquet(amounts), "amount", 0.99, "product", interpolated, accuracy).collect()
    assert {r.g: round(r.p, 6) for r in got} == {g: round(x, 6) for g, x in want} and len(got) == len(want)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_cut_values_are_exact(spark, amounts, accuracy):
    shares = [i / 16 for i in range(1, 16)]
    want = connect().execute(f"SELECT quantile_disc(amount, {shares}) FROM '{amounts}/*.parquet'").fetchone()[0]
    df = spark.read.parquet(amounts)
    assert rk.cut_values(df, "amount", shares, accuracy) == sorted(set(want))
    assert rk.cut_values(df.filter("amount < 0"), "amount", shares) == []


def test_statistics_beyond_the_accuracy(spark):
    """More rows in a product than an approximate rank tells apart."""
    t = spark.range(0, 200_000).select(F.lit("p").alias("product"), (F.pmod(F.col("id") * 7919, F.lit(200_000)) + 1).cast("double").alias("amount"))
    assert an.amount_statistics(t, exact=True, interpolated=False).first().p99 == 198_000.0
    assert an.amount_statistics(t, exact=True).first().p99 == pytest.approx(198_000.01)


def test_curve_bounds_beyond_the_accuracy(spark):
    df = spark.range(0, 300_000).select(F.pmod(F.col("id") * 7919, F.lit(300_000)).alias("k"))
    assert cl.range_bounds(df, ["k"], 6)["k"] == [-(-300_000 * i // 64) - 1 for i in range(1, 64)]
