"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that a link of two different nodes touches; root is the smallest node it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder. A node's smallest neighbour is aggregated
    (with partial sums) and staged before it is joined back, so that Spark can split the rows of a hub.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = staged(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "links")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        mark, before = _mark(edges), mark
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
