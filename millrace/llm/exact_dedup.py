"""Exact dedup by a distributed content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, partitions, read, staged, text_or_empty

_RUNS = "doc_id long, part int, run long, place long, head_id long, run_size long, edge boolean, text_sha256 string"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row with the one before it; rows come sorted by text, then doc_id.

    Of the run at hand only ids are held, never texts: at most the rows of one range partition.
    """
    part = TaskContext.get().partitionId()
    run, last, ids = -1, None, []

    def closed(edge: bool) -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "part": part, "run": run, "place": range(n),
            "head_id": pd.array([ids[0]] * n, dtype="Int64"), "run_size": n, "edge": edge,
            "text_sha256": hashlib.sha256(last.encode()).hexdigest(),
        })

    for batch in batches:
        out = []
        for i, text in zip(batch["doc_id"], batch["norm"]):
            if text != last:
                if ids:
                    out.append(closed(run == 0))
                run, last, ids = run + 1, text, []
            ids.append(None if pd.isna(i) else int(i))
        if out:
            yield pd.concat(out)
    if ids:
        yield closed(True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents stay when texts that are equal after white-space folding keep their smallest id.

    Sampled splitters deal the rows by (first characters, hash, id), so that a very large group of
    equal texts spans as many range partitions as it needs; Spark's external sort puts equal texts side by side
    and each is compared in full with its neighbour. Groups that cross a partition edge are stitched from
    the first and last run of every partition: at most two rows per partition.

    Null text counts as empty; empty texts are equal. A null id is larger than any other. Of repeated
    rows (same id, same text) one has kept = true. Other columns are ignored. No rows give no rows.
    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    rows = rows.select("doc_id", "norm", F.substring("norm", 1, 24).alias("lead"), F.xxhash64("norm").alias("h"))
    order = [F.asc("lead"), F.asc("h"), F.asc_nulls_last("doc_id")]
    dealt = rows.repartitionByRange(partitions(spark), *order)
    sorted_rows = dealt.sortWithinPartitions("lead", "h", "norm", F.asc_nulls_last("doc_id")).select("doc_id", "norm")
    runs = staged(sorted_rows.mapInPandas(_runs, _RUNS), "exact-runs")

    edges = runs.filter("edge").groupBy("part", "run").agg(
        F.first("text_sha256").alias("sha"), F.min("head_id").alias("head"), F.max("run_size").alias("n")
    )
    joined = edges.groupBy("sha").agg(
        F.min_by("head", F.struct("part", "run")).alias("first_id"),
        F.min(F.struct("part", "run")).alias("first_run"),
        F.sum("n").alias("all_n"),
        F.collect_list(F.struct("part", "run")).alias("at"),
    )
    stitch = joined.filter(F.size("at") > 1).select("first_id", "first_run", "all_n", F.inline("at"))
    out = runs.join(F.broadcast(stitch), ["part", "run"], "left")  # two rows per range partition at most
    crosses = F.col("all_n").isNotNull()
    return out.select(
        "doc_id",
        F.when(crosses, F.col("first_id")).otherwise(F.col("head_id")).alias("keep_id"),
        F.coalesce("all_n", "run_size").cast("long").alias("group_size"),
        ((F.col("place") == 0) & (~crosses | (F.struct("part", "run") == F.col("first_run")))).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
