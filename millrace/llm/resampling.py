"""Importance resampling of documents towards a target set, by hashed word n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, partitions, read, staged

MAX_N, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words are not drawn; of the others so many hundredths are.
MIN_WORDS, PERCENT = 20, 10


def feature_values(words: list[bytes], max_n: int = MAX_N) -> Iterator[Iterator[int]]:
    """For each run length up to max_n, the CRC-32 of all runs of so many words joined by a space; a longer run goes on from the shorter one's value."""
    if max_n == 1:
        yield map(crc32, words)
        return
    runs = list(map(crc32, words))
    yield runs
    for n in range(1, max_n):
        runs = [crc32(w, crc32(b" ", run)) for run, w in zip(runs, words[n:])]
        yield runs


def _counted(max_n: int, buckets: int):
    """Counts by bucket: at most one row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            counts = Counter()
            for text in batch.column("text"):
                for values in feature_values(byte_words(text.as_py()), max_n):
                    counts.update(values)
            values = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
            np.add.at(totals, values % buckets, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": totals[used]})

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Null and empty texts have none."""
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(_counted(max_n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():  # a row a bucket at most
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p / q)) by bucket, p and q being its shares of target and raw features with one added to each bucket."""
    buckets = len(raw)
    all_raw, all_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def _weighted(gains: np.ndarray, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(gains)
        for batch in batches:
            out = {"n_words": [], "n_features": [], "weight": []}
            for text in batch.column("text"):
                words = byte_words(text.as_py())
                n = total = 0
                for values in feature_values(words, max_n):
                    at = np.fromiter(values, dtype=np.int64)
                    n, total = n + len(at), total + int(gains[at % buckets].sum())
                out["n_words"].append(len(words))
                out["n_features"].append(n)
                out["weight"].append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array(v, pa.int64()) for v in out.values()]], names=["doc_id", "h", *out])

    return run


def ranked(rows: DataFrame, order: list, percent: int) -> DataFrame:
    """rows with rank: 1, 2, 3... in order for the first percent hundredths of them, else null.

    Sampled splitters deal the rows in order over all partitions; a row's rank is its place plus the rows of the partitions before it,
    one number a partition. order must tell all rows apart, so that no group of equal ones lies in one partition.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = staged(dealt.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "ranked")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = list(accumulate(n for _, n in sizes))
    drawn = ends[-1] * percent // 100 if ends else 0
    before = spark.createDataFrame([(p, e - n) for (p, n), e in zip(sizes, ends)], "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    return dealt.join(F.broadcast(before), "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_features, weight, score and rank, a row for each of docs.

    A weight is the floored mean of the gains of a document's features; a score adds Gumbel noise made from seed and id, so that taking
    the highest scores draws without replacement in proportion to exp(weight / 1000). Of the documents with min_words or more, percent
    hundredths are drawn; equal scores go to the smaller id, null ids last, rows of one id in no fixed order. Null and empty texts
    have no features and weight 0; a null id counts as an empty one in the noise. Rows that repeat are separate documents with
    one weight and score. An empty target leaves a uniform one; no documents give no rows. Other columns are ignored. Texts of any length are taken whole.
    """
    raw, wanted = bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.cast("binary").alias("text"))
    rows = rows.mapInArrow(_weighted(bucket_gains(raw, wanted), max_n), "doc_id long, h long, n_words long, n_features long, weight long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    rows = rows.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "importance")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    few = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.filter(F.col("n_words") >= min_words), order, percent).unionByName(few).drop("row")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The drawn rows of docs, in their own columns; of repeated rows all stay when one is drawn. limits are those of importance."""
    drawn = importance(docs, target, id_col, text_col, **limits).filter("rank is not null").select(F.col("doc_id").alias("_did"), F.col("h").alias("_h")).distinct()
    h = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    same = (h == F.col("k._h")) & F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k._did"))
    return docs.alias("d").join(staged(drawn, "drawn").alias("k"), same, "left_semi")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


# a byte at a time with the reflected polynomial; the table's 256 entries come from the same rule
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL = rf"""
WITH RECURSIVE tr(i, step, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, step + 1, {_STEP} FROM tr WHERE step < 8),
tb AS (SELECT list(c ORDER BY i) AS t FROM tr WHERE step = 8),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
bw AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
dc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM dw) GROUP BY ALL),
bc AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM bw) GROUP BY ALL),
x AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dc UNION SELECT w FROM bc)),
y AS (SELECT w, list_transform(range(len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::BIGINT) AS bs FROM x),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM y, tb),
ds AS (SELECT bucket, sum(n) AS n FROM dc JOIN k USING (w) GROUP BY ALL),
bs AS (SELECT bucket, sum(n) AS n FROM bc JOIN k USING (w) GROUP BY ALL),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM ds)::DOUBLE + {BUCKETS} AS a, (SELECT coalesce(sum(n), 0) FROM bs)::DOUBLE + {BUCKETS} AS b),
g AS (SELECT k.bucket, any_value(floor(1000 * ln((coalesce(bs.n, 0)::DOUBLE + 1) * a / ((coalesce(ds.n, 0)::DOUBLE + 1) * b))))::BIGINT AS gain
  FROM k LEFT JOIN ds USING (bucket) LEFT JOIN bs USING (bucket), z GROUP BY k.bucket),
s AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dc JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT dw.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || dw.doc_id)[1:8])::BIGINT AS h FROM dw LEFT JOIN s USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
