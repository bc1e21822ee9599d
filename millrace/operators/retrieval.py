"""Corpus retrieval: heading sections, clean chunks, exact vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .quality import latest_by

HEADING = r"^#{1,4}\s+(.*)$"
CUT = 6000
#: Queries and vectors of a cell, and queries scored at once: 16 MB of similarities.
BLOCK, CHUNK, SLICE = 2048, 16384, 128
#: Columns of a group: only groups whose largest similarity is large enough are looked into.
GROUP = 64


def _let(value: Column, f) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body): split at headings of level 1 to 4; what comes before the first is Overview.

    One array expression for each document: no shuffle. Null text is one empty section.
    """
    headed = lambda lines, i: F.get(lines, i).rlike(HEADING)

    def starts(lines: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: headed(lines, i))
        return F.when(F.get(marks, F.lit(0)) == 0, marks).otherwise(F.concat(F.array(F.lit(0)), marks))

    def section(lines: Column, at: Column, start: Column, i: Column) -> Column:
        own = headed(lines, start)
        body = start + own.cast("int")
        end = F.coalesce(F.get(at, i + 1), F.size(lines))
        return F.struct(
            (i + headed(lines, F.lit(0)).cast("int")).cast("long").alias("section"), F.when(own, F.trim(F.regexp_extract(F.get(lines, start), HEADING, 1))).otherwise("Overview").alias("heading"),
            F.array_join(F.slice(lines, body + 1, end - body), "\n").alias("body"),
        )

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    parts = _let(lines, lambda x: _let(starts(x), lambda at: F.transform(at, lambda start, i: section(x, at, start, i))))
    return docs.select(key, F.inline(parts))


def cleaned(text: Column) -> Column:
    """Without code fences, tags, link targets and marks; white space collapsed; cut at CUT characters."""
    for pattern, to in ((r"(?s)```.*?```", " "), (r"<[^>]+>", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`>#|]", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.left(F.trim(text), F.lit(CUT))


def with_fallback(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A query without hits gets the first k chunks, which are looked for only if there is one. ranked is read twice."""
    none = queries.select("query_id").join(ranked.select("query_id"), "query_id", "left_anti")
    if none.isEmpty():
        return ranked.select("query_id", key, "score", "rank")
    first = chunks.select(key).orderBy(key).limit(k)
    rest = none.crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows
    w = Window.partitionBy("query_id").orderBy(key)
    return ranked.select("query_id", key, "score", "rank").unionByName(rest.withColumn("rank", F.row_number().over(w)))


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest values of each row, rounded to 12 digits, ties by id."""
    most = np.maximum.reduceat(s, np.arange(0, s.shape[1], GROUP), axis=1)
    # k groups hold a value each that is no less
    least = np.partition(most, -k, axis=1)[:, -k, None] if most.shape[1] > k else -np.inf
    row, group = np.nonzero(most >= least - 1e-11)
    row, column = np.repeat(row, GROUP), (group[:, None] * GROUP + np.arange(GROUP)).ravel()
    row, column = row[column < s.shape[1]], column[column < s.shape[1]]
    value = np.round(s[row, column], 12)
    order = np.lexsort((ids[column], -value, row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(s)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], column[kept]


def best_of_cell(q: pd.DataFrame, v: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k vectors of largest cosine for each query, SLICE queries at a time."""
    if not len(q) or not len(v):
        return pd.DataFrame({"query_id": [], "k": [], "similarity": []}).astype({"query_id": "int64", "k": "int64"})
    own, ids, asking, out = _unit(v["v"]), v["k"].to_numpy(dtype=np.int64), q["query_id"].to_numpy(dtype=np.int64), []
    for i in range(0, len(q), SLICE):
        s = _unit(q["v"].iloc[i : i + SLICE]) @ own.T
        row, column = _best(s, ids, k)
        out.append(pd.DataFrame({"query_id": asking[i : i + SLICE][row], "k": ids[column], "similarity": s[row, column]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 3, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, key, similarity, rank): the k rows of largest cosine for each query, exactly.

    Queries are dealt into blocks of about so many, vectors into chunks; each pair of a block and a chunk is a cell, which keeps k rows
    a query, so that the final ranking sees k rows for each query and chunk. A cell scores SLICE queries at a time and never holds
    all its similarities. Nothing goes through the driver but two counts.
    queries: query_id and the vector. Null vectors take no part.
    """
    # floats stay floats while they travel
    plain = lambda df: F.col(vector).cast("array<float>" if df.schema[vector].dataType == ArrayType(FloatType(), True) else "array<double>").alias("v")
    rows = vectors.select(F.col(key).cast("long").alias("k"), plain(vectors)).filter("v IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), plain(queries)).filter("v IS NOT NULL")
    blocks, chunks = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))

    score = lambda q, v: best_of_cell(q, v, k)
    out = asked.groupBy("block", "chunk").cogroup(rows.groupBy("block", "chunk")).applyInPandas(score, "query_id long, k long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "k")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("k", key)


def centroid_shift(before: DataFrame, after: DataFrame, vector: str) -> DataFrame:
    """One row: the distance between the mean vectors of two sets."""
    mean = lambda df, n: df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias(n))
    both = mean(before, "a").join(mean(after, "b"), "i")
    return both.agg(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)).alias("shift"))


def first_chunks(docs: DataFrame, key: str) -> DataFrame:
    return latest_by(docs, [key], [F.asc("section")])
