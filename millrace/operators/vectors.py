"""An index of vectors by coarse cells: searches read the cells nearest to a query and rank what they find exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import SLICE, _best, _unit

#: Rows that cells are fitted on, and queries among them by which probes are chosen.
SAMPLE, JUDGES = 20_000, 500
#: Vectors of a piece of a cell, and queries that are sent to it together.
PIECE, BLOCK = 16_384, 65_536


@dataclass
class Cells:
    """Unit centroids, and how many cells a search reads so that the sample's neighbours are found at the recall asked for."""

    centroids: np.ndarray
    probes: int

    def order(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each vector, the nearest first."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :n]


def _fitted(unit: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    centroids = unit[r.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)  # an empty cell stays where it is
    return centroids


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, k: int = 3, recall: float = 0.97, rounds: int = 8, seed: int = 7) -> Cells:
    """Cells fitted by k-means of directions on the sample rows of smallest hash (of key); the driver holds those and their similarities to JUDGES of them.

    cells defaults to the square root of the sample's size. Probes are the fewest cells that hold the share recall of the k nearest neighbours, within the sample,
    of the judges. All vectors have one length; null ones take no part. Without vectors there are no cells.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    taken = rows.orderBy("h", "v").limit(sample).select("v").toPandas()  # bounded by sample
    if not len(taken):
        return Cells(np.zeros((0, 0)), 1)
    unit = _unit(taken["v"])
    cells = min(cells or max(1, int(np.sqrt(len(unit)))), len(unit))
    found = Cells(_fitted(unit, cells, rounds, seed), 1)
    judges = unit[: min(JUDGES, len(unit))]
    near = np.argsort(-(judges @ unit.T), axis=1, kind="stable")[:, : k + 1]
    home = np.argmax(unit @ found.centroids.T, axis=1)[near]
    place = np.argsort(found.order(judges, cells), axis=1)  # of each cell in the order in which a judge reads them
    found.probes = int(np.quantile(np.take_along_axis(place, home, 1), recall, method="higher")) + 1
    return found


def _placed(cells: Cells, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(pd.Series(batch.column("v").to_pylist())) if batch.num_rows else np.zeros((0, cells.centroids.shape[1]))
            order = cells.order(unit, probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def index(vectors: DataFrame, key: str, vector: str, cells: Cells) -> DataFrame:
    """(key, v, cell): every row that has a vector, in the cell of its nearest centroid. Written as a table, it serves any number of searches."""
    rows = vectors.select(F.col(key).alias(key), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    kind = vectors.schema[key].dataType.simpleString()
    return rows.mapInArrow(_placed(cells, 1), f"`{key}` {kind}, v array<double>, cells array<int>").select(key, "v", F.col("cells")[0].alias("cell"))


def search(indexed: DataFrame, queries: DataFrame, key: str, vector: str, cells: Cells, k: int = 3, probes: int | None = None, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(query_id, key, similarity, rank): of the rows in the probes cells nearest to each query, the k of largest cosine, ties by key.

    A cell is cut into pieces and its queries into blocks; a vector is sent once for each block of its own cell's queries, a query once for each
    piece of the cells that it reads. With probes as large as the number of cells the result is exact. indexed: see index; queries: query_id and the vector; null vectors take no part.
    """
    probes = min(probes or cells.probes, max(1, len(cells.centroids)))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = asked.mapInArrow(_placed(cells, probes), "query_id long, v array<double>, cells array<int>").select("query_id", "v", F.explode("cells").alias("cell"))
    parts = lambda rows, size, name: rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias(name))
    # a row for each cell at most
    counted = parts(indexed, piece, "pieces").join(parts(asked, block, "blocks"), "cell").collect()
    cut = asked.sparkSession.createDataFrame([tuple(r) for r in counted], "cell int, pieces int, blocks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = indexed.select(F.col(key).cast("long").alias("k"), "v", "cell").join(F.broadcast(cut), "cell")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("k"), "pieces").cast("int")).withColumn("block", every("blocks")).drop("pieces", "blocks")
    asked = asked.join(F.broadcast(cut), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("piece", every("pieces")).drop("pieces", "blocks")

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "k": [], "similarity": []}).astype({"query_id": "int64", "k": "int64"})]
        if len(q) and len(v):
            own, ids = _unit(v["v"]), v["k"].to_numpy(dtype=np.int64)
            for i in range(0, len(q), SLICE):
                part = q.iloc[i : i + SLICE]
                s = _unit(part["v"]) @ own.T
                row, column = _best(np.round(s, 12), ids, k)
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy(dtype=np.int64)[row], "k": ids[column], "similarity": s[row, column]}))
        return pd.concat(out)

    names = ["cell", "piece", "block"]
    found = asked.groupBy(*names).cogroup(rows.groupBy(*names)).applyInPandas(score, "query_id long, k long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "k")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("k", key)
