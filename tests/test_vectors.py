"""The cell index against exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as rt
from millrace.operators import vectors as vec
from tests.oracle import SF


def split(rows):
    return rows, rows.filter("k % 20 = 0").select(F.col("k").alias("query_id"), "v")


def pairs(found):
    return {(r.query_id, r.k) for r in found.collect()}


def made(spark, n, seed=1, dims=16):
    """Vectors around 20 centres, some of them equal, some null."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dims))
    v = centres[r.integers(0, 20, n)] + 0.4 * r.normal(size=(n, dims))
    v[5::50] = v[5]
    rows = [(i, None if i % 97 == 13 else v[i].tolist(), "x") for i in range(n)]
    return split(spark.createDataFrame(rows, "k long, v array<double>, cell string").repartition(3))


def test_all_probes_are_exact_and_fewer_find_most(spark):
    rows, queries = made(spark, 2000)
    cells = vec.fit_cells(rows, "k", "v")
    held = vec.index(rows, "k", "v", cells).cache()
    exact = pairs(rt.nearest(rows, queries, "k", "v"))
    every = vec.search(held, queries, "k", "v", cells, probes=len(cells.centroids))
    assert pairs(every) == exact
    assert pairs(vec.search(held, queries, "k", "v", cells, probes=len(cells.centroids), piece=17, block=9)) == exact
    some = pairs(vec.search(held, queries, "k", "v", cells))
    assert len(some & exact) >= 0.9 * len(exact) and cells.probes < len(cells.centroids) / 2
    assert held.count() == rows.filter("v is not null").count() == held.select("k").distinct().count()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_over_the_given_vectors(spark, sf):
    folder = os.path.join(os.path.dirname(SF), f"sf{sf}")
    rows, queries = split(spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v")))
    cells = vec.fit_cells(rows, "k", "v")
    exact = pairs(rt.nearest(rows, queries, "k", "v"))
    some = pairs(vec.search(vec.index(rows, "k", "v", cells), queries, "k", "v", cells))
    assert len(some & exact) >= 0.9 * len(exact)


def test_small_sample_of_the_rows_still_indexes_all(spark):
    rows, queries = made(spark, 1500, 2)
    cells = vec.fit_cells(rows, "k", "v", sample=300)
    held = vec.index(rows, "k", "v", cells)
    assert held.count() == rows.filter("v is not null").count()
    exact = pairs(rt.nearest(rows, queries, "k", "v"))
    assert len(pairs(vec.search(held, queries, "k", "v", cells)) & exact) >= 0.9 * len(exact)


def test_nothing_to_search(spark):
    rows, queries = made(spark, 40)
    none = rows.filter("k < 0")
    cells = vec.fit_cells(none, "k", "v")
    assert len(cells.centroids) == 0
    one = rows.filter("k = 20")
    cells = vec.fit_cells(one, "k", "v")
    assert pairs(vec.search(vec.index(one, "k", "v", cells), queries, "k", "v", cells)) == {(0, 20), (20, 20)}
    assert vec.search(vec.index(one, "k", "v", cells), queries.filter("query_id < 0"), "k", "v", cells).count() == 0


def test_best_breaks_ties_by_id():
    s = np.array([[1.0, 2.0, 2.0, 0.0, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    row, column = vec._best(s, np.array([9, 8, 7, 6, 5]), 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 4), (0, 2), (1, 4), (1, 3)]


def test_nearest_scores_a_few_queries_at_a_time():
    """A full cell of 2,048 queries and 16,384 vectors stays far below the 268 MB that its similarities alone would take."""
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(1)
    v = pd.DataFrame({"k": np.arange(rt.CHUNK), "v": list(r.normal(size=(rt.CHUNK, 8)))})
    q = pd.DataFrame({"query_id": np.arange(rt.BLOCK), "v": v["v"][: rt.BLOCK]})
    tracemalloc.start()
    out = rt.best_of_cell(q, v, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(out) == 3 * rt.BLOCK and (out["k"].to_numpy()[::3] == np.arange(rt.BLOCK)).all()


def test_best_looks_only_into_groups_that_may_hold_it():
    """Ties beyond 12 digits go by id, wherever the columns lie, and the last group may be short."""
    r = np.random.default_rng(2)
    s = np.round(r.normal(size=(9, 1000)), 2) + r.normal(size=(9, 1000)) * 1e-14
    s[3, 500:] = s[3].max()
    s[4] = -1.0
    ids = r.permutation(1000)
    row, column = rt._best(s, ids, 3)
    want = [(i, j) for i in range(9) for j in sorted(range(1000), key=lambda j: (-np.round(s[i, j], 12), ids[j]))[:3]]
    assert list(zip(row.tolist(), column.tolist())) == want


def test_retrieval_quality_asks_for_every_row(spark):
    from millrace.plans import catalog

    got = catalog.QUERIES["x09_retrieval_quality"](spark, SF).first()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v = np.array(e["embedding"].tolist(), dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label, s = e["label"].to_numpy(), np.round(v @ v.T, 12)
    near = [sorted(range(len(e)), key=lambda j: (-s[i, j], e["vec_id"][j]))[:3] for i in range(len(e))]
    assert got.pairs == 3 * len(e) and abs(got.hit_rate - np.mean([label[i] == label[j] for i, n in enumerate(near) for j in n])) < 1e-6
