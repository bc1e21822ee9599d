"""Near duplicates of the pipeline against all pairs by brute force."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, similar, simhash
from millrace.llm.common import drop_staged, shared_folder, staged
from tests.oracle import SF

from .data import awkward, empty, words


def _set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _groups(rows):
    """The least id of each id's component, over all pairs."""
    sets = [_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(k)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted((r[0], min(least[find(i)])) for i, r in enumerate(rows))


def _edited():
    """Copies with one word changed in places: similar by their shingles, over 4 bits of a fingerprint apart."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(12):
        text = [word() for _ in range(120)]
        rows.append((10 * g, " ".join(text)))
        for c in range(1, 5):
            own = list(text)
            for _ in range(c):
                own[r.randrange(120)] = word()
            rows.append((10 * g + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("chunk", [similar.CHUNK, 300])
def test_similar_documents(spark, monkeypatch, chunk):
    """Small chunks send a group through many cells."""
    monkeypatch.setattr(similar, "CHUNK", chunk)
    df, rows = awkward(spark)
    extra = _edited()
    docs = df.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in extra], "doc_id long, text string"))
    every = [r[:2] for r in rows if r[0] is not None] + [(1000 + i, t) for i, t in extra]
    got = sorted((r.doc_id, r.component_id) for r in similar.similar_documents(docs).collect())
    assert got == _groups(every)


def test_stage_keeps_one_of_edited_copies(spark):
    docs = spark.createDataFrame(_edited(), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect())
    assert kept == sorted({c for _, c in _groups(_edited())})


def test_confirmed_takes_the_limit_itself():
    a = np.arange(8, dtype=np.uint64)
    assert similar.confirmed([a, np.arange(10, dtype=np.uint64)]) == [(0, 1)]
    assert similar.confirmed([a, np.arange(11, dtype=np.uint64)]) == []


def test_similar_documents_of_nothing(spark):
    assert similar.similar_documents(empty(spark)).count() == 0


def test_texts_of_one_id_belong_together(spark):
    """Ids with several texts, whose copies have other ids and whose smallest ids meet: one document, however the texts are named."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(2) + " more"
    rows = [(5, text(1)), (7, text(1)), (5, text(2)), (3, text(2)), (9, near), (9, near), (4, text(3)), (4, text(4)), (6, text(4).upper()), (8, text(5)), (2, None), (11, "")]
    got = sorted((r.doc_id, r.component_id) for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2), (3, 3), (4, 4), (4, 4), (5, 3), (5, 3), (6, 4), (7, 3), (8, 8), (9, 3), (9, 3), (11, 2)]


def test_near_stage_goes_by_fingerprints(spark, monkeypatch):
    """Without bands, copies whose fingerprints are within 4 bits are still found, and only confirmed ones go."""
    monkeypatch.setattr(similar, "bands", lambda hashes: [])
    rows = _edited()
    docs = spark.createDataFrame(rows + [(500, rows[0][1].upper() + "  "), (501, ""), (502, None)], "doc_id long, text string")
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()}
    sets = {i: _set(t) for i, t in rows}
    alike = lambda i, k: bin(prints[i] ^ prints[k]).count("1") <= 4 and 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])
    near = {i for i in sets for k in sets if k < i and alike(i, k)}
    assert near and not near & kept and {0, 501} <= kept and not {500, 502} & kept
    assert kept >= {i for i, _ in rows if i % 10 == 0}


def test_filters_that_let_all_pass_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 3)
    got = sorted((r.doc_id, r.component_id) for r in similar.similar_documents(spark.createDataFrame(_edited(), "doc_id long, text string")).collect())
    assert got == _groups(_edited())


def test_large_tables_go_when_they_are_done(spark):
    """Bands and shingle sets are deleted once nothing reads them; no join or shuffle carries whole texts."""
    folder = shared_folder(spark).removeprefix("file://")
    before, plans, write = set(os.listdir(folder)), [], similar.staged

    def spied(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(similar, "staged", spied)
        out = similar.similar_documents(spark.createDataFrame(_edited(), "doc_id long, text string"))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert "named" in left and not left & {"banded", "banded-nodes", "banded-names", "shingle-sets"}
    assert not any("Join LeftSemi" in p for p in plans)
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == _groups(_edited())


def test_only_staged_tables_are_dropped(spark, tmp_path):
    own = str(tmp_path / "own")
    spark.range(3).write.parquet(own)
    mine, empty_one = staged(spark.range(2), "t"), staged(spark.range(0), "t")
    folders = [t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for t in (mine, empty_one)]
    drop_staged(spark.read.parquet(own), mine, empty_one)
    assert spark.read.parquet(own).count() == 3 and not any(os.path.exists(f) for f in folders)
