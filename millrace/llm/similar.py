"""Near duplicates by the Jaccard similarity of word shingles: minima in bands find candidates, whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, partitions, staged, text_or_empty
from .components import components
from .decontaminate import _filter, _passing

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9994 at 0.8.
BANDS, ROWS = 40, 8
#: Documents that bands connect are compared in cells of about two chunks of so many shingles.
CHUNK = 250_000

_MIX = np.random.default_rng(7).integers(0, 1 << 64, size=(2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> tuple[str, np.ndarray]:
    """Digest of the words and the sorted hashes of their shingles: one of all words if they are fewer, none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    joined = b" ".join(words)
    digest = xxhash.xxh3_128_hexdigest(joined)
    if not words:
        return digest, np.empty(0, dtype=np.uint64)
    last = max(0, len(words) - size)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[: last + 1].tolist(), ends[-last - 1 :].tolist())]
    return digest, np.unique(np.array(hashes, dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key a band, from the least value of the hashes in each of its orders; none without hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[i : i + 256, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [shingles(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "words": [d for d, _ in made], "bands": [bands(h) for _, h in made]})


def _shared_keys(known: Broadcast):
    """(node, key) of the bands that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("bands")
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), held.value_lengths().to_numpy(zero_copy_only=False))
            keys = held.flatten().to_numpy(zero_copy_only=False)
            at = _passing(known.value, keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node[at], pa.int64()), pa.array(keys[at], pa.int64())], names=["node", "key"])

    return run


def _sets(known: Broadcast):
    """Shingle sets of the documents whose token the filter lets through; the other texts stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.iloc[_passing(known.value, batch["token"].to_numpy(dtype=np.int64).view(np.uint64))]
            if not len(batch):
                continue
            made = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["doc_id"].to_numpy(), "words": [d for d, _ in made], "n": [len(h) for _, h in made], "hashes": [h.tobytes() for _, h in made]})

    return run


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def confirmed(sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """A forest of links that joins the sets whose Jaccard similarity is SIMILARITY or more; with side, only pairs of two sides count.

    Sets already in one component are not compared, so that a dense group costs one pass, not one a member.
    """
    sizes, sides = np.array([len(s) for s in sets]), np.zeros(len(sets), dtype=int) if side is None else np.array(side)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(ids.max() + 1, dtype=bool)
    parent, root, links = list(range(len(sets))), np.arange(len(sets)), []
    for i in range(len(sets)):
        ahead = np.arange(i + 1, len(sets))
        ok = (root[ahead] != root[i]) & (np.minimum(sizes[ahead], sizes[i]) >= SIMILARITY * np.maximum(sizes[ahead], sizes[i]))
        if side is not None:
            ok &= sides[ahead] != sides[i]
        ahead = ahead[ok]
        if not len(ahead):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        marked[own] = True
        for k in ahead.tolist():
            if root[k] == root[i]:
                continue
            both = int(np.count_nonzero(marked[ids[bounds[k] : bounds[k + 1]]]))
            # in whole numbers: 4 of 5 is 0.8 exactly
            if both * 100 >= round(SIMILARITY * 100) * (sizes[i] + sizes[k] - both):
                links.append((i, k))
                a, b = _find(parent, i), _find(parent, k)
                parent[max(a, b)] = min(a, b)
                root[root == root[k]] = root[i]
        marked[own] = False
    return links


def _confirmed(cell: pd.DataFrame) -> pd.DataFrame:
    sets = [np.frombuffer(h, dtype=np.uint64) for h in cell["hashes"]]
    split = cell["ci"].iloc[0] != cell["cj"].iloc[0]
    found = confirmed(sets, cell["c"].tolist() if split else None)
    node = cell["node"].tolist()
    return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[k] for _, k in found]}, dtype="int64")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and component_id, the smallest id among all documents that links reach; a link is a Jaccard similarity of 0.8 or more of five-word shingles.

    Bands of minima find candidates, and so does more, if given: of texts (doc_id, text) and nodes (doc_id, node) it makes pairs of nodes (node, least). Whole sets confirm all.
    Texts with the same words are one document. A null or empty text has no words, so that it is linked to its like only.
    Rows without an id take no part. Rows with the same id are one document, whatever their texts, and are returned as often. No rows give no rows.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    prints = staged(rows.mapInPandas(_banded, "doc_id long, words string, bands array<long>"), "banded")
    # texts with the same words go on as one node, named by its smallest id: a short key for the many rows of bands
    nodes = staged(prints.groupBy("words").agg(F.min("doc_id").alias("node")), "banded-nodes")
    named = prints.join(nodes, "words").select("doc_id", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands"))
    with_bands = staged(named, "banded-names")
    named = staged(with_bands.select("doc_id", "node"), "named")
    drop_staged(prints, nodes)
    banded = with_bands.filter("bands is not null").select("node", "bands")
    shared = banded.select("node", F.explode("bands").alias("key")).groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = staged(shared.filter("least <> most").drop("most"), "bands")
    # most bands are no one else's: they travel once, to be counted, and are left behind here; the join refuses what passes in error
    tokens = shared.select(F.col("key").alias("token"))
    keys = banded.mapInArrow(_shared_keys(_filter(tokens, tokens.count())), "node long, key long")
    links = staged(keys.join(shared, "key").filter("node <> least").select("node", "least").distinct(), "band-candidates")
    drop_staged(with_bands, shared)
    if more is not None:
        links = staged(links.unionByName(more(rows, named)), "candidates")
    groups = staged(components(links, "node", "least"), "candidate-groups")

    # only sets of documents with a candidate travel, each once, however many bands it shares, and no texts
    tokens = groups.select(F.xxhash64("node").alias("token"))
    texts = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("token"))
    sets = texts.mapInPandas(_sets(_filter(tokens, tokens.count())), "node long, words string, n long, hashes binary")
    sets = staged(sets.dropDuplicates(["node", "words"]).join(groups, "node"), "shingle-sets")
    chunks = sets.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    cells = sets.join(staged(chunks, "chunks"), "root").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("root", F.least("c", "j").alias("ci"), F.greatest("c", "j").alias("cj"), "c", "node", "hashes")
    # dealt anew: the join above leaves all cells of a large group in one partition
    cells = cells.repartition(partitions(docs.sparkSession), "root", "ci", "cj")
    links = cells.groupBy("root", "ci", "cj").applyInPandas(_confirmed, "a long, b long")
    # rows with one id are one document, so that their texts belong together
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id", "a")
    same_id = named.join(staged(same_id, "repeated-ids"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    confirmed_links = staged(links.unionByName(same_id), "confirmed")
    drop_staged(sets)
    found = staged(components(confirmed_links, "a", "b"), "similar")
    # the smallest node of a component is the smallest id of all its texts
    return named.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component_id"))
