"""SimHash near-dedup with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, partitions, read, staged, text_or_empty, unpacked
from .components import components
from .similar import similar_documents

SHINGLE, RADIUS = 4, 4
#: Bits of each block. Fingerprints that differ in 4 bits at most agree in 2 of 6 blocks at least: 15 tables find every link.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A bucket is compared in cells of about two chunks of so many fingerprints.
CHUNK = 4096
#: Buckets up to so many rows are compared many at a time; rows of one such batch.
SMALL, BATCH = 32, 65536


def fingerprint(text: str) -> int:
    """SimHash of the 4-word shingles, as a signed 64-bit integer."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, last = b" ".join(words), max(0, len(words) - SHINGLE)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: last + 1].tolist(), ends[-last - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows; row p holds bit p of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(fps) // 64) * 64), dtype=np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within_radius(differing, alive: np.ndarray) -> np.ndarray:
    """The lanes of alive whose distance is 4 at most.

    differing(p, at) gives plane p of the differences in the words at; distances of all lanes are counted at once in
    three bit-sliced counters, four planes at a time through carry-save adders. Words in which every lane
    has passed the radius are abandoned.
    """
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive.any(axis=0) if alive.ndim == 2 else alive)
    pick = lambda a: a[..., at]
    live = pick(alive)
    c0, c1, c2, over = (np.zeros_like(live) for _ in range(4))
    for p in range(0, 64, 4):
        if not len(at):
            return out
        a, b = differing(p, at), differing(p + 1, at)
        h = c0 ^ a
        two_a = (c0 & a) | (h & b)
        c0 = h ^ b
        a, b = differing(p + 2, at), differing(p + 3, at)
        h = c0 ^ a
        two_b = (c0 & a) | (h & b)
        c0 = h ^ b
        h = c1 ^ two_a
        four = (c1 & two_a) | (h & two_b)
        c1 = h ^ two_b
        over |= c2 & four
        c2 ^= four
        if p % 8 == 4:
            live = live & ~(over | (c2 & (c0 | c1)))
            some = live.any(axis=0) if live.ndim == 2 else live != 0
            if some.sum() < 0.7 * len(at):
                at = at[some]
                c0, c1, c2, over, live = (x[..., some] for x in (c0, c1, c2, over, live))
    out[..., at] = live
    return out


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def link_small(fps: np.ndarray, group: np.ndarray, parent: np.ndarray) -> None:
    """Links rows within groups of SMALL rows at most, all groups at once: lane k compares row k with row k + offset."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = bit_planes(fps)
    for offset in range(1, SMALL):
        same = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
        same[: n - offset] = group[offset:] == group[:-offset]
        if not same.any():
            break
        ahead = np.zeros((64, len(same)), dtype=np.uint8)
        ahead[:, : n - offset] = bits[:, offset:]
        diff = planes ^ np.packbits(ahead, axis=1, bitorder="little").view("<u8")
        near = within_radius(lambda p, at, d=diff: d[p, at], np.packbits(same, bitorder="little").view("<u8"))
        for k in np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")).tolist():
            a, b = _find(parent, k), _find(parent, k + offset)
            if a != b:
                parent[max(a, b)] = min(a, b)


def link_large(fps: np.ndarray, parent: np.ndarray, first: int) -> None:
    """Links the rows of one group: 64 queries at a time against the planes of all rows.

    Members already in the query's component are masked, so that a dense group costs one union a row, not one a pair.
    """
    planes, n = bit_planes(fps), len(fps)
    lanes = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
    lanes[:n] = 1
    valid = np.packbits(lanes, bitorder="little").view("<u8")
    members: dict[int, np.ndarray] = {}

    def member(i: int) -> np.ndarray:
        if i not in members:
            members[i] = np.zeros_like(valid)
            members[i][i >> 6] = np.uint64(1 << (i & 63))
        return members[i]

    for q in range(0, n, 64):
        bits = (fps[q : q + 64, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        masks = (np.uint64(0) - bits)[:, :, None]
        near = within_radius(lambda p, at, m=masks: planes[p, at][None, :] ^ m[:, p], np.repeat(valid[None, :], len(bits), axis=0))
        for i, row in enumerate(near, start=q):
            root = _find(parent, first + i) - first
            new = row & ~member(root)
            for k in np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist() if new.any() else ():
                a, b = _find(parent, first + i) - first, _find(parent, first + k) - first
                if a != b:
                    a, b = min(a, b), max(a, b)
                    parent[first + b] = first + a
                    members[a] = member(a) | member(b)
                    del members[b]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell. Of each cell a forest of links comes out: one link a row at most, whatever the number of pairs."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        cell = rows[["t", "key", "ci", "cj"]].to_numpy()
        group = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]).any(axis=1))))
        first, sizes = np.unique(group, return_index=True, return_counts=True)[1:]
        parent = np.arange(len(fps))
        small = np.flatnonzero(sizes[group] <= SMALL)
        if len(small):
            own = np.arange(len(small))
            link_small(fps[small], group[small], own)
            parent[small] = small[own]
        for f, n in zip(first.tolist(), sizes.tolist()):
            if n > SMALL:
                link_large(fps[f : f + n], parent, f)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"a": fps[child].view(np.int64), "b": fps[parent[child]].view(np.int64)})

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= BATCH:
            last = (held[["t", "key", "ci", "cj"]] == held[["t", "key", "ci", "cj"]].iloc[-1]).all(axis=1).to_numpy()
            whole = held[~last]
            if len(whole):
                yield linked(whole)
                held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield linked(held)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, distinct) within the radius, directly or by way of others.

    A bucket of one table holds the fingerprints that agree in two blocks. A large one is cut into chunks, and each pair of chunks is a cell of its own.
    """
    masks = [((1 << n) - 1) << sum(BLOCKS[:i]) for i, n in enumerate(BLOCKS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(masks[i] | masks[j]) for i, j in combinations(range(len(BLOCKS)), 2)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])
    rows = prints.select("fp", F.inline(keys))
    shared = staged(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    rows = rows.join(shared, ["t", "key"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = rows.select("t", "key", F.least("c", "j").alias("ci"), F.greatest("c", "j").alias("cj"), "fp")
    cell = ["t", "key", "ci", "cj"]
    dealt = cells.repartition(partitions(prints.sparkSession), *cell).sortWithinPartitions(*cell, "fp")
    return dealt.mapInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id among all documents that links reach.

    Null or empty text has the fingerprint zero and is linked like any other. A null id never names a component;
    a component without any id has none. Rows that repeat are returned as often. No rows give no rows.
    Copies share a fingerprint and are compared once.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    found = staged(components(near_links(nodes.select("fp")), "a", "b"), "components")
    roots = nodes.join(found, nodes["fp"] == found["node"]).groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_root = found.join(staged(roots, "roots"), "root").select(F.col("node").alias("fp"), "component_id")
    of_print = nodes.join(staged(of_root, "linked"), "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    out = prints.join(staged(of_print, "of-print"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_candidates(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, least): pairs of nodes that join all nodes whose fingerprints are within the radius. texts: doc_id and text; nodes: doc_id and its node."""
    prints = staged(fingerprints(texts).join(nodes, "doc_id").select("node", "fp").distinct(), "node-fingerprints")
    of_print = staged(prints.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    copies = prints.join(of_print, "fp").select("node", "least")
    near = near_links(of_print.select("fp"))
    near = near.join(of_print.select(F.col("fp").alias("a"), F.col("least").alias("node")), "a").join(of_print.select(F.col("fp").alias("b"), "least"), "b").select("node", "least")
    return copies.unionByName(near).filter("node <> least")


def confirmed_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id: fingerprints within the radius are candidates, as are shared bands, which reach copies with more edits; shingle sets confirm each link (see similar_documents)."""
    return similar_documents(docs, id_col, text_col, more=fingerprint_candidates)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of: Callable[..., DataFrame] = confirmed_near_duplicates) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, with its own columns.

    groups_of(docs, id_col, text_col) says what a group is: doc_id and component_id of each document.
    Documents without an id cannot be told apart and all stay. Of rows with the same id one stays, the first in order of all columns.
    Null and empty texts are as groups_of has them; no rows give no rows.
    """
    groups = staged(groups_of(docs, id_col, text_col).select("doc_id", "component_id"), "near-groups")
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    kept = staged(kept.groupBy("kept_id").agg(F.count(F.lit(1)).alias("n")), "near-kept")
    rows = packed(docs)
    own = F.col("doc")[id_col].cast("long")
    # as many ids as documents: merged at any size, so that small inputs show what large ones cost
    out = unpacked(rows.join(kept.select("kept_id").hint("merge"), own == F.col("kept_id"), "left_semi"), docs.columns)
    if not kept.filter("n > 1").isEmpty():
        first = Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*docs.columns)))
        out = out.withColumn("_place", F.row_number().over(first)).filter("_place = 1").select(*docs.columns)
    return out.unionByName(docs.filter(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
