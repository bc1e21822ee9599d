"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import byte_words, read, staged

#: Words of a window, and of the shingles in it.
WINDOW, SHINGLE = 10, 3
#: A filter has so many bits a shingle, and 2 ** MOST_BITS (128 MB) at most; what passes in error is refused by the join.
BITS_EACH, MOST_BITS = 64, 30
#: Words whose hashes a task remembers, and counts that it holds before it hands them on.
REMEMBERED, HELD = 500_000, 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NEAR = pa.list_(pa.struct([("at", pa.int32()), ("token", pa.int64()), ("before", pa.int32()), ("near", pa.string())]))


class _Hashes(dict):
    """Hash by word, made when first asked for; forgotten when too many are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words, given the words' hashes; runs of other sizes have others."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _ODD
        out ^= out >> np.uint64(32)
    return out * _ODD


def _word_hashes(known: _Hashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _windowed(window: int, shingle: int):
    """The distinct windows of each item with their shingles: min(shingle, words) words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids, texts, sizes, tokens = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                words = byte_words(text.as_py())
                if not words:
                    continue
                n = min(window, len(words))
                size = min(shingle, n)
                all_tokens = shingle_hashes(_word_hashes(known, words), size).view(np.int64).tolist()
                made = {b" ".join(words[i : i + n]): i for i in range(len(words) - n + 1)}
                for joined, i in made.items():
                    ids.append(item)
                    texts.append(joined.decode("utf-8", "replace"))
                    sizes.append(n)
                    tokens.append(all_tokens[i : i + n - size + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["item_id", "window", "n", "tokens"])

    return run


def _filter(tokens: DataFrame, count: int) -> Broadcast:
    """A bit for the leading bits of every token, so that most of the others can be told at once. Built in Spark; bounded by MOST_BITS."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(BITS_EACH * max(1, count)))))
    place = F.shiftrightunsigned(F.col("token"), 64 - bits) + 1
    parts = tokens.select(F.bitmap_bucket_number(place).alias("at"), F.bitmap_bit_position(place).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        piece = np.frombuffer(row["map"], dtype=np.uint8)
        start = (row["at"] - 1) * len(piece)
        out[start : start + len(piece)] = piece[: len(out) - start]
    return tokens.sparkSession.sparkContext.broadcast(out)


def _passing(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens that the filter lets through."""
    at = tokens >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _counted(known_tokens: Broadcast, sizes: list[int]):
    """Occurrences of the shingles that pass, in pieces of HELD at most."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(list(counts.keys()), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts = known_tokens.value, _Hashes(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                hashes = _word_hashes(known, byte_words(text.as_py()))
                for size in sizes:
                    tokens = shingle_hashes(hashes, size)
                    counts.update(tokens[_passing(bits, tokens)].view(np.int64).tolist())
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return run


def _candidates(prefixes: Broadcast, sizes: list[int], window: int):
    """For each document its number of words and the places of shingles that pass, each with the words of any window that could hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = prefixes.value, _Hashes()
        for batch in batches:
            n_words, found = [], []
            for text in batch.column("text"):
                words = byte_words(text.as_py())
                hashes, here = _word_hashes(known, words), []
                for size in sizes:
                    tokens = shingle_hashes(hashes, size)
                    for at in _passing(bits, tokens).tolist():
                        start = max(0, at - window + size)
                        near = b" ".join(words[start : at + window]).decode("utf-8", "replace")
                        here.append({"at": at, "token": int(tokens[at].view(np.int64)), "before": at - start, "near": near})
                n_words.append(len(words))
                found.append(here)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, _NEAR)], names=["doc_id", "n_words", "found"])

    return run


def _bytes(text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("text")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id (as string), window (its words, joined by a space), n and tokens (hashes of its shingles), once for each item and text of a window."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), _bytes(text_col))
    return rows.mapInArrow(_windowed(window, shingle), "item_id string, window string, n int, tokens array<long>").dropDuplicates(["item_id", "window"])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, n_words, spans (merged runs of hit words, start and end, end exclusive) and items (ids as strings, sorted), a row for each of docs.

    A window is a run of window words of an item, or all words of a shorter one; a document is hit wherever one occurs. All shingles of a
    window must occur for the window to, so that its necessary prefix is one shingle: the one rarest in all documents (a window with a
    shingle that occurs nowhere goes at once). Documents are joined with the windows on that shingle alone; a place is kept if
    the document has the words that the window needs before and after it, and if all words of the window are the document's there.

    Null and empty texts have no words, no spans and no items; an item without an id marks words but is not listed. Rows that repeat are documents of
    their own with one result; repeated items are one. No items hit nothing; no documents give no rows. Other columns are ignored.
    Texts of any length are read whole, twice; only the words around shingles that pass leave a task.
    """
    windows = staged(item_windows(items, item_id_col, item_text_col, window, shingle), "item-windows")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bytes(text_col))
    of_window = windows.groupBy("window", "n").agg(F.first("tokens").alias("tokens"))
    of_window = staged(of_window.select("window", "n", F.posexplode("tokens").alias("offset", "token")), "window-shingles")
    sizes = sorted({min(shingle, r["n"]) for r in of_window.select("n").distinct().collect()})  # window numbers at most
    known = _filter(of_window, of_window.count())
    counts = rows.select("text").mapInArrow(_counted(known, sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n_docs"))
    rarest = of_window.join(staged(counts, "shingle-counts"), "token", "left").groupBy("window", "n")
    rarest = rarest.agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "offset", "token")).alias("least")).filter("least.n_docs > 0")
    prefix = staged(rarest.select("window", "n", "least.offset", "least.token"), "prefixes")

    found = rows.mapInArrow(_candidates(_filter(prefix, prefix.count()), sizes, window), "doc_id long, n_words long, found array<struct<at:int,token:long,before:int,near:string>>")
    found = staged(found.select("*", F.monotonically_increasing_id().alias("row")), "window-candidates")
    places = found.filter(F.size("found") > 0).select("row", F.inline("found")).select("row", "at", "token", "before", F.split("near", " ").alias("near"))
    placed = places.join(prefix, "token").filter((F.col("before") >= F.col("offset")) & (F.size("near") - F.col("before") >= F.col("n") - F.col("offset")))
    placed = placed.filter(F.array_join(F.slice("near", F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window"))
    hits = staged(placed.select("row", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("n")).alias("end"), "window"), "window-hits")

    in_row = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("row", "start", "end", F.when(F.col("start") <= reached, 0).otherwise(1).alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(in_row)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = staged(runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "hit-spans")
    names = hits.select("row", "window").distinct().join(windows.filter("item_id is not null").select("window", "item_id"), "window").select("row", "item_id").distinct()
    names = staged(names.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "hit-items")
    out = found.select("row", "doc_id", "n_words").join(spans, "row", "left").join(names, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least({WINDOW}, len(ws)) AS n, array_to_string(ws[i : i + least({WINDOW}, len(ws)) - 1], ' ') AS run FROM b, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
p AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS run FROM d, (SELECT DISTINCT n FROM w) s, unnest(range(1, len(ws) - n + 2)) u(i)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN w USING (n, run)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + n)) u(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
