"""Vector code compression: product codes whose nearest entries are found by slicing sorted coordinates and intersecting bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this count as this, so that squared distances of up to 128 components fit 64 bits.
LARGEST = 1 << 27


class Nearest:
    """The nearest of at most 64 entries to each of many points, exactly.

    For each dimension the entries' coordinates are sorted, and place i of prefix holds the mask of the i first entries. The entries
    within a radius in one dimension are a range of places, whose mask is the difference of two prefixes; the masks of all
    dimensions, ANDed, leave the entries in the cube around the point. Whatever is as near as the radius lies in the cube, so that
    the least distance found there is the least of all once it is no larger than the radius.
    """

    def __init__(self, entries: np.ndarray):
        if not 0 < len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = entries.astype(np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.places = np.ascontiguousarray(np.take_along_axis(self.entries, order, axis=0).T)
        masks = np.bitwise_or.accumulate(np.left_shift(np.uint64(1), order.astype(np.uint64)), axis=0).T
        self.prefix = np.concatenate((np.zeros((len(self.places), 1), dtype=np.uint64), masks), axis=1)
        apart = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        apart = np.where(apart > 0, apart, np.iinfo(np.int64).max).min(axis=1)
        #: half the usual distance of an entry to the next one
        self.radius = max(1, int(np.sqrt(float(np.median(apart))) / 2)) if apart.min() < np.iinfo(np.int64).max else 1

    def within(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each point, the mask of the entries that differ by its radius at most in every dimension."""
        mask = np.full(len(points), (1 << 64) - 1, dtype=np.uint64)
        for x, place, prefix in zip(points.T, self.places, self.prefix):
            mask &= prefix[np.searchsorted(place, x + radius, "right")] ^ prefix[np.searchsorted(place, x - radius, "left")]
        return mask

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, the lowest of equally near ones, and the squared distance."""
        points = points.astype(np.int64)
        index, least = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        todo, radius = np.arange(len(points)), np.full(len(points), self.radius, dtype=np.int64)
        while len(todo):
            mask = self.within(points[todo], radius)
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            radius = radius * 2  # where the cube is empty
            if len(row):
                distance = ((points[todo[row]] - self.entries[entry]) ** 2).sum(axis=1)
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                best = np.minimum.reduceat(distance, first)
                hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(first, len(row)))))
                hit = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))]  # entries come in order, so that the first is the lowest
                some = row[first]
                index[todo[some]], least[todo[some]] = entry[hit], best
                enough = (radius[some] // 2) ** 2 >= best
                reach = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64)
                radius[some] = np.where(enough, -1, reach + (reach * reach < best))
            left = radius > 0
            todo, radius = todo[left], radius[left]
        return index, least


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(books: np.ndarray):
    """Sums and counts of the parts nearest to each entry: at most one row an entry and task, whatever the task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        finders = [Nearest(b) for b in books]
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch)
            for p in range(parts):
                part = rows[:, p * width : (p + 1) * width]
                index, _ = finders[p].find(part)
                np.add.at(sums[p], index, part)
                counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        finders = [Nearest(b) for b in books]
        for batch in batches:
            rows = _matrix(batch)
            found = [finders[p].find(rows[:, p * width : (p + 1) * width]) for p in range(parts)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8) if parts else np.zeros((len(rows), 0), dtype=np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints, the components floor(scale * x); a vector that is null or has a null or non-finite component is dropped."""
    x = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole: Column = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.filter(x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole.alias("ints"))


def fit_codebooks(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of the integer vectors of integer_vectors; none (no parts) without a vector that can be cut.

    The vectors' length is that of the smallest id whose length is a multiple of parts; others take no part. Entries start as the
    vectors with the smallest ids (of one id the smallest vector; rows without an id are no start), fewer than asked for if the ids are
    fewer. Every round all rows are assigned, and an entry in use becomes the floor of its parts' mean. Only the entries come to the driver.
    """
    size = F.size("ints")
    fit = F.col("vec_id").isNotNull() & (size > 0) & (size % parts == 0)
    least = ints.agg(F.min(F.when(fit, F.struct("vec_id", size.alias("size")))).alias("least")).first()["least"]
    if least is None:
        return np.zeros((0, 0, 0), dtype=np.int64)
    rows = ints.filter(size == least["size"])
    ids = rows.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    last = ids.agg(F.max("vec_id")).first()[0]
    starts = rows.filter(F.col("vec_id") <= last).groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").collect()
    width = least["size"] // parts
    books = np.array([r["ints"] for r in starts], dtype=np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("ints").mapInArrow(_summed(books), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for row in sums.collect():  # a row an entry at most
            books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error, the squared distance to the coded vector; null for vectors of another length."""
    size = F.size("ints") == books.shape[0] * books.shape[2]
    kind = ints.schema["label"].dataType.simpleString()
    rest = ints.filter(~size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not len(books):
        return ints.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return ints.filter(size).mapInArrow(_coded(books), f"vec_id long, label {kind}, code string, error long").unionByName(rest)


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with approx, the coded vector in the units of the given ones; null where code is null."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c is None else (books[np.arange(parts), np.frombuffer(bytes.fromhex(c), dtype=np.uint8)].reshape(-1) / scale).tolist() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "approx"])

    return codes.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema], "approx array<double>"]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error), a row for each vector that is neither null nor holds a null or non-finite component, and the codebooks.

    Components are floor(256 * x), those beyond LARGEST cut to it. A vector that can't be cut like the others (see fit_codebooks) has a null code.
    Repeated rows are coded alike, each counts in the means. Null ids and labels stay null. No vectors give no rows; other columns are
    ignored. The table is read as integers from the shared folder, once a round; no task holds more than a batch of it.
    """
    ints = staged(integer_vectors(vectors, id_col, vector_col, label_col), "vector-ints")
    books = fit_codebooks(ints, parts, entries, rounds)
    return encode(ints, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    codes = staged(codes, "vector-codes")
    by_label = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_DISTANCE = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"


def _assigned(name: str, books: str) -> str:
    return (
        f"{name}k AS (SELECT p.vec_id, p.part, min({_DISTANCE} * {ENTRIES} + entry) AS k FROM p JOIN {books} USING (part) GROUP BY ALL),\n"
        f"{name} AS (SELECT vec_id, part, (k % {ENTRIES})::BIGINT AS entry, (k // {ENTRIES})::BIGINT AS distance FROM {name}k)"
    )


def _moved(name: str, books: str, assigned: str) -> str:
    return (
        f"{name}m AS (SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM {assigned} JOIN p USING (vec_id, part), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL),\n"
        f"{name}l AS (SELECT part, entry, list(v ORDER BY i) AS y FROM {name}m GROUP BY ALL),\n"
        f"{name} AS (SELECT part, entry, coalesce(n.y, o.y) AS y FROM {books} o LEFT JOIN {name}l n USING (part, entry))"
    )


SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM v, unnest(range({PARTS})) u(part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
b0 AS (SELECT part, entry, x AS y FROM p JOIN s USING (vec_id)),
{_assigned("a0", "b0")},
{_moved("b1", "b0", "a0")},
{_assigned("a1", "b1")},
{_moved("b2", "b1", "a1")},
{_assigned("a2", "b2")},
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h
"""
