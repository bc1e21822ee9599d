"""A stream source with offsets: change events from a folder of log segments, each read once over any number of restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.layers import exists, make_folder

NAME = "log_segments"
SCHEMA = "offset long, value string"


@dataclass
class Piece(InputPartition):
    """Lines start to end (exclusive) of a segment, counted from its first; offset is that of its first line."""

    path: str
    offset: int
    start: int
    end: int | None


class _Log:
    """Segments of a folder by the offset of their first record, which is their name: <20 digits>.jsonl."""

    def __init__(self, path: str):
        self.files, self.folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def segments(self) -> list[tuple[int, str]]:
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted((int(f.base_name[:20]), f.path) for f in found if f.is_file and f.base_name.endswith(".jsonl") and f.base_name[:20].isdigit())

    def lines(self, path: str) -> Iterator[str]:
        with self.files.open_input_stream(path, compression=None) as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from (x.decode() for x in whole)
            if rest:
                yield rest.decode()

    def end(self, segments: list[tuple[int, str]]) -> int:
        """The offset after the last record: only the last segment is read for it."""
        return segments[-1][0] + sum(1 for _ in self.lines(segments[-1][1])) if segments else 0

    def pieces(self, start: int, end: int) -> list[Piece]:
        segments = self.segments()
        ends = [first for first, _ in segments[1:]] + [end]
        return [Piece(path, first, max(0, start - first), min(end, until) - first) for (first, path), until in zip(segments, ends) if until > start and first < end]

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        offsets, values = [], []
        for i, line in enumerate(self.lines(piece.path)):
            if piece.end is not None and i >= piece.end:
                break
            if i >= piece.start:
                offsets.append(piece.offset + i)
                values.append(line)
            if len(values) >= 10_000:
                yield pa.RecordBatch.from_pydict({"offset": pa.array(offsets, pa.int64()), "value": pa.array(values, pa.string())})
                offsets, values = [], []
        yield pa.RecordBatch.from_pydict({"offset": pa.array(offsets, pa.int64()), "value": pa.array(values, pa.string())})


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.log = _Log(path)

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.log.end(self.log.segments())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.log.pieces(start["offset"], end["offset"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: segments stay for other readers."""


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.log = _Log(path)

    def partitions(self) -> list[Piece]:
        segments = self.log.segments()
        return [Piece(path, first, 0, None) for first, path in segments] or [Piece("", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition) if partition.path else iter(())


class LogSegments(DataSource):
    """Format log_segments, option path: a row (offset, value) for each line of the segments there. A missing folder has no records yet.

    The folder is read from the executors by its URI (file, hdfs, s3 or gs). A partition is a segment, or the part of one that a batch takes.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def log(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """(offset, value) from the segments below path."""
    spark.dataSource.register(LogSegments)
    return (spark.readStream if stream else spark.read).format(NAME).load(path)


def append(rows: DataFrame, path: str, staging: str) -> None:
    """Adds rows as JSON lines to the log below path, a segment for each of their partitions.

    They are written by Spark to staging; then each file is counted and gets its first offset for a name. One writer at a time.
    """
    spark = rows.sparkSession
    rows.write.json(staging)
    counts = spark.read.text(staging).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()  # a row a file
    old = _Log(path)
    at = old.end(old.segments())
    if not exists(spark, path):
        make_folder(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in counts:
        if not files.rename(hadoop.Path(r["f"]), hadoop.Path(f"{path}/{at:020d}.jsonl")):
            raise OSError(f"segment {at} could not be added")
        at += r["n"]


def decoded_log(records: DataFrame, schema: str) -> DataFrame:
    """offset and the fields of each record's JSON; records that hold none keep nulls."""
    return records.select("offset", F.from_json("value", schema).alias("e")).select("offset", "e.*")
