"""Shared pieces of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def text_or_empty(name: str) -> Column:
    """The text column as string, null counted as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than white space, in order."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row although body may use it often."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local runs) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the files of tables from staged, which nothing may read again; what was staged from them stays. Other tables are left alone."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        ours = jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).toUri().getPath()
        for file in table.inputFiles():
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            if folder.getParent().toUri().getPath() == ours:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
                break


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """docs as one struct column, doc: whatever their columns are called, they can't clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("doc")[c].alias(c) for c in columns])


#: In UTF-8, lower-cases A-Z and blanks every other ASCII character that is neither a letter nor a digit.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def byte_words(text: bytes | None) -> list[bytes]:
    """Runs of lower-cased letters, digits and all characters beyond ASCII, in order; none for a null text."""
    return text.translate(WORD_TABLE).split() if text else []
