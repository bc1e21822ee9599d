"""Tables clustered by several columns: files along a space-filling curve, so that a lookup by any of the columns skips most of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.ranks import cut_values, range_rank

SAMPLE = 100_000


def range_bounds(df: DataFrame, columns: Sequence[str], bits: int, sample: int = SAMPLE) -> dict[str, list]:
    """For each column, up to 2 ** bits - 1 values that cut its rows into ranges of about equal size.

    Numbers, dates and times by exact percentiles over all rows; other types by the sample rows of smallest hash.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    ordered = [c for c in columns if isinstance(df.schema[c].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))]
    found: dict[str, list] = {c: cut_values(df, c, shares) for c in ordered}
    for c in columns:
        if c not in found:
            rows = df.filter(F.col(c).isNotNull()).select(c).orderBy(F.xxhash64(*df.columns)).limit(sample)
            values = sorted(r[0] for r in rows.collect())  # at most sample
            found[c] = sorted({values[len(values) * i >> bits] for i in range(1, 1 << bits)}) if values else []
    return found


def curve_key(ranks: Sequence[Column], bits: int) -> Column:
    """The bits of the ranks in turn, the highest first: near keys are near in every column."""
    if bits * len(ranks) > 63:
        raise ValueError("bits times columns must fit 63 bits")
    key = F.lit(0).cast("long")
    for b in range(bits):
        for i, rank in enumerate(ranks):
            bit = F.shiftright(rank.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - i))
    return key


def with_curve_key(df: DataFrame, columns: Sequence[str], bits: int = 6, bounds: Mapping[str, Sequence] | None = None, name: str = "curve_key") -> DataFrame:
    bounds = bounds or range_bounds(df, columns, bits)
    return df.withColumn(name, curve_key([range_rank(F.col(c), bounds[c]) for c in columns], bits))


def cluster(spark: SparkSession, path: str, to: str, columns: Sequence[str], files: int, bits: int = 6) -> None:
    """Rewrites a Parquet table in about so many files along the curve through columns; repeated keys are dealt on by the columns themselves."""
    rows = with_curve_key(spark.read.parquet(path), columns, bits, name="_curve")
    order = ["_curve", *columns]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_curve").write.mode("overwrite").parquet(to)


def files_with(table: DataFrame, column: str, value) -> int:
    """Files of a table whose least and largest values leave room for the value: those that a lookup must read."""
    ranges = table.groupBy(F.input_file_name().alias("f")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return ranges.filter((F.col("lo") <= F.lit(value)) & (F.col("hi") >= F.lit(value))).count()
