"""Ordered data-quality rules, rejects and issue records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import stable_id


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails; null for a valid row. A condition that is null does not fail."""
    out = None
    for name, bad in rules:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return F.lit(None).cast("string") if out is None else out


def rejects(rows: DataFrame, source: str, entity: Column, issue: Column, event_ts: Column) -> DataFrame:
    """A reject row for every row with an issue."""
    out = rows.select(F.lit(source).alias("source"), entity.cast("string").alias("entity_id"), issue.alias("issue_type"), event_ts.alias("event_ts"))
    out = out.filter("issue_type IS NOT NULL")
    return out.withColumn("reject_id", F.sha2(F.concat_ws("|", "source", F.coalesce("entity_id", F.lit("")), "issue_type"), 256))


def issues(rejected: DataFrame, layer: str, severities: Mapping[str, str] | None = None) -> DataFrame:
    """Repeated issues of an entity collapse to one record with a stable id; with severities (by issue type, low if none is given), also severity and the time last seen."""
    keys = ["source", "entity_id", "issue_type"]
    seen = [] if severities is None else [F.max("event_ts").alias("last_ts")]
    out = rejected.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), *seen)
    out = out.withColumn("issue_id", stable_id(F.lit(layer), F.coalesce("entity_id", F.lit("")), F.col("issue_type")))
    if severities is None:
        return out
    level = F.lit("low")
    for kind, severity in severities.items():
        level = F.when(F.col("issue_type") == kind, severity).otherwise(level)
    return out.withColumn("severity", level)


def severity_rank(severity: Column) -> Column:
    """0 for high, 1 for medium, 2 for others: sorting the words would put low before medium."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in a stated order: what dropDuplicates leaves open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def survivor(df: DataFrame, key: str, first_seen: str, arrival: str, fields: Sequence[str]) -> DataFrame:
    """Of each key, the fields of the row first seen; of ties, the one that arrived first. A plain aggregate, no window."""
    row = F.min_by(F.struct(*fields), F.struct(first_seen, arrival)).alias("r")
    return df.groupBy(key).agg(row).select(key, "r.*")


def missing_fields(payload: Column, required: Mapping[str, Sequence[str]], event_type: Column) -> Column:
    """Required fields that a JSON payload lacks; null for bad JSON, all of them for an empty object, none for an unknown type."""
    keys = F.json_object_keys(payload)
    out = F.array().cast("array<string>")
    for kind, fields in required.items():
        out = F.when(event_type == kind, F.array_except(F.array(*map(F.lit, fields)), keys)).otherwise(out)
    return F.when(keys.isNull(), F.lit(None)).otherwise(out)
