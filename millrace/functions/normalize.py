"""Column expressions that normalise identifiers, names and amounts, and make stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Stands for null inside a hashed record, so that (a, null) and (null, a) differ.
NULL_MARK = "\u0000"


def id_type(c: Column) -> Column:
    return F.upper(F.trim(c))


def id_value(c: Column, ascii_only: bool = False) -> Column:
    """Upper case, letters and digits only; letters of other scripts stay unless ascii_only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]" if ascii_only else r"[^\p{L}\p{N}]", "")


def identity_label(kind: Column, value: Column, ascii_only: bool = False) -> Column:
    """TYPE_ and 12 hex digits of SHA-1: names an identity without telling it."""
    kind = id_type(kind)
    return F.concat(kind, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", kind, id_value(value, ascii_only))), 1, 12))


def identity_key(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", id_type(kind), id_value(value, True)), 256)


def person_name(c: Column, collapse: bool = True) -> Column:
    out = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " ")) if collapse else F.trim(out)


def contact(c: Column) -> Column:
    """Upper case, with only A-Z, digits, @ and dot; null gives an empty text."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9@.]", "")


def stable_id(*parts: Column) -> Column:
    """UUID version 5 in the URL namespace of the parts joined by |, as a plain expression."""
    d = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat_ws("|", *parts), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(d, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(
        F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 19, 2), F.lit("-"), F.substring(d, 21, 12)
    )


def record_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


def money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))
