"""Identity bridge and pairwise matching with lossless blocking."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..functions.normalize import contact, person_name

#: Weight of each agreement, least name similarity that counts, least score of a candidate.
WEIGHTS = {"key": 0.50, "name": 0.25, "phone": 0.18, "email": 0.18, "dob": 0.12, "postal": 0.08}
NAME_MIN, REVIEW_MIN, ATTACH_MIN = 0.72, 0.68, 0.74
#: Scores are rounded to three digits: half of the last, and a bit for sums of doubles.
ROUNDING = 0.000501
SHORT_WEIGHTS = {"key": 0.50, "name": 0.25, "phone": 0.18, "email": 0.18}
#: Rows of a group that are paired in one cell: larger groups are cut into pieces of about so many.
PIECE = 2048
#: Longest names that are compared many at once, and how many.
SHORT, AT_ONCE = 64, 2048


def resolve(rows: DataFrame, bridge: DataFrame, on: list[str]) -> DataFrame:
    """Left join with the bridge; unresolved rows keep a null unified_key. Catalyst broadcasts a small bridge."""
    return rows.join(bridge, on, "left")


def blocking_is_lossless(weights: dict[str, float], least: float) -> bool:
    """No pair reaches the score unless it shares the key, or both phone and email."""
    total = sum(w for k, w in weights.items() if k != "key")
    return all(total - weights[k] < least for k in ("phone", "email"))


RECORD = ("unified_key", "name", "phone", "email", "dob", "postal")


def _normalised(people: DataFrame) -> DataFrame:
    """seq and p, the struct of RECORD."""
    p = people.select("seq", "unified_key", person_name(F.col("name")).alias("name"), *[contact(F.col(c)).alias(c) for c in ("phone", "email", "dob", "postal")])
    return p.select("seq", F.struct(*RECORD).alias("p"))


def _side(rows: DataFrame, s: str, *more: str | Column) -> DataFrame:
    return rows.select(F.col("seq").alias(f"{s}_seq"), F.col("p").alias(s), *more)


def _of_one_key(p: DataFrame, apart: Column) -> DataFrame:
    """Pairs of the first row of each unified key with every other."""
    first = p.filter("p.unified_key IS NOT NULL").groupBy(F.col("p.unified_key").alias("key")).agg(F.min("seq").alias("seq"), F.min_by("p", "seq").alias("p"))
    return _side(first, "l").join(_side(p, "r"), (F.col("l.unified_key") == F.col("r.unified_key")) & apart)


def _alike(p: DataFrame, kept: Column, keyed: bool = False, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The first rows of all records, with more, which follows from a record, and pairs of each with its copies; without keyed, copies under one key are left to the pairs of the key."""
    alike = p.filter(kept).groupBy("p").agg(F.min("seq").alias("seq"), *[F.max(m).alias(m) for m in more])
    l, r = (_side(x if keyed else x.filter("p.unified_key IS NULL"), s) for x, s in ((alike, "l"), (p, "r")))
    return alike, l.join(r, F.col("l").eqNullSafe(F.col("r")) & (F.col("l_seq") < F.col("r_seq")))


def _pairs(rows: DataFrame, by: list[str], piece: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(l_seq, l, r_seq, r, and more of both): in arrival order, all pairs of rows that agree in the fields of by.

    A group of more than piece rows is cut into pieces, and each pair of pieces is a cell of its own, so that no task holds or pairs a whole one.
    """
    keys = [f"b_{k}" for k in by]
    rows = rows.select("seq", "p", *more, *[F.col(f"p.{k}").alias(f"b_{k}") for k in by])
    # a row for each piece rows at most
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")).filter("pieces > 1")
    rows = rows.join(F.broadcast(large), keys, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own, every = F.pmod(F.xxhash64("seq"), "pieces").cast("int"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    # by number: few bytes make many pairs, which must not be brought into few tasks
    cell = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i", "j"]
    side = lambda s, i, j: _side(rows.select("*", i.alias("i"), j.alias("j")), s, *keys, "i", "j", *[F.col(m).alias(f"{s}_{m}") for m in more]).repartition(*cell)
    return side("l", own, every).join(side("r", every, own), [*keys, "i", "j"]).filter(F.col("l_seq") < F.col("r_seq")).drop(*keys, "i", "j")


def candidate_pairs(people: DataFrame, expand: bool = False) -> DataFrame:
    """Pairs (l, r) in arrival order that share the unified key, or phone and email.

    people: seq and the columns of RECORD. Each group of one unified key gives the pairs of its first row with every other, and rows that are alike in
    all columns count as their first row, with which each of them is paired: links between different records are all there, and a hot key costs a
    row for each of its rows. expand gives all pairs instead, which grow with the square of a key's rows.
    """
    if not blocking_is_lossless(WEIGHTS, REVIEW_MIN):
        raise ValueError("these weights need other blocks")
    p = _normalised(people)
    l, r = _side(p, "l"), _side(p, "r")
    apart = F.col("l_seq") < F.col("r_seq")
    other_key = ~F.coalesce(F.col("l.unified_key") == F.col("r.unified_key"), F.lit(False))
    reachable = (F.col("p.phone") != "") & (F.col("p.email") != "")
    same = (F.col("l.phone") == F.col("r.phone")) & (F.col("l.email") == F.col("r.email"))
    if expand:
        by_key = l.join(r, (F.col("l.unified_key") == F.col("r.unified_key")) & apart)
        able = p.filter(reachable)
        return by_key.unionByName(_side(able, "l").join(_side(able, "r"), same & apart).filter(other_key))
    alike, copies = _alike(p, reachable)
    by_contact = _side(alike, "l").join(_side(alike, "r"), same & apart).filter(other_key)
    return _of_one_key(p, apart).unionByName(copies).unionByName(by_contact)


def _codes(texts: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Code points of the texts, one in each row, filled up with pad."""
    wide = max(1, int(size.max(initial=0)))
    codes = texts.astype(f"U{wide}").view(np.uint32).reshape(-1, wide)
    return np.where(np.arange(wide) < size[:, None], codes, np.uint32(pad))


def _part(codes: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: int) -> np.ndarray:
    """codes[row, lo:hi], from the left, filled up with pad; a column for each row."""
    at = np.arange(int((hi - lo).max()))[:, None]
    return np.where(at < hi - lo, codes[row, np.minimum(lo + at, codes.shape[1] - 1)], np.uint32(pad))


def _matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters that SequenceMatcher matches in each pair of short texts: the longest block (of those the first in a, then in b), and so on at both its sides."""
    sizes = [np.array([len(x) for x in t], np.int64) for t in (a, b)]
    pads = (0xFFFFFFFE, 0xFFFFFFFF)
    codes = [_codes(t, n, pad) for t, n, pad in zip((a, b), sizes, pads)]
    total, row = np.zeros(len(a), np.int64), np.arange(len(a))
    alo, blo, ahi, bhi = np.zeros_like(row), np.zeros_like(row), *sizes
    while True:
        some = (alo < ahi) & (blo < bhi)
        row, alo, ahi, blo, bhi = (x[some] for x in (row, alo, ahi, blo, bhi))
        if not len(row):
            return total
        x, y = _part(codes[0], row, alo, ahi, pads[0]), _part(codes[1], row, blo, bhi, pads[1])
        runs = np.zeros((len(x), len(y), len(row)), np.uint8)  # of equal characters that end at (i, j)
        for i in range(len(x)):
            np.equal(x[i], y, out=runs[i], casting="unsafe")
            if i:
                runs[i, 1:] *= runs[i - 1, :-1] + np.uint8(1)
        flat = runs.reshape(-1, len(row))
        end = flat.argmax(axis=0)
        size = flat[end, np.arange(len(row))].astype(np.int64)
        np.add.at(total, row, size)
        i, j = alo + end // len(y) + 1 - size, blo + end % len(y) + 1 - size
        hit = size > 0
        row, alo, ahi, blo, bhi = (np.concatenate([u[hit], v[hit]]) for u, v in ((row, row), (alo, i + size), (i, ahi), (blo, j + size), (j, bhi)))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity as SequenceMatcher gives it; Spark has none. Only pairs that survive the blocking come here."""
    a, b = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    out = np.ones(len(a))
    other = np.flatnonzero(a != b)
    for k in other[np.maximum(n, m)[other] > SHORT]:
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    short = other[np.maximum(n, m)[other] <= SHORT]
    for k in (short[i : i + AT_ONCE] for i in range(0, len(short), AT_ONCE)):
        out[k] = 2.0 * _matched(a[k], b[k]) / (n[k] + m[k])
    return pd.Series(out)


def _signed(texts: np.ndarray, size: np.ndarray) -> np.ndarray:
    codes = np.sort(_codes(texts, size, 0xFFFFFFFF), axis=1).astype(np.uint64)
    at = np.arange(codes.shape[1])
    new = np.concatenate([np.ones((len(codes), 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    nth = (at - np.maximum.accumulate(np.where(new, at, 0), axis=1)).astype(np.uint64)
    bit = ((codes * np.uint64(1 << 20) + nth + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return np.bitwise_or.reduce(np.where(at < size[:, None], np.uint64(1) << bit, np.uint64(0)), axis=1).view(np.int64)


@F.pandas_udf(LongType())
def name_signature(a: pd.Series) -> pd.Series:
    """A bit, of 64, for each character and its number among its equals."""
    a = a.to_numpy(dtype=object)
    n = np.array([len(x) for x in a], np.int64)
    out = np.zeros(len(a), np.int64)
    short = np.flatnonzero(n <= SHORT)
    for k in [*(short[i : i + AT_ONCE] for i in range(0, len(short), AT_ONCE)), *np.flatnonzero(n > SHORT)[:, None]]:
        out[k] = _signed(a[k], n[k])
    return pd.Series(out)


def ratio_bound(a: Column, b: Column, sign_a: Column, sign_b: Column) -> Column:
    """What name_ratio is at most: a bit that one signature lacks is a character that finds no equal in the other name."""
    return 1 - F.coalesce(F.try_divide(F.bit_count(sign_a.bitwiseXOR(sign_b)), F.length(a) + F.length(b)), F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def score(pairs: DataFrame, similarity: Column, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Score, reasons and action of each pair; pairs below the review threshold go."""
    equal = {k: F.coalesce((F.col(f"l.{k}") == F.col(f"r.{k}")) & (F.col(f"l.{k}") != ""), F.lit(False)) for k in ("phone", "email", "dob", "postal") if k in weights}
    equal["key"] = F.coalesce(F.col("l.unified_key") == F.col("r.unified_key"), F.lit(False))
    rows = pairs.withColumn("name_similarity", similarity)
    alike = F.col("name_similarity") >= NAME_MIN
    total = F.when(alike, F.col("name_similarity") * weights["name"]).otherwise(0.0)
    for k, same in equal.items():
        total = total + F.when(same, weights[k]).otherwise(0.0)
    reasons = [F.when(equal["key"], "same_unified_key"), F.when(alike, F.format_string("name_similarity=%.2f", "name_similarity"))]
    reasons += [F.when(same, f"same_{k}") for k, same in equal.items() if k != "key"]
    one_known = F.col("l.unified_key").isNull() != F.col("r.unified_key").isNull()
    rows = rows.withColumn("score", F.round(F.least(total, F.lit(1.0)), 3)).withColumn("reasons", F.concat_ws(", ", *reasons)).withColumn("_same", equal["key"])
    action = F.when(F.col("_same"), "deterministic_merge_confirmed").when((F.col("score") >= ATTACH_MIN) & one_known, "review_attach_to_known_customer").when(F.col("score") >= REVIEW_MIN, "manual_review")
    return rows.withColumn("action", action).filter("action IS NOT NULL").select("l_seq", "r_seq", "score", "reasons", "action")


def blocks(weights: dict[str, float], least: float) -> list[tuple[str, ...]]:
    """The smallest sets of fields, besides key and name, of which a pair of different keys must share all of one to reach the score, the heaviest first."""
    fields = [k for k in weights if k not in ("key", "name")]
    able = [set(c) for n in range(len(fields) + 1) for c in combinations(fields, n) if sum(weights[k] for k in c) + weights["name"] >= least - ROUNDING]
    found = [s for s in able if not any(o < s for o in able)]
    return [tuple(k for k in fields if k in s) for s in sorted(found, key=lambda s: -sum(weights[k] for k in s))]


def _least_similarity(block: tuple[str, ...], earlier: list[tuple[str, ...]], weights: dict[str, float], least: float) -> float:
    """What the names of a pair that shares the block, and none of the earlier ones, must have at least: 0 if they don't matter."""
    more = [k for k in weights if k not in ("key", "name", *block)]
    shared = [{*block, *c} for n in range(len(more) + 1) for c in combinations(more, n)]
    most = max((sum(weights[k] for k in s) for s in shared if not any(set(e) <= s for e in earlier)), default=0.0)
    need = least - ROUNDING - most
    return 0.0 if need <= 0 else max(NAME_MIN, need / weights["name"])


def scored_pairs(
    people: DataFrame,
    similarity: Callable[[Column, Column], Column],
    weights: dict[str, float] = WEIGHTS,
    signature: Callable[[Column], Column] | None = None,
    bound: Callable[[Column, Column, Column, Column], Column] | None = None,
    links: bool = False,
    piece: int = PIECE,
    path: str | None = None,
) -> DataFrame:
    """score(candidate_pairs(people), ...), but only pairs that can reach the review threshold are made.

    Pairs of one key always count. Those of different keys must share all fields of one of blocks(weights); where names must be alike as well, different
    names are compared if bound lets them: it takes two names and their signatures, and similarity never exceeds it. Where no block is left, the key alone decides.
    links gives all pairs of different records of a key, and of each record with its copies, instead of those of the key's first row.
    path: where normalised records are kept, so that they are made once and not for each kind of pair.
    """
    p, apart = _normalised(people), F.col("l_seq") < F.col("r_seq")
    other_key = ~F.coalesce(F.col("l.unified_key") == F.col("r.unified_key"), F.lit(False))
    needed = blocks(weights, REVIEW_MIN)
    whole = lambda b: functools.reduce(operator.and_, [F.col(f"p.{k}") != "" for k in b], F.lit(True))
    likeness = lambda pairs: pairs.withColumn("name_similarity", similarity(F.col("l.name"), F.col("r.name")))
    known = F.col("p.unified_key").isNotNull()
    signed = ("sign",) if signature else ()
    if needed or links:
        # rows of one name are compared with themselves, before they are paired
        p = p.withColumn("own", similarity(F.col("p.name"), F.col("p.name")))
        p = p.withColumn("sign", signature(F.col("p.name"))) if signature else p
        if path:
            p.write.parquet(path)
            p = people.sparkSession.read.parquet(path)
        alike, copies = _alike(p, functools.reduce(operator.or_, [whole(b) for b in needed], known if links else F.lit(False)), links, ("own", *signed))
    by_key = _pairs(alike.filter(known), ["unified_key"], piece) if links else _of_one_key(p, apart)
    pairs = likeness(by_key.unionByName(copies) if needed or links else by_key)
    for i, block in enumerate(needed):
        shares = lambda b: functools.reduce(operator.and_, [(F.col(f"l.{k}") == F.col(f"r.{k}")) & (F.col(f"l.{k}") != "") for k in b])
        new = functools.reduce(operator.and_, [~shares(b) for b in needed[:i]], F.lit(True))
        least = _least_similarity(block, needed[:i], weights, REVIEW_MIN)
        rows = alike.filter(whole(block))
        if least:
            same = _pairs(rows, [*block, "name"], piece, ("own",)).filter(other_key & new).withColumnRenamed("l_own", "name_similarity")
            other = _pairs(rows, list(block), piece, signed).filter((F.col("l.name") != F.col("r.name")) & other_key & new)
            if signature and bound:
                other = other.filter(bound(F.col("l.name"), F.col("r.name"), F.col("l_sign"), F.col("r_sign")) >= least - ROUNDING)
            found = same.unionByName(likeness(other), allowMissingColumns=True).filter(F.col("name_similarity") >= least - ROUNDING)
        else:
            found = likeness(_pairs(rows, list(block), piece).filter(other_key & new))
        pairs = pairs.unionByName(found.select("l_seq", "l", "r_seq", "r", "name_similarity"))
    return score(pairs, F.col("name_similarity"), weights)
