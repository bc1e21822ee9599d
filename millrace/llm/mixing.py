"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, read, staged, text_or_empty, unpacked, word_list

#: The domain of a source is read off its name: a third of the sources each. Others fall under "other".
DOMAINS = {"web": r"^src(0|[369]|1[258])$", "books": r"^src([147]|1[0369])$", "papers": r"^src([258]|1[147])$"}
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.25, "papers": 0.2, "other": 0.05}
LANGUAGE_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
#: Sources have equal weights but for those given here.
SOURCE_WEIGHTS: Mapping[str, float] = {}
#: Weight of a domain or language that has none given, and the most times a document may be used.
OTHER_WEIGHT, MAX_EPOCHS = 0.05, 2
#: Tokens to pick, as a share of those at hand.
BUDGET_SHARE = 0.8
SEED = 17
#: Hash buckets of a leaf hold about so many rows; only the one at a leaf's limit is put in order.
BUCKET_ROWS = 2000


def domain_of(source: Column, domains: Mapping[str, str] = DOMAINS) -> Column:
    """The first of domains whose pattern fits the source."""
    out = None
    for name, pattern in domains.items():
        hit = source.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("other") if out is None else F.coalesce(out, F.lit("other"))


def _weight(of: Column, weights: Mapping[str, float], other: float = OTHER_WEIGHT) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(of == k, F.lit(float(v))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], budget: str, to: str) -> DataFrame:
    """Deals each parent's budget to its children by weight; what a full child can't take goes to its siblings.

    nodes has weight and cap. Children in order of cap / weight fill up first, so the cut is found by running sums.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *[c for c in nodes.columns if c in ("domain", "lang", "source") and c not in parent])
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    level = (F.col(budget) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    nodes = nodes.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("weight") >= F.col("cap"))
    first_open = F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("weight"), "_level"))).over(every)["_level"]
    return nodes.withColumn(to, F.when(F.col("_full"), F.col("cap")).otherwise(first_open * F.col("weight"))).drop("_level", "_full")


def budgets(
    leaves: DataFrame,
    share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    domain_weights: Mapping[str, float] = DOMAIN_WEIGHTS,
    language_weights: Mapping[str, float] = LANGUAGE_WEIGHTS,
    source_weights: Mapping[str, float] = SOURCE_WEIGHTS,
) -> DataFrame:
    """Tokens to take of each (domain, lang, source), from leaves (domain, lang, source, tokens).

    Weights go down the tree: domain, language, source. A node can't take more than max_epochs times
    its tokens; a shortage goes to siblings first and, when all of them are full, to the parent's siblings.
    """
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    cap = F.sum("cap").alias("cap")
    langs = leaves.groupBy("domain", "lang").agg(cap)
    domains = langs.groupBy("domain").agg(cap)
    domains = domains.withColumn("weight", _weight(F.col("domain"), domain_weights)).withColumn("budget", F.sum("cap").over(Window.partitionBy(F.lit(1))) / max_epochs * share)
    domains = _filled(domains, [], "budget", "domain_budget").select("domain", "domain_budget")
    langs = langs.join(domains, "domain").withColumn("weight", _weight(F.col("lang"), language_weights))
    langs = _filled(langs, ["domain"], "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    leaves = leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), source_weights, 1.0))
    leaves = _filled(leaves, ["domain", "lang"], "lang_budget", "take")
    return leaves.select("domain", "lang", "source", "tokens", F.floor(F.col("take") + 1e-6).alias("take"))


def mix(docs: DataFrame, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", domains: Mapping[str, str] = DOMAINS, **weights: Mapping[str, float]) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, copies. weights are those of budgets.

    Tokens are words. Of a leaf's budget, whole epochs take every document once; of the next epoch, the documents go by a hash
    of (seed, epoch, id), and those that begin before the remaining budget is used up are taken. Null lang or source is its own node "".
    Null text has no tokens. Rows that repeat (same id) count each; those without an id go by a hash of their text.
    No rows give no rows.

    A leaf may hold a third of all rows: its hash order is cut into buckets, whole buckets are taken by
    running sums over bucket totals, and only the bucket at the limit is sorted.
    """
    return _mix(docs, share, max_epochs, seed, id_col, text_col, domains, weights).drop("nameless")


def _mix(docs: DataFrame, share: float, max_epochs: int, seed: int, id_col: str, text_col: str, domains: Mapping[str, str], weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The rows of mix, and nameless: a digest of the text where there is no id."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        domain_of(F.coalesce(F.col("source").cast("string"), F.lit("")), domains).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.size(word_list(text_or_empty(text_col))).cast("long").alias("n_tokens"),
        _nameless(F.col(id_col), text_or_empty(text_col)).alias("nameless"),
    )
    rows = staged(rows, "mix-rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    take = budgets(leaves, share, max_epochs, **weights).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("take") / F.col("tokens"))).otherwise(0))
    take = take.withColumn("rest", F.col("take") - F.col("epochs") * F.col("tokens"))
    plan = staged(take.join(leaves.select(*leaf, "n"), leaf).withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)).select(*leaf, "epochs", "rest", "buckets"), "mix-plan")

    # a row for each leaf: joined without a hint, so that its size decides; a hot leaf's rows can be split
    rows = rows.join(plan, leaf)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col("nameless"))))
    rows = rows.withColumn("place", place)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)).cast("long"))
    sums = rows.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*leaf).orderBy("bucket")
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = sums.withColumn("left", F.col("rest") - F.col("before")).select(*leaf, "bucket", "left", "t")
    rows = rows.join(staged(edge, "mix-buckets"), [*leaf, "bucket"])
    whole = rows.filter((F.col("left") > F.col("t")) | (F.col("left") <= 0)).withColumn("extra", (F.col("left") > 0).cast("long"))
    at_limit = rows.filter((F.col("left") <= F.col("t")) & (F.col("left") > 0))
    order = Window.partitionBy(*leaf, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = at_limit.withColumn("extra", (F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) < F.col("left")).cast("long"))
    out = whole.unionByName(cut)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "nameless", (F.col("epochs") + F.col("extra")).cast("long").alias("copies"))


def _nameless(key: Column, text: Column) -> Column:
    return F.when(key.cast("long").isNull(), F.md5(text))


def mixed(docs: DataFrame, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", domains: Mapping[str, str] = DOMAINS, **weights: Mapping[str, float]) -> DataFrame:
    """docs, in their own columns, as often as mix takes them. Rows with the same id are taken alike, as are those without one that have the same text.

    Null lang, source and text are as in mix; no rows give no rows.
    """
    taken = _mix(docs, share, max_epochs, seed, id_col, text_col, domains, weights)
    taken = taken.groupBy(F.col("doc_id").alias("key"), F.col("nameless").alias("key_text")).agg(F.max("copies").alias("copies")).filter("copies > 0")
    own, own_text = F.col("doc")[id_col].cast("long"), _nameless(F.col("doc")[id_col], F.coalesce(F.col("doc")[text_col].cast("string"), F.lit("")))
    # as many ids as documents: merged at any size, so that small inputs show what large ones cost
    rows = packed(docs).join(staged(taken, "mix-taken").hint("merge"), own.eqNullSafe(F.col("key")) & own_text.eqNullSafe(F.col("key_text")))
    return unpacked(rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _sql() -> str:
    def case(of: str, weights: Mapping[str, float]) -> str:
        return f"CASE {of} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items())} ELSE {OTHER_WEIGHT}::DOUBLE END"

    def filled(nodes: str, name: str, parent: str, node: str, to: str) -> str:
        return f"""
{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER u, 0)) / (sum(w) OVER p - coalesce(sum(w) OVER u, 0)) AS lv FROM {nodes}
  WINDOW u AS (PARTITION BY {parent} ORDER BY cap / w, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY {parent})),
{name} AS (SELECT *, CASE WHEN lv * w >= cap THEN cap ELSE w * arg_min(lv, cap / w) FILTER (lv * w < cap) OVER (PARTITION BY {parent}) END AS {to} FROM {name}_l)"""

    domain = " ".join(f"WHEN regexp_matches(coalesce(source, ''), '{p}') THEN '{k}'" for k, p in DOMAINS.items())
    return f"""
WITH d AS (SELECT doc_id, CASE {domain} ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens, md5(coalesce(text, '')) AS nameless FROM documents),
leaf0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
lang0 AS (SELECT domain, lang, sum(cap) AS cap FROM leaf0 GROUP BY ALL),
dom0 AS (SELECT domain, sum(cap) AS cap, {case('domain', DOMAIN_WEIGHTS)} AS w, sum(sum(cap)) OVER () / {MAX_EPOCHS} * {BUDGET_SHARE}::DOUBLE AS budget FROM lang0 GROUP BY domain),
{filled('dom0', 'dom', "''", 'domain', 'given')},
lang1 AS (SELECT l.*, {case('lang', LANGUAGE_WEIGHTS)} AS w, given AS budget FROM lang0 l JOIN dom USING (domain)),
{filled('lang1', 'lng', 'domain', 'lang', 'given')},
leaf1 AS (SELECT l.*, 1::DOUBLE AS w, given AS budget FROM leaf0 l JOIN lng USING (domain, lang)),
{filled('leaf1', 'lf', 'domain, lang', 'source', 'take')},
pl AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor(take + 1e-6)::BIGINT // tokens ELSE 0 END AS epochs, floor(take + 1e-6)::BIGINT AS take, tokens FROM lf),
o AS (SELECT d.*, epochs, take - epochs * tokens AS rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, nameless)), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM d JOIN pl USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs + (coalesce(before, 0) < rest)::BIGINT AS copies FROM o
"""


SQL = _sql()
