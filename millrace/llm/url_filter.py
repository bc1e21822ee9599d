"""URL filter: fixed rules, then a path-template tree judged by smoothed labelled purity. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged

#: (verdict, host and path prefix)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A host with one of these terms is a labelled bad example.
BAD_TERMS = ("adult", "bets", "casino", "porn", "spam")
#: Levels of the tree below the host; in longer paths the last level's segment is the whole rest.
LEVELS = 8
#: Rows that a segment must have below its node to stay literal; others become the wildcard.
MIN_ROWS = 5
#: Siblings whose labelled share is within so many standard errors of their node's are one branch with it, as are those above, and those below.
MERGE_Z = 3.29
#: Pseudo-counts of the node's share, and the smoothed share of bad rows from which a branch is rejected.
PRIOR, MIN_PURITY = 2.0, 0.8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host (or a parent domain) and the start of the path, else null."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def _levels(n: int) -> list[str]:
    return [f"t{i}" for i in range(1, n + 1)]


def templates(rows: DataFrame, levels: int) -> DataFrame:
    """rows (host, path, ...) with t1 .. for so many levels added: the segment, * where segments vary at its place in the tree, or empty past the path's end.

    A level is decided for all hosts at once, from counts by (host, templates so far, segment): whatever has MIN_ROWS rows keeps its node.
    """
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = rows.withColumn("segments", segments)
    parent = ["host"]
    for level in range(1, levels + 1):
        seg = F.get("segments", F.lit(level - 1)) if level < LEVELS else F.array_join(F.slice("segments", LEVELS, F.greatest(F.size("segments"), F.lit(1))), "/")
        rows = rows.withColumn("seg", F.coalesce(seg, F.lit("")))
        kept = rows.groupBy(*parent, "seg").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= MIN_ROWS) | (F.col("seg") == "")).select(*parent, "seg", F.col("seg").alias(f"t{level}"))
        # staged, so that both sides of the join are plain scans and the rows of a hot host can be split
        rows = rows.join(staged(kept, "url-literals"), [*parent, "seg"], "left").withColumn(f"t{level}", F.coalesce(f"t{level}", F.lit("*"))).drop("seg")
        parent = [*parent, f"t{level}"]
    return rows.drop("segments")


def judged_templates(rows: DataFrame, levels: int) -> DataFrame:
    """(host, t1 .., purity) of every template, from rows with a label (1 bad, 0 good, null none): the smoothed share of bad rows in its branch.

    From the host down, the children of a node are merged: those whose share of bad rows is significantly above the node's,
    those significantly below, and all others, which stay with the node, however small. Merging needs sums only,
    so that no task holds all children of a node. A template's branch is the deepest that differs from the node above it.
    """
    by = ["host", *_levels(levels)]
    leaf = staged(rows.groupBy(*by).agg(F.count("label").alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("bad")), "url-leaves")
    every = leaf.groupBy().agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (every["bad"] or 0) / every["n"] if every["n"] else 0.0
    totals = lambda keys: leaf.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    nodes = totals(["host"]).withColumn("purity", (F.col("bad") + PRIOR * F.lit(overall)) / (F.col("n") + PRIOR))
    for level in range(1, levels + 1):
        above = by[:level]
        node = staged(nodes.select(*above, (F.col("bad") / F.nullif(F.col("n"), F.lit(0))).alias("p"), F.col("purity").alias("above")), "url-nodes")
        p = F.coalesce("p", F.lit(0.0))
        share = (F.col("bad") + PRIOR * p) / (F.col("n") + PRIOR)
        error = F.sqrt(p * (1 - p) / (F.col("n") + PRIOR))
        side = F.when(error == 0, 0).when(share - p >= MERGE_Z * error, 1).when(p - share >= MERGE_Z * error, -1).otherwise(0)
        nodes = staged(totals(by[: level + 1]).join(node, above).withColumn("side", side), "url-sides")
        branch = nodes.filter("side <> 0").groupBy(*above, "side").agg(((F.sum("bad") + PRIOR * F.first("p")) / (F.sum("n") + PRIOR)).alias("merged"))
        nodes = nodes.join(staged(branch, "url-branches"), [*above, "side"], "left").withColumn("purity", F.coalesce("merged", "above")).select(*by[: level + 1], "n", "bad", "purity")
    return nodes.select(*by, "purity")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, bad_terms: Sequence[str] = BAD_TERMS, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    label_col names a column of labelled examples (1 bad, 0 good, null not known); a host with a bad term is labelled bad besides.
    The rules' verdicts are no labels: they say nothing of other pages. Null url or one without :// has an empty host and path,
    is in a template of its own and judged by its labels like any other. Repeated rows count as often as they occur. No rows give none.
    A path of any length is in the tree as a whole.
    """
    url = F.col(url_col).cast("string")
    given = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), given.alias("label"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    if bad_terms:
        rows = rows.withColumn("label", F.when(F.col("host").rlike("|".join(bad_terms)), F.lit(1)).otherwise(F.col("label")))
    rows = staged(rows, "url-rows")
    deepest = rows.agg(F.max(F.size(F.filter(F.split("path", "/", -1), lambda s: s != "")))).first()[0] or 0
    levels = min(LEVELS, deepest)
    # each page has its place in the tree decided once; what follows reads the staged table
    rows = staged(templates(rows, levels), "url-templates")
    rows = rows.join(staged(judged_templates(rows, levels), "url-judged"), ["host", *_levels(levels)], "left")
    blocked = F.col("rule").isin(*[r for v, r in rules if v == "block"])
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("purity") >= MIN_PURITY, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The number that ends a page's path is the id of the document that the page holds.
DOCUMENT = r"/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$"


def with_document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url and label: of the document that the page holds, where it is labelled, bad if toxic or of low quality."""
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("document")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("label"))
    number = F.regexp_extract(path_of(F.col("url")), DOCUMENT, 1).try_cast("long")
    return pages.select("page_id", "url", number.alias("document")).join(bad, "document", "left").drop("document")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(with_document_labels(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")), label_col="label")


def _sql() -> str:
    quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
    whens = []
    for _, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        whens.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}') THEN '{rule}'")
    blocked = f"rule IN ({quoted(r for v, r in RULES if v == 'block')})"
    by = ["host", *_levels(LEVELS)]
    grow, judge = [], []
    for level in range(1, LEVELS + 1):
        parent = ", ".join(by[:level])
        seg = f"coalesce(segs[{level}], '')" if level < LEVELS else f"array_to_string(segs[{level}:], '/')"
        grow.append(f"l{level} AS (SELECT *, CASE WHEN {seg} = '' OR count(*) OVER (PARTITION BY {parent}, {seg}) >= {MIN_ROWS} THEN {seg} ELSE '*' END AS t{level} FROM l{level - 1})")
        judge.append(
            f"n{level} AS (SELECT *, coalesce(sum(bad) OVER (PARTITION BY {parent}) / nullif(sum(n) OVER (PARTITION BY {parent}), 0), 0)::DOUBLE AS p{level},"
            f" sum(n) OVER (PARTITION BY {parent}, t{level}) AS cn{level}, sum(bad) OVER (PARTITION BY {parent}, t{level}) AS cb{level} FROM b{level - 1}),\n"
            f"e{level} AS (SELECT *, (cb{level} + {PRIOR}::DOUBLE * p{level}) / (cn{level} + {PRIOR}::DOUBLE) AS sh{level}, sqrt(p{level} * (1 - p{level}) / (cn{level} + {PRIOR}::DOUBLE)) AS er{level} FROM n{level}),\n"
            f"c{level} AS (SELECT *, CASE WHEN er{level} = 0 THEN 0 WHEN sh{level} - p{level} >= {MERGE_Z}::DOUBLE * er{level} THEN 1 WHEN p{level} - sh{level} >= {MERGE_Z}::DOUBLE * er{level} THEN -1 ELSE 0 END AS c{level} FROM e{level}),\n"
            f"b{level} AS (SELECT *, CASE WHEN c{level} = 0 THEN u{level - 1} ELSE (sum(bad) OVER q + {PRIOR}::DOUBLE * p{level}) / (sum(n) OVER q + {PRIOR}::DOUBLE) END AS u{level} FROM c{level} WINDOW q AS (PARTITION BY {parent}, c{level}))"
        )
    every = ", ".join(by)
    number = DOCUMENT.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS label FROM labels GROUP BY doc_id),
r AS (SELECT u.*, CASE {' '.join(whens)} END AS rule, CASE WHEN regexp_matches(host, '{"|".join(BAD_TERMS)}') THEN 1 ELSE label END AS label
  FROM u LEFT JOIN g ON doc_id = try_cast(regexp_extract(path, '{number}', 1) AS BIGINT)),
l0 AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM r),
{', '.join(grow)},
b0 AS (SELECT *, (sum(bad) OVER w + {PRIOR}::DOUBLE * coalesce(sum(bad) OVER () / nullif(sum(n) OVER (), 0), 0)) / (sum(n) OVER w + {PRIOR}::DOUBLE) AS u0
  FROM (SELECT {every}, count(label) AS n, coalesce(sum(label), 0) AS bad FROM l{LEVELS} GROUP BY ALL) WINDOW w AS (PARTITION BY host)),
{', '.join(judge)}
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN {blocked} THEN 'block' ELSE 'allow' END WHEN u{LEVELS} >= {MIN_PURITY} THEN 'block' ELSE 'allow' END AS verdict
FROM l{LEVELS} JOIN b{LEVELS} USING ({every})
"""


SQL = _sql()
