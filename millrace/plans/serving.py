"""Read views, retrieval and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import lexical as lx
from ..operators import quality as dq
from ..operators import retrieval as rt
from ..operators import vectors as vec
from ..sources import layers as ly
from .base import ORACLE_SQL, query, table
from .contracts import everything, outbox
from .customers import BANDED, DRIFT, FEATURES, d05, d15_runs, LAPSE, PROPENSITY_SCALE, customer_base, eligible, policies, ELIGIBLE
from .layers import REJECTS, SHA, UUID5, checked_orders
from .matching import short_scores, SHORT
from .streams import SERVED, t07

SEGMENTS = f"SELECT c_mktsegment AS segment, count(*) AS customers, round(avg(monetary_30d), 2) AS mean_monetary FROM ({FEATURES}) JOIN customer ON customer = c_custkey GROUP BY 1"


def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    return customer_base(spark, d).join(c, "customer").groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("monetary_30d"), 2).alias("mean_monetary"))


@query("a10_segment_summary", SEGMENTS)
def a10(spark, d):
    return segment_summary(spark, d)


KPI = (("customers", "customer"), ("orders", "orders"), ("line_items", "lineitem"), ("events", "events"))


@query("a11_kpi_counts", "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {k}" for k, t in KPI))
def a11(spark, d):
    out = None
    for k, t in KPI:
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy().pivot("metric", [k for k, _ in KPI]).agg(F.first("n"))


@query("v_customer_features", f"SELECT customer, c_mktsegment AS segment, monetary_30d, propensity, band FROM ({BANDED}) JOIN customer ON customer = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY monetary_30d DESC, customer")
def v_features(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    rows = fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE).join(c, "customer")
    return rows.select("customer", "segment", "monetary_30d", "propensity", "band").orderBy(F.desc("monetary_30d"), "customer")


@query("v_single_customer", f"SELECT customer, monetary_30d, band FROM ({BANDED}) WHERE customer = 42")
def v_single(spark, d):
    return fe.with_propensity(customer_base(spark, d), PROPENSITY_SCALE).filter("customer = 42").select("customer", "monetary_30d", "band")


@query("v_policy_features", f"SELECT policy_id, c_name, tenure_days, lapse_risk FROM ({LAPSE}) JOIN customer ON customer = c_custkey ORDER BY lapse_risk DESC, policy_id")
def v_policies(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), "c_name")
    rows = fe.policy_features(policies(spark, d), fe.anchor_of(table(spark, d, "orders"), "o_orderdate"))
    return rows.join(c, "customer").select("policy_id", "c_name", "tenure_days", "lapse_risk").orderBy(F.desc("lapse_risk"), "policy_id")


@query("v_campaign_eligibility", f"SELECT customer, campaign_id, reason, c_mktsegment AS segment FROM ({ELIGIBLE}) JOIN customer ON customer = c_custkey WHERE campaign_id = 'CMP-A' ORDER BY eligible DESC, customer")
def v_eligibility(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    rows = eligible(spark, d).filter(F.upper("campaign_id") == "CMP-A").join(c, "customer")
    return rows.orderBy(F.desc("eligible"), "customer").select("customer", "campaign_id", "reason", "segment")


@query("v_quality_issues", f"SELECT issue_type, count(*) AS n FROM ({REJECTS}) WHERE issue_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC")
def v_issues(spark, d):
    rows = dq.rejects(checked_orders(spark, d), "orders", F.col("o_custkey"), F.col("issue_type"), F.col("o_orderdate"))
    return rows.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


SEVERITIES = {"invalid_amount": "high", "invalid_status": "medium"}
LEVEL = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITIES.items()) + " ELSE 'low' END"
RANKED = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(
    "v_issue_records",
    f"SELECT {UUID5} AS issue_id, source, entity_id, issue_type, {LEVEL} AS severity, times, last_ts FROM (SELECT *, {SHA.format("'silver|' || entity_id || '|' || issue_type")} AS h FROM "
    f"(SELECT source, entity_id, issue_type, count(*) AS times, max(event_ts) AS last_ts FROM ({REJECTS}) WHERE issue_type IS NOT NULL GROUP BY ALL)) ORDER BY {RANKED}, last_ts DESC, entity_id, issue_type",
)
def v_issue_records(spark, d):
    """The issue records themselves: the worst first, of those the latest."""
    rows = dq.issues(dq.rejects(checked_orders(spark, d), "orders", F.col("o_custkey"), F.col("issue_type"), F.col("o_orderdate")), "silver", SEVERITIES)
    rows = rows.orderBy(dq.severity_rank(F.col("severity")), F.desc("last_ts"), "entity_id", "issue_type")
    return rows.select("issue_id", "source", "entity_id", "issue_type", "severity", "times", "last_ts")


@query("v_drift", f"SELECT * FROM ({DRIFT}) ORDER BY {RANKED}, drift DESC, feature")
def v_drift(spark, d):
    """Features with their baseline, drift and severity: the worst first, of those the furthest from its baseline."""
    return d05(spark, d).orderBy(dq.severity_rank(F.col("severity")), F.desc("drift"), "feature")


@query("v_model_runs", ORACLE_SQL["d15_model_runs"])
def v_runs(spark, d):
    """The runs table, the last recorded first."""
    return d15_runs(spark, d)


@query("v_check_results")
def v_checks(spark, d):
    rank = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)
    return everything(spark, d).orderBy(rank, "check")


@query("x07_customer_profile", "SELECT o_custkey AS customer, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS products, count(*) AS offers, min(o_orderkey) AS first_offer FROM orders GROUP BY 1")
def x07(spark, d):
    """Products as an array, orders as an array of structs."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("products"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("offers"))
    return rows.select("customer", F.array_join("products", ",").alias("products"), F.size("offers").cast("long").alias("offers"), F.get("offers", F.lit(0))["o_orderkey"].alias("first_offer"))


@query("x10_entity_text", "SELECT c_custkey, format('Customer {} in segment {} of nation {}', c_name, c_mktsegment, n_name) AS body FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x10(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    text = F.format_string("Customer %s in segment %s of nation %s", "c_name", "c_mktsegment", "n_name")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", text.alias("body"))


COSINE = "SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank, q.label = v.label AS hit FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 3"


def similar(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The nearest rows of the searches' queries, or of every row: then both sides are cut into equal parts, so that neither is copied more often."""
    e = table(spark, d, "embeddings")
    queries = (e if every else e.filter("vec_id % 20 = 0")).select(F.col("vec_id").alias("query_id"), "embedding")
    return rt.nearest(e, queries, "vec_id", "embedding", block=rt.CHUNK if every else rt.BLOCK)


@query("x08_similar_entities", f"SELECT query_id, vec_id, rank FROM ({COSINE})")
def x08(spark, d):
    return similar(spark, d).select("query_id", "vec_id", "rank")


@query("x08_indexed_search")
def x08_indexed(spark, d):
    """The same search through an index of cells: nearly the same rows, for a part of the work (see its test for the recall)."""
    e = table(spark, d, "embeddings")
    cells = vec.fit_cells(e, "vec_id", "embedding")
    path = ly.work_folder(spark, "cells")
    vec.index(e, "vec_id", "embedding", cells).write.parquet(path)
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vec.search(spark.read.parquet(path), queries, "vec_id", "embedding", cells).select("query_id", "vec_id", "rank")


@query("x09_retrieval_quality", f"SELECT round(avg(hit::INT), 6) AS hit_rate, count(*) AS pairs FROM ({COSINE.replace(' WHERE q.vec_id % 20 = 0', '')})")
def x09(spark, d):
    """Share of neighbours with their own row's label, over every row and not only those that x08 takes as queries."""
    label = table(spark, d, "embeddings").select("vec_id", "label")
    rows = similar(spark, d, every=True).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return rows.agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("pairs"))


@query("x09_embedding_drift", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(x) FILTER (vec_id % 2 = 0) AS a, avg(x) FILTER (vec_id % 2 = 1) AS b FROM x GROUP BY i) SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS shift FROM m")
def x09_drift(spark, d):
    e = table(spark, d, "embeddings")
    return rt.centroid_shift(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "embedding").select(F.round("shift", 6).alias("shift"))


def marked(spark: SparkSession, d: str) -> DataFrame:
    """The documents have no headings: the first line of each paragraph that ends in a full stop and has 60 characters at most becomes one."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) <= 60) & x.endswith("."), F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = rt.sections(lx.dealt(marked(spark, d)), "doc_id", "text")
    # in a row of its own, so that the filter doesn't clean a second time
    rows = rows.select("doc_id", "section", "heading", F.explode(F.array(rt.cleaned(F.col("body")))).alias("body")).filter("body <> ''")
    return rows.withColumn("chunk", F.format_string("%08d-%05d", "doc_id", "section"))


SECTIONS = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, pos, line, length(line) <= 60 AND ends_with(line, '.') AS h FROM l),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m),
c AS (SELECT doc_id, section, coalesce(max(trim(line)) FILTER (h), 'Overview') AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '') AS body FROM s GROUP BY ALL),
k AS (SELECT doc_id, section, heading, left(trim(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[*_`>#|]', ' ', 'g'), '\s+', ' ', 'g')), 6000) AS body FROM c),
ch AS (SELECT *, printf('%08d-%05d', doc_id, section) AS chunk FROM k WHERE body <> '')"""


@query("r01_heading_sections", f"{SECTIONS} SELECT doc_id, section, heading FROM c")
def r01(spark, d):
    return rt.sections(marked(spark, d), "doc_id", "text").select("doc_id", "section", "heading")


@query("r02_clean_chunks", f"{SECTIONS} SELECT chunk, length(body) AS n_chars, sha256(body) AS digest FROM ch")
def r02(spark, d):
    return chunks(spark, d).select("chunk", F.length("body").alias("n_chars"), F.sha2("body", 256).alias("digest"))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_./+-]{{2,}}'))"


@query("r03_token_sets", f"SELECT item_id, len({TOKENS.format('text')}) AS n FROM benchmark")
def r03(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(lx.tokens(F.col("text"))).alias("n"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


SCORES = f"""{SECTIONS}, ct AS (SELECT chunk, body, lower(heading) AS h, unnest({TOKENS.format("heading || ' ' || body")}) AS token FROM ch),
qt AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS token FROM benchmark),
sc AS (SELECT query_id, chunk, sum(4 + contains(h, token)::INT) + least(length(any_value(body)) / 1200, 3.0) AS score FROM ct JOIN qt USING (token) GROUP BY ALL)"""


@query("r04_lexical_scores", f"{SCORES} SELECT query_id, count(*) AS chunks, max(score)::INT AS best, round(sum(score) * 1200)::BIGINT AS total FROM sc GROUP BY 1")
def r04(spark, d):
    """Scores are multiples of 1 / 1200: their total is given in that unit."""
    rows = lx.totals(chunks(spark, d), questions(spark, d), "chunk")
    return rows.select("query_id", "chunks", F.round("best", 0).cast("int").alias("best"), F.round(F.col("total") * 1200).cast("long").alias("total"))


TOP_CHUNKS = f"{SCORES} SELECT query_id, chunk, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk) AS rank FROM sc QUALIFY rank <= 5"


@query("r05_indexed_chunks", TOP_CHUNKS)
def r05_indexed(spark, d):
    """The same rows from an index kept as tables, which skips the blocks of chunks that can't reach a question's fifth score."""
    index = lx.build(chunks(spark, d), "chunk", ly.work_folder(spark, "lexical"))
    return lx.search(index, questions(spark, d)).select("query_id", "chunk", "rank")


@query("r05_top_chunks", TOP_CHUNKS)
def r05(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    ranked = lx.top(c, q, "chunk")
    return rt.with_fallback(ranked, q, c, "chunk").select("query_id", "chunk", "rank")


@query("u04_token_overlap", f"SELECT a.item_id AS a, b.item_id AS b, len(list_intersect({TOKENS.format('a.text')}, {TOKENS.format('b.text')})) AS common FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1")
def u04(spark, d):
    x = table(spark, d, "benchmark").select(F.col("item_id"), lx.tokens(F.col("text")).alias("t"))
    a, b = x.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), x.select(F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("a") == F.col("b") + 1).select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"))


LINEAGE = (("bronze", "events"), ("silver", "orders"), ("silver", "customer"), ("gold", "customer_features"))


@query("v_dataset_lineage", " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{t}' AS table_name, (SELECT count(*) FROM {t if t != 'customer_features' else '(SELECT DISTINCT o_custkey FROM orders)'}) AS n" for layer, t in LINEAGE))
def v_lineage(spark, d):
    out = None
    for layer, t in LINEAGE:
        rows = customer_base(spark, d) if t == "customer_features" else table(spark, d, t)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("v_inventory", "SELECT 'SKU-' || p_partkey AS sku, p_name, p_size AS on_hand, (round(p_retailprice * 100)::BIGINT / 100)::DOUBLE AS unit_price FROM part ORDER BY p_partkey")
def v_inventory(spark, d):
    """Stock of each part with its price in currency units."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    rows = table(spark, d, "part").orderBy("p_partkey")
    return rows.select(F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"), "p_name", F.col("p_size").alias("on_hand"), (cents / 100).alias("unit_price"))


@query("v_outbox", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, event_id % 50 = 0 AS pending FROM events ORDER BY CASE WHEN event_id % 400 <> 7 THEN ts END DESC NULLS LAST, event_id DESC LIMIT 100")
def v_outbox(spark, d):
    """The newest 100 outbox events with their payload parsed: a top-k report. Events whose time can't be parsed come last."""
    rows = outbox(spark, d).withColumn("at", F.try_to_timestamp("created_at")).orderBy(F.desc_nulls_last("at"), F.desc("event_id")).limit(100)
    return rows.select("event_id", "event_type", F.get_json_object("payload", "$.k").alias("k"), (F.col("status") == "PENDING").alias("pending"))


@query("v_customers", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey")
def v_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey")


@query("v_online_features", f"SELECT * FROM ({SERVED}) WHERE customer = '42'")
def v_online(spark, d):
    """One customer's features, those of the batch merged with those of the stream."""
    return t07(spark, d).filter("customer = '42'")


@query("v_identity_candidates", f"{SHORT} SELECT l_seq, r_seq, action, round(score, 2) AS score FROM c WHERE action IS NOT NULL ORDER BY score DESC, l_seq, r_seq")
def v_candidates(spark, d):
    """Candidates, the best first."""
    rows = short_scores(spark, d).orderBy(F.desc("score"), "l_seq", "r_seq")
    return rows.select("l_seq", "r_seq", "action", F.round("score", 2).alias("score"))
