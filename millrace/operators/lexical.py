"""Lexical ranking over an inverted index in tables: postings by token and block of chunks, with upper bounds that let a search skip most of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.layers import work_folder

#: Chunks of a block, and blocks of a question that are scored first.
ROWS, FIRST = 1024, 2
#: Tokens are left to the end while they can't make up more than this share of the score to be reached.
SHARE = 0.8


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_./+-]{2,}"), F.lit(0)))


@dataclass
class Index:
    """Tables of an index below path.

    chunks: id (a number for key), key, long (what its length adds to a score), h (heading), tokens, kind; postings, a row for each token and block that has it: token, block, best (largest gain),
    n, held (an array of 8 * id + gain); blocks: block, long, most (the largest long and number of tokens of its chunks).
    """

    spark: SparkSession
    path: str
    key: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes from so few files that most would be idle; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build(chunks: DataFrame, key: str, path: str, rows: int = ROWS) -> Index:
    """Writes the index of chunks (key, heading, body) to path.

    A block holds about so many chunks with like numbers of tokens, since what bounds a score is the tokens that a chunk has. A common token
    has a row for each block, so that no join on (token, block) has a hot key. Chunks without tokens are left out; a null heading or body is empty.
    A block's chunks are brought together before their tokens become rows, so that a token never travels with its chunk's key.
    """
    spark = chunks.sparkSession
    heading, body = F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit(""))
    c = chunks.select(F.col(key).alias("key"), F.least(F.length(body) / 1200, F.lit(3.0)).alias("long"), F.lower(heading).alias("h"), F.explode(F.array(tokens(F.concat_ws(" ", heading, body)))).alias("tokens"))
    c = c.withColumn("kind", F.floor(F.log2(F.size("tokens")) * 4).cast("int"))
    c.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("id"), "*").write.mode("overwrite").parquet(f"{path}/chunks")
    index = Index(spark, path, key)
    # four kinds for each doubling of tokens
    sizes = index.table("chunks").groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"), F.max("long").alias("long"), F.max(F.size("tokens")).alias("most")).collect()
    kinds = spark.createDataFrame([tuple(r) for r in sizes], "kind int, parts int, long double, most int")
    # all blocks of a kind share its bounds
    made = kinds.select((F.col("kind").cast("long") * (1 << 40)).alias("start"), "long", "most", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    made.select((F.col("start") + F.col("i")).alias("block"), "long", "most").write.mode("overwrite").parquet(f"{path}/blocks")
    block = F.col("kind").cast("long") * (1 << 40) + F.pmod(F.xxhash64("key"), F.col("parts"))
    rows_ = index.table("chunks").join(F.broadcast(kinds.select("kind", "parts")), "kind").select("id", "h", block.alias("block"), "tokens")
    rows_ = rows_.repartition(_parts(spark), "block").select("id", "h", "block", F.explode("tokens").alias("token"))
    posted = rows_.select("id", "block", "token", (4 + F.col("h").contains(F.col("token")).cast("int")).alias("gain"))
    posted = posted.groupBy("block", "token").agg(F.max("gain").alias("best"), F.count(F.lit(1)).alias("n"), F.collect_list(F.col("id") * 8 + F.col("gain")).alias("held"))
    posted.write.mode("overwrite").parquet(f"{path}/postings")
    return index


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _asked(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, asked), its tokens in rows, and the postings of all asked tokens."""
    q = queries.select("query_id", F.explode(F.array(tokens(F.coalesce("question", F.lit(""))))).alias("asked"))
    rows = _written(q.select("query_id", F.explode("asked").alias("token")), "asked-tokens")
    return q, rows, index.table("postings").join(rows.select("token").distinct(), "token", "left_semi")


def _scored(asked: DataFrame, touched: DataFrame) -> DataFrame:
    """(query_id, id, part, ...): gains of the chunks that hold tokens of asked (query_id, token, block, ...), by question and chunk.

    The postings of a question and block are brought together as they are, before they become rows.
    """
    more = [c for c in asked.columns if c not in ("query_id", "token", "block")]
    rows = asked.join(touched.select("token", "block", "held"), ["token", "block"])
    rows = rows.select("query_id", "block", *more, "held").repartition(_parts(asked.sparkSession), "query_id", "block")
    rows = rows.select("query_id", "block", *more, F.explode("held").alias("held"))
    rows = rows.select("query_id", "block", *more, F.shiftright("held", 3).alias("id"), F.pmod("held", F.lit(8)).alias("gain"))
    return rows.groupBy("query_id", "block", "id").agg(F.sum("gain").alias("part"), *[F.max(c).alias(c) for c in more]).drop("block")


def _with_length(index: Index, parts: DataFrame) -> DataFrame:
    """(query_id, key, score) of all chunks of parts."""
    rows = parts.join(index.table("chunks").select("id", "key", "long"), "id")
    return rows.select("query_id", "key", (F.col("part") + F.col("long")).alias("score"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 5, first: int = FIRST, share: float = SHARE) -> DataFrame:
    """(query_id, key, score, rank): the k chunks of the highest score, ties by key, among those with a token in common. queries: query_id, question.

    A score is 4 for each common token, 1 for each that the heading holds, and up to 3 for length.
    The first blocks of the highest bound give each question a score that k chunks reach. Other blocks whose bound is less are skipped. In
    those that are left, the most common tokens of the question wait while their bounds together are at most share of that score: a chunk must
    make up the rest by the other tokens, and only chunks that do are scored in full, from their own tokens.
    """
    q, asked, touched = _asked(index, queries)
    asked = asked.join(touched.select("token", "block", "best", "n"), "token")
    of_block = Window.partitionBy("query_id", "block")
    asked = asked.join(index.table("blocks"), "block").withColumn("bound", F.least(F.sum("best").over(of_block), 5 * F.col("most")) + F.col("long"))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    asked = _written(asked.select("query_id", "token", "block", "best", "n", F.col("long").alias("block_long"), "bound", place.alias("place")), "asked")

    # written, as are the candidates below, so that Spark knows how few they are and postings and chunks stay where they are
    nearest = _written(asked.filter(F.col("place") <= first).select("query_id", "token", "block"), "first-asked")
    full = _written(_ranked(_with_length(index, _written(_scored(nearest, touched), "first-parts")), k), "first-scores")
    reach = full.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))  # a question with fewer chunks so far takes all

    rest = asked.filter(F.col("place") > first).join(reach, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).filter("bound >= least")
    sofar = F.sum("best").over(of_block.orderBy(F.desc("n"), "token").rowsBetween(Window.unboundedPreceding, 0))
    rest = rest.withColumn("sofar", sofar).withColumn("waits", F.col("sofar") <= share * (F.col("least") - F.col("block_long")))
    # what the tokens that wait could add at most
    rest = rest.withColumn("more", F.coalesce(F.max(F.when(F.col("waits"), F.col("sofar"))).over(of_block), F.lit(0))).filter("NOT waits")
    some = _scored(rest.select("query_id", "token", "block", (F.col("more") + F.col("block_long")).alias("more"), "least"), touched)
    some = _written(some.filter(F.col("part") + F.col("more") >= F.col("least")).select("query_id", "id"), "candidates")
    some = some.join(index.table("chunks").select("id", "key", "long", "h", "tokens"), "id").join(q, "query_id")
    some = some.select("query_id", "key", "h", "long", F.explode(F.array(F.array_intersect("tokens", "asked"))).alias("common"))
    points = F.size("common") * 4 + F.size(F.filter("common", lambda t: F.col("h").contains(t)))
    some = some.select("query_id", "key", (points + F.col("long")).alias("score"))
    return _ranked(full.drop("rank").unionByName(some), k).withColumnRenamed("key", index.key)


def score_totals(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunks, best, total): number, maximum and sum of the scores that search ranks by."""
    _, asked, touched = _asked(index, queries)
    return _summed(_with_length(index, _scored(asked.join(touched.select("token", "block"), "token"), touched)))


def scores(chunks: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of all chunks with a token in common, in one pass over chunks without an index: the score of search.

    Tokens are joined where the chunks are, if the questions' are few enough to be sent there. Chunks are dealt by key before, so that their
    tokens travel once and the many sums by question and chunk don't.
    """
    heading, body = F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit(""))
    c = chunks.select(F.col(key).alias("key"), F.least(F.length(body) / 1200, F.lit(3.0)).alias("long"), F.lower(heading).alias("h"), F.explode(F.array(tokens(F.concat_ws(" ", heading, body)))).alias("tokens"))
    c = c.repartition(_parts(chunks.sparkSession), "key")
    asked = queries.select("query_id", F.explode(tokens(F.coalesce("question", F.lit("")))).alias("token"))
    # lists of questions, in pieces, so that a token that all of them have is no single row
    lists = asked.groupBy("token", F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("piece")).agg(F.collect_list("query_id").alias("of")).drop("piece")
    rows = c.select("key", "long", "h", F.explode("tokens").alias("token")).join(lists, "token")
    rows = rows.select("key", "long", (4 + F.col("h").contains(F.col("token")).cast("int")).alias("gain"), "of")
    return rows.select("key", "long", "gain", F.explode("of").alias("query_id")).groupBy("query_id", "key").agg((F.sum("gain") + F.max("long")).alias("score"))


def top(chunks: DataFrame, queries: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(query_id, key, score, rank) as by search, without an index. Written, so that however often it is read, chunks are scored once."""
    return _written(_ranked(scores(chunks, queries, key), k).withColumnRenamed("key", key), "top")


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("best"), F.sum("score").alias("total"))


def totals(chunks: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """score_totals without an index."""
    return _summed(scores(chunks, queries, key))
