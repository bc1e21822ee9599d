"""Secret scan: three fixed patterns, and character Markov models for other random strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, text_or_empty, word_list

#: Fixed values. Kind, pattern, group whose length counts, least length. Spans are listed in this order of kinds.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a maximal run of 16 or more is the same as a maximal run that is 16 or more long, and is found faster
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Log-likelihood ratio for each character pair above which a candidate is a secret.
MIN_RATIO = 0.9
#: Bounds of the training sample: documents whose words are ordinary, and strings made of each kind, random and ordinary.
SAMPLE_DOCS, SAMPLE_MADE = 2000, 4000
#: A pair's probability is smoothed by so many pseudo-counts of its second character's share of all.
BACKOFF = 20.0
#: Words that made identifiers are put together from.
PARTS = (
    "account action admin array auth base batch buffer build cache callback channel class client cluster code column command config connect content context control count create cursor data date default delete device document "
    "domain driver element encode engine entry error event export field file filter format frame function get group handle handler header image import index info input instance interface item key language layer length level "
    "library limit line link list load local location log main manager map message method model module name network node object offset operator option order output package page param parent parse path pattern point policy "
    "position process profile project property provider proxy query queue record region register remote render report request resource response result return role route row rule schema scope script search select server service "
    "session set size source start state status storage store stream string style system table tag target task template test text thread time timeout token tree type update user value version view window worker write"
).split()
_ONE_SPAN = "struct<start:int,kind:int,end:int>"
_SPAN = f"array<{_ONE_SPAN}>"


def _scan(items: Column, kind: str, start: Column, step) -> Column:
    """What step(state, item), a struct (state, out), gives for each item in turn, out being of the given type.

    Items are taken in blocks of the square root of their number, each with an array of its own: appending to one array would copy all before it
    for every item, and so grow with the square of the items.
    """
    block = F.ceil(F.sqrt(F.size(items))).cast("int")

    def inner(state: Column, part: Column) -> Column:
        grow = lambda acc, x: let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), grow)

    def outer(acc: Column, i: Column) -> Column:
        part = F.slice(items, i * block + 1, block)
        return let(inner(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    whole = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) == 0, F.array().cast(f"array<{kind}>")).otherwise(whole)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep=None) -> Column:
    """Start and end, in code points, of the leftmost non-overlapping matches that are long enough."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["m"])
        good = F.length(x["g"]) >= least
        if keep is not None:
            good = good & keep(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("state"), F.when(good, span).alias("out"))

    def placed(found: Column) -> Column:
        parts = F.arrays_zip(found.alias("m"), measured.alias("g"), F.split(text, pattern, -1).alias("gap"))
        spans = lambda p: _scan(p, _ONE_SPAN, F.lit(0), step)
        return F.filter(let(F.filter(parts, lambda x: x["m"].isNotNull()), spans), lambda x: x.isNotNull())

    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN)).otherwise(placed(m)))


def _apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap no base span: one pass in order of the starts of base and the ends of spans.

    Whatever base span could overlap comes before, so that the furthest end of those decides.
    """
    tagged = F.concat(
        F.transform(spans, lambda x: F.struct(x["end"].alias("place"), F.lit(0).alias("is_base"), x.alias("span"))),
        F.transform(base, lambda x: F.struct(x["start"].alias("place"), F.lit(1).alias("is_base"), x.alias("span"))),
    )

    def step(reach: Column, x: Column) -> Column:
        own = x["is_base"] == 1
        state = F.when(own, F.greatest(reach, x["span"]["end"])).otherwise(reach)
        return F.struct(state.alias("state"), F.when(~own & (x["span"]["start"] >= reach), x["span"]).alias("out"))

    scanned = let(F.array_sort(tagged), lambda t: _scan(t, _ONE_SPAN, F.lit(0), step))
    return F.filter(scanned, lambda x: x.isNotNull())


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c) - 1


def _made(digest: Column) -> list[Column]:
    """Ordinary strings of six kinds out of a digest: camelCase, snake_case, the same in capitals, a path with a number in it, a UUID, and a ruler of one character."""
    number = lambda at: F.conv(F.substring(digest, at, 4), 16, 10).cast("int")
    word = lambda k: F.get(F.array(*map(F.lit, PARTS)), number(1 + 4 * k) % len(PARTS))
    words = [word(k) for k in range(4)]
    camel = F.concat(words[0], *[F.initcap(w) for w in words[1:]])
    path = F.concat_ws("/", words[0], words[1], F.concat_ws("-", words[2], (number(20) % 3000).cast("string")), words[3])
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    snake = F.concat_ws("_", *words)
    return [camel, snake, F.upper(snake), path, uuid, F.repeat(F.substring(F.lit("=-_+/"), number(24) % 5 + 1, F.lit(1)), 20 + number(28) % 40)]


def training_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Labelled samples (sample, is_random): SAMPLE_MADE strings of each of three random kinds and of each ordinary kind, made from digests
    of numbers, and the words of SAMPLE_DOCS documents (those whose ids have the smallest hash), of at least 8 characters of the alphabet without digits.

    Null texts have no words; with no documents the made strings are all there is.
    """
    spark = docs.sparkSession
    digest = lambda kind: F.sha2(F.concat(F.lit(kind), F.col("id").cast("string")), 256)
    n = spark.range(0, SAMPLE_MADE, numPartitions=4)
    mixed = F.base64(F.unhex(digest("sample:")))
    kinds = F.array(mixed, F.upper(F.regexp_replace(mixed, "[+/=]", "")), digest("sample:"))
    random = n.select(F.explode(kinds).alias("sample"), F.lit(True).alias("is_random"))
    made = n.select(F.explode(F.array(*_made(digest("made:")))).alias("sample"), F.lit(False).alias("is_random"))
    chosen = docs.select(F.col(id_col).alias("_id")).distinct().orderBy(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), "_id").limit(SAMPLE_DOCS)
    text = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id", "left_semi")  # SAMPLE_DOCS ids at most
    words = text.select(F.explode(word_list(F.col("_text"))).alias("w")).select(F.regexp_extract("w", "[A-Za-z_+/=-]{8,}", 0).alias("sample"))
    return random.unionByName(made).unionByName(words.filter("sample <> ''").select("sample", F.lit(False).alias("is_random")))


def train(samples: DataFrame) -> list[float]:
    """Log of the ratio of both models' transition probabilities, by 67 * first + second character.

    A pair backs off to the share of its second character in the same model, so that a character which ordinary
    words hardly have speaks for a random string wherever it stands.
    """
    chars = samples.select("is_random", F.filter(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0).alias("c")).filter("size(c) > 1")
    pairs = chars.select("is_random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: _code(a) * len(ALPHABET) + _code(b))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o"))
    size = len(ALPHABET)
    table = {row["pair"]: (row["r"], row["o"]) for row in counts.collect()}  # 67 * 67 rows at most

    def logs(model: int) -> list[float]:
        n = [[table.get(a * size + b, (0, 0))[model] for b in range(size)] for a in range(size)]
        total = sum(map(sum, n))
        share = [(sum(row[b] for row in n) + 1) / (total + size) for b in range(size)]
        return [math.log((x + BACKOFF * q) / (sum(row) + BACKOFF)) for row in n for x, q in zip(row, share)]

    return [r - o for r, o in zip(logs(0), logs(1))]


def _ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio over the character pairs of the token."""
    codes = F.transform(F.split(token, ""), _code)
    return let(
        F.filter(codes, lambda c: c >= 0),
        lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda s, i: s + F.get(table, F.get(c, i) * len(ALPHABET) + F.get(c, i + 1))) / (F.size(c) - 1),
    )


def find_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of each base kind, and arrays base and spans of (start, kind, end), ends exclusive.

    A candidate that touches a base span is not reported again. Null text is empty and has no spans; repeated rows give repeated rows,
    no rows none. Rows stay where they are. Texts of any length are matched whole, in time that grows little faster than
    their matches (see _scan).
    """
    text = text_or_empty(text_col)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    random = lambda m: _ratio(m, table) > MIN_RATIO
    found = {k: _spans(text, p, i, g, n) for i, (k, p, g, n) in enumerate(BASE)}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.explode(F.array(F.struct(*[c.alias(k) for k, c in found.items()], _spans(text, CANDIDATE, len(BASE), keep=random).alias("markov")))).alias("f"),
    )
    base = F.array_sort(F.concat(*[F.col(f"f.{k}") for k in found]))
    rows = rows.select("doc_id", *[F.size(f"f.{k}").cast("long").alias(f"n_{k}") for k in found], base.alias("base"), F.col("f.markov").alias("markov"))
    apart = F.when((F.size("markov") == 0) | (F.size("base") == 0), F.col("markov")).otherwise(_apart(F.col("markov"), F.col("base")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", apart))).drop("markov")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = train(training_samples(docs))
    out = find_secrets(docs, ratios)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words_, rest = BASE[0][1].split(")", 1)[0].removeprefix("((?i:"), BASE[0][1].split("))", 1)[1]
    assign = "(" + "|".join(either(w) for w in words_.split("|")) + ")" + rest
    patterns = [(i, assign if k == "assign" else p, g, n) for i, (k, p, g, n) in enumerate(BASE)] + [(len(BASE), CANDIDATE, 0, 0)]
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, {n} AS least, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {g}) AS g, string_split_regex(t, {quoted(p)}) AS gap FROM t" for i, p, g, n in patterns
    )
    size, name = len(ALPHABET), "['assign', 'access', 'hex', 'markov'][k + 1]"
    joined = lambda at: f"coalesce(string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, k, e) {at}, '')"
    number = lambda at: f"('0x' || md[{at}:{at + 3}])::INT"
    words = "[" + ", ".join(f"'{w}'" for w in PARTS) + "]"
    code = f"list_filter(list_transform(string_split({{}}, ''), lambda c: strpos('{ALPHABET}', c) - 1), lambda c: c >= 0)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
chosen AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM t) ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id LIMIT {SAMPLE_DOCS}),
made AS (SELECT sha256('sample:' || i) AS dg, to_base64(unhex(sha256('sample:' || i))) AS b, sha256('made:' || i) AS md FROM range({SAMPLE_MADE}) r(i)),
wd AS (SELECT md, {', '.join(f"{words}[{number(1 + 4 * k)} % {len(PARTS)} + 1] AS w{k}" for k in range(4))}, {number(20)} % 3000 AS num, {number(24)} AS ch, {number(28)} AS n FROM made),
ord AS (SELECT unnest([w0 || {' || '.join(f'upper(w{k}[1]) || w{k}[2:]' for k in (1, 2, 3))}, w0 || '_' || w1 || '_' || w2 || '_' || w3, upper(w0 || '_' || w1 || '_' || w2 || '_' || w3), w0 || '/' || w1 || '/' || w2 || '-' || num || '/' || w3,
  md[1:8] || '-' || md[9:12] || '-' || md[13:16] || '-' || md[17:20] || '-' || md[21:32], repeat(substr('=-_+/', ch % 5 + 1, 1), 20 + n % 40)]) AS s FROM wd),
w AS (SELECT unnest(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+')) AS w FROM t SEMI JOIN chosen USING (doc_id)),
smp AS (SELECT unnest([b, upper(regexp_replace(b, '[+/=]', '', 'g')), dg]) AS s, TRUE AS rnd FROM made UNION ALL SELECT s, FALSE FROM ord UNION ALL SELECT regexp_extract(w, '[A-Za-z_+/=-]{{8,}}'), FALSE FROM w),
ch AS (SELECT rnd, {code.format('s')} AS c FROM smp WHERE s <> ''),
pr AS (SELECT rnd, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {size} + c[i + 1])) AS pair FROM ch WHERE len(c) > 1),
ct AS (SELECT pair, count(*) FILTER (rnd) AS r, count(*) FILTER (NOT rnd) AS o FROM pr GROUP BY 1),
cells AS (SELECT a, b, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM range({size}) x(a) CROSS JOIN range({size}) y(b) LEFT JOIN ct ON pair = a * {size} + b),
tb AS (SELECT list(l ORDER BY a, b) AS tbl FROM (SELECT a, b, ln((r + {BACKOFF}::DOUBLE * ((sum(r) OVER q + 1) / (sum(r) OVER () + {size}))) / (sum(r) OVER p + {BACKOFF}::DOUBLE))
  - ln((o + {BACKOFF}::DOUBLE * ((sum(o) OVER q + 1) / (sum(o) OVER () + {size}))) / (sum(o) OVER p + {BACKOFF}::DOUBLE)) AS l FROM cells WINDOW p AS (PARTITION BY a), q AS (PARTITION BY b))),
f AS ({found}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
sp AS (SELECT doc_id, k, m[i] AS m, coalesce(list_sum(list_transform(gap[1:i], lambda y: length(y))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT AS s FROM x WHERE length(g[i]) >= least),
sc AS (SELECT doc_id, k, s, s + length(m) AS e, {code.format('m')} AS c FROM sp),
ok AS (SELECT doc_id, k, s, e FROM sc, tb WHERE k < {len(BASE)} OR list_sum(list_transform(range(1, len(c)), lambda i: tbl[c[i] * {size} + c[i + 1] + 1])) / (len(c) - 1) > {MIN_RATIO}),
kept AS (SELECT * FROM ok o WHERE k < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM ok b WHERE b.k < {len(BASE)} AND b.doc_id IS NOT DISTINCT FROM o.doc_id AND b.s < o.e AND o.s < b.e)),
agg AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {joined(f'FILTER (k < {len(BASE)})')} AS base, {joined('')} AS spans FROM kept GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN agg USING (doc_id)
"""


SQL = _sql()
