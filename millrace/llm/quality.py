"""Quality rules: base counts, and divergence from language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, packed, read, staged, unpacked, word_list

#: Character classes in the order in which they are counted; a character counts for the first that has it.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("ascii", r"[\x00-\x7F]+"),
)
#: Very common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no"),
}
WORDS = tuple(sorted({w for words in COMMON.values() for w in words}))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Divergences (natural logarithm, 0 to ln 2) above which a document goes, before the allowance for short ones.
MAX_CLASS_JS, MAX_WORD_JS = 0.02, 0.05
#: Fewer characters or words than these, and the divergence of that kind says nothing.
MIN_CLASS_CHARS, MIN_HIST_WORDS = 200, 80


def _class_counts(text: Column) -> Column:
    """Characters by class, and other ones last. Each class is taken out of what the ones before it left."""

    def step(rest: Column, i: int, counts: list[Column]) -> Column:
        if i == len(CLASSES):
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, CLASSES[i][1], ""), lambda r: step(r, i + 1, [*counts, F.length(rest) - F.length(r)]))

    return let(text, lambda t: step(t, 0, []))


def _word_counts(words: Column) -> Column:
    """Occurrences of each common word, then of all others."""
    found = F.filter(words, lambda w: w.isin(*WORDS))
    return let(found, lambda f: F.array(*[F.size(f) - F.size(F.array_remove(f, w)) for w in WORDS], F.size(words) - F.size(f)))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hashes of their words."""

    def covered(hashes: Column) -> Column:
        in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            in_order,
            lambda s: F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"]) & (j > 0)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def quality_features(text: Column) -> dict[str, Column]:
    by_words = let(word_list(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"), _word_counts(w).alias("word_hist")))
    return {"by_words": by_words, "class_hist": _class_counts(text), "n_dup_lines": _dup_lines(text)}


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two histograms of counts; 0 if either is empty."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shares = lambda a, n: F.transform(a, lambda x: x / n)
    both = let(
        F.struct(total(p).alias("np"), total(q).alias("nq")),
        lambda n: F.when((n["np"] == 0) | (n["nq"] == 0), 0.0).otherwise(
            F.aggregate(
                F.zip_with(shares(p, n["np"]), shares(q, n["nq"]), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2),
                F.lit(0.0),
                lambda s, x: s + x,
            )
        ),
    )
    return both


def measured(rows: DataFrame, text: Column, lang: Column) -> DataFrame:
    """rows with one column _q: the base counts and both histograms of text."""
    columns = rows.columns
    f = quality_features(F.coalesce(text.cast("string"), F.lit("")))
    features = F.struct(*[c.alias(k) for k, c in f.items()], lang.cast("string").alias("lang"))
    # a generator keeps the optimizer from computing the features once for each use
    rows = rows.select(*columns, F.explode(F.array(features)).alias("_f"))
    c, w = F.col("_f.class_hist"), F.col("_f.by_words")
    n_words, repeat = w["n_words"].cast("long"), w["n_repeat_words"].cast("long")
    space = [k for k, _ in CLASSES].index("space")
    symbol = [k for k, _ in CLASSES].index("symbol")
    n_chars = F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    q = F.struct(
        F.col("_f.lang").alias("lang"),
        n_chars.alias("n_chars"),
        n_words.alias("n_words"),
        (n_chars - c[space]).cast("long").alias("word_chars"),
        c[symbol].cast("long").alias("n_symbols"),
        F.col("_f.n_dup_lines").cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        ((n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)).alias("base_failed"),
        c.alias("class_hist"),
        w["word_hist"].alias("word_hist"),
    )
    return rows.select(*columns, q.alias("_q"))


def references(measures: DataFrame, languages: tuple[str, ...] = tuple(COMMON)) -> DataFrame:
    """At most one row for each given language: histograms pooled over its documents that pass the base rules.

    Fitted twice: the second time without the documents that stray from the first fit.
    """
    long_enough = (F.col("_q.n_chars") >= MIN_CLASS_CHARS) & (F.col("_q.n_words") >= MIN_HIST_WORDS)
    good = measures.filter(~F.col("_q.base_failed") & F.col("_q.lang").isin(*languages) & long_enough)

    def pooled(rows: DataFrame) -> DataFrame:
        n_class, n_word = len(CLASSES) + 1, len(WORDS) + 1
        sums = [F.sum(F.col("_q.class_hist")[i]).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.col("_q.word_hist")[i]).alias(f"w{i}") for i in range(n_word)]
        one = rows.groupBy(F.col("_q.lang").alias("ref_lang")).agg(*sums)
        return one.select("ref_lang", F.array(*[f"c{i}" for i in range(n_class)]).alias("ref_class"), F.array(*[f"w{i}" for i in range(n_word)]).alias("ref_word"))

    first = pooled(good)
    near = good.join(F.broadcast(first), F.col("_q.lang") == F.col("ref_lang")).filter(~strays())  # a row for each given language
    return pooled(near.select("_q"))


def strays() -> Column:
    """Over a row with _q and its reference: does either histogram diverge too far?

    A sample of n items diverges by about (bins - 1) / (8 n) from its own source: that much is allowed besides.
    """
    q = F.col("_q")
    by_class = _js(q["class_hist"], F.col("ref_class")) > MAX_CLASS_JS + F.lit(len(CLASSES) / 8.0) / q["n_chars"]
    by_word = _js(q["word_hist"], F.col("ref_word")) > MAX_WORD_JS + F.lit(len(WORDS) / 8.0) / q["n_words"]
    return F.coalesce((q["n_chars"] >= MIN_CLASS_CHARS) & by_class, F.lit(False)) | F.coalesce((q["n_words"] >= MIN_HIST_WORDS) & by_word, F.lit(False))


def judged(measures: DataFrame, refs: DataFrame) -> DataFrame:
    """measures with kept added. A language without a reference (or null) has nothing to diverge from: only the base rules judge it."""
    rows = measures.join(F.broadcast(refs), F.col("_q.lang").eqNullSafe(F.col("ref_lang")), "left")  # a row for each given language
    return rows.withColumn("_kept", ~F.col("_q.base_failed") & ~strays())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """Base counts and verdict per document, by references of the caller's (as references() makes them from documents of known quality) or of these documents' own.

    Null text counts as empty: no words, base_failed. Null or unknown lang: only the base rules judge.
    Repeated rows give repeated rows; no rows give none. Histograms are taken in one pass over the texts and
    staged as a narrow table, from which the references and then the verdicts follow without a shuffle of rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).alias("doc"))
    measures = staged(measured(narrow, F.col("doc.text"), F.col("doc.lang")).select("doc_id", "_q"), "quality")
    out = judged(measures, references(measures) if refs is None else refs)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in counts], F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """The documents that quality_rules keeps, with their own columns. Nulls, empty texts, repeated rows and empty tables are as there.

    Documents and measures are staged together, so that every text is measured once and none is shuffled.
    """
    measures = staged(measured(packed(docs), F.col("doc")[text_col], F.col("doc")[lang_col]), "quality")
    refs = staged(references(measures), "quality-refs") if refs is None else refs
    return unpacked(judged(measures, refs).filter("_kept"), docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def _sql() -> str:
    space, symbol = (dict(CLASSES)[k].rstrip("+") for k in ("space", "symbol"))
    rest, counts, before = "t", [], "t"
    for k, pattern in CLASSES:
        rest = f"regexp_replace({before}, '{pattern}', '', 'g')"
        counts.append(f"length({before}) - length({rest}) AS c_{k}")
        before = rest
    counts.append(f"length({before}) AS c_other")
    names = [*(f"c_{k}" for k, _ in CLASSES), "c_other"]
    quoted = ["'" + w + "'" for w in WORDS]
    word_names = [f"w_{i}" for i in range(len(WORDS))]
    word_counts = ", ".join(f"len(list_filter(ws, lambda x: x = {w})) AS {n}" for w, n in zip(quoted, word_names))

    def js(own: list[str], ref: list[str]) -> str:
        p, q = f"({'+'.join(own)})", f"({'+'.join(ref)})"
        part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * ln({a} / (({a} + {b}) / 2)) ELSE 0.0 END)"
        terms = [f"({part(a, b)} + {part(b, a)}) / 2" for a, b in ((f"({x}/{p}::DOUBLE)", f"({y}/{q}::DOUBLE)") for x, y in zip(own, ref))]
        return f"(CASE WHEN {p} = 0 OR {q} = 0 THEN 0.0 ELSE {' + '.join(terms)} END)"

    all_words = [*word_names, "w_other"]
    stray = (
        f"((n_chars >= {MIN_CLASS_CHARS} AND {js([f'm.{n}' for n in names], [f'r.{n}' for n in names])} > {MAX_CLASS_JS} + {len(CLASSES) / 8.0} / n_chars)"
        f" OR (n_words >= {MIN_HIST_WORDS} AND {js([f'm.{n}' for n in all_words], [f'r.{n}' for n in all_words])} > {MAX_WORD_JS} + {len(WORDS) / 8.0} / n_words))"
    )
    sums = ", ".join(f"sum({n}) AS {n}" for n in [*names, *all_words])
    languages = ", ".join("'" + x + "'" for x in COMMON)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT doc_id, lang, ws, len(ws) AS n_words, length(t) AS n_chars,
    length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '{symbol}+', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
    {', '.join(counts)}, {word_counts}
  FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM d WHERE len(ws) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT b.*, n_words - ({' + '.join(word_names)}) AS w_other, coalesce(n_repeat_words, 0) AS n_repeat,
    n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM b LEFT JOIN p USING (doc_id)),
good AS (SELECT * FROM m WHERE NOT base_failed AND lang IN ({languages}) AND n_chars >= {MIN_CLASS_CHARS} AND n_words >= {MIN_HIST_WORDS}),
r1 AS (SELECT lang, {sums} FROM good GROUP BY lang),
r AS (SELECT lang, {sums} FROM (SELECT m.* FROM good m JOIN r1 r USING (lang) WHERE NOT {stray}) GROUP BY lang)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({stray}, FALSE) AS kept
FROM m LEFT JOIN r USING (lang)
"""


SQL = _sql()
