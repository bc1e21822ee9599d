"""The pipeline's stages one after another, on awkward rows and on the smallest tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from millrace.llm import bpe, line_dedup, mixing, quality, similar, simhash
from millrace.llm.common import staged
from tests.oracle import SF

from .data import awkward, empty, prose, words
from .test_dedup import _templates
from .test_pages_and_mix import _mix


def _through(spark, docs):
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = staged(stage(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        sizes.append(out.count())
        docs = out
    return sizes, docs


def test_stages_take_effect(spark):
    docs, _ = awkward(spark)
    sizes, out = _through(spark, docs)
    kept = sum(r.kept for r in quality.quality_rules(docs).collect())
    assert sizes[0] == kept and sizes[1] == sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[4] == sizes[3]


def test_run_equals_stages(spark):
    from millrace.llm.common import read

    run = corpus_pipeline.run(spark, SF).collect()
    docs = read(spark, SF, "documents")
    docs = quality.keep_good(docs)
    docs = line_dedup.drop_templates(docs, groups=similar.similar_documents(docs))
    docs = mixing.mixed(simhash.keep_one(staged(docs, "t")), max_epochs=1)
    own = bpe.load(bpe.default_vocabulary())
    assert sorted((r.doc_id, r.n_tokens) for r in run) == sorted((r.doc_id, len(own.encode(r.text or "")) // 4) for r in docs.collect())


def test_empty_table(spark):
    assert _through(spark, empty(spark))[0] == [0, 0, 0, 0, 0]


def _plain_quality(rows):
    """The rows that the quality rules keep, by plain counting."""
    classes = [re.compile(p.rstrip("+")) for _, p in quality.CLASSES]
    place = {w: i for i, w in enumerate(quality.WORDS)}

    def measure(text):
        w, c, h = words(text), [0] * (len(classes) + 1), [0] * (len(place) + 1)
        for x in text or "":
            c[next((i for i, p in enumerate(classes) if p.match(x)), len(classes))] += 1
        for x in w:
            h[place.get(x, len(place))] += 1
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), c, h, len(w) < quality.MIN_WORDS or 100 * len(hit) > quality.MAX_REPEAT_PERCENT * len(w)

    def js(a, b):
        if not sum(a) or not sum(b):
            return 0.0
        pairs = [(x / sum(a), y / sum(b)) for x, y in zip(a, b)]
        return sum(sum(v * math.log(2 * v / (x + y)) / 2 for v in (x, y) if v) for x, y in pairs)

    def strays(m, ref):
        n, c, h, _ = m
        by_class = sum(c) >= quality.MIN_CLASS_CHARS and js(c, ref[0]) > quality.MAX_CLASS_JS + len(classes) / 8 / sum(c)
        return by_class or n >= quality.MIN_HIST_WORDS and js(h, ref[1]) > quality.MAX_WORD_JS + len(place) / 8 / n

    made = [(r, measure(r[1])) for r in rows]
    good = [(r[2], m) for r, m in made if not m[3] and r[2] in quality.COMMON and sum(m[1]) >= quality.MIN_CLASS_CHARS and m[0] >= quality.MIN_HIST_WORDS]

    def pooled(some):
        by = defaultdict(list)
        for lang, m in some:
            by[lang].append(m)
        return {k: ([sum(x) for x in zip(*(m[1] for m in v))], [sum(x) for x in zip(*(m[2] for m in v))]) for k, v in by.items()}

    first = pooled(good)
    refs = pooled((lang, m) for lang, m in good if not strays(m, first[lang]))
    return [r for r, m in made if not m[3] and not (r[2] in refs and strays(m, refs[r[2]]))]


def _plain_groups(rows):
    """The smallest id of the group of each id; exact Jaccard similarities of 0.8 link."""
    named = [r for r in rows if r[0] is not None]
    sets = []
    for r in named:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(named)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(named)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if named[i][0] == named[j][0] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(named):
        least[find(i)] = min(least[find(i)], r[0])
    return {r[0]: least[find(i)] for i, r in enumerate(named)}


def _plain_near(rows):
    """Rows with the smallest id of each group, and those without an id."""
    group = _plain_groups(rows)
    return list({r[0]: r for r in rows if r[0] is not None and r[0] == group[r[0]]}.values()) + [r for r in rows if r[0] is None]


def test_pipeline_equals_plain_versions(spark):
    """Every stage by brute force, on awkward rows, boilerplate and near copies."""
    tokenizers = pytest.importorskip("tokenizers")
    df, rows = awkward(spark)
    r, extra = random.Random(12), []
    base = prose(r, 150, 10).split("\n")
    for i in range(60):
        lines = [prose(r, 60, 4), "Posted by the friendly staff of this site", prose(r, 70, 3)]
        if i < 20:
            lines = list(base)
            lines[i % 10] = lines[i % 10] + f" extra{i}"
        extra.append((700 + i, "\n".join(lines), "en", f"src{i % 6}", None, None, None, None, None, None))
    df, rows = df.unionByName(spark.createDataFrame(extra, df.schema)), rows + extra
    got = _through(spark, df)[1].collect()

    rows = _plain_quality(rows)
    gone = _templates(rows, groups=_plain_groups(rows))
    rows = [(*x[:1], None if x[1] is None else "\n".join(line for n, line in enumerate(x[1].split("\n")) if ((x[0], x[1]), n) not in gone), *x[2:]) for x in rows]
    assert not any("friendly staff" in x[1] for x in rows)
    rows = _plain_near(rows)
    assert sum(700 <= (x[0] or 0) < 720 for x in rows) == 1
    taken = {i for i, _, copies in _mix(rows, mixing.BUDGET_SHARE, 1, mixing.SEED) if copies}
    lib = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((x[0], len(lib.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows if x[0] is not None and str(x[0]) in taken)
    assert sorted((x.doc_id, x.n_tokens) for x in got if x.doc_id is not None) == want and len(want) > 40
