"""Exact dedup, line dedup and near dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import exact_dedup, line_dedup, simhash
from millrace.llm.components import components

from .data import SPACE, awkward, empty, prose, words


def test_exact_dedup(spark):
    df, rows = awkward(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        want += [(i, min(known, default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_dedup(df).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(key, want))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_group_over_many_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(1, 2000)}
    assert sum(r.kept for r in got) == 1001


def _fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(fps):
    f = np.array(fps, dtype=np.uint64)
    parent = list(range(len(f)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_near_duplicates(spark, monkeypatch, chunk):
    """Small chunks send a bucket through many cells."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    df, rows = awkward(spark)
    fps = [_fingerprint(r[1]) for r in rows]
    roots = _roots(fps)
    least = defaultdict(lambda: None)
    for r, root in zip(rows, roots):
        if r[0] is not None and (least[root] is None or r[0] < least[root]):
            least[root] = r[0]
    want = sorted((str(r[0]), format(f, "016x"), str(least[root])) for r, f, root in zip(rows, fps, roots))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_keep_one(spark):
    df, rows = awkward(spark)
    out = simhash.keep_one(df).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    kept = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted(ids) == sorted(i for i in kept if i is not None) and len(out[0]) == len(df.columns)
    assert sum(r.doc_id is None for r in out) == 2


@pytest.mark.parametrize("n,k", [(400, 40), (700, 2), (33, 1)])
def test_bit_sliced_links(n, k):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**64, size=k, dtype=np.uint64)[rng.integers(0, k, n)]
    for _ in range(6):
        fps = np.where(rng.random(n) < 0.5, fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), fps)
    parent = np.arange(n)
    simhash.link_large(fps, parent, 0)
    assert [simhash._find(parent, i) for i in range(n)] == _roots(fps)
    group = np.arange(n) // 20
    parent = np.arange(n)
    simhash.link_small(fps, group, parent)
    want = [r + g * 20 for g in range(group[-1] + 1) for r in _roots(fps[group == g])]
    assert [simhash._find(parent, i) for i in range(n)] == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(r.randint(300, 360), r.randint(300, 360)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def _templates(rows, min_docs=3, groups=None):
    """The tree by brute force: (document, line number) of lines whose template recurs. A document is (id, text); groups has the group of an id."""
    unit = lambda key: key[0] if key[0] is not None else key[1]
    counted = lambda key: (groups or {}).get(key[0], unit(key))
    lines = []
    for key in {(r[0], r[1] or "") for r in rows}:
        for n, line in enumerate(key[1].split("\n")):
            own = tuple(words(line))
            if own:
                lines.append((key, n, own, tuple("<*>" if re.search("[0-9]", x) else x for x in own)))
    docs, variants = defaultdict(set), defaultdict(set)
    for key, _, own, t in lines:
        leaf = (len(t), t[: line_dedup.DEPTH])
        docs[leaf, own].add(unit(key))
        variants[leaf].add((own, t))
    support = defaultdict(int)
    for leaf, vs in variants.items():
        if len(vs) > 1 and sum(len(docs[leaf, own]) for own, _ in vs) >= min_docs:
            for own, t in vs:
                for p, token in enumerate(t):
                    support[leaf, p, token] += len(docs[leaf, own])

    def template(own, t):
        leaf = (len(t), t[: line_dedup.DEPTH])
        fixed = tuple((p, x) for p, x in enumerate(t) if x != "<*>" and support[leaf, p, x] >= min_docs)
        return (leaf, fixed) if len(fixed) >= max(line_dedup.MIN_CONSTANT, line_dedup.CONSTANT_SHARE * len(t)) else (leaf, own, "line")

    lines = [(key, n, template(own, t), len(t)) for key, n, own, t in lines]
    seen = defaultdict(set)
    for key, _, t, _ in lines:
        seen[t].add(key)

    def need(n):
        return line_dedup.LONG_DOCS if n >= line_dedup.LONG_TOKENS else min_docs * line_dedup.SHORT_FACTOR ** max(0, line_dedup.SHORT_TOKENS - n)

    return {(key, n) for key, n, t, size in lines if len({counted(k) for k in seen[t]}) >= need(size) and len({unit(k) for k in seen[t]}) > 1}


def _with_boilerplate(spark):
    df, rows = awkward(spark)
    r = random.Random(9)
    extra, passage = [], prose(random.Random(11), 60)
    for i in range(30):
        head = f"Posted by user{i} on 2024-0{i % 9 + 1}-11 at the old forum page"
        tail = "Copyright the site owners all rights reserved by " + r.choice(("ann", "bob", "cy", f"solo{chr(97 + i % 26)}x"))
        extra.append((1000 + i, "\n".join([head, prose(r, 80, 2), tail if i % 2 else "short one", "x y", f"{i} {i + 1} {i * 7} {i} 12 {i}"]), "en", "src1", None, None, None, None, None, None))
    base = prose(random.Random(5), 90, 9).split("\n")
    for i in range(40):  # copies, most with a line of their own
        lines = list(base)
        if i % 4:
            lines[i % 9] = prose(r, 10)
        extra.append((2000 + i, "\n".join(lines), "en", "src1", None, None, None, None, None, None))
    extra += [(4000 + i, prose(r, 40) + "\n" + passage + "\nRead more", "en", "src1", None, None, None, None, None, None) for i in range(50)]
    return df.unionByName(spark.createDataFrame(extra, df.schema)), rows + extra


def test_line_templates(spark):
    df, rows = _with_boilerplate(spark)
    recurring = _templates(rows)
    assert len(recurring) > 50
    for r in line_dedup.with_templates(df).collect():
        text = r.doc.text or ""
        lines = [n for n in range(len(text.split("\n"))) if ((r.doc.doc_id, text), n) in recurring]
        assert r.recurring == lines, r.doc.doc_id
        assert r.clean == ("\n".join(x for n, x in enumerate(text.split("\n")) if n not in lines) if lines else r.doc.text)


def test_line_templates_generalise(spark):
    df, rows = _with_boilerplate(spark)
    out = {r.doc_id: r for r in line_dedup.drop_templates(df).collect()}
    before = {r[0]: r[1] for r in rows}
    assert "Posted by" not in out[1001].text and "Copyright" not in out[1001].text and "short one" in out[1000].text
    assert all(out[i].text == before[i].split("\n")[0] for i in range(4000, 4050))  # also where it is most of the text
    assert out[2000].text == ""  # every document counts, those of a group too
    assert all(out[1000 + i].text.endswith(f"{i} {i + 1} {i * 7} {i} 12 {i}") for i in range(30))  # numbers alone are no template
    assert out[1001].n_chars == len(out[1001].text) and line_dedup.drop_templates(df).columns == df.columns


@pytest.mark.parametrize("own,shared", [(35, 60), (45, 60), (12, 20), (100, 60), (5, 60)])
def test_shared_passages_go_whatever_else_a_document_has(spark, own, shared):
    r = random.Random(own)
    passage = prose(r, shared)
    texts = [prose(r, own) for _ in range(20)]
    docs = spark.createDataFrame([(i, t + "\n" + passage) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.drop_templates(docs).collect()} == dict(enumerate(texts))


def test_passages_of_two_documents(spark):
    r = random.Random(7)
    passage = prose(r, 60)
    docs = spark.createDataFrame([(i, prose(r, 80) + "\n" + passage) for i in range(2)], "doc_id long, text string")
    assert not any(passage in x.text for x in line_dedup.drop_templates(docs).collect())
    assert all(passage in x.text for x in line_dedup.drop_templates(docs, long_docs=3).collect())
    assert all(passage in x.text for x in line_dedup.drop_templates(docs, long_tokens=61).collect())


def test_short_lines_need_more_documents_by_the_given_rule(spark):
    docs = spark.createDataFrame([(i, f"{prose(random.Random(i), 30)}\nShare this page") for i in range(11)], "doc_id long, text string")
    left = lambda **how: sum("Share" in x.text for x in line_dedup.drop_templates(docs, **how).collect())
    assert left() == 11 and left(short_factor=3) == 0 and left(short_tokens=3) == 0


def test_groups_of_near_duplicates_count_once(spark):
    df, rows = _with_boilerplate(spark)
    groups = {i: 2000 for i in range(2000, 2040)}
    recurring = _templates(rows, groups=groups)
    frame = spark.createDataFrame(list(groups.items()), "doc_id long, component_id long")
    got = {((r.doc.doc_id, r.doc.text or ""), n) for r in line_dedup.with_templates(df, groups=frame).collect() for n in r.recurring}
    assert got == recurring and not any(2000 <= (k[0] or 0) < 2040 for k, _ in recurring) and any((k[0] or 0) >= 4000 for k, _ in recurring)


def test_line_templates_of_nothing(spark):
    assert line_dedup.with_templates(empty(spark)).count() == 0
