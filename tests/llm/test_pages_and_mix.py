"""HTML extraction, URL filter and mixing."""

from collections import defaultdict
from functools import cache

import pytest

from millrace.llm import html_extract, html_nodes, mixing, url_filter
from tests.oracle import SF

from .data import awkward, empty, words

PAGES = "page_id long, url string, html string, text string, host string, rule string"


@pytest.fixture(scope="module")
def forest(spark):
    return html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def _text(forest, page):
    nodes = html_nodes.parse(page)
    return "\n".join(html_nodes.blocks(nodes, html_extract.decode(nodes, forest.margin(html_nodes.features(nodes)))))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br><p>Second&#33;
line with some more words, to be a paragraph.</p><ul><li>one item here.<li>two items here.</ul><div class="comments"><p>Nice post, thanks for it.</p></div></article>
<aside class="sidebar">Side</aside><div id="cookie-notice"><p>We use cookies.</p></div><form><input name="q"><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_article_only(forest):
    assert _text(forest, PAGE) == "Title & more\nFirst line\nSecond! line with some more words, to be a paragraph.\none item here.\ntwo items here."


def test_held_out_layouts(forest):
    hit = total = exact = 0
    for seed in range(9000, 9150):
        page, labels = html_extract.layout(seed)
        nodes = html_nodes.parse(page)
        keep = html_extract.decode(nodes, forest.margin(html_nodes.features(nodes)))
        same = [bool(a) == bool(b) for a, b in zip(labels[-len(nodes) :], keep)]
        hit, total, exact = hit + sum(same), total + len(same), exact + all(same)
    assert hit / total > 0.99 and exact / 150 > 0.95


def test_forest_equals_the_model(spark):
    """The arrays give what the fitted model itself predicts."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier

    rows = html_extract.training_rows(spark.read.parquet(f"{SF}/pages.parquet").limit(5)).limit(3000).cache()
    model = GBTClassifier(maxIter=5, maxDepth=html_extract.TREE_DEPTH, stepSize=0.3, seed=html_extract.SEED).fit(rows)
    said = model.transform(rows).select("features", "rawPrediction").collect()
    margins = html_extract.Forest(model).margin(np.array([r.features.toArray() for r in said]))
    assert len(said) == 3000 and np.abs(margins).max() > 0.5
    assert np.allclose(margins, [r.rawPrediction[1] for r in said], rtol=0, atol=1e-12)


P = "Some people walked over the hill in the morning, and they found a river. "
#: Pages written by hand, other than the made layouts, with their main texts.
BY_HAND = [
    (f'<div class="login-story"><p>{P * 3}</p><p>{P * 2}</p></div>', [P * 3, P * 2]),
    (f'<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="comment-free-content"><h1>Hill</h1><p>{P * 3}</p><p>{P}</p></div><footer>c</footer>', ["Hill", P * 3, P]),
    (f'<header><h1>Site</h1></header><div class="main-header-story"><h1>Hill</h1><p>{P * 3}</p><p>{P * 2}</p></div><div class="comments"><h2>Comments</h2><div><p>{P}</p></div></div>', ["Hill", P * 3, P * 2]),
    (f'<div id="banner-page"><h1>Hill</h1><p>{P * 3}</p><p>{P * 2}</p><p>{P * 2}</p><p>{P * 2}</p></div><div class=ad>Buy now</div>', ["Hill", P * 3, P * 2, P * 2, P * 2]),
    (f'<ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{P * 3}</p><p>{P * 2}</p><div class="footer">(c) 2020 all rights</div>', [P * 3, P * 2]),
    (f'<div id=top><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><article class="share"><h2>Hill &amp; vale</h2><p>{P}<blockquote><p>{P * 2}</p></blockquote><p><b>Ok.<br></article><aside>More</aside>', ["Hill & vale", P, P * 2, "Ok."]),
    (f'<main><h1>Hill</h1><p>{P}</p><section class="related"><h3>Related</h3><ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul></section><p>{P * 2}</p></main>', ["Hill", P, P * 2]),
]


def test_pages_by_hand(forest):
    """Nothing kept that isn't main text. Of the blocks, 15 of 22 are found after training on the smallest table, 19 on the largest:
    headings under misleading names are missed, and all of the page whose only name speaks against it.
    """
    found = total = 0
    for page, want in BY_HAND:
        got, want = [x for x in _text(forest, f"<html><body>{page}</body></html>").split("\n") if x], [x.strip() for x in want]
        assert set(got) <= set(want), page
        found, total = found + len(got), total + len(want)
    assert found / total >= 0.65


@pytest.mark.parametrize("page", ["<p title='a" * 90_000, "<a " * 330_000, "<div>" * 50_000 + "</span></p></td>" * 50_000, "<b>" * 200_000 + "</i>" * 100_000, "<div>" * 2_000 + "<li>x" * 60_000, "<!-- " * 200_000, '<a "<a" ' * 120_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_nodes.parse(page)
    assert time.process_time() - began < 2


def test_decoding_equals_enumeration():
    """Small trees: the likeliest of all labellings in which nothing is kept below a node that goes."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        nodes = [html_nodes.Node("html", None, "")]
        for _ in range(int(rng.integers(1, 8))):
            nodes.append(html_nodes.Node("div", nodes[int(rng.integers(len(nodes)))], ""))
        margins = rng.normal(size=len(nodes))
        place = {id(n): i for i, n in enumerate(nodes)}
        up = [place[id(n.parent)] if n.parent else 0 for n in nodes]
        score = lambda keep: sum(-np.logaddexp(0, -2 * m if k else 2 * m) for k, m in zip(keep, margins))
        best = max((k for k in product((False, True), repeat=len(nodes)) if k[0] and all(not k[i] or k[up[i]] for i in range(len(nodes)))), key=score)
        assert tuple(html_extract.decode(nodes, margins)) == best


def test_decoding_never_keeps_below_a_dropped_node(forest):
    import numpy as np

    nodes = html_nodes.parse(PAGE)
    rng = np.random.default_rng(0)
    for _ in range(50):
        keep = html_extract.decode(nodes, rng.normal(size=len(nodes)))
        kept = {id(n) for n, k in zip(nodes, keep) if k}
        assert all(n.parent is None or id(n.parent) in kept for n, k in zip(nodes, keep) if k)


def test_extract_cases(spark, forest):
    rows = [(1, "http://a/b", PAGE, "x", "y", "z"), (2, None, None, None, None, None), (3, "u", "", None, None, None), (None, "u", "<p>", None, None, None), (4, "u", "no markup at all", None, None, None), (5, "u", "<div>" * 3000 + "deep", None, None, None), (1, "http://a/b", PAGE, "x", "y", "z")]
    out = html_extract.extract(spark.createDataFrame(rows, PAGES), forest).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id in (2, 3)} == {""} and len({r.text for r in out if r.page_id == 1}) == 1
    assert html_extract.extract(spark.createDataFrame([], PAGES), forest).count() == 0


URLS = [
    ("HTTP://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://x.com/en/1#t", "x.com", "/en/1", "com/en/", "block"), ("//com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("ftp://com/en/", "com", "/en/", "com/en/", "block"), ("http://xcom/en/", "xcom", "/en/", None, "allow"), ("http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"), ("http://net/de/8", "net", "/de/8", "net/de/", "allow"),
    ("a://b://c.org/es/x", "b:", "//c.org/es/x", None, "allow"), ("http://É.org/es/", "É.org", "/es/", "org/es/", "block"), ("http://c.org?x/es/", "c.org", "", None, "allow"), ("x\ny://h.org/es/\n?a", "h.org", "/es/\n", "org/es/", "block"),
]


def test_url_rules(spark):
    rows = [(i, u, None, None, "h", "r") for i, (u, *_) in enumerate(URLS)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [tuple(x[1:]) for x in URLS]
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def _plain_verdicts(rows):
    """The tree by brute force: purity of each (host, path) from rows (host, path, label)."""
    import math

    levels = min(url_filter.LEVELS, max(len([x for x in p.split("/") if x]) for _, p, _ in rows))
    paths = []
    for host, path, _ in rows:
        segs = [x for x in path.split("/") if x]
        segs = segs[: url_filter.LEVELS - 1] + ["/".join(segs[url_filter.LEVELS - 1 :])] if len(segs) >= url_filter.LEVELS else segs
        paths.append(((host,), segs + [""] * (levels - len(segs))))
    for i in range(levels):
        n = defaultdict(int)
        for t, segs in paths:
            n[t, segs[i]] += 1
        paths = [(t + (segs[i] if not segs[i] or n[t, segs[i]] >= url_filter.MIN_ROWS else "*",), segs) for t, segs in paths]
    count = defaultdict(lambda: [0, 0])
    for (t, _), (_, _, label) in zip(paths, rows):
        for k in range(len(t) + 1):
            count[t[:k]][0] += label is not None
            count[t[:k]][1] += label or 0
    k, purity = url_filter.PRIOR, {}
    share = lambda key: count[key][1] / count[key][0] if count[key][0] else 0.0
    for key in sorted(count, key=len):
        if len(key) == 1:
            purity[key] = (count[key][1] + k * share(())) / (count[key][0] + k)
        elif key:
            p, kin = share(key[:-1]), [x for x in count if len(x) == len(key) and x[:-1] == key[:-1]]

            def side(x, p=p):
                n, bad = count[x]
                s, e = (bad + k * p) / (n + k), math.sqrt(p * (1 - p) / (n + k))
                return 0 if e == 0 or abs(s - p) < url_filter.MERGE_Z * e else math.copysign(1, s - p)

            like = [x for x in kin if side(x) == side(key)]
            purity[key] = purity[key[:-1]] if side(key) == 0 else (sum(count[x][1] for x in like) + k * p) / (sum(count[x][0] for x in like) + k)
    return ["block" if purity[t] >= url_filter.MIN_PURITY else "allow" for t, _ in paths]


def test_url_tree(spark):
    """Against brute force, without any listed term: branches at every depth, small alike siblings, long paths, null labels, repeated rows."""
    import random

    r, rows = random.Random(3), []
    for i in range(1500):
        host = r.choice(("big.dev", "big.dev", "small.dev", f"h{i % 40}.dev"))
        branch = r.choice(("shop/item", "shop/promo", "a/b/c/good", "a/b/c/bad", "blog", "x/y/z/1/2/3/4/5/6/7/8/9"))
        bad = branch in ("shop/promo", "a/b/c/bad") and r.random() < 0.97 or r.random() < 0.1
        rows.append((host, f"/{branch}/{i}", None if r.random() < 0.4 else int(bad)))
    rows += [("pills.dev", f"/{i}/{i}", 1) for i in range(12)] + [("pills.dev", "/new/1", None), ("", "", None), ("one.dev", "", 1), *rows[:9]]
    df = spark.createDataFrame([(i, h and f"http://{h}{p}", y) for i, (h, p, y) in enumerate(rows)], "page_id long, url string, label int")
    got = [x.verdict for x in url_filter.filter_urls(df, rules=(), bad_terms=(), label_col="label").orderBy("page_id").collect()]
    assert got == _plain_verdicts(rows)
    by = defaultdict(set)
    for (host, path, _), v in zip(rows, got):
        by[host, path.rsplit("/", 1)[0]].add(v)
    assert by["big.dev", "/a/b/c/bad"] == by["big.dev", "/shop/promo"] == by["pills.dev", "/new"] == {"block"}
    assert by["big.dev", "/a/b/c/good"] == by["big.dev", "/blog"] == by["small.dev", "/shop/item"] == by["one.dev", ""] == {"allow"}


def _water(budget, nodes):
    """Deals a budget to (weight, cap) by weight; what full ones can't take goes to the others."""
    out, left = [None] * len(nodes), dict(enumerate(nodes))
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = [i for i, (w, c) in left.items() if level * w >= c]
        if not full:
            for i, (w, _) in left.items():
                out[i] = level * w
            break
        for i in full:
            out[i] = left.pop(i)[1]
            budget -= out[i]
    return out


def _mix(rows, share, epochs, seed):
    import hashlib
    import re

    docs = []
    for r in rows:
        source, lang = r[3] or "", r[2] or ""
        domain = next((k for k, p in mixing.DOMAINS.items() if re.search(p, source)), "other")
        docs.append(((domain, lang, source), hashlib.md5((r[1] or "").encode()).hexdigest() if r[0] is None else r[0], len(words(r[1]))))
    tokens = defaultdict(int)
    for leaf, _, n in docs:
        tokens[leaf] += n

    @cache
    def cap(*prefix):
        return epochs * sum(n for leaf, n in tokens.items() if leaf[: len(prefix)] == prefix)

    def deal(prefix, budget):
        if len(prefix) == 3:
            return {prefix: int(budget + 1e-6)}
        children = sorted({leaf[: len(prefix) + 1] for leaf in tokens if leaf[: len(prefix)] == prefix})
        weight = [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, None][len(prefix)]
        parts = _water(budget, [(weight.get(c[-1], mixing.OTHER_WEIGHT) if weight else 1.0, cap(*c)) for c in children])
        return {k: v for c, b in zip(children, parts) for k, v in deal(c, b).items()}

    take = deal((), share * sum(tokens.values()))
    out = []
    for leaf, n in tokens.items():
        whole = take[leaf] // n if n else 0
        rest, own = take[leaf] - whole * n, [(i, t) for l, i, t in docs if l == leaf]
        order = sorted(own, key=lambda x: (hashlib.md5(f"{seed}:{whole}:{x[0]}".encode()).hexdigest(), str(x[0]), x[1]))
        before = 0
        for i, t in order:
            out.append((str(None if isinstance(i, str) else i), t, whole + (before < rest)))
            before += t
    return sorted(out)


@pytest.mark.parametrize("share,epochs,bucket", [(0.8, 2, 2000), (0.5, 1, 3), (1.5, 2, 5)])
def test_mix(spark, monkeypatch, share, epochs, bucket):
    """Small buckets cut the leaves' order into many pieces."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    df, rows = awkward(spark)
    got = sorted((str(r.doc_id), r.n_tokens, r.copies) for r in mixing.mix(df, share, epochs).collect())
    want = _mix(rows, share, epochs, mixing.SEED)
    assert got == want


def test_mixed_documents(spark):
    df, rows = awkward(spark)
    copies = defaultdict(int)
    for r in mixing.mix(df.filter("doc_id IS NOT NULL")).collect():
        copies[r.doc_id] = max(copies[r.doc_id], r.copies)
    out = mixing.mixed(df.filter("doc_id IS NOT NULL")).collect()
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += 1
    times = defaultdict(int)
    for r in rows:
        times[r[0]] += 1
    assert dict(got) == {k: v * times[k] for k, v in copies.items() if v} and mixing.mixed(df).columns == df.columns
    nameless = df.filter("doc_id IS NULL")
    assert mixing.mixed(nameless, 1.0).count() == sum(r.copies for r in mixing.mix(nameless, 1.0).collect()) > 0
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_by_given_weights(spark):
    rows = [(i, "a b c d", "en", "wiki" if i % 2 else "news") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed(df, 0.5, 1, domains={"all": "wiki|news"}, domain_weights={"all": 1.0}, language_weights={"en": 1.0}, source_weights={"wiki": 3.0})
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"wiki": 75, "news": 25}
