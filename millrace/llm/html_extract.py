"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty
from .html_nodes import GROUPS, Node, blocks, features, parse

#: Bounds of the training sample: pages of the table (those whose ids have the smallest hash), and layouts made by rule.
SAMPLE_PAGES, LAYOUTS = 400, 1200
#: Characters of html whose nodes a task holds at once, but for a single longer page.
HELD = 1 << 22
TREES, TREE_DEPTH, SEED = 20, 6, 7


def rule_labels(nodes: list[Node]) -> list[int | None]:
    """1 for an article, what it holds and what holds it; 0 for elements of other kinds and what they hold; None where elements don't tell.

    Only tags decide, and tokens where they agree with the place: a name that sounds like junk inside an article
    may be an article's own name, so that it is left to the made layouts to say.
    """
    out: dict[int, int | None] = {}
    for n in nodes:
        above = out[id(n.parent)] if n.parent else None
        group = GROUPS.get(n.tag, -1)
        if above == 0 or 5 <= group <= 9 or n.bad and not n.good and above != 1 and not n.paragraphs:
            out[id(n)] = 0
        elif n.bad:
            out[id(n)] = None
        elif above == 1 or group == 0 or n.good:
            out[id(n)] = 1
        else:
            out[id(n)] = None
    for n in reversed(nodes):
        if out[id(n)] == 1 and n.parent and out[id(n.parent)] is None:
            out[id(n.parent)] = 1
    return [out[id(n)] for n in nodes]


def layout(seed: int) -> tuple[str, list[int]]:
    """A page made by rule, with a label for each of its block nodes: the article or not."""
    r = random.Random(seed)
    labels = [1]
    word = lambda: "".join(r.choice(("an", "er", "ing", "th", "on", "ti", "re", "é", "sch", "os")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() + r.choice(("", "", "", "", ",", ".")) for _ in range(n)) + r.choice((".", ""))

    def el(tag: str, body: str, label: int, attrs: str = "") -> str:
        return f"<{tag}{attrs}>\0{label}{body}</{tag}>"

    def links(label: int) -> str:
        return el("ul", "".join(el("li", f'<a href="/{word()}">{word()}</a>', label) for _ in range(r.randint(2, 8))), label)

    def named(names: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(names.split())}{r.choice(("", "-box", " wide", "-1"))}"'

    def misnamed(body: str) -> str:
        """A name that holds a junk word: a good word beside it or, where there are paragraphs enough to tell, none."""
        bad = r.choice("login header banner search share widget modal related footer comment social newsletter menu cookie promo".split())
        good = r.choice("story article post content entry text main body".split())
        if body.count("<p>") >= 4 and r.random() < 0.6:
            return f' {r.choice(("class", "id"))}="{bad}-{r.choice(("page", "view", "wrap", "x"))}"' if bad not in ("comment", "related") else f' class="{bad}-{good}"'
        return f' {r.choice(("class", "id"))}="{r.choice((f"{bad}-{good}", f"{good} {bad}", f"{bad}-free-{good}", f"main-{bad}-{good}"))}"'

    def junk() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return el(r.choice(("nav", "div")), links(0), 0, r.choice(("", named("menu nav navigation navbar"))))
        if kind == 1:
            return el(r.choice(("aside", "div")), el("h3", word(), 0) + links(0), 0, named("sidebar widget related"))
        if kind == 2:
            return el("div", prose(r.randint(3, 30)), 0, named("ad advert sponsored promo banner"))
        if kind == 3:
            return el("div", el("p", prose(r.randint(5, 25)), 0) + "<button>OK</button>", 0, named("cookie consent notice gdpr"))
        if kind == 4:
            return el("form", el("label", word(), 0).replace("label", "span").replace("\x000", "") + '<input name="q"><button>Go</button>', 0, named("search login newsletter subscribe"))
        if kind == 5:
            body = "".join(el("div", el("p", prose(r.randint(4, 40)), 0), 0, r.choice(("", named("comment reply")))) for _ in range(r.randint(1, 5)))
            return el(r.choice(("section", "div")), el("h2", "Comments", 0) + body, 0, named("comments disqus replies"))
        if kind == 6:
            return el("header", el(r.choice(("h1", "p", "div")), word(), 0) + r.choice(("", links(0))), 0)
        if kind == 7:
            return el("footer", "&copy; " + prose(r.randint(3, 15)), 0)
        return el("div", " ".join(f"<a href='#'>{word()}</a>" for _ in range(4)), 0, r.choice(("", named("share social breadcrumb pagination"))))

    def article() -> str:
        body = el("h1", prose(r.randint(1, 10)), 1) if r.random() < 0.8 else ""
        for _ in range(r.randint(1, 12)):
            kind = r.randrange(12)
            if kind == 0:
                body += el("h2", prose(r.randint(1, 6)), 1)
            elif kind == 1:
                body += el("ul", "".join(el("li", prose(r.randint(3, 15)), 1) for _ in range(3)), 1)
            elif kind in (2, 4):
                body += el("blockquote", el("p", prose(r.randint(5, 30)), 1), 1)
            elif kind == 3 and r.random() < 0.6:
                body += junk()
            else:
                text = prose(r.randint(1, 120)) if r.random() < 0.8 else r.choice((prose(1), prose(2), word()[:3].title() + "."))
                body += el("p", f"<b>{text}<br>" if len(text) < 6 and r.random() < 0.6 else r.choice((text, text, text, f"<b>{text}<br>", f"<b>{text}</b>", f"{text} <a href='/{word()}'>{word()}</a> {text}<br>{text}")), 1)
        kind = r.random()
        if kind < 0.4:
            return el(r.choice(("article", "main")), body, 1, r.choice(("", "", misnamed(body))))
        if kind < 0.65:
            return el(r.choice(("div", "section")), body, 1, misnamed(body))
        return el(r.choice(("div", "section")), body, 1, r.choice((named("content article post entry story main"), "")))

    main = article()
    if r.random() < 0.3:
        main = el("div", junk() * (r.random() < 0.5) + main + junk() * (r.random() < 0.5), 1, r.choice(("", named("content main page wrap"))))
    page = "<html><body>" + "".join(junk() for _ in range(r.randint(0, 4))) + main + "".join(junk() for _ in range(r.randint(0, 4))) + "</body></html>"
    page = page.replace("<body>", "<body>\x001", 1)
    labels += [int(x) for x in re.findall("\x00([01])", page)]
    return re.sub("\x00[01]", "", page), labels


def training_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(features, label) of nodes: of a bounded sample of pages by what their markup says, and of layouts made by rule."""
    spark = pages.sparkSession
    chosen = pages.select(F.col(id_col).alias("_id")).distinct().orderBy(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))), "_id").limit(SAMPLE_PAGES)
    sample = pages.select(F.col(id_col).alias("_id"), text_or_empty(html_col).alias("html")).join(F.broadcast(chosen), "_id", "left_semi")  # SAMPLE_PAGES ids at most

    def rows(x: np.ndarray, y: list) -> Iterator[tuple]:
        return ((row.tolist(), float(label)) for row, label in zip(x, y) if label is not None)

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                nodes = parse(page)
                yield pd.DataFrame(rows(features(nodes), rule_labels(nodes)), columns=["x", "label"])

    def of_layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                page, labels = layout(int(seed))
                nodes = parse(page)
                if len(nodes) == len(labels) - 1 + (nodes[1].tag != "body"):
                    labels = labels[1:]
                yield pd.DataFrame(rows(features(nodes), labels), columns=["x", "label"])

    schema = "x array<double>, label double"
    made = spark.range(0, LAYOUTS, numPartitions=4).mapInPandas(of_layouts, schema)
    return sample.mapInPandas(of_pages, schema).unionByName(made).select(array_to_vector("x").alias("features"), "label")


class Forest:
    """The trees of a fitted model as arrays, for whole batches of nodes."""

    def __init__(self, model: GBTClassificationModel):
        self.trees = [self._read(t._call_java("rootNode")) for t in model.trees]
        self.weights = list(model.treeWeights)

    @staticmethod
    def _read(root) -> tuple[np.ndarray, ...]:
        feature, limit, yes, no, value = [], [], [], [], []

        def grow(node) -> int:
            at = len(feature)
            for a, v in ((feature, -1), (limit, 0.0), (yes, at), (no, at), (value, node.prediction())):
                a.append(v)
            if node.subtreeDepth():
                split = node.split()
                feature[at], limit[at] = split.featureIndex(), split.threshold()
                yes[at], no[at] = grow(node.leftChild()), grow(node.rightChild())
            return at

        grow(root)
        return tuple(map(np.array, (feature, limit, yes, no, value)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, limit, yes, no, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(TREE_DEPTH):
                at = np.where(x[rows, feature[at]] <= limit[at], yes[at], no[at])
            out += weight * value[at]
        return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Forest:
    rows = training_rows(pages, id_col, html_col).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=SEED).fit(rows)
    rows.unpersist()
    return Forest(model)


def decode(nodes: list[Node], margins: np.ndarray) -> np.ndarray:
    """The likeliest labels in which nothing is kept below a node that goes. The root is always kept.

    A node goes with all that it holds; a kept one chooses for each child, from the leaves up.
    """
    log_keep, log_drop = -np.logaddexp(0, -2 * margins), -np.logaddexp(0, 2 * margins)
    place = {id(n): i for i, n in enumerate(nodes)}
    drop, keep = log_drop.copy(), log_keep.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    out = np.zeros(len(nodes), dtype=bool)
    out[0] = True
    for i in range(1, len(nodes)):
        out[i] = out[place[id(nodes[i].parent)]] and keep[i] > drop[i]
    return out


def portions(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    part = batch["html"].str.len().cumsum() // HELD
    return (rows for _, rows in batch.groupby(part))


def extract(pages: DataFrame, forest: Forest, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. Null or empty html gives an empty text; repeated rows give repeated rows, no rows none.

    Rows stay where they are: no shuffle. Pages are whole, and those of HELD characters of html are in memory as nodes at once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in portions(whole)):
            parsed = [parse(x) for x in batch["html"]]
            margins = forest.margin(np.concatenate([features(n) for n in parsed])) if parsed else np.zeros(0)
            texts, at = [], 0
            for nodes in parsed:
                texts.append("\n".join(blocks(nodes, decode(nodes, margins[at : at + len(nodes)]))))
                at += len(nodes)
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, train(pages))
