"""DOM nodes of an HTML page: a small tree builder and the features of each block node."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import log1p

import numpy as np

#: A tag with quoted values, else one whose quotes don't pair up. Both give up at the next < outside quotes and never go back, so that a page is scanned once.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>")
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style textarea title noscript template svg iframe object select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of these names, looked for up to the bounds.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
GOOD_TOKENS = frozenset("article articlebody body content entry main post story text".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
GROUPS = {t: i for i, names in enumerate(("article main", "section div body html", "p blockquote pre figure figcaption", "h1 h2 h3 h4 h5 h6", "ul ol dl li dd dt menu", "nav", "header", "footer", "aside dialog", "form fieldset button label", "table tbody thead tfoot tr td th")) for t in names.split()}
N_GROUPS = 12
FEATURES = N_GROUPS + 20


class Node:
    __slots__ = ("anchor", "attrs", "bad", "children", "controls", "depth", "good", "items", "n_tags", "paragraphs", "parent", "place", "stops", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent, self.attrs, self.children, self.items = tag, parent, attrs, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.children) if parent else 0
        self.text = self.anchor = self.n_tags = self.paragraphs = self.controls = self.stops = 0
        tokens = _WORD.findall(" ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower()) if "=" in attrs else ()
        self.good, self.bad = sum(t in GOOD_TOKENS for t in tokens), sum(t in BAD_TOKENS for t in tokens)
        if parent:
            parent.children.append(self)


def _tags(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of each tag, in order; comments and declarations have no match. The caller may send the place where to go on."""
    at, last = 0, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            m, at = None, end + 3 if end >= 0 else len(page)
        elif start > last:  # no tag ends after this
            return
        elif page.startswith(("<!", "<?"), start):
            m, at = None, page.find(">", start) + 1
        elif m := _TAG.match(page, start) or _LOOSE_TAG.match(page, start):
            at = m.end()
        else:
            at = start + 1
            continue
        at = (yield start, at, m) or at


def parse(page: str) -> list[Node]:
    """Block nodes in page order; items of a node are its child nodes and pieces of inline text, in order.

    Open elements are counted by name, so that an end tag without a start tag costs nothing, however deep the page.
    """
    root = Node("html", None, "")
    nodes, here, at = [root], root, 0
    inline: list[str] = []
    blocks_open: dict[str, int] = defaultdict(int)
    inline_open: dict[str, int] = defaultdict(int)

    def close(node: Node, upto: Node) -> Node:
        while node is not upto:
            blocks_open[node.tag] -= 1
            node = node.parent
        return upto

    tags, go_on = _tags(page), None
    while True:
        try:
            start, end, m = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            _text(here, page[at:start], inline_open["a"] > 0)
        at = end
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                if blocks_open[tag]:
                    up = here
                    while up.tag != tag:
                        up = up.parent
                    here = close(here, up.parent)
                    inline.clear()
                    inline_open.clear()
            elif inline_open[tag]:
                while True:
                    last = inline.pop()
                    inline_open[last] -= 1
                    if last == tag:
                        break
            here.n_tags += 1
            continue
        here.n_tags += 1
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            go_on = at = stop.end()
            here.controls += tag in ("select", "textarea", "button")
            continue
        if tag == "br":
            _text(here, " ", False)
        if tag == "input":
            here.controls += 1
        if tag not in BLOCK:
            if tag not in VOID and not m[3].endswith("/"):
                inline.append(tag)
                inline_open[tag] += 1
            continue
        if tag in ("html", "head"):
            continue
        # an open paragraph ends where a block begins
        up = here
        while up.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and up.parent and (up.tag == "p" or tag[0] == "h" and tag[1:].isdigit()):
            up = up.parent
        here = close(here, up)
        if tag in ENDS:
            names, bounds = ENDS[tag]
            target, left = here, sum(blocks_open[n] for n in names.split())
            while left and up and up.tag not in bounds.split():
                if up.tag in names.split():
                    target, left = up.parent, left - 1
                up = up.parent
            here = close(here, target)
        inline.clear()
        inline_open.clear()
        if tag == "hr":
            here.items.append(None)
            continue
        node = Node(tag, here, m[3])
        blocks_open[tag] += 1
        here.items.append(node)
        nodes.append(node)
        here = node
    if at < len(page):
        _text(here, page[at:], False)
    return nodes


def _text(node: Node, piece: str, in_anchor: bool) -> None:
    node.items.append(piece)
    n = len(piece) if not piece.isspace() else 0
    node.text += n
    node.stops += piece.count(". ") + piece.count(", ") + (piece[-1:] == ".")
    if in_anchor:
        node.anchor += n


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: tag group, attribute tokens of its own and above, depth, siblings, densities of its subtree, its parent's group, and whether all above speaks for it."""
    for n in reversed(nodes):
        if n.tag == "p" and n.text:
            n.paragraphs += 1
        if n.parent:
            p = n.parent
            p.text += n.text
            p.anchor += n.anchor
            p.n_tags += n.n_tags
            p.paragraphs += n.paragraphs
            p.controls += n.controls
            p.stops += n.stops
    out = np.zeros((len(nodes), FEATURES))
    total = nodes[0].text or 1
    above: dict[int, tuple] = {}
    for row, n in zip(out, nodes):
        p = n.parent
        good, bad, bad_tag, art = above[id(p)] if p else (0, 0, 0, 0)
        group = GROUPS.get(n.tag, N_GROUPS - 1)
        bad_tag = bad_tag or 5 <= group <= 9
        art = art or group == 0
        above[id(n)] = (good + n.good, bad + n.bad, bad_tag, art)
        row[group] = 1
        siblings = len(p.children) if p else 1
        row[N_GROUPS:] = (
            n.good, n.bad, good, bad, bad_tag, art, bool(bad_tag or bad or n.bad), n.depth, n.place / siblings, siblings,
            log1p(n.text), n.text / (1 + n.n_tags), n.anchor / (1 + n.text), n.text / total, n.text / (1 + (p.text if p else n.text)),
            n.paragraphs, n.controls, n.stops / (1 + n.text), GROUPS.get(p.tag, N_GROUPS - 1) if p else -1, bool(p and (good or art) and not (bad or n.bad or bad_tag)),
        )
    return out


def blocks(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Texts of the kept nodes: a block is the inline text between two block boundaries."""
    out: list[str] = []
    kept = {id(n) for n, k in zip(nodes, keep) if k}
    piece: list[str] = []

    def flush() -> None:
        if piece:
            text = SPACE.sub(" ", html.unescape("".join(piece))).strip("\x20\t\n\x0b\x0c\r")
            if text:
                out.append(text)
            piece.clear()

    stack = [iter(nodes[0].items)] if id(nodes[0]) in kept else []
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                piece.append(item)
                continue
            flush()
            if item is not None and id(item) in kept:
                stack.append(iter(item.items))
                break
        else:
            flush()
            stack.pop()
    return out
