"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and its runs of inline text; each is content or
not. A node's own features give its potential, and one table of parent-child potentials
connects the tree. Sum-product messages upward and downward give exact marginals; runs
of text that are likelier content than not are the page's main text.

Potentials are trained by pseudo-likelihood (a logistic regression on features and the
labels of parent and children) from the labelled pages of ``html_pages``.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.html_pages import labelled_pages

BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary hr dialog menu center button select option".split()
)
#: Elements whose content is raw text and never page text.
SKIPPED = frozenset("script style template textarea iframe title".split())
_ANY_TAG = re.compile(r"<(?=/?[a-zA-Z])")
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: A start tag ends an open element of its set, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "ul", "table", "blockquote", "pre", "figure", "button", "heading", "body", "text"]
_SAME = {"ol": "ul", "menu": "ul", "dl": "ul", "dt": "li", "dd": "li", "td": "table", "th": "table", "tr": "table", "tbody": "table", "thead": "table", "figcaption": "figure", "select": "form", "option": "form", "fieldset": "form", "legend": "form", "dialog": "aside", "html": "body", "center": "div", **{f"h{i}": "heading" for i in range(1, 7)}}
_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar skip tabs toc",
    "frame": "header masthead banner top footer bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended more popular trending archive",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert dialog newsletter subscribe signup paywall",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp",
    "social": "share sharing social follow tweet like author byline meta tags tag date",
    "comment": "comment comments reply replies discussion disqus thread responses respond",
    "form": "form search login register contact",
    "content": "article content post entry story body text main maincontent articlebody document page",
}
_GROUPS = {k: frozenset(v.split()) for k, v in _WORDS.items()}
_INSIDE = ["nav", "header", "footer", "aside", "form", "article", "main", "menu", "frame", "side", "notice", "advert", "comment", "social", "content"]
THRESHOLD = 0.5


class Node:
    __slots__ = ("tag", "names", "parent", "label", "text", "linked", "length")

    def __init__(self, tag: str, names: frozenset, parent: int, label: int | None) -> None:
        self.tag, self.names, self.parent, self.label, self.text, self.linked, self.length = tag, names, parent, label, "", 0, 0


@lru_cache(4096)
def _names(attributes: str) -> tuple[frozenset, int | None]:
    """Words of class, id, role and aria-label; and the label that training pages carry."""
    words, label = [], None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            words += re.split(r"[^a-z]+", value.lower())
        elif name == "data-main":
            label = int(value)
        elif name in ("hidden", "aria-hidden") and value != "false":
            words.append("notice")
    return frozenset(g for g, names in _GROUPS.items() if names & set(words)), label


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


def parse(page: str) -> list[Node]:
    """Block elements and runs of inline text in page order; the first node is the root."""
    nodes = [Node("body", frozenset(), -1, None)]
    open_: list[tuple[str, int]] = [("#root", 0)]  # tag, node (inline elements have their block's)
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    unclosed: set[str] = set()
    count: dict[str, int] = {}  # open elements of each tag
    block_at = [0]  # places in open_ of the root and of open block elements

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            owner = open_[-1][1]
            node = Node("text", frozenset(), owner, nodes[owner].label)
            node.text, node.length, node.linked = text, len(text), min(linked, len(text))
            nodes.append(node)
        linked = 0

    def close(i: int) -> None:
        nonlocal in_link
        if block_at[-1] >= i:
            flush()
        for t, _ in open_[i:]:
            count[t] -= 1
            in_link -= t == "a"
        del open_[i:]
        while block_at[-1] >= i:
            block_at.pop()

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            linked += len(piece) * (in_link > 0)
        if not m:
            break
        at = m.end()
        tag, shut, attributes = (m[2] or m[5] or "").lower(), m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if shut:
            if count.get(tag):
                close(next(i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                if tag not in unclosed and (stop := _end_of(tag).search(page, at)):
                    at = stop.end()
                else:  # never closed: it ends where the next tag is
                    unclosed.add(tag)
                    stop = _ANY_TAG.search(page, at)
                    at = stop.start() if stop else end
            continue
        if tag in IMPLIED:
            ends, fence = IMPLIED[tag]
            for i in range(len(open_) - 1, 0, -1) if any(count.get(t) for t in ends) else ():
                if open_[i][0] in fence:
                    break
                if open_[i][0] in ends:
                    close(i)
                    break
        if tag in BLOCKS:
            if open_[block_at[-1]][0] == "p":
                close(block_at[-1])
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCKS:
            names, label = _names(attributes)
            owner = open_[-1][1]
            nodes.append(Node(tag, names, owner, nodes[owner].label if label is None else label))
            block_at.append(len(open_))
            open_.append((tag, len(nodes) - 1))
        else:
            in_link += tag == "a"
            open_.append((tag, open_[-1][1]))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its tag, its names, what it lies in, and its text."""
    n = len(nodes)
    length, linked, runs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        length[i] += node.length
        linked[i] += node.linked
        runs[i] += node.tag == "text"
        if node.parent >= 0:
            length[node.parent] += length[i]
            linked[node.parent] += linked[i]
            runs[node.parent] += runs[i]
    inside: list[frozenset] = []
    names, groups = len(_TAGS), list(_GROUPS)
    x = np.zeros((n, 1 + names + len(groups) + len(_INSIDE) + 10))
    x[:, 0] = 1
    tag_at, group_at, in_at = {t: 1 + i for i, t in enumerate(_TAGS)}, {g: 1 + names + i for i, g in enumerate(groups)}, {t: 1 + names + len(groups) + i for i, t in enumerate(_INSIDE)}
    base = 1 + names + len(groups) + len(_INSIDE)
    for i, node in enumerate(nodes):
        up = inside[node.parent] if node.parent >= 0 else frozenset()
        tag = _SAME.get(node.tag, node.tag)
        inside.append(up | {tag} | node.names if node.tag != "text" else up)
        if tag in tag_at:
            x[i, tag_at[tag]] = 1
        for g in node.names:
            x[i, group_at[g]] = 1
        for t in inside[i]:
            if t in in_at:
                x[i, in_at[t]] = 1
        text = node.text
        per = length[i] / max(1.0, runs[i])
        x[i, base : base + 10] = (
            min(1.0, np.log1p(per) / 6), linked[i] / max(1.0, length[i]), per < 25, per > 120, bool(text) and text[-1] in ".!?…", "©" in text or "(c)" in text.lower(),
            bool(text) and "heading" in (_SAME.get(nodes[node.parent].tag, ""),), text.count(",") > 1, node.tag == "h1" or (node.parent >= 0 and nodes[node.parent].tag == "h1"), length[i] == 0,
        )
    return x


def fit(pages: list[str], ridge: float = 0.5, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, and the 2 x 2 table of parent-child potentials."""
    rows, y = [], []
    for page in pages:
        nodes = parse(page)
        labels = np.array([node.label or 0 for node in nodes], float)
        main, all_ = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i in range(len(nodes) - 1, 0, -1):
            main[i] += nodes[i].length * labels[i]
            all_[i] += nodes[i].length
            main[nodes[i].parent] += main[i]
            all_[nodes[i].parent] += all_[i]
        # an element without a label of its own is content if most of its text is
        labels = np.array([label if node.tag == "text" or not total else float(2 * m > total) for node, label, m, total in zip(nodes, labels, main, all_)])
        up = np.array([labels[node.parent] if node.parent >= 0 else np.nan for node in nodes])
        ones, zeros = np.zeros(len(nodes)), np.zeros(len(nodes))
        for node, label in zip(nodes[1:], labels[1:]):
            ones[node.parent] += label
            zeros[node.parent] += 1 - label
        # table[parent, child] with table[0, 0] = 0: the log-odds are linear in the other three
        rows.append(np.hstack([features(nodes), np.stack([(up == 0) - ones, zeros - (up == 1), (up == 1) + ones], 1)]))
        y.append(labels)
    x, y = np.vstack(rows), np.concatenate(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w[:-3], np.array([[0.0, w[-3]], [w[-2], w[-1]]])


def _passed(odds: float, zero: float, one: float, zero_if_content: float, one_if_content: float) -> float:
    """Log-odds that a message carries: the sender's log-odds summed out against the potentials of the edge."""
    if odds > 40:
        return one_if_content - one
    if odds < -40:
        return zero_if_content - zero
    e = math.exp(odds)
    return math.log((math.exp(zero_if_content) + math.exp(one_if_content) * e) / (math.exp(zero) + math.exp(one) * e))


def marginals(nodes: list[Node], weights: np.ndarray, table: np.ndarray) -> list[float]:
    """Probability that each node is content: messages from the leaves to the root, then back."""
    belief = (features(nodes) @ weights).tolist()
    (t00, t01), (t10, t11) = table.tolist()
    sent = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        sent[i] = _passed(belief[i], t00, t01, t10, t11)
        belief[nodes[i].parent] += sent[i]
    for i in range(1, len(nodes)):
        belief[i] += _passed(belief[nodes[i].parent] - sent[i], t00, t10, t01, t11)
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_pages())


def main_text(page: str | None, weights: np.ndarray, table: np.ndarray) -> str:
    if not page:
        return ""
    nodes = parse(page)
    p = marginals(nodes, weights, table)
    return "\n".join(node.text for node, x in zip(nodes, p) if node.tag == "text" and x >= THRESHOLD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row: the main text of the whole html.

    Blocks are joined by one \\n in page order; a block's white space runs become one
    space. Null, empty and text-less pages give an empty text. Unclosed, crossed and cut
    tags are read as far as they make sense. Repeated rows are answered each and
    further columns are ignored.
    """
    weights, table = model()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page, weights, table) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
