"""HTML main text by a tree-structured graphical model.

Each page is a tree of elements with their text. Every element carries a hidden state, content or not; a node potential
scores features of the element, a potential on each parent-child edge how states pass down the tree. Sum-product
messages upward and downward give each element's exact marginal of being content, and text is kept where it is likelier
than not. The weights are trained on labelled pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import small_batches

# What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math select option canvas audio video noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements that an opening tag of a kind closes, up to the elements that hold them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_GOOD_WORDS = re.compile(r"article|post|story|entry|content|body|main|text|prose|blog|news", re.IGNORECASE)
_BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumb\w*|header|masthead|foot\w*|side\w*|widget\w*|related|recommend\w*|"
    r"comment\w*|disqus|repl(?:y|ies)|respond|discussion|share|sharing|social|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|"
    r"form|tag|tags|meta|byline|pagination|pager|toolbar|legal|copyright|skip)(?=$|[\s_-]|\d)",
    re.IGNORECASE,
)
_BAD_TAGS = frozenset("nav aside footer header form dialog menu fieldset button label search head title".split())
_GOOD_TAGS = frozenset("article main".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figcaption".split())
FEATURES = ("one", "bad_tag", "bad_name", "good_tag", "good_name", "text_tag", "hidden", "log_text", "link_share", "sentence_marks", "list_of_links", "root", "own_text", "root_text", "under_bad")


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    hidden: bool = False
    #: texts and child numbers in page order
    parts: list[str | int] = field(default_factory=list)


class _Tree(HTMLParser):
    """The elements of a page, with missing end tags supplied; never fails on malformed input."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1)]
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES:
            closing, within = _CLOSES[tag]
            self._close(closing, within)
        if tag in _ENDS_P:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "body", "table", "button"})
        if tag in ("html", "body") and any(self.nodes[k].tag == tag for k in self.open):
            return
        if tag == "body":
            self._close({"head"}, set())
        at, hidden, names = len(self.nodes), False, ""
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop"):
                names += f" {v or ''}"
            elif k == "hidden" or k == "aria-hidden" and v == "true":
                hidden = True
            elif k == "style":
                style = (v or "").replace(" ", "").lower()
                hidden = hidden or "display:none" in style or "visibility:hidden" in style
        self.nodes.append(Node(tag, self.open[-1], names, hidden))
        self.nodes[self.open[-1]].parts.append(at)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Close open elements down to the lowest one of ``tags``, unless one of ``within`` holds it."""
        lowest = None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in tags:
                lowest = depth
            elif tag in within:
                break
        if lowest is not None:
            del self.open[lowest:]

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            mine = self.nodes[self.open[depth]].tag
            if mine == tag:
                if tag not in ("body", "html"):
                    del self.open[depth:]
                return
            # an inline end tag does not close the blocks around it
            if mine in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.nodes[self.open[-1]].parts.append(data)


def parse(html: str) -> list[Node]:
    """The nodes of a page, parents before children. A tag that the page breaks off in is dropped."""
    tree = _Tree()
    tree.feed(html)
    rest = tree.rawdata
    if rest and not rest.startswith("<"):
        tree.handle_data(unescape(rest))
    elif rest and tree.cdata_elem:
        tree.handle_data(rest)
    return tree.nodes


def node_features(nodes: list[Node]) -> np.ndarray:
    """nodes x features; sizes of text are those of the whole subtree."""
    n = len(nodes)
    text, linked, marks, own = ([0.0] * n for _ in range(4))
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        if node.tag in RAW:
            continue
        for p in node.parts:
            if isinstance(p, str):
                own[k] += len(p.strip())
                marks[k] += p.count(".") + p.count("!") + p.count("?")
        text[k] += own[k]
        if node.tag in ("a", "button", "label"):
            linked[k] = text[k]
        if k:
            text[node.parent] += text[k]
            linked[node.parent] += linked[k]
            marks[node.parent] += marks[k]
    out: list[tuple[float, ...]] = []
    under, good = [False] * n, [False] * n
    for k, node in enumerate(nodes):
        share = linked[k] / text[k] if text[k] else 0.0
        own_bad = bool(node.names) and bool(_BAD_WORDS.search(node.names))
        if k:
            above = out[node.parent]
            good[k] = good[node.parent] or bool(above[3] or above[4])
            under[k] = under[node.parent] or bool(above[1] or above[2] or above[6])
        bad_tag = node.tag in _BAD_TAGS and not (node.tag == "header" and good[k])  # an article's own header
        good_name = bool(node.names) and not own_bad and bool(_GOOD_WORDS.search(node.names))
        out.append(
            (
                1.0, bad_tag, own_bad, node.tag in _GOOD_TAGS, good_name, node.tag in _TEXT_TAGS, node.hidden or node.tag in RAW,
                min(log1p(text[k]), 8.0) / 8, share, min(marks[k] / max(text[k] / 100, 1), 3.0) / 3, node.tag in ("ul", "ol") and share > 0.6, k == 0,
                min(log1p(own[k]), 8.0) / 8, k == 0 and own[k] > 0, under[k],
            )
        )
    return np.array(out, float)


@dataclass(frozen=True)
class TreeModel:
    """Weights of features for the content state, and the log potential of (parent state, child state)."""

    weight: np.ndarray
    edge: np.ndarray

    def marginals(self, nodes: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of content per node, of both states per edge (by child), and the log partition function."""
        n = len(nodes)
        parent = [node.parent for node in nodes]
        (e00, e01), (e10, e11) = self.edge.tolist()
        # upward: a node's potential and the messages of its children, for either state
        up0, up1 = [0.0] * n, (x @ self.weight).tolist()
        to0, to1 = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            to0[k], to1[k] = _log_add(e00 + up0[k], e01 + up1[k]), _log_add(e10 + up0[k], e11 + up1[k])
            up0[parent[k]] += to0[k]
            up1[parent[k]] += to1[k]
        z = _log_add(up0[0], up1[0])
        # downward: what the rest of the tree says to each node
        own0, own1, rest0, rest1 = up0[:], up1[:], [0.0] * n, [0.0] * n
        for k in range(1, n):
            rest0[k], rest1[k] = own0[parent[k]] - to0[k], own1[parent[k]] - to1[k]
            own0[k] = up0[k] + _log_add(rest0[k] + e00, rest1[k] + e10)
            own1[k] = up1[k] + _log_add(rest0[k] + e01, rest1[k] + e11)
        rest, up = np.array([rest0, rest1]).T, np.array([up0, up1]).T
        pair = np.exp(rest[:, :, None] + self.edge + up[:, None, :] - z)
        pair[0] = 0.0
        return np.exp(np.array(own1) - z), pair, z


def _log_add(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def blocks(nodes: list[Node], content: np.ndarray) -> list[str]:
    """The texts of content nodes by block in page order, white space inside a block as one space."""
    out, buffer = [], []

    def end() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            out.append(text)
        buffer.clear()

    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        k, at = todo.pop()
        node = nodes[k]
        if at == 0 and node.tag in BLOCK:
            end()
        if at == 0 and node.tag == "br":
            buffer.append(" ")
        while at < len(node.parts):
            p = node.parts[at]
            at += 1
            if isinstance(p, str):
                if content[k]:
                    buffer.append(p)
            else:
                todo += [(k, at), (p, 0)]
                break
        else:
            if node.tag in BLOCK:
                end()
    end()
    return out


def main_text(html: str, model: TreeModel) -> str:
    """The main text of a page; blocks joined by an empty line, nothing if no element is content."""
    if not html:
        return ""
    nodes = parse(html)
    p, _, _ = model.marginals(nodes, node_features(nodes))
    return "\n\n".join(blocks(nodes, p > 0.5))


def labelled_pages(n: int, seed: int = 11) -> list[tuple[list[Node], np.ndarray]]:
    """``n`` made-up pages of varied layout with the content state of every element."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(4, 16).capitalize() + pick(".....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    links = lambda k: "<ul>" + "".join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(k)) + "</ul>"
    mark = "data-c"

    def c(tag: str, inner: str, attrs: str = "") -> str:
        return f"<{tag} itemprop='{mark}' {attrs}>{inner}</{tag}>"

    def para() -> str:
        kind = rng.random()
        if kind < 0.65:
            return c("p", prose(1, 6) if rng.random() < 0.8 else words(1, 4))
        if kind < 0.75:
            return c("p", f"{prose(1, 3)} {c('a', words(1, 3), 'href=/x')} {prose(1, 2)} {c('b', word())}")
        if kind < 0.82:
            return c("h2", words(1, 6))
        if kind < 0.9:
            return c("ul", "".join(c("li", prose(1, 2)) for _ in range(int(rng.integers(1, 5)))))
        if kind < 0.95:
            return c("blockquote", c("p", prose(1, 3)))
        return c("table", c("tr", c("td", words(1, 4)) + c("td", words(1, 4))))

    out = []
    for _ in range(n):
        body = "".join(para() for _ in range(int(rng.integers(1, 9))))
        title = c("h1", words(2, 8))
        if rng.random() < 0.3:
            title = c("header", title)
        inside = [body]
        noise = [
            f"<div class='{pick(['share-buttons', 'social', 'ad', 'related-posts', 'newsletter-signup'])}'>{pick([links(3), f'<p>{prose(1, 2)}</p>', words(2, 6)])}</div>",
            f"<aside>{pick([links(4), f'<p>{prose(1, 3)}</p>'])}</aside>", f"<form><label>{words(1, 3)}</label><button>{word()}</button></form>",
        ]
        if rng.random() < 0.4:
            inside.insert(int(rng.integers(0, 2)), pick(noise))
        core = c("article", title + "".join(inside)) if rng.random() < 0.6 else c("div", title + "".join(inside), pick(["class=post-content", "id=content", "class='entry'", "class=story-body"]))
        if rng.random() < 0.3:
            core = c("main", core)
        before = [f"<nav>{links(5)}</nav>", f"<header><div>{words(1, 4)}</div>{links(3)}</header>", f"<div class='{pick(['menu', 'navbar', 'top-nav'])}'>{links(6)}</div>", f"<div class='{pick(['ad', 'banner', 'advert', 'sponsored'])}'>{prose(1, 3)}</div>", f"<div class='{pick(['cookie-notice', 'alert', 'consent'])}'><p>{prose(1, 2)}</p><button>{word()}</button></div>"]
        after = [f"<aside>{links(5)}<p>{prose(1, 2)}</p></aside>", f"<div class='{pick(['sidebar', 'widget-area', 'related'])}'>{links(4)}<p>{prose(1, 2)}</p></div>", f"<section class='{pick(['comments', 'comment-list', 'replies'])}'><h3>{words(1, 3)}</h3><div class=comment><p>{prose(1, 4)}</p></div><div class=comment><p>{prose(1, 4)}</p></div></section>", f"<footer><p>{words(2, 9)}</p>{links(3)}</footer>", f"<form class=search><input><label>{words(1, 3)}</label></form>", f"<div class='ad'>{prose(1, 3)}</div>"]
        page = "".join(x for x in before if rng.random() < 0.5) + core + "".join(x for x in after if rng.random() < 0.5)
        if rng.random() < 0.05:  # a bare fragment
            nodes = parse(pick([prose(1, 4), f"{words(3, 9)}<br>{prose(1, 2)}"]))
            out.append((nodes, np.ones(len(nodes), int)))
            continue
        nodes = parse(page) if rng.random() < 0.1 else parse(f"<html><head><title>{words(2, 6)}</title><style>p</style><script>x=1;</script></head><body>{page}</body></html>")
        y = np.array([mark in node.names for node in nodes], int)
        for node in nodes:
            node.names = node.names.replace(mark, "").strip()
        out.append((nodes, y))
    return out


def train(n: int = 120, rounds: int = 60, penalty: float = 0.0005) -> TreeModel:
    """Fit by gradient ascent on the likelihood of ``n`` labelled made-up pages; needs no input table."""
    pages = [(nodes, y, node_features(nodes)) for nodes, y in labelled_pages(n)]
    theta = np.zeros(len(FEATURES) + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = TreeModel(theta[:-4], theta[-4:].reshape(2, 2))
        grow = -penalty * n * theta
        for nodes, y, x in pages:
            p, pair, _ = model.marginals(nodes, x)
            parent = np.array([node.parent for node in nodes[1:]], int)
            grow[:-4] += x.T @ (y - p)
            grow[-4:] += np.bincount(2 * y[parent] + y[1:], minlength=4) - pair[1:].sum(axis=0).ravel()
        # Adam: steps scaled by running moments of the gradient
        mean, square = 0.9 * mean + 0.1 * grow, 0.98 * square + 0.02 * grow * grow
        theta = theta + 0.5 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.98**t)) + 1e-9)
    return TreeModel(theta[:-4], theta[-4:].reshape(2, 2))


def extract(df: DataFrame, html: str = "html", model: TreeModel | None = None, out: str = "text") -> DataFrame:
    """``df`` with the main text of each whole page; null and empty pages give an empty text. ``out`` must be free.

    Character references are decoded; text of one block has single spaces, blocks are joined by an empty line. Rows are
    independent of each other, so copies and skew do not matter.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model or train())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(b.schema.names.index(html))
            texts = [main_text(p.as_py() or "", sent.value).encode("utf-8", "replace").decode() for p in pages]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
