"""Main-text extraction by gradient-boosted trees over DOM-node features.

A page becomes a tree of block elements (inline elements belong to the block around them). Each block has features: its tag,
the words of its class, id and role by kind of box, those of the blocks around it, depth, place and number among its
siblings, and of its subtree the text per tag, link share and sentence marks. Spark's gradient-boosted trees, trained on
``TRAIN_PAGES`` pages made by rule (no page of the table is used), give each block the log-odds of being content. Hierarchical decoding then chooses
the likeliest consistent labels of the whole tree: on every way down from the root blocks are first outside, then content,
then excluded, and never the other way round, so no excluded block has content below it.

Text of content blocks: character references are decoded, white space within a block becomes one space, blocks are trimmed
and joined in page order by one space. Scripts, styles and markup never count; buttons, selections and text fields are blocks, as
other parts of forms. Elements that are neither are inline, unknown ones too. Attributes are read whole. Parsing takes time in proportion to the page, however deep or broken it is.
Null or empty html gives an empty text. Repeated rows each give their own row; other columns are dropped.

``svg``, ``object``, ``canvas``, ``iframe``, ``template`` and ``noscript`` give no text, as far as they are closed; ``math`` gives its text without annotations. An ``svg`` also ends where an HTML block starts.
A head ends with ``</head>``, or where a tag or a text comes that can't stand in it. Comment marks count only where comments can stand: not in attributes, scripts, styles,
titles and text fields. As in HTML, a comment or script that never ends, or a last tag without its ``>``, takes all that follows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache, lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession

from .common import map_text
from .html_train import NAMES, pages

TRAIN_PAGES = 2000
TREES = 40
#: Nodes that a task holds at once, besides a page.
NODES = 10_000
DEPTH = 5
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template noscript head title iframe svg object canvas annotation annotation-xml".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: All tags that are blocks; any other is inline.
_BLOCK = _ENDS_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup option optgroup select button textarea datalist legend summary figcaption search frameset noframes dir listing xmp plaintext".split())
#: Tags that may stand in a head.
_IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
#: Foreign elements: there any tag may end itself.
_FOREIGN = ("svg", "math")
_BARRIERS = ("article", "main", "table", "body")
#: Tags whose start ends an open element of the same set, up to the nearest element of the second set.
_SIBLINGS = {"option": (("option",), ("select",)), "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_HOLDS = frozenset("html body article aside div footer header main nav section td th table ul ol dl form blockquote".split())
_TAGS = "body article main section div p h1 h2 h3 ul ol li table tr td blockquote pre header footer nav aside form figure dl button select textarea".split()
_TAG = {t: i for i, t in enumerate(_TAGS)}
_KINDS = list(NAMES)
#: Words of attribute tokens by kind of box; the first kind that has a word counts.
_WORDS: dict[str, int] = {}
for _kind in ["comments", "form", "notice", "advert", "share", "sidebar", "menu", "footer", "header", "content"]:
    for _name in NAMES[_kind]:
        for _word in {_name, *(_name.split("-") if _kind != "content" else [])} - {"list", "box", "main", "site", "body", "user", "more", "top", "links", "content", "buttons", "slot", "page", "stories"}:
            _WORDS.setdefault(_word, _KINDS.index(_kind))
for _word in ("content", "main", "body"):
    _WORDS.setdefault(_word, _KINDS.index("content"))
_TOKEN = re.compile(r"[a-z]+(?:-[a-z]+)*")
_MARK = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "kinds", "text", "link", "children", "depth", "y", "inputs", "number")

    def __init__(self, tag: str, parent: Node | None, kinds: int, y: int, number: int = 0):
        self.tag, self.parent, self.kinds, self.y, self.number = tag, parent, kinds, y, number
        self.text: list[str] = []
        self.link = self.inputs = 0
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0


_OPENS = re.compile("<[A-Za-z/!?]")
_COMMENT_ENDS = re.compile("-?>")
_COMMENT_END = re.compile("--!?>")


@cache
def _end_tag(tag: str) -> re.Pattern:
    """For the few tags that are silent or hold text only."""
    return re.compile(rf"</{re.escape(tag)}(?=[\t\n\r\f />])", re.IGNORECASE)


@lru_cache(100_000)
def token_kinds(value: str) -> int:
    """The kinds of box that an attribute's words name, as bits."""
    found = 0
    for token in _TOKEN.findall(value.lower()):
        for word in (token, *(token.split("-") if "-" in token else ())):
            if (k := _WORDS.get(word)) is not None:
                found |= 1 << k
    return found


class Tree(HTMLParser):
    """Block elements in page order, and the runs of text between block boundaries, each with its block."""

    #: Elements whose content is text up to their end tag.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")

    def __init__(self, page: str = ""):
        super().__init__(convert_charrefs=True)
        root = Node("html", None, 0, 0)
        self.nodes, self.stack, self.silent, self.links = [root], [("html", root)], [], 0
        self.places: dict[str, list[int]] = defaultdict(list)  # by tag the places of its open elements
        self.holding: list[int] = []  # the places of open elements that hold others
        self.runs: list[tuple[Node, str]] = []
        self.pending: list[str] = []
        self.silent_at: dict[str, list[int]] = defaultdict(list)  # by tag the places of its silent elements
        self.page, self.at = page, 0
        self.ends: dict[str, int] = {}  # by tag the place of its next end tag

    def hush(self, tag: str) -> None:
        self.silent_at[tag].append(len(self.silent))
        self.silent.append(tag)

    def end_hush(self, at: int = 0) -> None:
        while len(self.silent) > at:
            self.silent_at[self.silent.pop()].pop()

    def closes(self, tag: str) -> bool:
        """Whether an end tag follows. Each part of the page is searched once a tag."""
        if self.ends.get(tag, -1) < self.at:
            m = _end_tag(tag).search(self.page, self.at)
            self.ends[tag] = m.start() if m else len(self.page)
        return self.ends[tag] < len(self.page)

    def parse_starttag(self, i):
        self.at = len(self.page) - len(self.rawdata) + i
        return super().parse_starttag(i)

    def parse_comment(self, i, report=1):
        if m := _COMMENT_ENDS.match(self.rawdata, i + 4) or _COMMENT_END.search(self.rawdata, i + 4):
            return m.end()
        return len(self.rawdata)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        if self.cdata_elem is None:
            return super().parse_endtag(i)
        tag, end = self.cdata_elem, self.rawdata.find(">", i)
        self.clear_cdata_mode()
        self.handle_endtag(tag)
        return end + 1 if end >= 0 else len(self.rawdata)

    def set_cdata_mode(self, elem, **_):
        """A script or style without an end takes the rest; others are then read as if they held markup."""
        if elem in ("script", "style") or self.closes(elem):
            self.cdata_elem, self.interesting = elem, _end_tag(elem)

    def break_run(self) -> None:
        if self.pending:
            text = " ".join("".join(self.pending).split())
            if text:
                node = self.stack[-1][1]
                self.runs.append((node, text))
                node.text.append(text)
            self.pending = []

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if self.silent[-1] in ("head", "title") and tag not in _IN_HEAD or self.silent[-1] == "svg" and tag in _BLOCK:
                self.end_hush()
            else:
                if tag in _SILENT:
                    self.hush(tag)
                return
        if tag in _SILENT:
            if tag in ("head", "title", "script", "style") or self.closes(tag):
                self.hush(tag)
            return
        if tag == "br":
            self.pending.append(" ")
            return
        if tag not in _BLOCK:
            if tag == "a":
                self.links += 1
            if tag == "input":
                self.stack[-1][1].inputs += 1
            if tag not in _VOID:
                self.push(tag, self.stack[-1][1])
            return
        self.break_run()
        if tag == "html" or tag == "body" and self.places["body"]:
            return
        if tag in _ENDS_P:
            self.close(("p",), _HOLDS)
        if tag in _SIBLINGS:
            self.close(*_SIBLINGS[tag])
        if tag in _VOID:
            return
        kinds, y = 0, 0
        for name, value in attrs:
            if value and name in ("class", "id", "role", "aria-label", "itemprop"):
                kinds |= token_kinds(value)
            elif name == "data-y":
                y = int(value == "1")
        while self.stack[-1][0] not in _BLOCK:  # a block ends the inline elements around it
            self.pop()
        parent = self.stack[-1][1]
        parent.inputs += tag in ("button", "select", "textarea")
        node = Node(tag, parent, kinds, y, len(self.nodes))
        parent.children.append(node)
        self.nodes.append(node)
        self.push(tag, node)

    def handle_startendtag(self, tag, attrs):
        if tag in _FOREIGN or self.silent and self.silent[-1] in _FOREIGN:
            return
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS and self.closes(tag):
            self.set_cdata_mode(tag)
        elif tag not in _VOID:
            self.handle_endtag(tag)

    def push(self, tag: str, node: Node) -> None:
        self.places[tag].append(len(self.stack))
        if tag in _HOLDS:
            self.holding.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> None:
        tag, _ = self.stack[-1]
        if tag in _BLOCK:
            self.break_run()
        elif tag == "a":
            self.links -= 1
        self.stack.pop()
        self.places[tag].pop()
        if tag in _HOLDS:
            self.holding.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max([p[-1] for t in tags if (p := self.places.get(t))], default=0)

    def close(self, tags, until) -> None:
        """End the open elements of ``tags`` (a paragraph: the innermost) within the nearest of ``until``."""
        while (at := self.last(tags)) > (self.holding[-1] if self.holding and until is _HOLDS else 0 if until is _HOLDS else self.last(until)):
            while len(self.stack) > at:
                self.pop()
            if tags == ("p",):
                return

    def handle_endtag(self, tag):
        if self.silent:
            if at := self.silent_at.get(tag):
                self.end_hush(at[-1])
            return
        if tag in ("html", "body") or tag == "br":
            return
        at = self.last((tag,))
        if not at or (tag not in _BLOCK or tag == "p") and self.holding and self.holding[-1] > at or tag not in _HOLDS and self.last(_BARRIERS) > at:
            return
        while len(self.stack) > at:
            self.pop()

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.end_hush()
        if self.silent:
            return
        if self.cdata_elem:
            data = unescape(data)
        self.pending.append(data)
        if self.links:
            self.stack[-1][1].link += len(data)

    def finish(self) -> Tree:
        self.close_input()
        self.break_run()
        return self

    def close_input(self) -> None:
        HTMLParser.close(self)


def parse(html: str | None) -> Tree:
    if not html:
        return Tree().finish()
    m = _OPENS.search(html, html.rfind(">") + 1)  # the last tag, if it never ends
    tree = Tree(page := html[: m.start()] if m else html)
    tree.feed(page)
    return tree.finish()


def _bits(values: list[int], n: int) -> np.ndarray:
    return (np.array(values, np.int64)[:, None] >> np.arange(n)) & 1


def features(tree: Tree) -> np.ndarray:
    nodes = tree.nodes
    n = len(nodes)
    parent = [node.parent.number if node.parent else 0 for node in nodes]
    kinds = [node.kinds for node in nodes]
    tags = [1 << t if (t := _TAG.get(node.tag)) is not None else 0 for node in nodes]
    around, sections, below = [0] * n, [0] * n, [0] * n
    for i in range(1, n):  # parents come before their children
        p = parent[i]
        around[i] = around[p] | kinds[p]
        sections[i] = sections[p] | tags[p]
    own = [sum(map(len, node.text)) for node in nodes]
    link = [min(node.link, o) for node, o in zip(nodes, own)]
    marks = [sum(len(_MARK.findall(t)) for t in node.text) for node in nodes]
    sums = [[1] * n, own[:], link[:], marks, [int(node.tag == "p") for node in nodes], [node.inputs for node in nodes]]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in sums:
            a[p] += a[i]
        below[p] |= below[i] | kinds[i]
    place, same = [0.0] * n, [1] * n
    for node in nodes:
        if node.children:
            by_tag: dict[str, int] = {}
            for c in node.children:
                by_tag[c.tag] = by_tag.get(c.tag, 0) + 1
            last = max(1, len(node.children) - 1)
            for j, c in enumerate(node.children):
                place[c.number], same[c.number] = j / last, by_tag[c.tag]
    count, deep, under_link, under_marks, paragraphs, inputs = (np.array(a, float) for a in sums)
    mine, whole = np.array(own, float), max(1.0, deep[0])
    numbers = np.stack(
        [
            [node.depth for node in nodes], [len(node.children) for node in nodes], place, same, np.log1p(mine), np.log1p(deep), deep / count, mine / whole, deep / whole,
            np.array(link) / np.maximum(mine, 1), under_link / np.maximum(deep, 1), under_marks / np.maximum(deep, 1), paragraphs / count, np.minimum(inputs, 5),
        ],
        axis=1,
    )
    k = len(_KINDS)
    return np.concatenate([_bits(tags, len(_TAGS)), _bits(sections, len(_TAGS)), _bits(kinds, k), _bits(around, k), _bits(below, k), numbers], axis=1).astype(float)


class Forest:
    """Trees as arrays; gives twice the margin, the log-odds."""

    def __init__(self, trees: list[tuple[float, list[list[float]]]]):
        self.trees = [(w, *(np.array(c) for c in zip(*t))) for w, t in trees]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at].astype(int)
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= limit[at], left[at], right[at]).astype(int))
            total += weight * value[at]
        return 2 * total


def _read_tree(lines: list[str]) -> list[list[float]]:
    """Nodes (feature or -1, limit, left, right, value) from the lines of a tree's debug string."""
    nodes: list[list[float]] = []
    it = iter(lines)

    def build() -> int:
        line, me = next(it).strip(), len(nodes)
        nodes.append([-1, 0, 0, 0, 0])
        if m := re.match(r"If \(feature (\d+) <= ([^)]+)\)", line):
            nodes[me][:2] = [int(m[1]), float(m[2])]
            nodes[me][2] = build()
            next(it)  # Else
            nodes[me][3] = build()
        else:
            nodes[me][4] = float(line.split(":")[1])
        return me

    build()
    return nodes


@cache
def _trained(app: str, n: int, seed: int) -> Forest:
    spark, trees = SparkSession.getActiveSession(), [parse(html) for html in pages(n, seed)]
    x = np.concatenate([features(t) for t in trees])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    rows = spark.createDataFrame(pa.table({"label": pa.array([float(node.y) for t in trees for node in t.nodes]), "x": flat}))
    data = rows.select("label", array_to_vector("x").alias("features")).repartition(4)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed).fit(data)
    return Forest([(float(w), _read_tree(t.toDebugString.splitlines()[1:])) for w, t in zip(model.treeWeights, model.trees)])


def train(spark: SparkSession, n: int = TRAIN_PAGES, seed: int = 7) -> Forest:
    """The trees, from n pages made by rule; trained once for an application."""
    return _trained(spark.sparkContext.applicationId, n, seed)


def decode(tree: Tree, odds: np.ndarray) -> list[bool]:
    """Of each node whether it is content, in the likeliest labelling that is outside, content, excluded on each way down."""
    nodes = tree.nodes
    weight = 0.2 + np.log1p([sum(map(len, n.text)) for n in nodes])
    gain = (np.clip(odds, -6, 6) * weight).tolist()
    best = [[-g, g, -g] for g in gain]  # by state: outside, content, excluded
    for i in range(len(nodes) - 1, 0, -1):
        b, up = best[i], best[nodes[i].parent.number]
        up[0] += max(b[0], b[1])
        up[1] += max(b[1], b[2])
        up[2] += b[2]
    state = [int(best[0][1] > best[0][0])] + [0] * (len(nodes) - 1)
    for i in range(1, len(nodes)):
        p = state[nodes[i].parent.number]
        state[i] = p if p == 2 else p + (best[i][p + 1] > best[i][p])
    return [s == 1 for s in state]


def text_of(tree: Tree, content: list[bool]) -> str:
    return " ".join([text for node, text in tree.runs if content[node.number]])


def extract_one(html: str | None, forest: Forest) -> str:
    if not html:
        return ""
    tree = parse(html)
    return text_of(tree, decode(tree, forest(features(tree))))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", forest: Forest | None = None) -> DataFrame:
    """``key``, ``url``, text, n_chars."""
    sent = df.sparkSession.sparkContext.broadcast(forest or train(df.sparkSession))  # TREES trees of at most 2 ** (DEPTH + 1) nodes

    def rows(part):
        texts, held = [], []

        def settle():
            odds, at = sent.value(np.concatenate([f for _, f in held])), 0
            for tree, f in held:
                texts.append(text_of(tree, decode(tree, odds[at : at + len(f)])))
                at += len(f)
            held.clear()

        for h in part[html]:
            tree = parse(h)
            held.append((tree, features(tree)))
            if sum(len(f) for _, f in held) >= NODES:
                settle()
        if held:
            settle()
        return {key: part[key], url: part[url], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_text(df, [key, url, html], f"{key} long, {url} string, text string, n_chars long", rows, html)
