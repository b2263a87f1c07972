"""Main text of web pages, by a tree-structured graphical model over the nodes of a page.

Every block element and every run of text in one is a node that is content or not. Node potentials come from tag,
class and id words, length, share of links and the like; parent-child potentials from how often a child of content is
content. Messages pass upward and downward once (sum-product), which gives exact marginals on a tree; runs of text
with a marginal above one half are the article, one line each.

Potentials are relative frequencies in labelled pages: a few that come with this module and name the usual parts of a
page, and a bounded sample of the pages at hand that mark their article themselves (``article`` or ``main``). Their
counts are all that reaches the workers. Pages are extracted row by row, without a shuffle.

Defined results: a NULL or empty page, or one without content, gives an empty text. Broken markup is read as browsers
do in the main: missing end tags are implied, unknown ones skipped. Hidden elements end with the block they are in at
the latest. Formulas and what stands in an ``object`` for want of it are text. ``br`` is white space in its block. Repeated rows
are extracted each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 256

# Least chance that a child element differs from a parent that is content (1) or not, as pages that mark their article are too regular.
LEAST_CHANGE = {0: 0.003, 1: 0.05}

# Fixed values of HTML: elements without an end tag, in running text, never shown, closed by the start of a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr object param embed source track math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror "
    "mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr "
    "mlabeledtr mtd maction semantics".split()
)
HIDDEN = set("script style noscript template title iframe svg textarea select datalist annotation annotation-xml".split())
# Blocks that cannot be in a drawing or formula, so that their start ends it, and elements in which they can.
OUTSIDE = set(
    "blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu nav ol p pre table ul article aside footer form header main section".split()
)
HOLDERS = {"foreignobject", "desc", "annotation-xml"}
LISTS = {"select", "datalist"}
RAW = re.compile(r"script|style|textarea|title|noscript|iframe|template", re.I)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element, or a run of text if ``tag`` is empty."""

    __slots__ = ("tag", "parent", "attributes", "text", "linked", "children", "label")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes, self.children = tag, parent, attributes, []
        self.text: list[str] = []
        self.linked = 0
        self.label = None


def parse(page: str) -> list[Node]:
    """The block elements and runs of text of a page, parents before their children."""
    root = Node("html", None)
    nodes, block, inline, run = [root], root, [], None
    end, links = 0, 0
    # Elements that are open from a hidden one on.
    hidden: list[str] = []

    def add(text: str) -> None:
        nonlocal run
        if not text:
            return
        if run is None:
            if text.isspace():
                return
            run = Node("", block)
            nodes.append(run)
        run.text.append(text)
        if links:
            run.linked += len(text)

    def close(tag: str, barriers: set[str]) -> None:
        """Closes the innermost element of that name, unless a barrier is in between."""
        nonlocal block, run
        at = block
        while at is not None and at.tag != tag:
            if at.tag in barriers:
                return
            at = at.parent
        if at is not None and at.parent is not None:
            block, run = at.parent, None
            inline.clear()

    def is_open(tag: str) -> bool:
        at = block
        while at is not None and at.tag != tag:
            at = at.parent
        return at is not None and at.parent is not None

    def ends_hidden(tag: str) -> bool:
        """Whether the start of this element ends the hidden ones, or the block they are in."""
        if not HOLDERS.isdisjoint(hidden):
            return False
        listed = not LISTS.isdisjoint(hidden)
        return tag in OUTSIDE and (block.tag == "p" or not listed) or block.tag in SAME.get(tag, ())

    position = 0
    while match := TOKEN.search(page, position):
        start, position = match.span()
        if start > end and not hidden:
            add(html.unescape(page[end:start]))
        end = position
        closing, tag = match[1], (match[2] or "").lower()
        if not tag:
            continue
        open_ = not closing and not match[3].endswith("/")
        if open_ and RAW.fullmatch(tag):
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, position)
            position = end = len(page) if stop is None else page.find(">", stop.start()) + 1 or len(page)
            continue
        if tag in ("head", "body", "html"):
            # What a head may hold is never shown, so other text and tags are outside of it, closed or not.
            hidden.clear()
            continue
        if hidden:
            if closing and tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            if closing and is_open(tag) or open_ and ends_hidden(tag):
                hidden.clear()
            else:
                if open_ and tag not in VOID and tag != hidden[-1] or tag in HIDDEN and open_:
                    hidden.append(tag)
                continue
        if tag in HIDDEN:
            if open_:
                hidden.append(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if closing:
            links = 0
            close(tag, set())
            continue
        links = 0
        if tag != "p":
            close("p", {"td", "th", "button", "table"})
        else:
            close("p", {"td", "th", "button", "table", "li", "div", "section", "article"})
        for same in SAME.get(tag, ()):
            close(same, BARRIERS.get(tag, set()))
        run = None
        if tag in VOID or match[3].endswith("/"):
            continue
        block = Node(tag, block, match[3])
        nodes.append(block)
    if end < len(page) and not hidden:
        add(html.unescape(page[end:]))
    for node in nodes[1:]:
        node.parent.children.append(node)
    return nodes


def line(node: Node) -> str:
    return " ".join("".join(node.text).split())


def features(node: Node) -> list[str]:
    """What is seen of a node itself."""
    if node.tag:
        seen = ["tag " + node.tag]
        for name, *values in ATTRIBUTE.findall(node.attributes):
            if name.lower() in ("class", "id", "role"):
                seen += ["word " + word.lower() for word in WORD.findall("".join(values))]
        return seen
    text = line(node)
    words = text.count(" ") + 1
    return [
        f"length {min(words, 100).bit_length()}",
        f"links {round(3 * node.linked / max(len(text), 1))}",
        f"sentence {text[-1:] in '.!?:;'}",
        f"mark {text[:1] in '©®' }",
    ]


class Model:
    """Log potentials, from nodes with labels. The module's pages count half as much as the sample, however large that is."""

    def __init__(self, pages: list[list[Node]], sample: list[list[Node]] = ()):
        pages = [*(pages * max(1, len(sample) // (2 * len(pages)))), *sample]
        counts, edges, states = [Counter(), Counter()], Counter(), [1.0, 1.0]
        for node in (node for nodes in pages for node in nodes if node.label is not None):
            counts[node.label].update(features(node))
            states[node.label] += 1
            if node.parent is not None and node.parent.parent is not None:
                edges[node.parent.label, bool(node.tag), node.label] += 1
        known = counts[0].keys() | counts[1].keys()
        share = lambda feature, s: math.log((counts[s][feature] + 0.02) / (states[s] + 0.04))
        self.features = {f: share(f, 1) - share(f, 0) for f in known}
        # Of a child, element or text, given the parent.
        self.edges = {}
        for parent in (0, 1):
            for element in (False, True):
                n = [edges[parent, element, s] + 0.5 for s in (0, 1)]
                least = LEAST_CHANGE[parent] if element else LEAST_CHANGE[parent] / 10
                content = min(1 - least, max(least, n[1] / sum(n)))
                self.edges[parent, element] = 1 - content, content
        # What the page itself holds is open.
        self.edges[None, True] = self.edges[None, False] = 0.5, 0.5

    def edge(self, node: Node) -> list[tuple[float, float]]:
        """Chances of a node's states given those of its parent."""
        return [self.edges[None if node.parent.parent is None else s, bool(node.tag)] for s in (0, 1)]

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """Chance of being content, for every node by its ``id``."""
        # What a node and all below it say, as odds in a pair; then the message to its parent.
        own = {id(node): [1.0, math.exp(max(-30.0, min(30.0, sum(self.features.get(f, 0.0) for f in features(node)))))] for node in nodes}
        up = {}
        for node in reversed(nodes):
            below = own[id(node)]
            for child in node.children:
                message = up[id(child)]
                below[0], below[1] = below[0] * message[0], below[1] * message[1]
                total = below[0] + below[1]
                below[0], below[1] = below[0] / total, below[1] / total
            if node.parent is not None:
                up[id(node)] = [chance[0] * below[0] + chance[1] * below[1] for chance in self.edge(node)]
        found, beliefs = {}, {}
        for node in nodes:
            belief = own[id(node)]
            if node.parent is not None:
                message, above = up[id(node)], beliefs[id(node.parent)]
                # The parent without what it has heard from this child.
                rest = [above[s] / max(message[s], 1e-300) for s in (0, 1)]
                edge = self.edge(node)
                down = [rest[0] * edge[0][t] + rest[1] * edge[1][t] for t in (0, 1)]
                belief = [belief[t] * down[t] for t in (0, 1)]
            else:
                belief = [belief[0], belief[1] * 1e-6]
            total = belief[0] + belief[1]
            beliefs[id(node)] = [belief[0] / total, belief[1] / total]
            found[id(node)] = belief[1] / total
        return found

    def extract(self, page: str) -> str:
        nodes = parse(page)
        marginals = self.marginals(nodes)
        lines = (line(node) for node in nodes if not node.tag and marginals[id(node)] > 0.5)
        return "\n".join(text for text in lines if text)


# Elements that are no article wherever they are, and those that mark one.
APART = set("nav aside footer form header button dialog menu".split())
MARKED = {"article", "main"}

# Labelled pages: ``data-main`` and ``data-rest`` say what is content below an element, until the other one does.
LABELLED = [
    """<body><header class="site-header"><a href="/">Home</a></header><nav class="menu main-nav"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>
    <article data-main class="post entry"><h1>A long day at the lake</h1><p>It rained for hours, and nobody minded at all.</p><p>Later on, the sun came out and the water was warm.</p><blockquote>We stayed.</blockquote><ul><li>One boat was red.</li><li>The other one was blue.</li></ul></article>
    <aside data-rest class="sidebar related"><h3>More stories</h3><ul><li><a href="/c">Five lakes</a></li></ul></aside><footer class="footer copyright">© 2020 The Paper · All rights reserved</footer></body>""",
    """<body><div class="header top banner" id="header"><div class="logo">The Site</div></div><div class="nav navbar menu"><a href="/x">One</a> <a href="/y">Two</a></div>
    <div class="cookie notice consent"><p>We use cookies to make this site work.</p><button>Accept</button></div><div id="content" class="content main" data-main><h1>How bread is made</h1><p>Flour and water are mixed and left alone for a night.</p><h2>In the oven</h2><p>After that, the loaf goes into the oven for an hour.</p>
    <div class="ad advert advertisement ads sponsored promo" data-rest>Buy a better oven today.</div><p>It should sound hollow when it is knocked upon.</p></div><div class="comments comment reader responses" id="comments"><h3>Comments</h3><div class="comment"><p>I tried this and it was very good bread.</p></div></div>
    <div class="sidebar widget" id="sidebar"><p>About the author of this page.</p></div><div class="footer" id="footer">Contact · Imprint</div></body>""",
    """<body><main data-main><section class="article body text story"><h1>The bridge</h1><p>The old bridge was closed in spring for repairs.</p><p>It will open again when the river is low.</p><table><tr><td>Length</td><td>90 metres</td></tr></table><figure><figcaption>The bridge in March.</figcaption></figure><pre>a = b</pre></section>
    <div class="share social buttons toolbar" data-rest><a href="#">Share</a> <a href="#">Send</a></div><form data-rest class="newsletter signup subscribe login search"><label>Your address</label><input name="q"><button>Subscribe</button></form><section data-rest class="comments discussion"><h2>What readers say</h2><p>A fine old bridge, and I hope it stays.</p></section></main>
    <div class="popup modal notice overlay warning"><p>Please turn off your blocker.</p></div><footer><p>© The Town</p><ul><li><a href="/imprint">Imprint</a></li></ul></footer></body>""",
    """<body><div class="breadcrumb breadcrumbs pagination pager"><a href="/">Home</a> <a href="/n">News</a></div><div class="ad">The best shoes are here.</div><article data-main><h1>Shoes</h1><p>Shoes wear out where the weight is.</p><dl><dt>Sole</dt><dd>The part below.</dd></dl><nav data-rest class="toc"><a href="#1">First</a></nav><p>Good ones can be mended many times over.</p>
    <footer data-rest class="meta tags author byline"><a href="/t">Shoes</a></footer><div data-rest class="related recommended links"><a href="/s">More on shoes</a></div></article><div class="ad banner">Sale. Only today.</div><aside class="ad"><p>All must go now, says the shop at the corner.</p></aside><footer>© shoes · Some words of the house.</footer></body>""",
]


def labelled(page: str) -> list[Node]:
    """Nodes with labels from ``data-main`` and ``data-rest``."""
    nodes = parse(page)
    for node in nodes:
        inherited = node.parent.label if node.parent is not None else 0
        marks = node.attributes
        node.label = 1 if "data-main" in marks else 0 if "data-rest" in marks else inherited
        node.attributes = marks.replace("data-main", "").replace("data-rest", "")
    return nodes


def self_labelled(page: str) -> list[Node]:
    """Nodes with labels from the page's own ``article`` or ``main``; none of a page without."""
    nodes = parse(page)
    if not any(node.tag in MARKED for node in nodes):
        return []
    for node in nodes:
        inherited = node.parent.label if node.parent is not None else 0
        node.label = 1 if node.tag in MARKED else 0 if node.tag in APART else inherited
    return nodes


def train(pages: DataFrame | None, train_pages: int = TRAIN_PAGES) -> Model:
    """Potentials from the module's labelled pages and at most ``train_pages`` of ``pages(page_id, html)`` that
    mark their article; of repeated ids the first page in the order of text."""
    sample = []
    if pages is not None:
        # Ids first, so that a task answers with numbers and not with as many pages.
        rows = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]") & F.col("page_id").isNotNull())
        chosen = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()
        rows = rows.where(F.col("page_id").isin([row.page_id for row in chosen]))
        rows = rows.groupBy("page_id").agg(F.min("html").alias("html"))
        sample = [self_labelled(row.html) for row in rows.collect()]
    return Model([labelled(page) for page in LABELLED], sample)


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    model = train(pages.select("page_id", "html"), train_pages)

    @F.arrow_udf("string")
    def extract(page: pa.Array) -> pa.Array:
        return pa.array([model.extract(each.as_py() or "") for each in page], pa.string())

    rows = pages.select("page_id", "url", extract.asNondeterministic()("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
