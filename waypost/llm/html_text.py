"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree. A node stands for an
element by its path (tags, classes and ids from the page's body down); the
text that stands directly in an element is a leaf below it. The tree is kept as
counts, a row a node: the pages that have it, how often each order of children
occurs there, and for leaves the pages of each text. To the base of the number
of pages

* a leaf's content importance is 1 less the mean entropy of its texts over the
  pages: texts that differ from page to page are important, repeated ones not;
* a node's presentation importance is the entropy of its orders of children;
* a node's importance is composite: ``CONTENT`` parts the content importance
  of all leaves below it, by their words, and one part its own presentation.

The importance is multiplied by a mark-up weight, and a branch whose product is
below ``threshold`` is cut from the page with all that is below it; what is
left is judged further down, to the leaves. Entropy alone can't tell a menu
whose links differ on every page from an article, nor an article that is
copied on many pages from a notice, so the weight depends on what elements say
of themselves:

* Elements that declare themselves menus, headers, footers, sidebars, notices,
  adverts, forms or comments, by element or role or, weaker, by a whole class or
  id, and weakest what lies outside of the page's article, have a weight of
  ``PRIOR`` times words / (words + ``SHORT``), with the words a block below the
  node. So long texts that differ from page to page stay.
* Reader comments, adverts, notices, footers and forms differ from page to page
  too, so no entropy tells them from an article. Where a class or id names one
  outright (``user-comments``, ``ad-slot``, ``cookie-bar``, ``newsletter-form``),
  the weight is so low that the branch is cut whatever its texts, unless the
  page's article stands in it.
* In an article, a node's importance counts with ``DOUBT`` pages more that
  speak for it, so what an article repeats on all pages of a host goes. Where
  nothing of a page's article would be left, all of it stays: copied articles
  aren't boilerplate.
* On pages without article, nodes that declare nothing have the weight 1.

What holds the page's article is never cut. Up to ``max_nodes`` nodes the tree
is broadcast; larger trees meet the nodes of the pages in a join, with the same
result.

Edge cases: null and empty html, and pages of which nothing is left, give an
empty text. On pages without a host, and for nodes that only one page of a host
has, the mark-up decides. Unclosed, stray and cut-off tags and comments are
taken as browsers do: paragraphs end where the next block begins, a cut-off tag
or comment is dropped. Rows that repeat a page_id are each returned. A page
needs memory in proportion to its length, and is never split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import stored

#: Weights of what declares itself boilerplate: by element; by class or id, with and without an article on the page;
#: and of what is outside of the page's article.
PRIOR = (0.24, 0.26, 0.3, 0.4)
#: The weight of what a class or id names outright; below any sensible threshold.
NAMED = 0.1
#: Levels of elements that are told apart, more than real pages have.
LEVELS = 128
#: The share of content in a composite importance.
CONTENT = 0.9
#: Words a block at which a declared node's importance counts half.
SHORT = 8
#: Pages that speak for a node of an article beforehand.
DOUBT = 4

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>|<[/a-zA-Z][^<]*\Z|[^<]+|<""",
    re.S
)
_ATTRIBUTE = re.compile(
    r"""(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_BOILERPLATE = frozenset(
    "head nav aside footer form menu button select dialog search label fieldset legend option datalist".split()
)
#: Raw elements that a slash may close, being of other languages than HTML.
_CLOSABLE = frozenset({"svg", "math"})
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog hidden".split()
)
_HINT = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscri\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend\w*|popup|modal|overlay|pagination|pager|widget|login|signup|search|skip|tags?|toc|hidden)"
)
#: Parts that leave a name made of hints what it is: site-header, share-buttons, left-sidebar.
_NEUTRAL = frozenset(
    "area bar block bottom box button buttons column container desktop global inner js left link links list mobile outer panel posts primary right secondary section site top wrap wrapper".split()
)
#: Words that name what isn't the article, wherever they stand in a name, and those that do as its last word.
_OUTRIGHT = re.compile(
    r"(?:ads?|advert\w*|adsense|adsby\w*|adslot|adunit|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w*|comments?|commentlist|commenter|disqus|respond|footer|sidebar|breadcrumbs?|nav|navbar|navigation|menu|share|sharing|social|related|recommend\w*|popup|modal|paywall|signup|login|outbrain|taboola)"
)
_OUTRIGHT_LAST = re.compile(
    r"(?:form|notices?|alerts?|banner|overlay|widget|pagination|pager|toolbar|repl(?:y|ies)|disclaimer|copyright|ticker)"
)
#: Words of names that tell a state of the page, not what an element is: has-sidebar, comments-open, ad-free.
_STATE_FIRST = frozenset("has no not with without is hide show non".split())
_STATE_LAST = frozenset(
    "open opened closed on off free enabled disabled supported active inactive visible hidden loaded ready count left right allowed accepted layout page template".split()
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_MAIN = re.compile(r"^(?:article|articlebody|main)$")
_PART = re.compile(r"[^a-z0-9]+")


def _hints(name: str) -> bool:
    """Whether a class or id as a whole names boilerplate: each part does, but for neutral ones."""
    parts = [x for x in _PART.split(name) if x and not x.isdigit() and x not in _NEUTRAL]
    return bool(parts) and all(map(_HINT.fullmatch, parts))


def _outright(name: str) -> bool:
    """Whether a class or id, as written, names a comment, advert, notice, footer, menu or form: by any strong word or its last."""
    parts = [x for x in _PART.split(_CAMEL.sub("-", name).lower()) if x and not x.isdigit()]
    if not parts or parts[0] in _STATE_FIRST or (len(parts) > 1 and parts[-1] in _STATE_LAST):
        return False
    return any(map(_OUTRIGHT.fullmatch, parts)) or (len(parts) > 1 and bool(_OUTRIGHT_LAST.fullmatch(parts[-1])))


def _attributes(text: str) -> tuple[str, set[str], str, bool, bool]:
    """(class and id without digits, their tokens, role, whether one hints at boilerplate or names it outright) of attributes."""
    if not text or text.isspace():
        return "", set(), "", False, False
    names, role, named = [], "", False
    for name, *values in _ATTRIBUTE.findall(text):
        given = values[0] or values[1] or values[2]
        value = given.lower()
        name = name.lower()
        if name == "role":
            role = role if role == "hidden" else value
        elif name == "itemprop":
            role = role or ("main" if value == "articlebody" else "")
        elif name in ("hidden", "aria-hidden"):
            role = "hidden" if name == "hidden" or value == "true" else role
        else:
            names += value.split()
            named = named or any(map(_outright, given.split()))
    tokens = set(names) | {part for x in names for part in _PART.split(x)}
    return ".".join(re.sub(r"\d+", "", x) for x in names), tokens, role, named or any(map(_hints, names)), named


def _number(*parts: object) -> int:
    return int.from_bytes(
        hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
        "little", signed=True
    )


class Element(NamedTuple):
    """An open element: its path in the style tree, what it and those around it declare, and the node above."""

    tag: str
    path: int
    declared: bool = False
    inside: bool = False
    hints: tuple[int, ...] = ()
    above: Element | None = None
    node: bool = False


class Block(NamedTuple):
    """A text block: its nodes (number of the path, role) from the outermost on, and its text."""

    chain: tuple[tuple[int, int], ...]
    text: str

    @property
    def role(self) -> int:
        return self.chain[-1][1] if self.chain else 1


def parsed(html: str, host: str = "") -> list[Block]:
    """The text blocks of a page; paths are numbered by host.

    Role 0 is boilerplate by element or role attribute, 3 by class or id only,
    4 named outright by class or id, 2 inside an article, 1 none of these. An article or main isn't boilerplate
    by class or id, nor is what it stands in, unless both say so. Elements more
    than ``LEVELS`` deep stand beside each other, as in browsers (at another depth).
    """
    out: list[tuple[Element, str]] = []
    text: list[str] = []
    stack = [Element("", _number(host))]
    place = stack[0]
    overruled: set[int] = set()
    outright: set[int] = set()

    def flush() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                out.append((place, whole))

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        slash, tag, given = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
            continue
        tag = tag.lower()
        if slash:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(x.node for x in stack[i:]):
                        flush()
                    del stack[i:]
                    place = stack[-1] if stack[-1].node else stack[-1].above or stack[0]
                    break
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag not in _CLOSABLE or not given.endswith("/"):
                at = close.end() if close else end
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        if tag in _BLOCK:
            flush()
            if tag == "hr":
                continue
            # a block ends an open paragraph, an item or cell the one before
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "td", "th", "tr", "option") else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in ("div", "ul", "ol", "table", "section", "article", "body"):
                    break
        if len(stack) > LEVELS:
            stack.pop()
        last = stack[-1]
        above = last if last.node else last.above
        if not given and tag not in _BLOCK and tag not in _BOILERPLATE:
            stack.append(last._replace(tag=tag, above=above, node=False))
            continue
        label, tokens, role, hinted, named = _attributes(given)
        declared, inside, hints = last.declared, last.inside, last.hints
        firm = tag in ("article", "main") or role == "main"
        main = firm or any(map(_MAIN.match, tokens))
        told = tag in _BOILERPLATE or role in _ROLES or (tag == "header" and not inside)
        if tag in ("html", "body"):
            main = told = hinted = firm = False
        if firm and not inside and not (hinted and hints):
            hinted = False
            if not declared and not told:
                overruled.update(hints)
        # an inline element that declares itself is a block of its own
        if hinted and named:
            outright.add(at)
        node = tag in _BLOCK or hinted or (told and not declared)
        path = _number(last.path, tag, label) if node else last.path
        entry = Element(
            tag, path, declared or told, inside or (main and not hinted and not declared and not told),
            (*hints, at) if hinted else hints, above, node
        )
        stack.append(entry)
        if node:
            flush()
            place = entry
    flush()

    chains: dict[int, tuple[tuple[int, int], ...]] = {}
    outright -= overruled

    def role_of(x: Element) -> int:
        if not outright.isdisjoint(x.hints):
            return 4
        return 0 if x.declared else 3 if not overruled.issuperset(x.hints) else 2 if x.inside else 1

    def chain(x: Element) -> tuple[tuple[int, int], ...]:
        if id(x) not in chains:
            lane, y = [], x
            while y is not None:
                if y.tag not in ("", "html", "body"):
                    lane.append((y.path, role_of(y)))
                y = y.above
            chains[id(x)] = tuple(reversed(lane))
        return chains[id(x)]

    return [Block(chain(x), whole) for x, whole in out]


class Page:
    """A page's nodes, in the order in which they first occur, and its blocks.

    ``nodes`` are (number, above, role, shape, around): the number of the path
    on its host, the place of the node above (or -1), and whether an article is
    below. ``leaves`` hold the leaf's place, its distinct texts, words and
    blocks; ``at`` the leaf of each block.
    """

    def __init__(self, html: str, host: str | None):
        host = host or ""
        found = parsed(html, host)
        self.texts = [b.text for b in found]
        places: dict[tuple[int, int, bool], int] = {}
        self.nodes: list[list] = []
        self.at: list[int] = []
        children: list[list[int]] = []
        leaves: dict[int, tuple[set[int], list[int]]] = {}
        for b in found:
            above, lane = -1, []
            leaf = (b.chain[-1][0] if b.chain else 0, b.role, True)
            for key in (*((*x, False) for x in b.chain), leaf):
                if key not in places:
                    places[key] = len(self.nodes)
                    self.nodes.append([_number(host, *key), above, key[1], 0, False])
                    children.append([])
                x = places[key]
                if above >= 0 and (not children[above] or children[above][-1] != x):
                    children[above].append(x)
                above = x
                lane.append(x)
            if b.role == 2:
                for x in lane:
                    self.nodes[x][4] = self.nodes[x][2] != 2
            texts, sums = leaves.setdefault(above, (set(), [0, 0]))
            texts.add(_number(b.text))
            sums[0] += b.text.count(" ") + 1
            sums[1] += 1
            self.at.append(above)
        for x, below in enumerate(children):
            # the order of a node's children; for a leaf, how many blocks it has
            self.nodes[x][3] = leaves[x][1][1] if x in leaves else _number(*(str(self.nodes[y][0]) for y in below))
        self.leaves = [(x, sorted(texts), *sums) for x, (texts, sums) in leaves.items()]

    @property
    def landmark(self) -> bool:
        return any(self.nodes[x][2] == 2 for x in self.at)


_NODES = "nodes array<struct<node: long, above: int, role: tinyint, shape: long, around: boolean>>"
_LEAVES = "leaves array<struct<at: int, up: array<long>, texts: array<long>, words: int, blocks: int>>"
_PARSED = f"page_id long, url string, host string, landmark boolean, {_NODES}, {_LEAVES}, at array<int>, texts array<string>"
_NODE_TYPE = pa.list_(
    pa.struct(
        [
            ("node", pa.int64()), ("above", pa.int32()), ("role", pa.int8()), ("shape", pa.int64()),
            ("around", pa.bool_())
        ]
    )
)
_LEAF_TYPE = pa.list_(
    pa.struct(
        [
            ("at", pa.int32()), ("up", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("words", pa.int32()),
            ("blocks", pa.int32())
        ]
    )
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.small(batches, "html", 2 << 20):
        pages = [
            Page(html or "", host) for html,
            host in zip(W.column(batch, "html").to_pylist(), W.column(batch, "host").to_pylist(), strict=True)
        ]
        nodes = [
            [dict(zip(("node", "above", "role", "shape", "around"), x, strict=True)) for x in p.nodes] for p in pages
        ]
        leaves = []
        for p in pages:
            rows = []
            for x, texts, words, n in p.leaves:
                up, y = [], x
                while y >= 0:
                    up.append(p.nodes[y][0])
                    y = p.nodes[y][1]
                rows.append({"at": x, "up": up, "texts": texts, "words": words, "blocks": n})
            leaves.append(rows)
        arrays = [
            *(W.column(batch, c) for c in ("page_id", "url", "host")), pa.array([p.landmark for p in pages]),
            pa.array(nodes, _NODE_TYPE), pa.array(leaves, _LEAF_TYPE),
            pa.array([p.at for p in pages], pa.list_(pa.int32())),
            pa.array([p.texts for p in pages], pa.list_(pa.string()))
        ]
        yield pa.RecordBatch.from_arrays(
            arrays, names=["page_id", "url", "host", "landmark", "nodes", "leaves", "at", "texts"]
        )


def style_tree(pages: DataFrame) -> DataFrame:
    """(node, pages, words, importance) of the nodes that more than one of the parsed ``pages`` of a host has."""
    hosted = pages.filter("host is not null")
    shapes = hosted.select(F.explode("nodes").alias("x")).groupBy("x.node", "x.shape").agg(F.count("*").alias("n"))
    shapes = shapes.groupBy("node").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("nln")
    ).filter("pages > 1")
    # -sum(n/m ln(n/m)) / ln m over the orders of children
    presentation = (F.ln("pages") - F.col("nln") / F.col("pages")) / F.ln("pages")
    leaf = hosted.select(F.explode("leaves").alias("x")).select(
        F.col("x.up")[0].alias("leaf"), "x.up", "x.texts", "x.words", "x.blocks"
    )
    texts = leaf.select("leaf", F.explode("texts").alias("text")).groupBy("leaf", "text").agg(F.count("*").alias("df"))
    texts = texts.groupBy("leaf").agg(F.avg(F.ln("df")).alias("mean_ln_df"))
    sizes = leaf.groupBy("leaf").agg(
        F.any_value("up").alias("up"), F.count("*").alias("m"), F.sum("words").alias("words"),
        F.sum("blocks").alias("blocks")
    )
    content = F.when(F.col("m") > 1, 1 - F.col("mean_ln_df") / F.ln("m")).otherwise(1.0)
    weighed = sizes.join(texts, "leaf").select(
        F.explode("up").alias("node"), (content * F.col("words")).alias("value"), "words", "blocks"
    )
    below = weighed.groupBy("node").agg(
        (F.sum("value") / F.sum("words")).alias("content"), (F.sum("words") / F.sum("blocks")).alias("words")
    )
    value = CONTENT * F.col("content") + (1 - CONTENT) * presentation
    return shapes.join(below, "node").select("node", "pages", "words", value.alias("importance"))


def low(role: int, landmark: bool, pages: int, words: float, importance: float, threshold: float) -> bool:
    """Whether a node of a role is cut; ``pages`` is 0 for a node that the tree doesn't have."""
    if role == 2:
        return pages > 0 and (importance * pages + DOUBT) / (pages + DOUBT) < threshold
    if role == 1 and not landmark:
        return pages > 0 and importance < threshold
    prior = NAMED if role == 4 else PRIOR[0] if role == 0 else PRIOR[3] if role == 1 else PRIOR[1] if landmark else PRIOR[2]
    return pages == 0 or prior * importance * words / (words + SHORT) < threshold


def kept_blocks(
    landmark: bool, nodes: list[dict], at: list[int], known: Callable[[int], tuple[int, float, float]], threshold: float
) -> list[int]:
    """The numbers of the blocks that stay; ``known`` gives (pages, words, importance) of a node's number."""
    cut, faded = [False] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes):  # a node comes after the one above
        own = not x["around"] and low(x["role"], landmark, *known(x["node"]), threshold)
        above = x["above"]
        cut[i] = (own and x["role"] != 2) or (above >= 0 and cut[above])
        faded[i] = (own and x["role"] == 2) or (above >= 0 and faded[above])
    lively = any(nodes[x]["role"] == 2 and not cut[x] and not faded[x] for x in at)
    return [i for i, x in enumerate(at) if not cut[x] and not (lively and faded[x])]


class Tree:
    """The tree as sorted arrays, for a broadcast."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["node"].to_numpy())
        self.node, self.pages, self.words, self.importance = (
            table[c].to_numpy()[order] for c in ("node", "pages", "words", "importance")
        )

    def known(self, node: int) -> tuple[int, float, float]:
        at = int(np.searchsorted(self.node, node))
        if at == len(self.node) or self.node[at] != node:
            return 0, 0.0, 0.0
        return int(self.pages[at]), float(self.words[at]), float(self.importance[at])


def _decide(threshold: float, tree=None):
    """Texts of (page_id, url, landmark, nodes, at, texts); without a broadcast tree the rows have ``told``, their own nodes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, float, float]] = {}

        def shared(node: int) -> tuple[int, float, float]:
            if node not in seen:
                if len(seen) > 1 << 16:
                    seen.clear()
                seen[node] = tree.value.known(node)
            return seen[node]

        for batch in batches:
            columns = [W.column(batch, c).to_pylist() for c in ("landmark", "nodes", "at", "texts")]
            told = W.column(batch, "told").to_pylist() if tree is None else [None] * batch.num_rows
            texts = []
            for landmark, nodes, at, blocks, own in zip(*columns, told, strict=True):
                mine = {x["node"]: (x["pages"], x["words"], x["importance"]) for x in own or ()}
                known = shared if tree is not None else lambda node, mine=mine: mine.get(node, (0, 0.0, 0.0))
                texts.append("\n".join(blocks[i] for i in kept_blocks(landmark, nodes, at, known, threshold)))
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "page_id"), W.column(batch, "url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"]
            )

    return run


#: Pages that have a node from which on it is looked up in a broadcast; there are as few such nodes as pages allow.
_HOT = 1_000_000


def main_text(pages: DataFrame, threshold: float = 0.2, max_nodes: int = 1_000_000) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text."""
    spark = pages.sparkSession
    host = F.lower(
        F.nullif(
            F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1),
            F.lit("")
        )
    )
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
        F.col("html").cast("string").alias("html")
    )
    cut = stored(rows.mapInArrow(_parse, _PARSED).withColumn("row_", F.monotonically_increasing_id()), "blocks")
    tree = stored(style_tree(cut), "tree")
    found = "page_id long, url string, text string"
    shown = ("page_id", "url", "landmark", "nodes", "at", "texts")
    if tree.count() <= max_nodes:
        held = spark.sparkContext.broadcast(Tree(tree.toArrow()))
        return cut.select(*shown).mapInArrow(_decide(threshold, held), found)
    wanted = cut.filter("host is not null").select("row_", F.explode("nodes.node").alias("node")).distinct()
    hot = F.col("pages") >= _HOT
    met = wanted.join(F.broadcast(tree.filter(hot)), "node").unionByName(
        wanted.join(F.broadcast(tree.filter(hot).select("node")), "node", "left_anti").join(tree.filter(~hot), "node")
    )
    told = met.groupBy("row_").agg(F.collect_list(F.struct("node", "pages", "words", "importance")).alias("told"))  # a page's own nodes
    return cut.join(told, "row_", "left").select(*shown, "told").mapInArrow(_decide(threshold), found)
