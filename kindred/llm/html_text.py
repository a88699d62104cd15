"""HTML extraction by tree scoring.

One pass over the markup builds the tree of block elements; elements that never hold an article (menus, page headers,
footers, sidebars, forms, scripts, adverts, notices, reader comments) are left out.  A class or id that names such a part
(``share-buttons``) is only a hint: an element that it names stays if the page's article lies in it, or most of the article's text, as names
like ``has-sidebar`` are given to wrappers, and so does a form or fieldset (some sites put whole pages into one).  A name that holds other words too
(``share-price``, ``related-work``) is a weak hint: such an element goes only if it stands outside the container that the rest of the page's text
chooses, or is mostly links.  Only elements named for reader comments go whatever they hold.  Spans within a sentence and headings are not judged by name
(headings but for comments); a span goes if all of its block's text lies in spans that are so named.  Of a header within an article the headings stay.  Paragraphs pass points for length
and commas to their ancestors, half as much a level further up; a container's points are discounted by its share of link
text.  The best container is taken (an ``article`` or ``main`` around it takes its place), with headings before it and those
siblings that score well or are long and hardly linked.

Defined cases: a null or empty page, and one without article text, give an empty text.  A tag or comment that is cut
off at the end of the page is markup, not text.  Unclosed and misnested tags are closed where a browser would.  Repeated
rows are read row by row; an empty table gives an empty result; other columns are carried along, and one named like a
result column is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from kindred.llm.workspace import ship

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")

#: Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "svg", "object", "canvas", "video", "audio", "option",
}
VOID = {"hr"}
DROPPED = {"nav", "header", "footer", "aside", "head", "menu", "button", "select", "svg", "dialog", "object", "canvas", "video", "audio", "search"}
INLINE = {"span", "small", "sup", "label", "ins"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
NEVER_BY_NAME = {"html", "body", "article", "main"}
UNWANTED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination",
    "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget",
}
#: Words that stand beside those in names of parts of a page; with any other word a name may be that of a part of the article.
PARTS = {
    "area", "article", "articles", "bar", "bars", "block", "blocks", "blog", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content",
    "copyright", "email", "entry", "facebook", "fixed", "floating", "follow", "form", "global", "google", "grid", "group", "head", "holder", "icon", "icons", "inline", "inner",
    "item", "items", "layout", "left", "legal", "link", "links", "list", "login", "logo", "main", "message", "mobile", "module", "network", "networks", "news", "outer", "overlay", "page",
    "panel", "policy", "post", "posts", "primary", "reader", "reply", "right", "row", "search", "secondary", "section", "side", "signup", "site", "slot", "sticky", "stories",
    "story", "tab", "tabs", "text", "thread", "title", "tools", "top", "twitter", "unit", "user", "website", "wrap", "wrapper", "zone",
}
#: With these words a header is that of a part of the article.
ARTICLE_PARTS = {"article", "chapter", "content", "entry", "post", "section", "story"}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
#: A name with such a word before or after it tells of a state, not of a part of the page.
_STATE = re.compile(r"(?<![a-z])(?:has|no|not|with|without)[-_]+[a-z]+|[a-z]+[-_]+(?:enabled|disabled)(?![a-z])")
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: An opening tag closes open elements of these kinds, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
#: Points: a paragraph counts from so many characters on; each ancestor gets half of what the one below got.
MIN_CHARS, LEVELS, CONTENT_POINTS = 25, 5, 10.0
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25


class _Node:
    __slots__ = ("tag", "parent", "dropped", "cut", "head", "named", "depth", "weak", "weight", "score", "chars", "linked", "end", "at")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, named: int, at: int) -> None:
        self.tag, self.parent, self.dropped, self.named, self.at = tag, parent, dropped, named, at
        self.weak = named == WEAK or bool(parent and parent.weak)
        self.depth = (parent.depth if parent else 0) + max(0, named - WEAK)  # how much the elements around the text are named as unwanted
        self.cut = False  # dropped for the name of it or of an element around it
        self.head = False  # in the header of an article, of which headings stay
        self.weight, self.score, self.chars, self.linked, self.end = 0.0, 0.0, 0, 0, at


#: What an element's tag and attributes say of it: nothing, hardly that it is unwanted, that it may be, that it holds comments, that it surely is unwanted.
WANTED, WEAK, HINTED, NAMED, UNFIT = range(5)
WRAPPERS = {"form", "fieldset"}


def _unwanted(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return UNFIT
    least = HINTED if tag in WRAPPERS else WANTED
    if not attributes or tag in NEVER_BY_NAME:
        return least
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true":
        return UNFIT
    if re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return UNFIT
    names = _STATE.sub(" ", f"{found.get('class', '')} {'' if tag in HEADINGS else found.get('id', '')}".lower()).split()
    said = max(map(_named, names), default=WANTED)
    return max(least, said if said == NAMED or tag not in HEADINGS else WANTED)


def _named(name: str) -> int:
    """What one name says of its element."""
    words = set(_TOKEN.findall(name))
    own, others = words & UNWANTED, words - UNWANTED
    if not own:
        return WANTED
    if not others <= PARTS or (own == {"header"} and others & ARTICLE_PARTS):
        return WEAK
    return HINTED if own.isdisjoint(COMMENTS) else NAMED


def _inside(node: _Node, top: _Node) -> bool:
    return top.at <= node.at < top.end


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3.0) if len(text) >= MIN_CHARS else 0.0


class _Page:
    """Blocks of text with their elements, in page order."""

    def __init__(self, text: str) -> None:
        self.root = _Node("#", None, False, WANTED, 0)
        self.nodes, self.stack, self.open = [self.root], [self.root], {}
        self.blocks: list[tuple[_Node, str, int]] = []
        self.pieces: list[str] = []
        self.link, self.linked = 0, 0
        self.doubtful: list[tuple[str, int]] = []  # open inline elements that are named as unwanted, with the depth they began at
        self.doubted, self.sure = False, False  # whether the block has text in such elements, and outside them
        self._read(text)
        self._flush()
        for node in self.stack:
            node.end = len(self.nodes)
        if any(node.named for node in self.nodes):
            self._drop_named()

    def _drop_named(self) -> None:
        """Drops the elements that are named as unwanted, except those around the article or most of its text."""
        plain = 0.0
        for node, text, linked in self.blocks:
            own = _points(text) * max(0.0, 1 - linked / len(text)) + len(text) / 1000
            node.weight += own
            plain += 0.0 if node.depth else own
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.weight += node.weight
        articles = [x for x in self.nodes if x.tag in ("article", "main") and x.weight]
        least = min((x.depth for x in articles), default=0)
        articles = [x for x in articles if x.depth == least]
        most = max((x.weight for x in articles), default=0.0)
        scope = self.root
        if articles and (not least or most > plain):  # each reader's comment may be an article
            heavy = next(x for x in articles if x.weight == most)
            scope = [x for x in articles if _inside(x, heavy) and x.weight > most / 2][-1]
        home = None
        for node in self.nodes:
            around = _inside(scope, node)
            holds = node.named in (WEAK, HINTED) and _inside(node, scope) and 2 * node.weight > scope.weight
            if node.named == WEAK and not around and not holds:
                home = home or self._home()
                holds = (_inside(node, home) or _inside(home, node)) and node.linked < SIBLING_LINKS * node.chars
            node.cut = bool(node.parent and node.parent.cut) or bool(node.named and not around and not holds)
            node.dropped = node.dropped or node.cut
        self.blocks = [b for b in self.blocks if not b[0].dropped]

    def _home(self) -> _Node:
        """The container that text without any hint would choose; leaves the counts of all text in the nodes."""
        best = choose(self.nodes, [b for b in self.blocks if not b[0].depth and not b[0].weak])
        count_links(self.nodes, self.blocks)
        if best is None:
            return self.root
        home = container(best)
        return home.parent if home.tag == "section" and home.parent is not None else home

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text and (self.sure or not self.doubted):
                self.blocks.append((self.stack[-1], text, self.linked))
        self.pieces, self.linked = [], 0
        self.doubted, self.sure = False, False

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1].dropped:
            raw = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if not raw.isspace():
                self.doubted, self.sure = self.doubted or bool(self.doubtful), self.sure or not self.doubtful
            if self.link:
                self.linked += len(raw.strip())

    def _pop(self) -> None:
        node = self.stack.pop()
        node.end = len(self.nodes)
        self.open[node.tag] -= 1
        self.link = 0

    def _close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        if self.open.get("p") and self.stack[-1].tag == "p":
            self._pop()
        if tag in IMPLIED:
            shut, border = IMPLIED[tag]
            while len(self.stack) > 1 and any(self.open.get(x) for x in shut):
                for node in reversed(self.stack):
                    if node.tag in border or node.tag in shut:
                        break
                if node.tag not in shut:
                    break
                self._close(node.tag)
        if tag in VOID:
            return
        parent = self.stack[-1]
        named = WANTED if parent.dropped else _unwanted(tag, attributes)
        title = parent.head and tag in HEADINGS
        if title:
            named = _unwanted(tag, attributes)
        node = _Node(tag, parent, (parent.dropped and not title) or named == UNFIT, named % UNFIT, len(self.nodes))
        inside = self.open.get("article") or self.open.get("main")
        node.head = parent.head and tag in ("div", "span", "hgroup") or (tag == "header" and bool(inside) and not parent.dropped)
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if not attributes.endswith("/") or tag != "svg":
            self.stack.append(node)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        inline: list[tuple[str, int]] = []  # inline elements that are left out, with the depth they began at
        while at < n:
            start = page.find("<", at)
            if start < 0:
                start = n
            if not inline:
                self._text(page[at:start])
            if start == n:
                break
            at = start
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = n if stop < 0 else stop + 3
                continue
            mark = page[at + 1 : at + 3]
            if not (mark[:1].isascii() and mark[:1].isalpha() or mark[:1] == "/" and mark[1:].isascii() and mark[1:].isalpha()):
                if mark[:1] in ("!", "?", "/"):
                    stop = page.find(">", at)
                    at = n if stop < 0 else stop + 1
                elif not mark:
                    at = n
                else:
                    if not inline:
                        self._text("<")
                    at += 1
                continue
            tag = _TAG.match(page, at) or _LOOSE.match(page, at)
            if not tag:
                break
            at = tag.end()
            ends, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
            if name in RAW and not ends:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else n
                if name in ("iframe", "textarea"):
                    self.pieces.append(" ")
            elif name in BLOCKS:
                if ends:
                    self._flush()
                    self._close(name)
                else:
                    self._start(name, attributes)
                for left in (inline, self.doubtful):
                    while left and left[-1][1] >= len(self.stack) + (not ends):
                        left.pop()
            elif inline:
                if ends and name == inline[-1][0]:
                    inline.pop()
                elif not ends and name == inline[-1][0]:
                    inline.append((name, len(self.stack)))
            elif name == "br":
                self._text(" ")
            elif name == "a":
                self.link = 0 if ends else 1
            elif name in INLINE:
                if self.doubtful and name == self.doubtful[-1][0]:
                    self.doubtful.pop() if ends else self.doubtful.append((name, len(self.stack)))
                elif not ends and (said := _unwanted(name, attributes)) >= HINTED:
                    (inline if said == UNFIT else self.doubtful).append((name, len(self.stack)))


def count_links(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Counts the characters, and those in links, of each element."""
    for node in nodes:
        node.chars = node.linked = 0
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def choose(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> _Node | None:
    """The element with most points from these blocks; None if there are no points."""
    count_links(nodes, blocks)
    for node in nodes:
        node.score = CONTENT_POINTS if node.tag in ("article", "main") and not node.dropped and node.chars else 0.0
    for node, text, _ in blocks:
        holder = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        points = _points(text)
        for _ in range(LEVELS):
            if holder is None or not points:
                break
            holder.score += points
            points /= 2
            holder = holder.parent
    for node in nodes:
        node.score *= 1 - min(1.0, node.linked / node.chars) if node.chars else 0.0
    best = max(nodes, key=lambda x: x.score)
    return best if best.score else None


def container(best: _Node) -> _Node:
    """The ``article`` or ``main`` around an element, or the element."""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up or best


def extract(page: str | None) -> str:
    """The main text of one page, blocks joined by line feeds."""
    if not page:
        return ""
    seen = _Page(page)
    if not seen.blocks:
        return ""
    best = choose(seen.nodes, seen.blocks) or seen.root
    top = container(best)
    tops = [top]
    if top.parent is not None:
        floor = max(1.0, SIBLING_SHARE * best.score)
        for x in seen.nodes:
            if x.parent is top.parent and x is not top and not x.dropped and x.chars:
                loose = x.linked / x.chars
                heading = x.tag in ("h1", "h2", "hgroup") and x.at < top.at
                if heading or x.score >= floor or (x.chars >= SIBLING_CHARS and loose < SIBLING_LINKS):
                    tops.append(x)
    return "\n".join(text for node, text, _ in seen.blocks if any(_inside(node, t) for t in tops))


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the markup, with ``text`` and ``n_chars``."""
    ship(pages.sparkSession)
    own = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in own], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(column)]
                yield pa.record_batch([*[part.column(c) for c in own], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*own, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in dict.fromkeys([*own, column])]).mapInArrow(run, schema)
