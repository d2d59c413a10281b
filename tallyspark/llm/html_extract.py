"""Main-text extraction from HTML by tree scoring.

The page becomes a tree.  Subtrees that never hold article text (scripts, navigation,
forms, ...; elements whose class or id names an advert, menu, comment, ...) are left out.
Every paragraph-like block passes points, for its length and its commas, to its ancestors:
all to the parent, half to the grandparent, a third of that further up.  A container's
points are discounted by its link density.  The best container is kept, with those of its
siblings whose own points, or whose long and link-poor text, show that they go on with it.

Cases: null or empty html, and pages without text, give ''.  Unclosed and stray tags,
unknown entities and text outside any element are accepted.  No block is dropped for its
length and nothing is cut.  One output row for each input row, repeated rows included.
Other columns are kept; one that has the output column's name already is replaced.  Pages are
read once from front to end, so a long page with unclosed or deeply nested tags takes time in
proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: HTML element kinds -------------------------------------------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIPPED = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "menu", "dialog", "video", "audio", "label", "fieldset"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "img",
}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the value is closed by a start tag of the key.
CLOSED_BY = {
    "a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Words of class, id and role values that name parts beside the article, wherever they are.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|sponsor\w*|promo|promotions?|banner|cookies?|consent|gdpr|popup|modal|overlay|subscribe|newsletter|"
    r"sidebar|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|site-header|page-header|topbar|masthead|comments?|comment-\w+|disqus|replies|reply|respond|"
    r"share|sharing|social|related|recommended|toolbar|login|signup|contentinfo|complementary)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Words that name such parts outside the article only: inside, they are also said of its own boxes and remarks.
BESIDE_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:notices?|alert|side|aside|widget|search|tags?|skip|tracking)(?=$|[\s_-])", re.IGNORECASE)
#: Values that name the article itself and outweigh the words above.
ARTICLE = {"article", "article-body", "post-body", "post-content", "entry-content", "content", "main-content", "main", "story", "story-body"}
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.IGNORECASE)
# --------------------------------------------------------------------------------------

# Possessive throughout, so that each character is looked at a bounded number of times.  A tag
# ends at > or, if that is missing, before the next one; quotes count only after =.
_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/<>]*+)[^<>]*+>?|"""
    r"""<(?P<start>[a-zA-Z][a-zA-Z0-9:_.-]*+)(?=[\s/<>]|\Z)(?P<rest>(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="']|<(?![a-zA-Z/!?]))*+)>?""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"']++))?""")
_NAMES = {"class", "id", "role"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for name in RAW}
COMMAS = re.compile("[,，、،;；]")

LENGTH_POINT = 100  # characters a point
MOST_LENGTH_POINTS = 3
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("children", "in_article", "name", "parent", "points", "skipped")

    def __init__(self, name: str, parent: Node | None, skipped: bool = False, in_article: bool = False) -> None:
        self.name, self.parent, self.skipped, self.in_article = name, parent, skipped, in_article
        self.children: list[Node | str] = []
        self.points = 0.0


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _said(attributes: str) -> tuple[bool, str]:
    """Whether an element is hidden, and its class, id and role together."""
    values = []
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, ""
        if key in _NAMES:
            values.append(value)
    return False, _CAMEL.sub("-", " ".join(values))


def _beside(name: str, said: str, in_article: bool) -> bool:
    if not said or name in ("html", "body"):
        return False
    if name in ("article", "main"):
        return bool(COMMENT.search(said))
    words = set(said.lower().split())
    if words & ARTICLE:
        return False
    return bool(BESIDE.search(said)) or not in_article and (bool(BESIDE_OUTSIDE.search(said)) or "header" in words)


class _Open:
    """The open elements, and at which depths each name is among them."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Ends the element at this depth and all within it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()

    def depth(self, name: str, within: frozenset[str] | tuple = ()) -> int:
        """Where the innermost element of this name is; 0 if there is none, or one of within is open inside it."""
        own = self.depths.get(name)
        if not own or any((d := self.depths.get(w)) and d[-1] > own[-1] for w in within):
            return 0
        return own[-1]


_P_ENDS_AT = ("table", "td", "li", "div", "article", "section", "body")


def parse(page: str) -> Node:
    """The tree of a page; text children are raw, with their character references."""
    root = Node("#root", None)
    opened = _Open(root)
    stack = opened.stack
    begin = position = 0
    while (start := page.find("<", position)) >= 0:
        found = _MARKUP.match(page, start)
        if found is None:  # a plain <
            position = start + 1
            continue
        if start > begin:
            stack[-1].children.append(page[begin:start])
        begin = position = found.end()
        kind = found.lastgroup
        if kind == "data":
            stack[-1].children.append(entities.escape(found["data"], quote=False))
        elif kind == "end":
            name = found["end"].lower()
            if depth := opened.depth(name):
                opened.close(depth)
            elif name == "p":
                stack[-1].children.append(Node("p", stack[-1]))
        elif kind == "rest":
            name, attributes = found["start"].lower(), found["rest"]
            if name in CLOSES_P and (depth := opened.depth("p", _P_ENDS_AT)):
                opened.close(depth)
            if name in CLOSED_BY:
                while stack[-1].name in CLOSED_BY[name] or stack[-1].name == "p" and stack[-1].parent.name in CLOSED_BY[name]:
                    opened.close(len(stack) - 1)
            above = stack[-1]
            hidden, said = _said(attributes) if attributes else (False, "")
            skipped = name in SKIPPED or hidden or _beside(name, said, above.in_article)
            inside = above.in_article or name in ("article", "main") or bool(said) and not ARTICLE.isdisjoint(said.lower().split())
            node = Node(name, above, skipped or name == "header" and not (inside or "section" in opened.depths and bool(opened.depths["section"])), inside)
            above.children.append(node)
            alone = attributes.endswith("/")
            if name in RAW and not alone:
                closing = _RAW_END[name].search(page, position)
                begin = position = closing.end() if closing else len(page)
            elif name not in VOID and not (alone and name not in CLOSES_P | INLINE):
                opened.push(node)
    if begin < len(page):
        stack[-1].children.append(page[begin:])
    return root


def _text(raw: str) -> str:
    return entities.unescape(raw) if "&" in raw else raw


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in page order, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            words = "".join(run).split()
            run.clear()
            if words:
                out.append(" ".join(words))

    stack: list[Iterator[Node | str]] = [iter(node.children)]
    names = [node.name]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if names.pop() not in INLINE:
                close()
        elif isinstance(child, str):
            run.append(_text(child))
        elif child.name == "br":
            run.append(" ")
        elif not child.skipped:
            if child.name not in INLINE:
                close()
            stack.append(iter(child.children))
            names.append(child.name)
    close()
    return out


def _measure(node: Node) -> dict[int, tuple[int, int]]:
    """Of each node, by id: length of its text and of the text in its links; points go up on the way."""
    sizes: dict[int, tuple[int, int]] = {}
    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        at, done = stack.pop()
        if not done:
            stack.append((at, True))
            stack += [(c, False) for c in at.children if isinstance(c, Node) and not c.skipped]
            continue
        size = links = 0
        own = []
        for child in at.children:
            if isinstance(child, str):
                size += len(child.strip())
                own.append(child)
            elif id(child) in sizes:
                size += sizes[id(child)][0]
                links += sizes[id(child)][1]
                if child.name in INLINE:
                    own += [c for c in child.children if isinstance(c, str)]
        sizes[id(at)] = (size, size if at.name == "a" else links)
        text = "".join(own).strip()
        if text and at.name not in INLINE and at.parent is not None and sizes[id(at)][1] < 0.5 * size:
            points = 1 + len(COMMAS.findall(text)) + min(MOST_LENGTH_POINTS, len(text) // LENGTH_POINT)
            receiver, weight = (at.parent if at.name in PARAGRAPHS else at), 1.0
            for level in range(4):
                if receiver is None:
                    break
                receiver.points += points * weight
                receiver, weight = receiver.parent, (0.5 if level == 0 else weight / 3)
    return sizes


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    sizes = _measure(root)
    best, most = None, 0.0
    stack = [root]
    density = lambda n: sizes[id(n)][1] / max(1, sizes[id(n)][0])
    while stack:
        at = stack.pop()
        at.points *= 1 - density(at)
        if at.points > most or (at.points == most and at.name in ("article", "main")):
            best, most = at, at.points
        stack += [c for c in reversed(at.children) if isinstance(c, Node) and id(c) in sizes]
    if best is None:  # no block below any element: whatever text there is
        best = root
    # a container within the article speaks for the whole article
    above = best
    while above is not None:
        if above.name in ("article", "main") and above.points >= 0.3 * most:
            best = above
            break
        above = above.parent
    kept = [best]
    if best.parent is not None and best.name not in ("body", "html", "#root"):
        kept = []
        for child in best.parent.children:
            if child is best:
                kept.append(child)
            elif isinstance(child, Node) and id(child) in sizes:
                own = child.points >= max(10, SIBLING_SHARE * most)
                goes_on = child.name == "p" and density(child) < 0.25
                if own or (goes_on and best.name not in ("article", "main")):
                    kept.append(child)
    return " ".join(block for node in kept for block in blocks(node))


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text in a further column."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(extract, na_action=None)

    return pages.withColumn(out, run(F.col(html)))
