"""Main text of web pages by tree scoring.

The page becomes a tree of elements.  Every paragraph gives points to its parent
and half as many to its grandparent: one, one for each comma, and one for each
100 characters up to three.  An element's points are discounted by the share of
its text that stands in links.  The best element is the article; siblings that
score a fifth of it, are long paragraphs with few links, or hold paragraphs that
end like sentences and no link, belong to it.  The
blocks of these, in page order, make the text; what is never content (scripts,
menus, forms, asides and the like, by tag, role or class name) is left out.  A
class name or a form leaves out nothing that holds most of the text of the page's
articles, or of its paragraphs if it has no article, and counts for nothing where
the text would be empty.

Defined results: a null or empty page gives an empty text; without paragraphs
the best element is the body; unclosed tags are closed where HTML closes them;
white space inside a block becomes one space, blocks are joined by two line
feeds; character references are decoded once; pages are read whole, to any depth,
in linear time; repeated rows are read each; a null page_id stays null.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.session import bound_batches

#: Fixed values of HTML: elements without content, blocks, and never-content elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript template head title nav footer header aside button select textarea option iframe svg canvas object dialog menu".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: A new element of the first kind closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_ROLES = frozenset("navigation banner contentinfo complementary dialog alert menu menubar".split())
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|nav\w*|menu|breadcrumbs?|sidebar|widget|footer|header|masthead|comments?|disqus|replies|respond|share|social|related|recommend\w*|newsletter|subscribe|subscription|login|signup|pagination|pager|skip|toolbar|tags?)(?=$|[\s_-])", re.I)
#: Names of what readers write: it can be longer than the article.
REPLIES = frozenset("comment comments disqus replies respond".split())
SIBLING_SHARE = 0.2
SPACE = re.compile(r"\s+")
#: How a sentence ends.
SENTENCE_END = (".", "!", "?", "…", "。", ":", '."', ".”", ".»")
#: Elements over whose borders a paragraph, or a list item or cell, is not closed by a new one.
PARAGRAPH_BORDERS = BLOCK - {"p"}
ITEM_BORDERS = frozenset("ul ol dl table select".split())


class Element:
    __slots__ = ("tag", "parent", "children", "skip", "names", "points", "chars", "link_chars", "commas")

    def __init__(self, tag: str, parent, skip: bool, names: frozenset = frozenset()):
        self.tag, self.parent, self.children, self.skip, self.names = tag, parent, [], skip, names
        self.points, self.chars, self.link_chars, self.commas = 0.0, 0, 0, 0


class Tree(HTMLParser):
    """Builds the elements; ``open`` is the path to the current one and ``places`` has the places of each tag in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", None, False)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def _pop_to(self, k: int) -> None:
        for e in self.open[k:]:
            self.places[e.tag].pop()
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head") and self._last(tag):
            return
        if tag in BLOCK:
            self._close("p", PARAGRAPH_BORDERS)
        for other in CLOSES.get(tag, ()):
            self._close(other, ITEM_BORDERS)
        named = dict(attrs)
        inside = self._last("article") or self._last("main")
        names = frozenset()
        if tag not in ("body", "html", "article", "main") and ("class" in named or "id" in named):
            names = frozenset(x.strip().strip("_-").lower() for x in UNLIKELY.findall(f"{named.get('class') or ''} {named.get('id') or ''}"))
            if names == {"header"} and inside:
                names = frozenset()
        if tag == "form" or named.get("role") in ("form", "search"):
            names |= {"form"}
        hidden = "hidden" in named or named.get("aria-hidden") == "true"
        own_header = tag == "header" and inside
        skip = (tag in NEVER and not own_header) or (named.get("role") or "") in NEVER_ROLES or hidden
        parent = self.open[-1]
        e = Element(tag, parent, skip, names)
        parent.children.append(e)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._pop_to(len(self.open) - 1)

    def _close(self, tag, borders=frozenset()):
        """Close the last open element of this tag and all in it, unless a border lies between."""
        k = self._last(tag)
        if k and not any(self._last(x) > k for x in borders):
            self._pop_to(k)

    def handle_endtag(self, tag):
        if tag not in VOID:
            # An end tag doesn't reach over the borders of cells and the like, but over unclosed inline elements.
            self._close(tag, {"table"} if tag not in ("html", "body", "table") else frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _skip_by_name(root: Element) -> None:
    """Skip elements with an unlikely class or id but those that hold most of the text that matters."""
    order, stack = [], [(root, False, False)]
    own: dict[int, list[int]] = {}
    while stack:
        e, article, paragraph = stack.pop()
        article, paragraph = article or e.tag in ("article", "main"), paragraph or e.tag in ("p", "pre", "blockquote")
        order.append(e)
        n = sum(len(c.strip()) for c in e.children if isinstance(c, str)) if article or paragraph else 0
        own[id(e)] = [n * article, n * paragraph]
        # Links and what is never content don't count.
        stack.extend((c, article, paragraph) for c in e.children if not isinstance(c, str) and not c.skip and c.tag != "a")
    for e in reversed(order):
        if e.parent is not None:
            above, mine = own[id(e.parent)], own[id(e)]
            above[0] += mine[0]
            above[1] += mine[1]
    kind = 0 if own[id(root)][0] else 1
    total = own[id(root)][kind]
    stack = [root]
    while stack:
        e = stack.pop()
        if e.names:
            most = 2 * own.get(id(e), (0, 0))[kind] > total
            e.skip = e.skip or not most or (kind == 1 and e.names <= REPLIES)
        stack.extend(c for c in e.children if not isinstance(c, str))


def _measure(root: Element) -> list[Element]:
    """Characters, link characters and commas below each element, and all elements, parents first."""
    order, stack = [], [(root, False, False)]
    while stack:
        e, skip, link = stack.pop()
        e.skip = e.skip or skip
        link = link or e.tag == "a"
        order.append(e)
        for c in e.children:
            if isinstance(c, str):
                if not e.skip:
                    n = len(c.strip())
                    e.chars += n
                    e.link_chars += n if link else 0
                    e.commas += c.count(",") + c.count("、") + c.count("，")
            else:
                stack.append((c, e.skip, link))
    for e in reversed(order):
        if e.parent is not None and not e.skip:
            e.parent.chars += e.chars
            e.parent.link_chars += e.link_chars
            e.parent.commas += e.commas
    return order


def _score(order: list[Element]) -> None:
    for e in order:
        direct = e.tag in ("div", "article", "section", "main") and any(isinstance(c, str) and len(c.strip()) > 20 for c in e.children)
        if e.skip or not e.chars or e.parent is None or not (e.tag in PARAGRAPH or direct):
            continue
        points = 1 + e.commas + min(e.chars / 100, 3.0)
        if direct:
            e.points += points
        e.parent.points += points
        if e.parent.parent is not None:
            e.parent.parent.points += points / 2
    for e in order:
        if e.chars:
            e.points *= 1 - e.link_chars / e.chars


def _blocks(e: Element, out: list[str]) -> None:
    """The blocks of text below ``e``, in page order."""
    buffer: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            out.append(text)
        buffer.clear()

    stack: list = [e]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
        elif x.tag == "br" or x.tag == "hr":
            buffer.append(" ")
        elif not x.skip:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def _prose(e: Element) -> bool:
    """Whether ``e`` has no link and only paragraphs, or is one, that end like sentences: a lead or a closing paragraph."""
    if e.skip or e.link_chars or not e.chars or e.tag not in ("p", "div", "section"):
        return False
    found, stack = False, [e]
    while stack:
        x = stack.pop()
        if x.tag == "p":
            out: list[str] = []
            _blocks(x, out)
            if out and not out[-1].endswith(SENTENCE_END):
                return False
            found = found or bool(out)
            continue
        for c in x.children:
            if isinstance(c, str):
                if c.strip():
                    return False
            elif not c.skip and c.chars:
                stack.append(c)
    return found


def main_text(html) -> str:
    if not isinstance(html, str) or not html:
        return ""
    return _main_text(parse(html), True) or _main_text(parse(html), False)


def _main_text(root: Element, by_name: bool) -> str:
    if by_name:
        _skip_by_name(root)
    order = _measure(root)
    _score(order)
    containers = [e for e in order if not e.skip and e.points > 0 and e.tag not in ("p", "html", "#root")]
    best = max(containers, key=lambda e: e.points, default=None)
    if best is None:
        best = next((e for e in order if e.tag == "body"), root)
    # A heading and its article often share a container that scores half: an article or main element around the best is taken whole.
    around = best
    while around.parent is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around.tag in ("article", "main") and not around.skip:
        best = around
    chosen = [best]
    if best.parent is not None and best.tag not in ("body", "html", "#root"):
        floor = max(1.0, SIBLING_SHARE * best.points)
        chosen = []
        for s in best.parent.children:
            if isinstance(s, str) or s.skip:
                continue
            few_links = s.link_chars <= 0.25 * s.chars
            if s is best or s.points >= floor or (s.tag == "p" and few_links and s.chars > 80) or (s.tag in ("h1", "h2") and few_links and s.chars) or _prose(s):
                chosen.append(s)
    out: list[str] = []
    for e in chosen:
        _blocks(e, out)
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the page source, with ``text`` and ``n_chars``."""
    bound_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def run(source: pd.Series) -> pd.Series:
        return source.map(main_text).astype(object)

    return pages.select(*keep, run(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
