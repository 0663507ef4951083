"""Main text of web pages by tree scoring: paragraphs give points to the elements around them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundweave.llm import words as W

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_COMMA = re.compile("[,،、，]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template title textarea iframe noframes xmp svg math".split())
_DROPPED = frozenset("head nav footer aside form button select option input label fieldset dialog menu object embed canvas audio video map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl div section article body html main blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class, id and role that name what isn't the article, and those that name the article.
_UNLIKELY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification pager pagination paywall popup promo promotion recommended related remark replies respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets alert complementary "
    "search".split())
_COMMENT = frozenset("comment comments reply replies disqus respond remark".split())
_LIKELY = frozenset("article blog body content entry main page post story text".split())
_TAG_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
               "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5} | dict.fromkeys(_HEADINGS, -5)
_LEAST_CHARS = 25
_ANCESTORS = 4
#: A menu has at least so many links, of at most so many characters each and together.
_MENU_LINKS, _LINK_CHARS, _MENU_CHARS = 3, 25, 300
#: From so many characters on a paragraph with few links is large.
_LARGE_CHARS = 100


class _Node:
    __slots__ = ("chars", "commas", "doubtful", "holds", "inner", "link_chars", "links", "names", "own_chars", "parent", "points", "prose", "tag",
                 "within")

    def __init__(self, tag: str, parent: _Node | None, names: frozenset[str], doubtful: bool = False) -> None:
        self.tag, self.parent, self.names, self.doubtful = tag, parent, names, doubtful
        self.inner: list[_Node | str] = []
        self.points: float | None = None
        self.chars = self.commas = self.link_chars = self.links = self.own_chars = 0


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role; whether the element is hidden. What stands in one name with a word for comments, as in
    comment-body, doesn't name the article."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset(), False
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for own in map(_WORD.findall, value.split()):
                words += own if _COMMENT.isdisjoint(own) else [w for w in own if w not in _LIKELY]
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value == "true") or (
            name == "style" and "display:none" in value.replace(" ", ""))
    return frozenset(words), hidden


def _unwanted(tag: str, hidden: bool, in_article: bool) -> bool:
    return hidden or tag in _DROPPED or tag == "header" and not in_article


def _doubtful(tag: str, names: frozenset[str]) -> bool:
    """Whether names say that an element isn't the article, and none says that it is."""
    if not names or tag in ("html", "body", "main") or tag in _HEADINGS or names & _LIKELY:
        return False
    return bool(names & (_COMMENT if tag == "article" else _UNLIKELY))


def parse(html: str) -> _Node:
    """A tree of what may be the article. Unwanted elements aren't in it, nor are comments, scripts and the like; those with
    doubtful names are."""
    root = _Node("html", None, frozenset())
    stack = [root]
    opened: Counter[str] = Counter()  # tags of the stack, but for the root's

    def close(k: int) -> int:
        """Ends the elements from place k of the stack on; returns how many articles end."""
        tags = [node.tag for node in stack[k:]]
        opened.subtract(tags)
        del stack[k:]
        return sum(tag in ("article", "main") for tag in tags)

    skipping: list[str] = []  # an unwanted element and the open ones inside it
    skipped: Counter[str] = Counter()  # their tags
    at = articles = 0
    size = len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        stop = found.start() if found else size
        if stop > at and not skipping:
            text = html[at:stop]
            if text.endswith("<") and found is None:
                text = text[:-1]
            stack[-1].inner.append(unescape(text) if "&" in text else text)
        if found is None:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            if found[0].startswith("<![CDATA[") and not skipping:
                stack[-1].inner.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            if skipping:
                if skipped[tag]:
                    last = ""
                    while last != tag:
                        last = skipping.pop()
                        skipped[last] -= 1
                    continue
                if not (tag in _BLOCK and opened[tag]):
                    continue
                skipping.clear()  # an element around the unwanted one ends, which was never closed
                skipped.clear()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    articles -= close(k)
                    break
                if stack[k].tag in _SCOPE and tag not in _BLOCK:
                    break
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        while skipping and (skipping[-1] in _ENDED_BY.get(tag, ()) or skipping[-1] == "p" and tag in _ENDS_P
                            or skipping[-1] == tag == "option"):
            skipped[skipping.pop()] -= 1  # its end tag was left out
        if skipping:
            if tag not in _VOID and not attributes.endswith("/"):
                skipping.append(tag)
                skipped[tag] += 1
            continue
        if tag in ("html", "body"):
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                stack[-1].inner.append(" " if tag == "br" else _Node("hr", stack[-1], frozenset()))
            continue
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k].tag == "p":
                    articles -= close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        ended = _ENDED_BY.get(tag)
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    articles -= close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        names, hidden = _names(attributes)
        if _unwanted(tag, hidden, articles > 0):
            if not attributes.endswith("/"):
                skipping.append(tag)
                skipped[tag] += 1
            continue
        node = _Node(tag, stack[-1], names, _doubtful(tag, names))
        stack[-1].inner.append(node)
        stack.append(node)
        opened[tag] += 1
        articles += tag in ("article", "main")
    return root


def _in_order(root: _Node) -> list[_Node]:
    """All elements, each before what is inside it."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left += [x for x in reversed(node.inner) if x.__class__ is _Node]
    return out


def _density(node: _Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _start_points(node: _Node) -> float:
    named = -25 if node.doubtful else 25 if node.names & _LIKELY and not node.names & _UNLIKELY else 0
    return _TAG_POINTS.get(node.tag, 0) + named


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.commas = node.link_chars = node.links = node.own_chars = 0
        for x in node.inner:
            if x.__class__ is str:
                n = len(" ".join(x.split()))
                node.chars += n
                node.own_chars += n
                node.commas += len(_COMMA.findall(x))
            else:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.links += x.links
                if x.tag not in _BLOCK:
                    node.own_chars += x.own_chars
                    node.commas += x.commas
        if node.tag == "a":
            node.link_chars = node.chars
            node.links += 1


def _place(nodes: list[_Node]) -> None:
    """`within` is the nearest doubtful element, itself or around."""
    for node in nodes:
        node.within = node if node.doubtful else node.parent.within if node.parent else None


def _drop_by_name(nodes: list[_Node]) -> bool:
    """Takes doubtful elements out of the tree; returns whether there were any. Those stay, for the scores to judge, that
    hold <main>, or an <article> if none is elsewhere, or large paragraphs: a fourth as much as there is in elements that
    aren't doubtful, and ten beside an article. Where no paragraph is large, all text without links counts, and it has to be
    as much. Comments stay only if they hold the sole article and no large paragraph is elsewhere."""
    if not any(node.doubtful for node in nodes):
        return False
    _place(nodes)
    for kind in ("main", "article"):
        if kind == "article" and any(node.tag in ("main", "article") and node.within is None for node in nodes):
            break
        for node in nodes:
            around = node.within if node.tag == kind and not node.doubtful else None
            if kind == "article" and around and around.names & _COMMENT:
                continue
            while around and around.doubtful:
                around.doubtful = False
                around = around.parent.within
        _place(nodes)
    _measure(nodes)
    every = [node for node in nodes if node.tag in _BLOCK and node.tag not in _HEADINGS]
    large = {node for node in every if node.own_chars >= _LARGE_CHARS and _density(node) < 0.25}
    for node in reversed(nodes):
        kids = [x for x in node.inner if x.__class__ is _Node]
        own = node.own_chars if node in large else 0
        node.prose = own + sum(x.prose for x in kids if not (x.doubtful and x.names & _COMMENT))
        node.holds = any(x.holds or x.tag in ("article", "main") and not x.doubtful for x in kids)
    firm = sum(node.own_chars for node in large if node.within is None)
    inside = [node for node in nodes if node.doubtful and (node.parent is None or node.parent.within is None)]
    rest = nodes[0].chars - nodes[0].link_chars - sum(node.chars - node.link_chars for node in inside)
    in_article = set()
    for node in nodes:
        if node.parent in in_article or node.tag in ("main", "article") and not node.doubtful:
            in_article.add(node)
    found = any(node.within is None and node.own_chars for node in in_article)
    gone = set()
    for node in nodes:
        if not node.doubtful:
            continue
        beside = found and node not in in_article
        if node.names & _COMMENT:
            stays = node.holds and not firm
        elif large:
            stays = node.prose > 0 and 4 * node.prose >= max(firm, 40 * _LARGE_CHARS if beside else 0)
        else:
            stays = not beside and node.tag in _BLOCK and node.chars - node.link_chars >= max(rest, 1)
        if not stays:
            gone.add(node)
        elif node.prose >= firm and not beside:
            node.doubtful = False  # most of the text is in it
    for parent in {node.parent for node in gone}:
        parent.inner = [x for x in parent.inner if x.__class__ is str or x not in gone]
    return True


def _score(nodes: list[_Node]) -> _Node | None:
    """Gives points and returns the best container."""
    _measure(nodes)
    for node in nodes:
        if node.tag not in _BLOCK or node.own_chars < _LEAST_CHARS or node.tag in _HEADINGS:
            continue
        points = (1 + node.commas + min(node.own_chars / 100, 3)) * (1 - _density(node))
        up = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") and node.parent else node
        for level in range(_ANCESTORS):
            if up is None:
                break
            if up.points is None:
                up.points = _start_points(up)
            up.points += points / (1, 2, 6, 9)[level]
            up = up.parent
    ranked = [node for node in nodes if node.points is not None]
    for node in ranked:
        node.points *= 1 - _density(node)
    return max(ranked, key=lambda node: node.points, default=None)


def _article(best: _Node) -> _Node | None:
    """The article that the best container is or lies in, or else the main element."""
    main = None
    node: _Node | None = best
    while node:
        if node.tag == "article":
            return node
        if node.tag == "main" and main is None:
            main = node
        node = node.parent
    return main


def _unlinked(x: _Node | str) -> bool:
    if x.__class__ is str:
        return bool(x.strip())
    return x.chars > 0 and not x.links and not x.doubtful


def _like(x: _Node | str, best: _Node, points: float, first: bool) -> bool:
    """Whether a sibling of the best container looks like a part of the article by its own score or text."""
    if x.__class__ is str:
        return False
    own = (x.points or 0) + (points * 0.2 if x.names and x.names == best.names else 0)
    density = _density(x)
    text = x.tag in ("p", "pre", "blockquote") and (x.chars > 80 and density < 0.25 or x.chars > 0 and density == 0 and x.commas > 0)
    return x.points is not None and own >= max(10, points * 0.2) or text or x.tag in _HEADINGS and first and density < 0.5


def _kept(best: _Node) -> list[_Node | str]:
    """What the article consists of, in page order. In an <article> that is the whole of it and those of its siblings that look
    like parts of it; in a <main> without, the whole of that. On other pages it is the best container with such siblings and,
    where they share an element of their own, all siblings without links, however short; cousins in which something scores like
    a part of the article, and whatever has no links between two parts."""
    points = best.points
    whole = _article(best)
    if whole and whole.tag == "main" or (whole or best).parent is None:
        return [whole or best]
    node, climbs = whole or best, whole is None
    before: list[list[_Node | str]] = []
    after: list[_Node | str] = [node]
    while node.parent is not None:
        inner, near = node.parent.inner, climbs and node is best and node.parent.parent is not None
        at = next(k for k, x in enumerate(inner) if x is node)
        found: list[int] = []
        for k, x in enumerate(inner):
            if k == at or near and _unlinked(x):
                found.append(k)
            elif not climbs or node is best:
                if _like(x, node, points, not found):
                    found.append(k)
            elif climbs and x.__class__ is _Node and _density(x) < 0.25 and max(y.points or 0 for y in _in_order(x)) >= max(10, points * 0.2):
                found.append(k)
        if climbs:
            parts = set(found)
            found = [k for k in range(found[0], found[-1] + 1) if k in parts or _unlinked(inner[k])]
        before.append([inner[k] for k in found if k < at])
        after += [inner[k] for k in found if k > at]
        if not climbs:
            break
        node = node.parent
    return [x for level in reversed(before) for x in level] + after


def _menu(node: _Node) -> bool:
    """A short list of links that are a word or two, with no text but separators outside them."""
    return (node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.links >= _MENU_LINKS
            and node.chars <= min(_MENU_CHARS, node.links * (_LINK_CHARS + 2)) and node.chars - node.link_chars <= 2 * node.links)


def _text(parts: list[_Node | str]) -> str:
    """Blocks in page order, joined by a space. Menus before or after all other text are left out, if there is any."""
    blocks: list[tuple[str, str]] = []  # text and what it is part of: "menu", "heading" or nothing
    open_text: list[str] = []
    kinds = [""]

    def end() -> None:
        block = " ".join("".join(open_text).split())
        open_text.clear()
        if block:
            blocks.append((block, kinds[-1]))

    left: list[_Node | str | None] = list(reversed(parts))
    whole = {id(part) for part in parts}
    while left:
        x = left.pop()
        if x is None:
            end()
            kinds.pop()
        elif x.__class__ is str:
            open_text.append(x)
        else:
            if x.tag in _BLOCK:
                end()
                menu = kinds[-1] == "menu" or id(x) not in whole and _menu(x)
                kinds.append("menu" if menu else "heading" if x.tag in _HEADINGS else kinds[-1])
                left.append(None)
            left += reversed(x.inner)
    end()
    body = [k for k, (_, kind) in enumerate(blocks) if not kind]
    if body:
        blocks = [block for k, block in enumerate(blocks) if block[1] != "menu" or body[0] < k < body[-1]]
    return " ".join(block for block, _ in blocks)


def main_text(html: str | None) -> str:
    """The article of one page; empty if there is none. If no text is left, names don't count."""
    if not html:
        return ""
    for by_name in (True, False):
        root = parse(html)
        nodes = _in_order(root)
        named = by_name and _drop_by_name(nodes)
        if named:
            nodes = _in_order(root)
        best = _score(nodes)
        text = _text(_kept(best) if best else [root])
        if text or not named:
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text and n_chars (code points). A null or empty html
    gives an empty text. Repeated rows are extracted each; other columns are ignored. One pass without a shuffle; each page
    is parsed whole, without recursion, so deeply nested and very long pages take memory in proportion only."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in W.blocks(batches, "html"):
            texts = [main_text(html.as_py()) for html in block.column(2)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
