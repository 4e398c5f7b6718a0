"""Main text of web pages by shallow text features.

A page is cut into flat text blocks. Each block has its own and its neighbours' word counts and link densities, and what
markup says of its place: main text, surely boilerplate (by element, or by names made of known words only), doubtful
(names that hold a word of boilerplate among others), or nothing. A decision tree, grown on a small labelled table of
pages, tells content from boilerplate. Places in the table mislead: links to other pages stand inside articles and texts
inside elements with doubtful names, so words and links, the neighbours' included, overrule the place there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VALUE = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*+)"
#: An attribute as HTML reads it: quotes matter only where a value begins.
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is never text of the page. Fixed values.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select", "title", "annotation", "annotation-xml"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
MATH = {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mpadded", "mphantom", "mtable", "mtr", "mtd"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
#: Boilerplate in which an article is a teaser.
ASIDE = BOILER - {"form"}
#: Elements whose names tell what they hold.
NAMED = {"article", "div", "section", "aside", "nav", "header", "footer", "figure", "ul", "ol", "li", "dl", "form", "table", "td", "details", "fieldset", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in names of what readers and advertisers add; an article among them is not the page's own.
READERS = {
    "ad", "ads", "adslot", "adsense", "advert", "adverts", "advertise", "advertisement", "advertisements", "advertising", "advertorial", "comment", "comments", "commentlist", "disqus", "recommendation", "recommendations",
    "outbrain", "promoted", "recommended", "related", "replies", "reply", "respond", "sponsor", "sponsored", "sponsors", "taboola", "teaser", "teasers",
}
#: Words in names of what serves the page.
SERVICE = {
    "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "gdpr", "header", "lightbox", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "notifications", "overlay", "pager", "pagination", "popup", "promo", "promos", "promotion", "searchform", "share", "sharing", "sidebar", "signup", "social", "subscribe",
    "subscription", "toast", "toolbar", "topbar", "widget", "widgets",
}
#: Words that say nothing of what an element holds.
GENERIC = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "entry", "first", "fixed", "form", "full", "global", "icon", "icons", "id", "inline", "inner", "item",
    "items", "large", "last", "left", "link", "links", "list", "main", "media", "mobile", "outer", "page", "pages", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "the", "this",
    "thread", "top", "unit", "user", "wide", "wrap", "wrapper",
}
#: Places of a block: surely boilerplate, boilerplate if its names can be trusted, nothing known, in the main text.
BAD, DOUBTFUL, UNKNOWN, MAIN = -2, -1, 0, 1
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Names that say what a page has or lacks, not what the element is.
_MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|without|no)[_-][^\s]*|[^\s]*[_-](?:enabled|disabled|open|closed)(?=\s|$))", re.I)
#: Sections of an article that are named like lists of links.
_OWN_SECTION = re.compile(r"(?:^|\s)related[_-]?(?:work|works|research|literature|studies)(?:$|\s)", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?:$|[\s_-])", re.I)
#: Names of the main text itself, which undo a boilerplate name (not an element) around them.
_MAIN_NAME = re.compile(r"(?:^|\s)(?:(?:article|entry|post|story)[_-](?:body|content|text)|main[_-](?:content|text))(?:$|\s)", re.I)
_MAIN_ID = re.compile(r"(?:main|content|main[_-]?content)$", re.I)


def _sample(rng: np.random.Generator, least: int, most: int) -> str:
    return " ".join(f"word{n}" for n in rng.integers(0, 999, rng.integers(least, most + 1)))


def labelled_pages(n: int = 200, seed: int = 1) -> list[tuple[str, list[str]]]:
    """The labelled table: pages of ten layouts with invented words, and the texts of their content blocks.

    Layouts 0 to 5 are regular: sectioning elements; named divs; divs without names; a layout table; a blog theme whose
    wrapper is named after its sidebar; and one with a form around everything. In 6 to 9 places mislead: lists of links
    without names stand inside the article, headings are links, sections of the text have names of boilerplate, and
    whole pages, menus included, stand in wrappers with such names. Nameless pages have a title that counts as a header.
    """
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        words = lambda a, b: _sample(rng, a, b)
        link = lambda a, b: f'<a href="/{rng.integers(99)}">{words(a, b)}</a>'
        nav = "".join(f"<li>{link(1, 3)}</li>" for _ in range(rng.integers(2, 7)))
        teasers = "".join(f"<div>{link(3, 9)}</div>" for _ in range(rng.integers(2, 6)))
        foot = f"<p>{words(3, 9)}</p>"
        title, body = words(2, 9), []
        for i in range(rng.integers(3, 9)):
            kind = rng.random() if 0 < i else 1.0
            body.append(f"<p>{words(2, 8)}</p>" if kind < 0.2 else f"<h2>{words(1, 6)}</h2>" if kind < 0.4 else f"<p>{words(14, 40)} {link(1, 4)} {words(5, 60)}</p>" if kind < 0.6 else f"<p>{words(20, 120)}</p>")
        body.append(f"<p>{words(25, 90)}</p>")
        if k % 10 in (0, 1, 4, 5, 6) and rng.random() < 0.4:  # a short last line, which only its place tells from a caption
            body.append(f"<p>{words(2, 8)}</p>")
        notes = "".join(f"<p>{words(4, 60)}</p>" for _ in range(rng.integers(1, 5)))
        text, main = "".join(body), f"<h1>{title}</h1>" + "".join(body)
        loose = "".join(f"<div>{link(2, 9)}</div>" for _ in range(rng.integers(3, 7)))
        prose = "".join(f"<p>{words(16, 90)}</p>" for _ in range(rng.integers(2, 5)))
        some = lambda x: x if rng.random() < 0.7 else ""  # noqa: E731  (pages may begin and end with their text)
        odd = str(rng.choice(["social-impact", "menu-planning", "banner-year", "widget-makers", "cookie-recipes", "sharing-economy", "newsletter-history"]))
        layout = k % 10
        if layout == 0:
            page = some(f"<header><h1>{words(1, 3)}</h1></header>") + some(f"<nav><ul>{nav}</ul></nav>") + f"<main><article>{main}</article></main>" + some(f"<aside>{notes}{teasers}</aside>") + some(f"<footer>{foot}</footer>")
        elif layout == 1:
            page = f'<div class="site-header">{words(1, 4)}</div><ul class="menu">{nav}</ul><div id="content" class="post">{main}</div>' + some(f'<div class="comments">{notes}</div><div class="sidebar">{teasers}</div>') + some(f'<div id="footer">{foot}</div>')
        elif layout == 2:
            page = f"<div>{nav}</div><h1>{title}</h1><div>{text}</div><div>{teasers}</div><div>{link(1, 3)} {link(1, 3)}</div>"
        elif layout == 3:
            page = f"<table><tr><td>{nav}</td><td>{text}</td></tr><tr><td>{link(1, 4)}</td></tr></table>"
        elif layout == 4:
            page = f'<body class="single right-sidebar"><div id="page" class="has-sidebar"><ul>{nav}</ul><article><header class="entry-header"><h1>{title}</h1></header>{text}</article>' + some(f'<div class="comment-list">{notes}</div>') + "</div></body>"
        elif layout == 5:
            page = f"<form action=/x><div class=navbar>{nav}</div><main>{main}</main></form>" + some(f"<div class='cookie-notice'>{words(8, 40)}</div>") + some(f"<footer>{foot}</footer>")
        elif layout == 6:  # links of other pages inside the article, without a name
            page = some(f"<nav>{nav}</nav>") + f"<article>{main}<div>{loose}</div></article>" + some(f"<footer>{foot}</footer>")
        elif layout == 7:  # headings that are links, each before its text; shares among the paragraphs
            main = "".join(f'<h2><a href="/{i}">{words(2, 9)}</a></h2><p>{words(18, 90)}</p>' for i in range(rng.integers(2, 5)))
            page = some(f"<nav>{nav}</nav>") + f"<main>{main}" + some(f"<div><div>{link(1, 2)}</div><div>{link(1, 2)}</div><div>{link(1, 2)}</div></div>") + "</main>"
        elif layout == 8:  # a section of the text with a name of boilerplate, and one of links with a name alike
            links = f'<div class="{odd}-x">{loose}</div>' if rng.random() < 0.5 else ""
            page = f'<nav>{nav}</nav><article>{main}<section class="{odd}">{prose}</section>{links}</article>' + some(f'<div class="{odd}-more"><p>{words(2, 7)}</p>{teasers}<p>{words(2, 7)}</p></div>')
            main += prose
        else:  # the whole page in a wrapper with a name of boilerplate
            page = f'<div class="{odd}-theme"><ul>{nav}</ul>{prose}' + some(f"<div>{teasers}</div>") + "</div>"
            main = prose
        kept = text if layout in (2, 3) else main
        out.append((page, [_SPACE.sub(" ", re.sub(r"<[^>]*>", "", x)).strip() for x in re.findall(r"<(?:p|h1|h2)>(.*?)</(?:p|h1|h2)>", kept)]))
    return out


def labelled(pages: list[tuple[str, list[str]]] | None = None) -> list[tuple]:
    """A row of each block of labelled pages: its features, and 1 for content."""
    rows = []
    for page, content in pages or labelled_pages():
        bs, good = blocks(page), set(content)
        rows += [(*x, int(b.text in good)) for x, b in zip(table_of(bs).tolist(), bs, strict=True)]
    return rows


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@lru_cache(8192)
def _told(names: str) -> tuple[bool, bool, bool]:
    """What names say: whether readers' or advertisers', whether surely of service, whether perhaps. Names of headers and
    footers are left to ``_place``, which knows what they head."""
    reader = sure = doubtful = False
    for word in _OWN_SECTION.sub(" ", _MODIFIER.sub("", names)).split():
        tokens = {t.lower() for t in _TOKENS.findall(word)}
        reader |= bool(tokens & READERS)
        if tokens & SERVICE:
            known = tokens <= SERVICE | GENERIC | READERS
            sure, doubtful = sure or known, doubtful or not known
    return reader, sure, doubtful


def _place(tag: str, attributes: str, place: int, named: bool, aside: int) -> tuple[int, bool, bool]:
    """The place of an element's content, whether a name (not an element) made it boilerplate, and whether it is readers'.

    aside counts the elements around it in which an article is a teaser or a reader's.
    """
    root = tag == "html" or tag == "body"
    found = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attributes)] if attributes else []
    names = " ".join(v for _, v in found)
    inside = place == MAIN
    reader, sure, doubtful = _told(names) if names and tag in NAMED else (False, False, False)
    if inside and (sure or doubtful):  # an article's own head and foot
        rest = re.sub(r"(?i)(?:^|(?<=[\s_-]))(?:header|footer)(?=[\s_-]|$)", "", names)
        reader, sure, doubtful = _told(rest)
    if tag in BOILER and not (tag == "header" and inside and not reader and not sure):
        return BAD, False, reader
    if tag == "main" or tag == "article" and not aside and not reader:  # whatever other names and forms are around it
        return MAIN, False, False
    own = tag in NAMED and not reader and bool(_MAIN_NAME.search(names) or any(k == "id" and _MAIN_ID.match(v.strip()) for k, v in found))
    if place == BAD:
        return (MAIN, False, False) if named and own and not aside else (place, named, reader)
    if (reader or sure) and not own:
        return BAD, True, reader
    if names and tag in NAMED and not reader and _GOOD_NAME.search(_MODIFIER.sub("", names)) and not doubtful:
        return MAIN, False, False
    if doubtful and not own:
        return DOUBTFUL, True, False
    return (UNKNOWN, False, False) if root else (MAIN, False, False) if own else (place, named, False)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, character references decoded, white space turned into one space.

    Time is linear in the page: open elements are counted by name, so an end tag without a start is passed over at once.
    """
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    place, named, aside, link_at, at, n = 0, False, 0, -1, 0, len(page)

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            linked = _SPACE.sub(" ", html.unescape(" ".join(links))).strip()
            out.append(Block(text, text.count(" ") + 1, linked.count(" ") + 1 if linked else 0, place))
        parts.clear()
        links.clear()

    def pop() -> str:
        nonlocal place, named, aside
        name, place, named, counted = stack.pop()
        opened[name] -= 1
        aside -= counted
        return name

    while at < n:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else n]
        if text:
            parts.append(text)
            if link_at >= 0:
                links.append(text)
        if not found:
            break
        at, tag = found.end(), (found[1] or "").lower()
        if not tag:
            continue
        closing = found[0].startswith("</")
        if tag in RAW:
            if not closing and not found[0].endswith("/>") and tag not in endless:
                end = _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    break
                else:  # its end is missing: only the tag is dropped
                    endless.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            link_at = -1 if closing else len(stack)
        if tag in INLINE or tag in MATH:
            continue
        flush()
        if tag in ("p", "li") or len(stack) < link_at:
            link_at = -1
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
                if len(stack) < link_at:
                    link_at = -1
            continue
        if stack and (stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li"):  # a paragraph ends where a block begins
            pop()
        before = (tag, place, named)
        place, named, reader = _place(tag, found[2] or "", place, named, aside)
        counted = reader or tag in ASIDE
        stack.append((*before, counted))
        opened[tag] += 1
        aside += counted
    flush()
    return out


def table_of(bs: list[Block]) -> np.ndarray:
    """A row of features for each block; beyond the ends there are no words and no links."""
    rows = [(0, 0.0), *((b.words, b.density) for b in bs), (0, 0.0)]
    return np.array([(*rows[i], *rows[i + 1], *rows[i + 2], bs[i].place) for i in range(len(bs))], float).reshape(-1, 7)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A binary tree by Gini gain: (share of content,) or (feature, threshold, left, right); ties take the first."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            loss = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, t, left)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    _, f, t, left = best
    return (f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, judge(a, x), judge(b, x)) if len(x) else np.zeros(0, bool)


@lru_cache(1)
def _own() -> tuple:
    return train(labelled())


def train(rows: list[tuple] | None = None) -> tuple:
    """The tree of labelled rows; by default that of the labelled pages."""
    if rows is None:
        return _own()
    data = np.array(rows, float)
    return grow(data[:, :-1], data[:, -1])


def main_text(page: str | None, tree: tuple) -> str:
    bs = blocks(page or "")
    return "\n".join(b.text for b, ok in zip(bs, judge(tree, table_of(bs)), strict=True) if ok)


def extract(pages: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty page, and one without content, has an empty text; an empty table gives an empty table. Broken markup
    and cut pages are read as far as they go, very long ones whole and in linear time. Repeated rows give equal rows;
    null ids and urls stay null; extra columns are ignored, whatever their names.
    """
    tree = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return held.mapInArrow(run, "page_id long, url string, text string, n_chars long")
