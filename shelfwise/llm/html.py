"""Main text of web pages by tree scoring.

Every paragraph passes points to its ancestors, one for being of some length, one per comma and
up to three by length: all of them to its parent, half to the grandparent, less further up. An
element's points are discounted by the share of its text that stands in links. The best element is
the article's container; it grows to the ``article`` or ``main`` element around it, if there is one,
and siblings with enough points of their own or plain prose join it. What is marked as menu,
header or footer by tag or role, or is hidden, never counts. What a form, fieldset, aside or dialog
holds, or an element whose class or id has an unlikely word, is left out at first; it is spared if it
holds the page's only ``article`` or ``main``, or if what is found without it is under ``LEAST_SHARE``
of the page's prose and it holds most of that (comments: only if nothing else is found).

Pages are independent, so this is one pass without a shuffle; a page is parsed in time linear in
its length, by one regular expression and a stack of open elements.

Text: character references are decoded, white space inside a block is one space, blocks are
joined in page order by one space. Nothing is cut off.

Edge cases: null or empty html, or a page without any text, gives an empty text; unclosed or
stray tags are closed or ignored as a browser would; a page of one short paragraph is kept whole;
ties go to the container that begins first; repeated rows are handled one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>",
                   re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/]+)")

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot
th thead tr ul""".split())
CLOSES = {  # an element that begins ends an open one of these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}

# Fixed values of the method: what never belongs to an article, by tag, role and class or id word.
UNLIKELY_TAGS = frozenset("nav footer button menu".split())
DOUBTFUL_TAGS = frozenset("form fieldset aside dialog".split())
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
UNLIKELY_WORDS = frozenset("""ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices
overlay pager pagination paywall popup promo promoted promotion related respond rss share sharing sidebar signup social
sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split())
LIKELY_WORDS = frozenset("article body content entry hentry main page post story text blog".split())
WORD = re.compile(r"[a-z]+")

START = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
         "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0, "th": -5.0, "body": 0.0}
PARAGRAPH = 25  # characters from which a paragraph counts as one
ARTICLE = ("article", "main")
LEAST_SHARE = 0.25


class Element:
    __slots__ = ("tag", "parent", "children", "words", "score", "chars", "linked", "order", "root",
                 "doubtful", "prose")

    def __init__(self, tag: str, parent: Element | None, words: frozenset[str] = frozenset(), root: bool = False) -> None:
        self.tag, self.parent, self.words, self.root = tag, parent, words, root
        self.children: list[Element | str] = []
        self.score, self.chars, self.linked, self.order = 0.0, 0, 0, 0
        self.doubtful, self.prose = False, 0


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare, alone in ATTRIBUTE.findall(source):
        found.setdefault((name or alone).lower(), double or single or bare)
    return found


def parse(html: str) -> Element:
    """The tree of a page without the parts that never belong to an article; other marks are noted."""
    top = Element("html", None)
    open_: list[Element] = [top]
    hidden: list[int] = []  # depth of the unlikely element that is open, as its subtree is not kept
    at, n = 0, len(html)
    last = html.rfind(">")  # no tag ends after it: what follows is text, but for a comment that is left open
    unclosed: set[str] = set()
    while at < n:
        m = (TOKEN.search(html, at, last + 1) if at <= last else None) or COMMENT.search(html, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            open_[-1].children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        if m.re is COMMENT or m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment left open hides the rest
            continue
        tag = m[2].lower()
        if m[1]:
            _end(tag, open_, hidden)
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
            if not close:
                unclosed.add(tag)
            at = close.end() if close else n if tag in ("script", "style") else at
            continue
        if tag in ("html", "head"):
            continue
        _implied(tag, open_, hidden)
        if tag in VOID:
            if not hidden and tag in ("br", "hr"):
                open_[-1].children.append("\n")
            continue
        words, unlikely, doubtful, marked = _judge(tag, m[3], open_)
        made = Element(tag, open_[-1], words, marked)
        made.doubtful = doubtful
        if not hidden:
            if unlikely:
                hidden.append(len(open_))
                open_[-1].children.append(" ")
            else:
                open_[-1].children.append(made)
        if not m[3].endswith("/") or tag in BLOCK:
            open_.append(made)
        elif hidden and hidden[-1] == len(open_):
            hidden.pop()
    return top


def _judge(tag: str, source: str, open_: list[Element]) -> tuple[frozenset[str], bool, bool, bool]:
    """Class and id words, whether the element is no part of an article, whether that is doubtful,
    whether it is marked as an article."""
    if tag in UNLIKELY_TAGS:
        return frozenset(), True, False, False
    if tag == "header" and not any(e.tag in ARTICLE for e in open_):
        return frozenset(), True, False, False
    if "=" not in source and "hidden" not in source:
        return frozenset(), False, tag in DOUBTFUL_TAGS, False
    attributes = _attributes(source)
    words = frozenset(WORD.findall((attributes.get("class", "") + " " + attributes.get("id", "")).lower()))
    role = attributes.get("role", "").lower()
    unseen = ("hidden" in attributes or attributes.get("aria-hidden") == "true"
              or "display:none" in attributes.get("style", "").replace(" ", "").lower())
    marked = role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    doubtful = tag in DOUBTFUL_TAGS or bool(words & UNLIKELY_WORDS) and tag not in (*ARTICLE, "body")
    return words, unseen or role in UNLIKELY_ROLES, doubtful, marked


def _pop(open_: list[Element], hidden: list[int], depth: int) -> None:
    del open_[depth:]
    while hidden and hidden[-1] >= depth:
        hidden.pop()


def _implied(tag: str, open_: list[Element], hidden: list[int]) -> None:
    """Closes what the start of ``tag`` ends: an open paragraph, list item, row or cell."""
    if tag in BLOCK:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag == "p":
                _pop(open_, hidden, depth)
                break
            if open_[depth].tag in BLOCK:
                break
    if tag in CLOSES:
        ends, within = CLOSES[tag]
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in within:
                break
            if open_[depth].tag in ends:
                _pop(open_, hidden, depth)
                if tag != "tr" or not any(e.tag == "tr" for e in open_[depth - 1:]):
                    break


def _end(tag: str, open_: list[Element], hidden: list[int]) -> None:
    for depth in range(len(open_) - 1, 0, -1):
        if open_[depth].tag == tag:
            _pop(open_, hidden, depth)
            return
        if tag not in BLOCK and open_[depth].tag in BLOCK:
            return


def blocks(element: Element) -> list[str]:
    """The text of the blocks of a subtree, in page order; no block is empty."""
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append(text)

    stack: list[Element | str | None] = [element]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        else:
            if item.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return found


def _measure(top: Element) -> list[Element]:
    """Sets characters, linked characters and points of all elements; returns them in page order."""
    order: list[Element] = []
    stack = [top]
    while stack:
        e = stack.pop()
        e.order = len(order)
        order.append(e)
        stack.extend(c for c in reversed(e.children) if not isinstance(c, str))
    for e in order:
        e.chars = e.linked = 0
        e.score = START.get(e.tag, -5.0 if re.fullmatch("h[1-6]", e.tag) else 0.0)
        if e.words & LIKELY_WORDS:
            e.score += 25.0
    for e in reversed(order):
        own = "".join(c if isinstance(c, str) else " " for c in e.children)
        e.chars += len(" ".join(own.split()))
        if e.tag == "a":
            e.linked = e.chars
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
    for e in order:
        # A paragraph is a block whose text stands in it directly or in inline elements.
        if e.tag not in BLOCK or e.tag in ("html", "body") and not any(isinstance(c, str) and c.strip() for c in e.children):
            continue
        text = _inline(e)
        if not text:
            continue
        points = (len(text) >= PARAGRAPH) + text.count(",") + min(len(text) / 100.0, 3.0)
        points *= 1.0 - min(1.0, e.linked / max(1, e.chars))
        heir, level = (e.parent if e.tag == "p" or e.tag in ("li", "h1", "h2", "h3", "h4", "h5", "h6") else e), 0
        while heir is not None:
            heir.score += points if level == 0 else points / 2.0 if level == 1 else points / (3.0 * level)
            heir, level = heir.parent, level + 1
    return order


def _inline(e: Element) -> str:
    parts: list[str] = []
    stack: list[Element | str] = list(reversed(e.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag not in BLOCK:
            stack.extend(reversed(item.children))
    return " ".join("".join(parts).split())


def _links(e: Element) -> float:
    return e.linked / e.chars if e.chars else 0.0


def _article(top: Element) -> str:
    """The text of the best element of a tree and of what belongs to it."""
    order = _measure(top)
    best = max((e for e in order if e.chars and e.tag in BLOCK),
               key=lambda e: (e.score * (1.0 - _links(e)), -e.order), default=None)
    if best is None:
        return " ".join(blocks(top))
    around: Element | None = best
    while around is not None:
        if around.tag in ARTICLE or around.root:
            return " ".join(blocks(around))
        around = around.parent
    if best.parent is None:
        return " ".join(blocks(best))
    enough = max(10.0, 0.2 * best.score)
    kept: list[str] = []
    for c in best.parent.children:
        if c is best:
            kept += blocks(c)
        elif isinstance(c, Element) and c.chars:
            prose = c.tag == "p" and _links(c) < 0.25 and (c.chars > 80 or c.linked == 0 and re.search(r"\.( |$)", _inline(c)))
            if c.score * (1.0 - _links(c)) >= enough or prose:
                kept += blocks(c)
    return " ".join(kept)


def _walk(top: Element) -> Iterator[Element]:
    stack = [top]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(c for c in reversed(e.children) if not isinstance(c, str))


def _doubts(e: Element | None) -> list[Element]:
    """The doubtful elements that an element is or stands in."""
    found = []
    while e is not None:
        if e.doubtful:
            found.append(e)
        e = e.parent
    return found


def _weigh(order: list[Element]) -> None:
    """Sets ``prose``: the characters of paragraphs in an element, without linked text."""
    for e in order:
        e.prose = e.linked = 0
    for e in reversed(order):
        if e.tag == "a":
            e.linked = len(_inline(e))
        elif e.tag in BLOCK or e.parent is None:
            n = len(_inline(e)) - e.linked
            e.prose += n if n >= PARAGRAPH else 0
        if e.parent is not None:
            e.parent.prose += e.prose
            if e.tag not in BLOCK:
                e.parent.linked += e.linked


def _without(doubtful: list[Element], spared: set[Element], top: Element) -> str:
    """The article of the tree without the doubtful elements that are not spared."""
    cut = {e for e in doubtful if e not in spared}
    whole = [(p, p.children) for p in {e.parent for e in cut}]
    for p, children in whole:
        p.children = [" " if c in cut else c for c in children]
    text = _article(top)
    for p, children in whole:
        p.children = children
    return text


def main_text(html: str | None) -> str:
    """The article's text, blocks joined by one space."""
    if not html:
        return ""
    top = parse(html)
    order = list(_walk(top))
    doubtful = [e for e in order if e.doubtful]
    if not doubtful:
        return _article(top)
    _weigh(order)
    marks = [(len(doubts), doubts) for e in order if (e.tag in ARTICLE or e.root) and e.prose and not e.words & UNLIKELY_WORDS
             for doubts in [_doubts(e)]]
    least = min((n for n, _ in marks), default=0)
    spared = {d for n, doubts in marks if n == least for d in doubts}
    text = _without(doubtful, spared, top)
    if len(text) < LEAST_SHARE * top.prose:
        more = {e for e in doubtful if 2 * e.prose > top.prose and not (text and e.words & COMMENT_WORDS)} - spared
        if more:
            spared |= more
            text = _without(doubtful, spared, top)
    return text or _without(doubtful, set(doubtful), top)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
