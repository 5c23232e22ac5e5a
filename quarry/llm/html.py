"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' figures.

The page is cut into flat blocks of text at block-level tags; what is no text to read (comments, scripts, styles, the head)
is left out. A block has its number of words and its link density (share of characters in links), those of the blocks
before and after it, whether it stands in an element made for running text (paragraphs, headings, quotations, cells), and
whether it lies inside an article or inside what a page marks as furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments; a name marks it only if all its words do, and a form only if it holds less than half). A CART decision tree (Gini impurity), trained here on the small labelled table LABELLED,
keeps or drops each block; in pages without any mark the words and link densities decide.

Nulls and odd cases: a null or empty page, or one without main text, gives the empty text and n_chars 0. Unclosed and
stray tags are tolerated: an end tag closes the nearest open element of its name, or nothing; a head ends where the first
element of a body begins; only script, style and comments run to the page's end when unclosed, other elements whose text
is left out are then taken as empty. Ids may be null or repeat; extra columns are ignored; an empty table gives an empty
result. No part of a page is capped or cut, and the work grows in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

#: Element names and marks (fixed values).
TO_END = {"script", "style"}
UNREAD = {"title", "textarea", "select", "iframe", "noscript", "template", "svg", "canvas"}
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "html", "head"}
FURNITURE = {"nav", "header", "footer", "aside", "menu", "dialog"}
FORMS = {"form", "fieldset"}
ARTICLE = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = HEADING | {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption", "address", "summary"}
#: Parts of class names, ids and roles: of furniture, of furniture whatever else is said, of articles, of layout.
SOFT = set("banner promo promos notice popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets footer header masthead share sharing social related recommended copyright legal toolbar pagination pager tags complementary contentinfo".split())
HARD = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments reply replies disqus respond".split())
GOOD = set("article articles content entry post story main text body".split())
#: Words that say nothing by themselves: a name is furniture only if it has no others beside furniture's.
PLAIN = set("list box block area section form wrapper wrap container inner outer item items slot unit link links bar top bottom left right main primary secondary site page global local header head foot title mobile desktop sticky fixed small large new wp id".split())
LAYOUT = {"has", "with", "no", "without", "is", "js", "tag", "category", "cat", "lang", "layout", "page", "theme"}
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
TAG_PART = re.compile(r"""=\s*(["'])|>""")
ANCHOR = re.compile(r"<(/?)a(?=[\s>/])", re.I)


class Block(NamedTuple):
    text: str
    words: int
    link: float
    textual: bool
    article: bool
    furniture: bool
    form: bool = False


def marks(attributes: str) -> tuple[bool, bool, bool]:
    """(soft furniture, hard furniture, article) by the names that a tag carries."""
    soft = hard = good = False
    for _, *values in ATTRIBUTE.findall(attributes):
        for name in "".join(values).lower().split():
            parts = [p for p in re.split(r"[_\W]+", name) if p]
            if not parts or parts[0] in LAYOUT:
                continue
            # a word beside others is no sign: side-by-side, newsletter-history and cookie-recipe are names of text
            only = all(p in HARD or p in SOFT or p in PLAIN or p[-1].isdigit() for p in parts)
            is_hard = only and bool(HARD.intersection(parts))
            is_soft = only and bool(SOFT.intersection(parts))
            hard |= is_hard
            soft |= is_soft
            good |= not is_hard and not is_soft and bool(GOOD.intersection(parts))
    return soft, hard, good


class Page:
    """Cuts a page into flat blocks in one pass."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.found: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        # open elements: (name, hard, article, soft marks and forms counted outside an article, textual)
        self.open: list[tuple[str, bool, bool, tuple[int, int], bool]] = []
        self.names: Counter[str] = Counter()
        self.hard = self.soft = self.good = self.textual = self.forms = 0
        self.in_link = self.in_head = False
        self.lacks: set[str] = set()  # what the rest of the page has none of
        self.pattern: dict[str, re.Pattern[str]] = {}
        self.read()
        # a form that holds most of a page's words is how the page is made, no form to fill in
        if 2 * sum(b.words for b in self.found if b.form) > sum(b.words for b in self.found):
            self.found = [b._replace(furniture=False) if b.form else b for b in self.found]

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(p for p, _ in self.parts).split())
            if text:
                linked = sum(len("".join(p.split())) for p, link in self.parts if link)
                self.found.append(Block(text, len(text.split()), linked / max(1, len("".join(text.split()))), self.textual > 0, self.good > 0, self.hard + self.soft + self.forms > 0, self.forms > 0 and not self.hard + self.soft))
            self.parts.clear()

    def push(self, name: str, attributes: str) -> None:
        if name in ARTICLE:
            # a menu that nobody closed ends where an article begins
            for open_menu in ("nav", "menu"):
                self.end(open_menu)
        soft, hard, good = marks(attributes)
        inside = self.good > 0
        if name in FURNITURE and not (name == "header" and inside):
            hard = True
        # an article outweighs mere parts of class names, its own and those around it, and a form around it
        article = (name in ARTICLE or good) and not hard
        if article or (inside and not hard):
            soft = False
        held = self.soft, self.forms
        if name in ARTICLE and not hard:
            self.soft = self.forms = 0
        textual = name in TEXTUAL
        self.open.append((name, hard, article, held, textual))
        self.names[name] += 1
        self.hard += hard
        self.soft += soft
        self.forms += name in FORMS
        self.good += article
        self.textual += textual

    def pop(self) -> None:
        name, hard, article, held, textual = self.open.pop()
        self.names[name] -= 1
        self.hard -= hard
        self.soft, self.forms = held
        self.good -= article
        self.textual -= textual

    def end(self, name: str) -> None:
        if self.names[name]:
            while self.open[-1][0] != name:
                self.pop()
            self.pop()

    def text(self, a: int, b: int) -> None:
        if a < b:
            piece = self.page[a:b]
            if self.in_head:
                if not piece.strip():
                    return
                self.in_head = False
            self.parts.append((html.unescape(piece), self.in_link))

    def find(self, what: str, at: int) -> int:
        """Place of a string from at on, or -1; remembered once there is none."""
        if what in self.lacks:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.lacks.add(what)
        return i

    def tag_end(self, at: int) -> int:
        """Place after the > that ends a tag; one in a quoted value doesn't. -1: none."""
        while self.find(">", at) >= 0 and (m := TAG_PART.search(self.page, at)):
            if m.group() == ">":
                return m.end()
            i = self.find(m.group(1), m.end())
            at = i + 1 if i >= 0 else m.end()
        return -1

    def skip(self, name: str, at: int) -> int:
        """Place after the end tag of an element whose text is left out; at, if it has none before the next of its name."""
        if name in self.lacks:
            return len(self.page) if name in TO_END else at
        if name not in self.pattern:
            self.pattern[name] = re.compile(rf"<(/?){name}(?=[\s>/])", re.I) if name not in TO_END else re.compile(rf"<(/){name}(?=[\s>/])", re.I)
        m = self.pattern[name].search(self.page, at)
        if not m:
            self.lacks.add(name)
            return len(self.page) if name in TO_END else at
        if not m.group(1):
            return at
        i = self.find(">", m.end())
        return i + 1 if i >= 0 else len(self.page)

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                break
            self.text(at, lt)
            at = lt
            if page.startswith("<!--", lt):
                i = self.find("-->", lt + 4)
                at = i + 3 if i >= 0 else n
                continue
            if page.startswith(("<!", "<?"), lt):
                i = self.find(">", lt)
                if i >= 0:
                    at = i + 1
                    continue
            closing = page.startswith("/", lt + 1)
            m = NAME.match(page, lt + 1 + closing)
            after = self.tag_end(m.end()) if m else -1
            if not m or after < 0:
                self.text(lt, lt + 1)  # no tag
                at = lt + 1
                continue
            at = after
            name, rest = m.group().lower(), page[m.end() : after - 1]
            at = self.end_tag(name, at) if closing else self.start_tag(name, rest, at)
        self.text(at, n)
        self.close_block()

    def end_tag(self, name: str, at: int) -> int:
        if name == "head":
            self.in_head = False
        if name == "a":
            self.in_link = False
        elif name not in INLINE:
            self.close_block()
        if name not in VOID:
            self.end(name)
        return at

    def start_tag(self, name: str, rest: str, at: int) -> int:
        if name == "head":
            self.in_head = True
        elif self.in_head and name not in IN_HEAD:
            self.in_head = False
        empty = rest.rstrip().endswith("/")
        if name in TO_END or name in UNREAD:
            if name not in INLINE and name in UNREAD:
                self.close_block()
            return at if empty and name not in TO_END else self.skip(name, at)
        if name == "a":
            # a link without an end tag before the next link holds nothing
            m = ANCHOR.search(self.page, at)
            self.in_link = bool(m and m.group(1))
        elif name not in INLINE:
            self.close_block()
        if name in VOID or empty or name in ("html", "head", "body"):
            return at
        if name not in INLINE:
            # a paragraph ends where another block begins, a list item where the next one does
            while self.open and (self.open[-1][0] == "p" or (self.open[-1][0] in HEADING and name in HEADING)):
                self.pop()
            if name == "li" and self.names["li"]:
                i = len(self.open) - 1
                while i >= 0 and self.open[i][0] not in ("li", "ul", "ol", "menu"):
                    i -= 1
                if i >= 0 and self.open[i][0] == "li":
                    self.end("li")
            self.push(name, rest)
        elif rest and name in ("span", "label", "small"):
            soft, hard, _ = marks(rest)
            if hard or soft:
                self.close_block()
                self.push(name, rest)
        return at


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    return Page(page).found


Row = tuple[float, ...]


def features(found: list[Block]) -> list[Row]:
    """words, link density, both of the block before and after, then textual, article, furniture.

    Neighbours are blocks that are no furniture, if the block is none."""
    none = Block("", 0, 0.0, False, False, False)
    before, after = [none] * len(found), [none] * len(found)
    for places, out in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last = {False: none, True: none}
        for i in places:
            out[i] = last[found[i].furniture]
            last[found[i].furniture] = found[i]
    return [
        (float(b.words), b.link, float(p.words), p.link, float(n.words), n.link, float(b.textual), float(b.article), float(b.furniture))
        for b, p, n in zip(found, before, after, strict=True)
    ]


#: Labelled blocks: words, link density; the same before; the same after; textual, article, furniture; 1 main text.
LABELLED: list[tuple[Row, int]] = [
    # marked as furniture: menus, notices, adverts, sidebars with prose, comments of readers
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1), 0),
    ((2, 1.0, 1, 1.0, 12, 0.0, 0, 0, 1), 0),
    ((8, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1), 0),
    ((25, 0.0, 1, 1.0, 10, 0.0, 1, 0, 1), 0),
    ((60, 0.1, 40, 0.0, 30, 0.0, 1, 0, 1), 0),
    ((14, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1), 0),
    ((45, 0.0, 80, 0.0, 45, 0.0, 1, 1, 1), 0),
    ((20, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1), 0),
    ((5, 1.0, 50, 0.0, 60, 0.0, 0, 1, 1), 0),
    ((120, 0.0, 20, 0.0, 0, 0.0, 1, 0, 1), 0),
    ((3, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1), 0),
    ((8, 0.0, 40, 0.0, 40, 0.0, 0, 1, 1), 0),
    ((1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), 0),
    ((20, 0.1, 10, 0.0, 30, 0.0, 0, 1, 1), 0),
    ((2, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1), 0),
    ((60, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1), 0),
    ((90, 0.1, 90, 0.0, 0, 0.0, 0, 0, 1), 0),
    ((45, 0.0, 80, 0.0, 45, 0.0, 0, 1, 1), 0),
    ((150, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1), 0),
    ((35, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1), 0),
    ((70, 0.0, 20, 0.0, 35, 0.0, 0, 1, 1), 0),
    # articles that are marked
    ((10, 0.0, 0, 0.0, 30, 0.0, 1, 1, 0), 1),
    ((3, 0.0, 8, 0.0, 30, 0.0, 1, 1, 0), 1),
    ((1, 0.0, 40, 0.0, 1, 0.0, 1, 1, 0), 1),
    ((1, 0.0, 1, 0.0, 35, 0.0, 1, 1, 0), 1),
    ((1, 0.0, 14, 0.0, 14, 0.0, 0, 1, 0), 1),
    ((90, 0.0, 10, 0.0, 60, 0.0, 1, 1, 0), 1),
    ((150, 0.05, 20, 0.0, 14, 0.0, 0, 1, 0), 1),
    ((40, 0.3, 30, 0.0, 30, 0.1, 1, 1, 0), 1),
    ((4, 1.0, 60, 0.0, 70, 0.0, 1, 1, 0), 1),
    ((6, 0.6, 40, 0.0, 20, 0.0, 0, 1, 0), 1),
    ((2, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0), 1),
    ((2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((5, 0.0, 60, 0.0, 3, 0.0, 1, 1, 0), 1),
    ((8, 0.0, 4, 0.0, 6, 0.0, 0, 1, 0), 1),
    ((12, 0.0, 80, 0.0, 5, 0.0, 0, 1, 0), 1),
    ((6, 0.0, 2, 1.0, 6, 0.0, 1, 1, 0), 1),
    ((20, 0.0, 30, 0.0, 1, 1.0, 1, 1, 0), 1),
    ((15, 0.0, 15, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((4, 1.0, 20, 0.0, 10, 0.0, 1, 1, 0), 1),
    ((6, 1.0, 60, 0.0, 0, 0.0, 1, 1, 0), 1),
    ((2, 1.0, 5, 0.0, 5, 0.0, 1, 1, 0), 1),
    # lists of links in them
    ((2, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0), 0),
    ((3, 1.0, 40, 0.0, 2, 1.0, 0, 1, 0), 0),
    ((5, 1.0, 4, 1.0, 14, 0.0, 0, 1, 0), 0),
    ((4, 0.9, 2, 1.0, 0, 0.0, 0, 1, 0), 0),
    # pages without marks: menus, lists of links, bylines, notices
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0),
    ((2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0),
    ((2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0), 0),
    ((4, 0.9, 2, 1.0, 30, 0.0, 0, 0, 0), 0),
    ((6, 0.8, 60, 0.0, 5, 1.0, 0, 0, 0), 0),
    ((30, 0.8, 12, 0.0, 40, 0.1, 0, 0, 0), 0),
    ((30, 0.7, 60, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((60, 0.9, 3, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((45, 0.8, 50, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((5, 0.0, 2, 1.0, 4, 0.5, 0, 0, 0), 0),
    ((8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0), 0),
    ((6, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0), 0),
    ((12, 0.0, 1, 1.0, 25, 0.0, 0, 0, 0), 0),
    ((10, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0), 0),
    ((12, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0), 0),
    ((3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0), 0),
    ((2, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), 0),
    ((15, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((8, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((9, 0.3, 60, 0.0, 3, 1.0, 0, 0, 0), 0),
    ((5, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0), 0),
    # bare text, a sentence under a heading
    ((30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((20, 0.0, 4, 0.0, 40, 0.0, 0, 0, 0), 1),
    # and their prose: long blocks, and short ones in elements for text
    ((40, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0), 1),
    ((70, 0.1, 30, 0.0, 20, 0.0, 0, 0, 0), 1),
    ((25, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0), 1),
    ((120, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 1),
    ((35, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((55, 0.2, 70, 0.0, 8, 0.0, 1, 0, 0), 1),
    ((40, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0), 1),
    ((12, 0.0, 40, 0.0, 55, 0.0, 1, 0, 0), 1),
    ((12, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0), 1),
    ((3, 0.0, 70, 0.0, 60, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 21, 0.0, 21, 0.0, 1, 0, 0), 1),
    ((2, 0.0, 0, 0.0, 20, 0.0, 1, 0, 0), 1),
    ((7, 0.0, 1, 1.0, 45, 0.0, 1, 0, 0), 1),
    ((10, 0.0, 9, 0.0, 30, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 8, 0.0, 12, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 8, 0.0, 1, 0.0, 1, 0, 0), 1),
    ((2, 0.0, 1, 0.0, 8, 0.0, 1, 0, 0), 1),
    ((6, 0.0, 12, 0.0, 9, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 6, 0.0, 8, 0.0, 1, 0, 0), 1),
    ((4, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0), 1),
    ((20, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), 1),
    ((10, 0.3, 40, 0.0, 40, 0.0, 1, 0, 0), 1),
    ((28, 0.0, 20, 0.0, 3, 1.0, 1, 0, 0), 1),
    ((33, 0.0, 40, 0.0, 2, 1.0, 1, 0, 0), 1),
    ((24, 0.1, 30, 0.0, 2, 1.0, 1, 1, 0), 1),
    ((26, 0.0, 0, 0.0, 50, 0.0, 1, 0, 0), 1),
    ((30, 0.0, 30, 0.0, 30, 0.0, 1, 0, 0), 1),
    ((23, 0.0, 12, 0.0, 6, 0.0, 1, 1, 0), 1),
    ((2, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0), 1),
    ((4, 0.0, 2, 1.0, 20, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 2, 1.0, 1, 0.0, 1, 0, 0), 1),
    ((3, 0.0, 4, 1.0, 40, 0.0, 1, 1, 0), 1),
    ((3, 0.0, 2, 1.0, 1, 1.0, 1, 0, 0), 0),
    ((1, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0), 0),
    ((1, 1.0, 20, 0.0, 5, 0.0, 1, 0, 0), 0),
    ((1, 1.0, 20, 0.0, 2, 1.0, 1, 0, 0), 0),
    ((2, 1.0, 90, 0.0, 1, 1.0, 1, 0, 0), 0),
    ((3, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((6, 0.9, 30, 0.0, 3, 1.0, 1, 0, 0), 0),
]

Tree = int | tuple[int, float, "Tree", "Tree"]


def grow(rows: list[tuple[Row, int]], depth: int = 10) -> Tree:
    """CART: the split of least Gini impurity, halfway between neighbouring values; ties to the earlier feature and value."""
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)) or not depth:
        return int(2 * ones >= len(rows))
    best: tuple | None = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            cut = (lo + hi) / 2
            impurity = 0.0
            for side in ([y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]):
                p = sum(side) / len(side)
                impurity += len(side) * p * (1 - p)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


def decide(tree: Tree, row: Row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars for every row of pages."""
    small_batches(pages.sparkSession)
    tree = grow(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("html")
            texts = [main_text(col[i].as_py(), tree) for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string"
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
