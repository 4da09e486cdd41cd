"""Operator 1: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element.  Lines of menus, headers, footers, sidebars,
adverts, notices and comments (by element, role, class or id) are left out; a line weighs its length,
nothing if it is mostly link text.  Weights are summed over sliding windows of ``WINDOW`` lines; a surge
point is where the sum rises over a threshold, a dive point where it falls to nothing, and the text
from each surge to its dive is kept, on every page.  Where a page names its article (``article``,
``main``) and this holds most of the text, the name counts as a weight: lines inside weigh
``ARTICLE_WEIGHT`` times their length, links too, and lines outside nothing.  A form is left out like a
menu, unless it holds most of the page's text: some sites wrap whole pages in one.  Class names and ids
are a verdict only while enough text is left without them: an element of such a name that holds
``WAIVE`` times what is left, or leaves less than a surge, is kept and those inside it are judged anew.

Scanning takes time in proportion to the page, however broken its markup is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .storage import modest_batches

WINDOW = 3
SURGE = 80
ARTICLE_WEIGHT = 2
WAIVE = 4

_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
#: The rest of a tag without angle brackets in its quotes; it ends at the next bracket at the latest.
_NEAT = re.compile(r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+>")
_BRACKET = re.compile(r"[<>]")
_MARKS = re.compile(r"[>\"']")
_ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
_DROP = frozenset("head nav footer aside menu dialog template object svg canvas audio video select button map applet datalist search".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_DROP_WORDS = frozenset(
    "ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
_OUTER_WORDS = frozenset({"header", "head", "top"})  # not inside an article
_ARTICLE_WORDS = frozenset("article content entry page post story text".split())
_STATES = frozenset("category has is layout no not tag topic with without".split())  # "has-sidebar" says something about another element
_CONDITIONS = frozenset("closed disabled enabled open".split())  # so does "comments-open"
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"option", "optgroup", "body", "html"}
_INNER = frozenset("p li span a b i".split())
_SCOPE = frozenset("ul ol dl table article section div main body html form nav aside header footer blockquote td th".split())


@dataclass
class Line:
    text: str
    linked: int
    dropped: bool
    article: bool
    heading: bool
    form: bool = False
    named: int = 0  # the innermost element around it whose class or id is a verdict


class Scanner:
    """Tags of a page from left to right, in linear time: what is found missing once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()
        self.marks: list[int] | None = None
        self.dead: set[int] = set()

    def find(self, what: str, at: int) -> int:
        """Position of ``what`` from ``at`` on, or -1."""
        if what in self.missing:
            return -1
        at = self.page.find(what, at)
        if at < 0:
            self.missing.add(what)
        return at

    def tag_end(self, at: int) -> int:
        """The first > from ``at`` that stands in no quotes, or -1.  Ways that led to no end are not gone twice."""
        if self.marks is None:
            self.marks = [m.start() for m in _MARKS.finditer(self.page)]
        way = []
        while at not in self.dead:
            way.append(at)
            k = bisect_left(self.marks, at)
            if k == len(self.marks):
                break
            mark = self.marks[k]
            if self.page[mark] == ">":
                return mark
            close = self.find(self.page[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(way)
        return -1

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, kind, name, attributes); kind is open, close, skip or text (the name is then a text).

        A caller may send a position to go on from.
        """
        page, at = self.page, 0
        while (start := self.find("<", at)) >= 0:
            at = start + 1
            if m := _NAME.match(page, start):
                if neat := _NEAT.match(page, m.end()):
                    end = neat.end() - 1
                else:
                    end = self.tag_end(m.end())
                    if end < 0:  # a quote that never ends: up to the next bracket
                        b = _BRACKET.search(page, m.end())
                        if not b or b[0] == "<":
                            continue
                        end = b.start()
                at = (yield start, end + 1, "close" if m[1] else "open", m[2].lower(), page[m.end() : end]) or end + 1
            elif page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, "skip", "", ""
            elif page.startswith("<![CDATA[", start) and (end := self.find("]]>", start + 9)) >= 0:
                at = end + 3
                yield start, at, "text", page[start + 9 : end], ""
            elif page.startswith(("<!", "<?"), start) and (end := self.find(">", start + 2)) >= 0:
                at = end + 1
                yield start, at, "skip", "", ""

    def raw_end(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup, or -1."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        end = self.find(">", m.end()) if m else -1
        if end < 0:
            self.missing.add(name)
        return end + 1 if end >= 0 else -1


class Stack:
    """Open elements: (name, dropped, article, form, named), the places of each name, and the nearest scope below each place."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, bool, bool, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scope: list[int] = []

    def top(self) -> tuple[str, bool, bool, bool, int]:
        return self.items[-1] if self.items else ("", False, False, False, 0)

    def push(self, item: tuple[str, bool, bool, bool, int]) -> None:
        k = len(self.items)
        self.scope.append(k if item[0] in _SCOPE else self.scope[-1] if self.scope else -1)
        self.places[item[0]].append(k)
        self.items.append(item)

    def pop(self) -> None:
        self.places[self.items.pop()[0]].pop()
        self.scope.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of this name; some do not reach over the edge of a block."""
        if not self.places[name] or name in _INNER and self.places[name][-1] < self.scope[-1]:
            return
        for _ in range(len(self.items) - self.places[name][-1]):
            self.pop()


def _attrs(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(s):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def _name_words(names: str) -> set[str]:
    """The words of class names and ids, without names that tell a state."""
    out: set[str] = set()
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in _STATES and words[-1] not in _CONDITIONS:
            out.update(words)
    return out


def judge(rows: list[Line], around: list[int], final: list[bool]) -> None:
    """Drop the lines inside elements whose names are a verdict, unless too little text is left.

    ``around`` has the next such element around each (0: none; outer ones come first), ``final`` whether
    the verdict stands whatever is left.
    """
    own = [0] * len(around)
    for x in rows:
        if not x.dropped and x.linked <= 0.5 * len(x.text):
            own[x.named] += len(x.text)
    held, inner = own[:], [[] for _ in around]
    for k in range(len(around) - 1, 0, -1):
        held[around[k]] += held[k]
        inner[around[k]].append(k)
    kept, waived = own[0], [k == 0 for k in range(len(around))]
    heap = [(-held[k], k) for k in inner[0] if not final[k]]
    heapify(heap)
    while heap and (most := -heap[0][0]) >= SURGE and (kept < SURGE or most >= WAIVE * kept):
        k = heappop(heap)[1]
        waived[k] = True
        kept += own[k]
        for i in inner[k]:
            if not final[i]:
                heappush(heap, (-held[i], i))
    for x in rows:
        x.dropped = x.dropped or not waived[x.named]


def lines(page: str) -> list[Line]:
    """The page's blocks in order, without those that have no text."""
    out: list[Line] = []
    around, final = [0], [False]
    stack, scan = Stack(), Scanner(page)
    parts: list[str] = []
    linked, in_link, heading, breaks = 0, False, False, 0

    def flush() -> None:
        nonlocal linked, in_link, breaks
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            _, dropped, article, form, named = stack.top()
            out.append(Line(text, linked, dropped, article, heading, form, named))
        parts.clear()
        linked, in_link, breaks = 0, False, 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        text = html.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            breaks = 0
        parts.append(text)
        if in_link:
            linked += len("".join(text.split()))

    at, tags, jump = 0, scan.tags(), None
    while True:
        try:
            start, end, kind, name, inside = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at:
            add(page[at:start])
        at = end
        if kind == "text":
            add(name)
        if kind in ("text", "skip"):
            continue
        if kind == "close":
            if name in _BLOCK:
                flush()
            elif name in ("td", "th"):
                parts.append(" ")
            if name == "a":
                in_link = False
            stack.close(name)
            heading = False if name in _BLOCK else heading
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif name in ("td", "th", "img"):
            parts.append(" ")
        if name in _RAW:
            behind = scan.raw_end(name, at)
            at = jump = behind if behind >= 0 else (len(page) if name in ("script", "style") else at)
            continue
        if name == "a":
            in_link = True
        if name in _VOID or inside.endswith("/") and name in ("svg", "path"):
            continue
        closes = _CLOSES.get(name, set()) | ({"p"} if name in _ENDS_P else set())
        while stack.items and stack.top()[0] in closes:
            stack.pop()
        if name in ("b", "i", "em", "strong", "u", "small", "font", "a", "tt", "big", "s", "strike", "code", "nobr"):
            continue  # often left open; they neither hold blocks nor mark boilerplate
        _, dropped, article, form, named = stack.top()
        attrs = _attrs(inside)
        role = attrs.get("role", "").lower()
        words = _name_words(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        whole = name in ("html", "body", "main")
        dropped = dropped or name in _DROP or role in _DROP_ROLES or name == "header" and not article
        if not whole and (words & _DROP_WORDS or not article and name != "article" and words & _OUTER_WORDS and not words & _ARTICLE_WORDS):
            around.append(named)
            final.append(bool(words & _COMMENT_WORDS))
            named = len(around) - 1
        dropped = dropped or "hidden" in attrs and not whole or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
        article = article or name in ("article", "main") or role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower()
        stack.push((name, dropped, article, form or name == "form", named))
    if at < len(page):
        add(page[at:])
    flush()
    judge(out, around, final)
    return out


def regions(lengths: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """[start, end) of the lines from each surge to its dive.

    Surge: the first line with text of a window whose sum reaches ``surge``; dive: the first line after
    which a whole window sums to nothing.
    """
    n = len(lengths)
    padded = np.concatenate([lengths, np.zeros(WINDOW, lengths.dtype)])
    sums = np.convolve(padded, np.ones(WINDOW), "full")[WINDOW - 1 : WINDOW - 1 + n]  # of lines i to i + WINDOW - 1
    out, i = [], 0
    while i < n:
        if lengths[i] and sums[i] >= surge:
            start = i
            while start and lengths[start - 1] and (not out or start - 1 >= out[-1][1]):
                start -= 1
            while i < n and sums[i] > 0:
                i += 1
            out.append((start, i))
        i += 1
    return out


def weights(rows: list[Line]) -> tuple[np.ndarray, bool]:
    """The weight of each line, and whether a named article decides it."""
    length = np.array([len(x.text) for x in rows], np.int64)
    article, links = np.array([x.article for x in rows]), np.array([x.linked > 0.5 * len(x.text) for x in rows])
    plain = np.where(links, 0, length)
    if 2 * plain[article].sum() >= max(plain.sum(), 1):
        return np.where(article, ARTICLE_WEIGHT * length, 0), True
    return plain, False


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    rows = [x for x in lines(page) if not x.dropped]
    in_forms = sum(len(x.text) for x in rows if x.form)
    if 2 * in_forms <= sum(len(x.text) for x in rows):
        rows = [x for x in rows if not x.form]
    if not rows:
        return ""
    weight, named = weights(rows)
    if not weight.any():
        return ""
    sums = np.convolve(weight, np.ones(WINDOW))
    stray = lambda k: len(rows[k].text) < 40 and not rows[k].heading and not re.search(r"[.!?…:;,\"'»”)]$", rows[k].text)
    kept: list[str] = []
    for i, j in regions(weight, min(SURGE, 0.5 * float(sums.max()))):
        block = [k for k in range(i, j) if weight[k]]
        if not named:
            while len(block) > 1 and stray(block[-1]):
                block.pop()
            while len(block) > 1 and stray(block[0]):
                block.pop(0)
        kept += [rows[k].text for k in block]
    return "\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the html column, with ``text_col`` (an old one is replaced).

    A null or empty page, or one that has boilerplate only, gives an empty text; ids are not looked at,
    repeated rows get equal results; other columns pass through.
    """
    modest_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                texts = [main_text(x) for x in some.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, text_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), f"`{text_col}` string"])
    return rows.mapInArrow(run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
