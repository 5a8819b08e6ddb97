"""Main text of web pages by line-block distribution.

The page is turned into lines, one per block of text, with markup stripped; the
bounds of a container and each removed part (navigation, advert, form, ...) stand as a
run of empty lines. A line's weight is its text outside links. Weights are summed over
sliding windows of WINDOW lines: text begins at a surge (a window sum above SURGE, or
above SHARE of the page's largest sum if that is less, whose first line has text) and
ends at the dive point, where the sum has fallen to nothing. The text between surge and
dive points is kept. Lines in an article or main element need no surge.

What is kept tells where the article is: the least container that holds all of it. Its
other lines (headlines and short lines with a container of their own) are kept as well,
if they are the smaller part of it. A run of lines with a container of its own whose
words are those of a notice is left out everywhere.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
SURGE = 120             # a window sum above this starts a text
SHARE = 0.5             # on pages of short lines, one above this share of the page's largest does
REST = 0.5              # other lines of the article are at most this share of what surges
LINK_SHARE = 0.6        # a line with a larger share of link text has no weight

# Elements and names of parts that aren't the article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "noembed", "noframes", "xmp"}
SKIPPED = {
    "aside", "button", "canvas", "dialog", "fieldset", "footer", "form", "head", "header", "input", "menu", "nav",
    "object", "option", "select",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "div", "main", "section"}      # windows don't reach over their bounds
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
    "cookies", "consent", "disclaimer", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promoted", "related", "reply",
    "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "ad-banner", "ad-container", "ad-slot", "comment-form", "comment-list", "cookie-banner", "cookie-bar", "cookie-consent",
    "cookie-notice", "login-form", "main-menu", "main-nav", "nav-bar", "nav-menu", "page-footer", "page-header",
    "related-articles", "related-posts", "share-buttons", "site-footer", "site-header", "social-links",
}
NAME_PARTS = {"comment", "comments", "cookie", "cookies"}     # of a class or id, wherever in it
ROLES = {"banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "alert"}

# Parts that aren't the article however much text they hold, unless an article or main is in them.
NEVER = {"button", "canvas", "footer", "head", "input", "menu", "nav", "object", "option", "select"}
# A start tag closes an open element of the group, up to one of the bounds.
TABLE_PARTS = {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
STRUCTURE = BLOCKS | SKIPPED
IMPLIED = {
    "li": [({"li"}, {"ol", "ul", "menu", "table"})], "option": [({"option"}, {"select"})],
    "dt": [({"dt", "dd"}, {"dl", "table"})], "dd": [({"dt", "dd"}, {"dl", "table"})],
    "td": [({"td", "th"}, {"table", "tr"})], "th": [({"td", "th"}, {"table", "tr"})], "tr": [({"tr"}, {"table"})],
    **{tag: [({"tbody", "thead", "tfoot"}, {"table"})] for tag in ("tbody", "thead", "tfoot")}, "body": [({"head"}, set())],
}
ENDS_P = STRUCTURE - {"body", "button", "canvas", "caption", "head", "html", "input", "object", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_BOUNDS = {"button", "caption", "object", "table", "td", "th"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for kind, *values in _NAME.findall(attributes):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value.strip() in ROLES:
                return True
        elif NAMES.intersection(value.split()) or NAME_PARTS.intersection(re.split(r"[\s_-]+", value)):
            return True
    return bool(_HIDDEN.search(attributes))


class _Element:
    """An open tag: where it ends in the list of pieces, and how much text is in it."""

    __slots__ = ("tag", "start", "unwanted", "end", "block", "before", "size", "first", "share", "main")

    def __init__(self, tag: str, start: int, unwanted: bool, before: int):
        self.tag, self.start, self.unwanted, self.before = tag, start, unwanted, before
        self.end = self.block = None    # past the last piece; the first block below
        self.size = self.first = 0      # text outside links; of it, before the first block
        self.share = 0                  # of it, in the largest article
        self.main = False               # holds a main element


def _pieces(page: str) -> list[tuple]:
    """The page as ("text", text), ("open", tag, attributes), ("close", tag); raw elements left out."""
    out, at, size = [], 0, len(page)
    while at < size:
        match = _TAG.search(page, at)
        if match is None:
            out.append(("text", page[at:]))
            break
        if match.start() > at:
            out.append(("text", page[at:match.start()]))
        at = match.end()
        if match.group(1) is not None:
            out.append(("text", match.group(1).replace("&", "&amp;")))
        elif match.group(3) is not None:
            closing, tag, attributes = bool(match.group(2)), match.group(3).lower(), match.group(4)
            if tag in RAW:
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
            else:
                out.append(("close", tag) if closing else ("open", tag, attributes))
    return out


def _end_bounds(tag: str) -> set[str]:
    """An end tag closes no element outside one of these."""
    if tag == "table":
        return set()
    if tag in TABLE_PARTS:
        return {"table"}
    return {"td", "th"} if tag in STRUCTURE else STRUCTURE


def _removed(pieces: list[tuple]) -> dict[int, int]:
    """First piece of each removed part: the piece to go on with."""
    stack: list[_Element] = []
    waiting: list[_Element] = []    # unwanted elements before their first block
    unwanted: list[_Element] = []
    articles: list[_Element] = []
    total = links = heads = 0
    count: Counter[str] = Counter()     # open elements by tag

    def close(to: int, end: int | None):
        nonlocal links, heads
        while len(stack) > to:
            element = stack.pop()
            count[element.tag] -= 1
            links -= element.tag == "a"
            heads -= element.tag == "head"
            element.end, element.size = end, total - element.before
            if element.tag == "article":
                element.share = max(element.share, element.size)
            if stack:
                stack[-1].share = max(stack[-1].share, element.share)
                stack[-1].main |= element.main

    def find(tags: set[str], bounds: set[str]) -> int:
        if not any(count[tag] for tag in tags):
            return -1
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in bounds:
                break
        return -1

    for at, piece in enumerate(pieces):
        if piece[0] == "text":
            if not links and not heads:
                total += len(piece[1].strip())
            continue
        tag = piece[1]
        if piece[0] == "close":
            if tag in ("body", "html"):
                continue                # what is still open then was never closed
            depth = find({tag}, _end_bounds(tag))
            if depth >= 0:
                close(depth + 1, at)
                close(depth, at + 1)
            continue
        for group, bounds in IMPLIED.get(tag, ()):
            depth = find(group, bounds)
            if depth >= 0:
                close(depth, at)
        if tag in ENDS_P and (depth := find({"p"}, P_BOUNDS)) >= 0:
            close(depth, at)
        if tag in STRUCTURE:
            for element in waiting:
                element.block, element.first = at, total - element.before
            waiting.clear()
        element = _Element(tag, at, _unwanted(tag, piece[2]), total)
        element.main = tag == "main"
        if element.unwanted:
            unwanted.append(element)
        if tag in VOID or piece[2].endswith("/"):
            element.end = at + 1
            continue
        if element.unwanted:
            waiting.append(element)
        if tag == "article":
            articles.append(element)
        links += tag == "a"
        heads += tag == "head"
        count[tag] += 1
        stack.append(element)
    close(0, None)
    largest = max((a.size for a in articles), default=0)
    out = {}
    for e in unwanted:
        if e.end is None and e.block is not None:   # never closed: takes the text up to the first block only
            if 2 * e.first <= total:
                out[e.start] = e.block
            continue
        if e.tag != "head" and (e.main or 2 * e.share >= max(1, largest)):
            continue
        if e.tag not in NEVER and 2 * e.size > total and 2 * largest <= total:
            continue
        out[e.start] = len(pieces) if e.end is None else e.end
    return out


# Words of notices: any of them in a short run, or both of the second kind in any run of few lines.
_NOTICE = re.compile(r"\b(?:cookies?|copyright|all rights reserved|subscribe|newsletter|sign up|log ?in|advertisement|sponsored)\b|©|\(c\) ?\d{4}", re.I)
_COOKIES, _CONSENT = re.compile(r"\bcookies?\b", re.I), re.compile(r"\b(?:accept|consent|agree|privacy|browser|website)\b", re.I)


class Line:
    """A line of a page; ``path`` are the containers around it, the page's first, and
    ``run`` numbers the stretches between the bounds of containers and removed parts."""

    __slots__ = ("text", "weight", "told", "path", "run")

    def __init__(self, text: str, weight: float, told: bool, path: tuple[int, ...], run: int) -> None:
        self.text, self.weight, self.told, self.path, self.run = text, weight, told, path, run


def lines_of(page: str) -> list[Line]:
    """The lines with text, in page order, removed parts left out."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = links = run = opened = 0
    inside: list[tuple[str, int]] = []      # open containers

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            weight = 0.0 if linked > LINK_SHARE * len(text) else float(len(text))
            told = any(tag in ("article", "main") for tag, _ in inside)
            lines.append(Line(text, weight, told, tuple(number for _, number in inside), run))
        linked = 0

    def cut():
        nonlocal run
        flush()
        run += 1

    pieces = _pieces(page)
    removed = _removed(pieces)
    at = 0
    while at < len(pieces):
        piece = pieces[at]
        if at in removed:
            cut()
            at = removed[at]
            continue
        at += 1
        if piece[0] == "text":
            parts.append(piece[1])
            if links:
                linked += len(piece[1].strip())
            continue
        closing, tag = piece[0] == "close", piece[1]
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            parts.append(" ")
        elif tag in CONTAINERS:
            cut()
            if not closing:
                opened += 1
                inside.append((tag, opened))
            elif any(tag == t for t, _ in inside):
                while inside.pop()[0] != tag:
                    pass
        elif tag in STRUCTURE:
            flush()
    flush()
    return lines


def _notices(lines: list[Line]) -> set[int]:
    """Runs whose words are those of a notice."""
    runs: dict[int, list[str]] = {}
    for line in lines:
        runs.setdefault(line.run, []).append(line.text)
    found = set()
    for run, texts in runs.items():
        text = " ".join(texts)
        if (len(text) <= SURGE and _NOTICE.search(text)) or (len(texts) <= WINDOW and _COOKIES.search(text) and _CONSENT.search(text)):
            found.add(run)
    return found


def _surging(lines: list[Line], window: int, surge: float) -> list[bool]:
    """Which lines lie between a surge and a dive point. Windows don't reach over the
    end of a run."""
    sums = [0.0] * len(lines)
    for i, line in enumerate(lines):
        for later in lines[i:i + window]:
            if later.run == line.run:
                sums[i] += later.weight
    surge = min(surge, SHARE * max(sums, default=0.0))
    kept, inside = [], False
    for i, line in enumerate(lines):
        if i and line.run != lines[i - 1].run:
            inside = False
        if not inside and line.weight > 0 and (line.told or sums[i] > surge):
            inside = True
        elif inside and sums[i] <= 0:
            inside = False
        kept.append(inside)
    return kept


def main_text(page: str, window: int = WINDOW, surge: float = SURGE) -> str:
    """The kept lines, joined by blank lines; empty if there is none."""
    lines = lines_of(page)
    kept, notices = _surging(lines, window, surge), _notices(lines)
    if any(k and line.run not in notices for k, line in zip(kept, lines)):
        kept = [k and line.run not in notices for k, line in zip(kept, lines)]
        path = None     # of the least container around all that is kept
        for k, line in zip(kept, lines):
            if k:
                same = [a == b for a, b in zip(path, line.path)] if path is not None else []
                path = line.path if path is None else path[:same.index(False) if False in same else len(same)]
        if path:
            around = [line.path[:len(path)] == path and line.run not in notices and line.weight > 0 for line in lines]
            text = sum(len(line.text) for k, line in zip(kept, lines) if k)
            if sum(len(line.text) for a, k, line in zip(around, kept, lines) if a and not k) <= REST * text:
                kept = [k or a for k, a in zip(kept, around)]
    return "\n\n".join(line.text for k, line in zip(kept, lines) if k)


def _extract(batches, window: int, surge: float):
    for batch in batches:
        texts = [main_text(p or "", window, surge) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
        ], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    No shuffle, and no rows in, no rows out. Pages are read whole, however long. NULL or
    empty html, or a page without text: empty text, n_chars 0.
    NULL page_id or url are handed on; repeated rows come out as often as they went
    in. Broken markup is read as far as it goes: a removed part that is never closed ends
    at the next block.
    Other columns are ignored.
    """
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    ).mapInArrow(partial(_extract, window=window, surge=surge), "page_id long, url string, text string, n_chars long")
