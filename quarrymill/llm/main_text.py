"""Operator 4: main text of HTML pages by line-block distribution (``extract_main_text``).

Markup is stripped so that each block element becomes a line. Elements that are never article text go with their
content: scripts, styles, heads, forms, navigation, headers outside an article, footers, asides, and elements whose
class, id or role names a menu, advert, notice or comment section. Navigation, headers and footers leave empty lines,
and so do the borders of an article or main element.

Over the lines, text lengths (without link text) of three lines in turn are summed. Text surges where these blocks rise
from nothing and dives where they fall back to nothing; the text between is kept if one of its blocks passes the
threshold, or comes near the page's highest where no block of a short page does.

Elements settle only what lengths can't. If the surge with most text lies in an article, the surges in articles are the
text; if it lies outside, articles are teasers and go. Where an article has the h1, a surge outside needs three lines
to be the one with most text.

A name that is only a part of a class or id (``content-social``, ``with-sidebar``), that stands beside other names
(``news alert``) or on an article, is doubtful, unless it names comments: the element comes back where it holds four times the text
of the rest of the page, or an article longer than that rest; a main element never goes by its name.

A page that would be left without any text but headings and links is read again: an element of such a name, but for readers' comments,
is text where it lies in a main or article element, and doubtful where it has an h1 (a film review, a page of notices).

Defined results: a null, empty or markup-only page gives an empty text; very long pages are read whole, in time that
grows with their length; markup that is never closed ends with its enclosing element or the page, a quote that is never
closed is an ordinary character; of repeated attributes all count; repeated rows give a row each; an empty table gives an
empty result; only id, url and html columns are read, others may have any name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines summed in a block, and the characters that one block of a text must pass.
BLOCK_LINES, SURGE = 3, 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Element names by their role in a page.
_RAW = frozenset("script style textarea title noscript template iframe svg math select option button canvas object".split())
_DROPPED = _RAW | frozenset("head nav footer aside form menu dialog label audio video".split())
_BORDERS = frozenset("nav header footer".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommended|comments?|respond|replies|disqus|reviews?|pagination|pager|toolbar|search|widget|contentinfo|complementary|navigation)(?:$|[\s_-])",
    re.I,
)
_REPLIES = re.compile(r"(?:^|[_-])(?:comments?|respond|replies|disqus|reviews?)(?:$|[_-])", re.I)
_COMMENTS = re.compile(r"(?:^|[\s\"'_-])(?:comments?|respond|replies|disqus)(?:$|[\s\"'_-])", re.I)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_STATE = re.compile(r"(?:^|[_-])(?:with|has|no|without|is|show|hide)[_-]", re.I)
_ARTICLE = frozenset(("article", "main"))
#: A doubtful element comes back if it has so many times the text of the rest.
HOLDS = 4
_ENDED_BY_NEXT = frozenset("p li dt dd tr td th".split())


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, value)``: text, open or close; the content of raw elements is skipped."""
    at, size = 0, len(page)
    unclosed: set[str] = set()  # raw elements without an end from here on
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if (name := m.group(2)) is None:
            continue
        name = name.lower()
        if m.group(1):
            yield "close", name, ""
            continue
        yield "open", name, m.group(3)
        if name in _RAW and name not in unclosed and not m.group(3).rstrip().endswith("/"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if stop is None:
                if name in ("script", "style"):
                    return
                unclosed.add(name)
            elif name in ("script", "style", "textarea", "title"):
                at = stop.start()


def _named(name: str, value: str) -> str:
    """Whether an element's names mark it as boilerplate: "" no, "part" by some of a name only, "whole"."""
    found = ""
    for v in _NAMED.findall(value):
        names = v.strip("\"'").split()
        marks = [x for x in names if _BOILERPLATE.search(x)]
        for x in marks:
            replies = _REPLIES.search(x) and not _STATE.search(x)
            if replies or (len(marks) == len(names) and (all(_BOILERPLATE.search(part) for part in re.split("[_-]", x)) or x.lower() == "side-bar")):
                return "part" if name == "article" else "" if name == "main" else "whole"
            found = "part"
    return "" if name == "main" else found


@dataclass
class _Page:
    """A page's events in order, and its doubtful elements by number (0 is the page): parent, own text, own text in articles.

    An event is ``("line",)``, ``("text", value, owner, in a link, in an h1, in any heading)``, ``("border", owner)`` or
    ``("article", 1 or -1, owner)``; an owner is the innermost doubtful element. Sizes don't count text in links. ``barred``
    are doubtful elements of boilerplate names without an h1.
    """

    events: list[tuple]
    parent: list[int]
    size: list[int]
    cards: list[int]
    barred: list[bool]


def _read(page: str, again: bool = False) -> _Page:
    events: list[tuple] = []
    parent, size, cards, barred = [0], [0], [0], [False]
    stack: list[tuple[str, bool, int, int | None]] = []  # open elements: name, drops its content, owner before, owner of an article
    count: Counter[str] = Counter()
    articles: list[int] = []  # the owners of the open articles
    dropping = owner = 0

    def close(i: int) -> None:
        nonlocal dropping, owner
        while len(stack) > i:
            n, drops, before, article = stack.pop()
            count[n] -= 1
            dropping -= drops
            if article is not None:
                articles.pop()
                events.append(("article", -1, article))
            owner = before
            if n in _BORDERS and not dropping:
                events.append(("border", owner))

    for kind, name, value in _tokens(page):
        if kind == "text":
            if not dropping:
                events.append(("text", value, owner, count["a"] > 0, count["h1"] > 0, any(count[h] for h in _HEADINGS)))
                if not count["a"]:
                    length = len(value.strip())
                    size[owner] += length
                    if articles:
                        cards[articles[-1]] += length
            continue
        if name in _BLOCKS:
            events.append(("line",))
        if kind == "close":
            if count[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _VOID or value.rstrip().endswith("/"):
            continue
        if name in _ENDED_BY_NEXT:
            for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[i][0] == name:
                    if not any(n in _BLOCKS and n != name for n, *_ in stack[i + 1 :]):
                        close(i)
                    break
        drops = name in _DROPPED or (name == "header" and not articles)
        named = _named(name, value) if not drops and name not in ("body", "html") else ""
        strict = again and named == "whole" and not _COMMENTS.search(" ".join(_NAMED.findall(value)))
        if strict:
            named = "" if articles else "part"
        drops, before = drops or named == "whole", owner
        if named == "part" and not dropping:
            parent.append(owner)
            size.append(0)
            cards.append(0)
            barred.append(strict)
            owner = len(parent) - 1
        if name == "h1" and not dropping:
            k = owner
            while k:
                barred[k], k = False, parent[k]
        dropping += drops
        article = owner if name in _ARTICLE and not dropping else None
        if article is not None:
            articles.append(owner)
            events.append(("article", 1, owner))
        stack.append((name, drops, before, article))
        count[name] += 1
    close(0)
    events.append(("line",))
    return _Page(events, parent, size, cards, barred)


def _come_back(page: _Page) -> list[bool]:
    """Which doubtful elements are text after all, from the outermost inwards."""
    total, cards = page.size.copy(), page.cards.copy()
    inside: list[list[int]] = [[] for _ in total]
    for k in range(len(total) - 1, 0, -1):
        inside[page.parent[k]].append(k)
        if page.parent[k]:
            total[page.parent[k]] += total[k]
            cards[page.parent[k]] += cards[k]
    alive = [True] + [False] * (len(total) - 1)
    rest, edge = page.size[0], inside[0]
    while back := [k for k in edge if total[k] and not page.barred[k] and (total[k] >= HOLDS * rest or cards[k] > rest)]:
        for k in back:
            alive[k] = True
            rest += page.size[k]
        edge = [k for k in edge if not alive[k]] + [c for k in back for c in inside[k]]
    return alive


def _has_body(page: _Page, alive: list[bool]) -> bool:
    """Whether there is text outside of links and headings."""
    return any(e[0] == "text" and alive[e[2]] and not e[3] and not e[5] and e[1].strip() for e in page.events)


def lines_of(page: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, int, bool]]:
    """The page's lines in order: text, its length without links, number of the article or 0, is in an h1."""
    read = _read(page)
    alive = _come_back(read)
    if not _has_body(read, alive):
        second = _read(page, again=True)
        back = _come_back(second)
        if _has_body(second, back):
            read, alive = second, back
    out: list[tuple[str, int, int, bool]] = []
    held: list[str] = []
    linked = article = number = 0
    heading = False
    gap = [("", 0, 0, False)] * block_lines
    for kind, *event in read.events:
        if kind == "text":
            value, owner, in_link, in_h1, _ = event
            if alive[owner]:
                held.append(value)
                linked += len(value.strip()) if in_link else 0
                heading |= in_h1
        elif kind == "line":
            if held and (text := _SPACE.sub(" ", html_lib.unescape("".join(held))).strip()):
                out.append((text, max(0, len(text) - linked), number if article else 0, heading))
            held, linked, heading = [], 0, False
        elif kind == "border":
            if alive[event[0]] and not article:
                out.extend(gap)
        elif alive[event[1]]:
            if event[0] > 0 and not article:
                number += 1
                out.extend(gap)
            article += event[0]
            if not article:
                out.extend(gap)
    return out


def surges(lengths: list[int], block_lines: int = BLOCK_LINES, surge: int = SURGE) -> list[tuple[int, int]]:
    """``(surge, dive)`` line ranges between blocks without text that have a block above the threshold."""
    blocks = [sum(lengths[i : i + block_lines]) for i in range(len(lengths))]
    least = min(surge, max(blocks, default=0) // 2)
    out, start = [], None
    for i, b in enumerate([*blocks, 0]):
        if b and start is None:
            start = i
        elif not b and start is not None:
            if max(blocks[start:i]) > least:
                out.append((start, i))
            start = None
    return out


def main_text(page: str | None, block_lines: int = BLOCK_LINES, surge: int = SURGE) -> str:
    if not page:
        return ""
    lines = lines_of(page, block_lines)
    # In an article links are text too.
    inside = surges([len(text) if no else 0 for text, _, no, _ in lines], block_lines, surge)
    outside = surges([0 if no else n for _, n, no, _ in lines], block_lines, surge)
    least = block_lines if any(no and h1 for _, _, no, h1 in lines) else 1

    def most(found: list[tuple[int, int]], least: int) -> int:
        """The text of the largest surge with so many lines."""
        held = ([n for _, n, _, _ in lines[a:z] if n] for a, z in found)
        return max((sum(h) for h in held if len(h) >= least), default=0)

    found = inside if inside and most(inside, 0) >= most(outside, least) else outside
    return " ".join(text for a, z in found for text, _, _, _ in lines[a:z] if text)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_lines: int = BLOCK_LINES, surge: int = SURGE) -> DataFrame:
    """``(id, url, text, n_chars)``: a row per page."""
    source = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), block_lines, surge) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
