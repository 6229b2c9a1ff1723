"""Elements of pages: a scanner that takes any markup, CSS selectors, and DataFrames of the elements that they pick.

A page's elements are numbered in document order. An element holds the numbers from its own to ``leave``, so that "inside"
is an interval: an element ``e`` is inside ``c`` where ``c.node < e.node <= c.leave``. Pages are scanned where they lie,
in Arrow batches and without a shuffle, and only the elements that a selector picks become rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of HTML: elements without an end tag, and tags that end an open element of the kinds named.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {b: ("p",) for b in BLOCKS}
#: An implied end looks no further up than these.
SCOPES = ("ul", "ol", "dl", "table", "select", "body", "html", "div", "section", "article")


@dataclass(slots=True)
class Element:
    node: int
    parent: int | None
    depth: int
    tag: str
    attrs: dict[str, str]
    first: int
    leave: int = 0
    last: int = 0


@dataclass
class Page:
    """Elements in document order and the pieces of text between tags; an element's text is ``pieces[first:last]``."""

    elements: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)


class _Scanner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(), []

    def _end(self, keep: int) -> None:
        for e in self.open[keep:]:
            e.leave, e.last = len(self.page.elements) - 1, len(self.page.pieces)
        del self.open[keep:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in ENDS.get(tag, ()):
                self._end(at)
            elif self.open[at].tag in SCOPES:
                break
        up = self.open[-1] if self.open else None
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")  # the first of a name counts
        e = Element(len(self.page.elements), up.node if up else None, len(self.open), tag, given, len(self.page.pieces))
        self.page.elements.append(e)
        self.open.append(e)
        if tag in VOID:
            self._end(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't end an element that isn't void

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self._end(at)
                return

    def handle_data(self, data: str) -> None:
        self.page.pieces.append(data)


def scan(html: str | None) -> Page:
    """All elements and text pieces; elements that are never closed end with the page, stray end tags are nothing."""
    s = _Scanner()
    s.feed(html or "")
    s.close()
    s._end(0)
    return s.page


_STEP = re.compile(r"\s*(>)\s*|(\s+)|([\w*-]+)|([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*(i)?)?\s*\]", re.I)
_HOW = {
    "=": lambda own, said: own == said,
    "~=": lambda own, said: said in own.split(),
    "^=": lambda own, said: bool(said) and own.startswith(said),
    "$=": lambda own, said: bool(said) and own.endswith(said),
    "*=": lambda own, said: bool(said) and said in own,
}
Test = tuple[str, str, str, bool]


@dataclass
class Compound:
    """What one element must have; ``child`` says that it must lie directly in what the compound before it picks."""

    tag: str = "*"
    tests: list[Test] = field(default_factory=list)
    child: bool = False

    def holds(self, e: Element) -> bool:
        if self.tag not in ("*", e.tag):
            return False
        for name, how, said, fold in self.tests:
            own = e.attrs.get(name)
            if own is None or how and not _HOW[how](*((own.lower(), said.lower()) if fold else (own, said))):
                return False
        return True


def parse_selector(css: str) -> list[list[Compound]]:
    """The alternatives of a selector list: tags, ``#id``, ``.class``, attributes, descendants and children."""
    out = []
    for part in re.findall(r"(?:\"[^\"]*\"|'[^']*'|[^,])+", css):
        chain, at, part = [Compound()], 0, part.strip()
        while at < len(part):
            m = _STEP.match(part, at)
            if not m:
                raise ValueError(f"no selector: {css}")
            child, blank, tag, mark, name, attr, how, *said = m.groups()
            if child or blank:
                chain.append(Compound(child=bool(child)))
            elif tag:
                chain[-1].tag = tag.lower()
            elif mark:
                chain[-1].tests.append(("id", "=", name, False) if mark == "#" else ("class", "~=", name, False))
            else:
                chain[-1].tests.append((attr.lower(), how or "", next((s for s in said[:3] if s is not None), ""), bool(said[3])))
            at = m.end()
        out.append(chain)
    return out


def matches(chain: list[Compound], e: Element, elements: list[Element], at: int = -1) -> bool:
    if not chain[at].holds(e):
        return False
    if -at == len(chain):
        return True
    up = e.parent
    while up is not None:
        if matches(chain, elements[up], elements, at - 1):
            return True
        if chain[at].child:
            return False
        up = elements[up].parent
    return False


ELEMENT = "node int, parent int, leave int, depth int, tag string, attrs map<string,string>, pieces array<string>, picked array<int>"


def pick(pages: DataFrame, selectors: Sequence[str], keys: Sequence[str] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """A row for each element of a page that one of ``selectors`` picks: ``keys``, its place, attributes and text pieces.

    ``picked`` has the places of the selectors in the list. A null page has no elements. Nothing is shuffled.
    """
    parsed = [parse_selector(s) for s in selectors]
    source = pages.select(*keys, pages[html_col])
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL(ELEMENT).fields])
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                b = batch.slice(start, 200)
                of, rows = [], []
                for i, html in enumerate(b.column(len(keys))):
                    page = scan(html.as_py())
                    for e in page.elements:
                        if picked := [n for n, alternatives in enumerate(parsed) if any(matches(c, e, page.elements) for c in alternatives)]:
                            of.append(i)
                            rows.append((e.node, e.parent, e.leave, e.depth, e.tag, list(e.attrs.items()), page.pieces[e.first : e.last], picked))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of, pa.int64())) for k in range(len(keys))), *columns], names)

    return source.mapInArrow(run, schema)


def has(selector: int) -> Column:
    """Whether the selector at that place picked the element."""
    return F.array_contains("picked", selector)


def text_content(pieces: Column) -> Column:
    """The text as it stands, trimmed at both ends."""
    return F.regexp_replace(F.array_join(pieces, ""), r"^\s+|\s+$", "")


def joined_text(pieces: Column, separator: str = "") -> Column:
    """Every piece trimmed, the empty ones dropped, joined."""
    return F.array_join(F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""), separator)


def literal_references(html: Column, names: Sequence[str]) -> Column:
    """``html`` with every ``&`` as text that doesn't begin a reference of ``names`` with its semicolon; scripts and styles are left alone.

    HTML decodes ``&amp`` at the end of a cut text, and two thousand names; this is for callers who mean no more than theirs.
    """
    bare = re.compile(rf"(<(script|style)\b.*?(?:</\2|\Z))|&(?!(?:{'|'.join(map(re.escape, names))});)", re.I | re.S)

    @F.pandas_udf("string")
    def escaped(column):
        return column.map(lambda h: None if h is None else bare.sub(lambda m: m[1] or "&amp;", h))

    return escaped(html)


def plain_text(html: Column) -> Column:
    """The text of markup as a parser sees it: pieces joined by blanks, references decoded, white space squeezed.

    A pandas function, as no regular expression knows where a quoted ``>`` or a script ends.
    """

    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda h: " ".join(" ".join(scan(h).pieces).split()))

    return text(html)


def meta_tags(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(keys, meta)``: name or property to content of meta tags, attributes in any order; empty ones are left out, the last of a name wins."""
    a = F.col("attrs")
    name, content = F.coalesce(F.nullif(a["name"], F.lit("")), a["property"]), a["content"]
    rows = pick(pages, ["meta"], keys).select(*keys, "node", name.alias("name"), content.alias("content")).filter("name <> '' AND content <> ''")
    last = rows.groupBy(*keys, "name").agg(F.max_by("content", "node").alias("content"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "content")))).alias("meta"))


def first_text(pages: DataFrame, selectors: Sequence[str], keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(keys, text, selector)``: the trimmed text of the first element of the first selector whose first element has text.

    As a query for one element per selector does, later elements of a selector aren't asked. Pages without any have no row.
    """
    each = pick(pages, selectors, keys).select(*keys, "node", text_content(F.col("pieces")).alias("text"), F.explode("picked").alias("selector"))
    firsts = each.groupBy(*keys, "selector").agg(F.min_by("text", "node").alias("text")).filter("text <> ''")
    return firsts.groupBy(*keys).agg(F.min_by("text", "selector").alias("text"), F.min("selector").alias("selector"))


def selected(pages: DataFrame, selectors: Sequence[str], keys: Sequence[str] = ("page_id",), shown: int = 3, limit: int = 100) -> DataFrame:
    """``(keys, selector, n, texts)``: how many elements a selector picks and the first ``shown`` texts, cut at ``limit``."""
    each = pick(pages, selectors, keys).select(*keys, "node", F.substring(text_content(F.col("pieces")), 1, limit).alias("text"), F.explode("picked").alias("selector"))
    held = each.groupBy(*keys, "selector").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node", "text"))).alias("t"))
    return held.select(*keys, "selector", "n", F.transform(F.slice("t", 1, shown), lambda t: t["text"]).alias("texts"))
