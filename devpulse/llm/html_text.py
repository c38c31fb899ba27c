"""The visible text of web pages, laid out as a browser would: blocks, lists, aligned tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noframes noembed title".split())
RAW = frozenset("script style iframe noembed noframes noscript xmp".split())
RAW_TEXT = frozenset("textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp plaintext listing".split()
)
SPACED = frozenset("blockquote dl fieldset figure form h1 h2 h3 h4 h5 h6 ol p pre table ul xmp menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
# an open element of the right side ends when one of the left side starts, unless a wall stands between
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, "body": {"head"},
}
WALLS = {"li": LISTS | {"table", "td", "th"}, "dt": {"dl", "table", "td", "th"}, "dd": {"dl", "table", "td", "th"}}
TABLE_WALL = frozenset({"table"})

# as in HTML a quote opens a string only after '=': elsewhere it is a character like others, and the next '>' ends the tag
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_TOKEN = re.compile(
    r"""(?P<comment><!--(?:-?>|.*?--!?>|.*))|(?P<odd><[!?/](?![a-zA-Z])[^>]*+>?|<![^>]*+>?|<\?[^>]*+>?)"""
    r"""|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|<(?P<start>[a-zA-Z][^\s/>]*+)"""
    rf"""(?P<attributes>(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|(?!\s*+=)))*+(?:{_NAME}\s*+=\s*+["'])?+)>?"""
    r"""|(?P<text>[^<]++|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?""")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: a column is padded up to this width; longer cells stand out
WIDEST_COLUMN = 60
# The largest spans that HTML knows
MOST_ACROSS, MOST_DOWN = 1000, 65_534
#: lines are indented by so many characters at most, and tables within so many tables are plain blocks: else a page could grow with its square
MOST_INDENT, MOST_TABLES = 100, 50
PREFORMATTED = frozenset("pre textarea listing xmp plaintext".split())
FOREIGN = frozenset("svg math".split())


class Flow:
    """Lines of text in one box: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.indent = 0
        self.marker = ""

    def words(self, text: str) -> None:
        """Text in which white space collapses."""
        parts = _SPACE.split(text)
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def exact(self, text: str) -> None:
        """Text whose white space counts."""
        for i, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.end_line(always=True)
            if part:
                self.line.append(part)
        self.space = False

    def end_line(self, always: bool = False) -> None:
        text = "".join(self.line).rstrip()
        self.line.clear()
        self.space = False
        if text or self.marker or always:
            indent = " " * min(self.indent, MOST_INDENT)
            if self.marker:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append((indent + text).rstrip())

    def block(self, spaced: bool) -> None:
        if self.line or not self.marker:
            self.end_line()
        self.gap = self.gap or (spaced and not self.marker)

    def add_lines(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self.line.append(line)
            self.end_line(always=True)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells as they come, placed on a grid."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # the first row below a span that began above, by column
        self.caption: list[str] = []
        self.next_column = 0

    def start_row(self) -> None:
        self.rows.append([])
        self.next_column = 0

    def place(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.start_row()
        row, column = len(self.rows) - 1, self.next_column
        while self.taken.get(column, 0) > row:
            column += 1
        self.rows[row].append((column, lines))
        if down > 1:
            for c in range(column, column + across):
                self.taken[c] = max(self.taken.get(c, 0), row + down)
        self.next_column = column + across

    def rendered(self) -> list[str]:
        """Columns separated by bars, each as wide as its widest line up to a limit."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, lines in row:
                for line in lines:
                    widths[column] = max(widths.get(column, 0), min(len(line), WIDEST_COLUMN))
        out = list(self.caption)
        used = sorted(widths)
        for row in self.rows:
            cells = {column: lines for column, lines in row if lines}
            for k in range(max(map(len, cells.values()), default=0)):
                parts = [(cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(widths[c]) for c in used]
                out.append(" | ".join(parts).rstrip(" |") if any(p.strip() for p in parts) else "")
        return out


class _Element:
    __slots__ = ("name", "hidden", "exact", "flow", "table", "count", "indent", "across", "down")

    def __init__(self, name: str, hidden: bool, exact: bool) -> None:
        self.name, self.hidden, self.exact = name, hidden, exact
        self.flow: Flow | None = None
        self.table: Table | None = None
        self.count: int | None = None
        self.indent = 0
        self.across = self.down = 1


class Page:
    """Builds the tree as a stack of open elements and lays out text as it comes."""

    def __init__(self) -> None:
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a name are
        self.flows = [Flow()]
        self.tables: list[Table] = []

    # --- tree ---

    def _has(self, names: frozenset[str] | set[str], walls=TABLE_WALL) -> int | None:
        """The place of the innermost open element of these names, unless a wall is further in."""
        place = self._innermost(names)
        return place if place >= 0 and place >= self._innermost(walls) else None

    def _innermost(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _close_to(self, i: int) -> None:
        while len(self.open) > i:
            element = self.open.pop()
            self.places[element.name].pop()
            self._left(element)

    def foreign(self) -> bool:
        """Whether what comes is a part of a drawing or a formula."""
        return self._has(FOREIGN, {"foreignobject"}) is not None

    def _imply_ends(self, name: str) -> None:
        if name in BLOCKS or name in ("tr", "td", "th", *SECTIONS):
            i = self._has({"p"}, {"table", "td", "th", "caption", "button"})
            if i is not None and name not in ("option", "optgroup", "legend", "summary"):
                self._close_to(i)
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self._close_to(len(self.open) - 1)
        for other in (ENDS[name],) if name in ENDS else ():
            while (i := self._has(other, WALLS.get(name, TABLE_WALL))) is not None:
                self._close_to(i)

    def _imply_starts(self, name: str) -> None:
        """Cells outside a row get one, where there is a table."""
        if name in CELLS and self._has({"tr"}) is None and self._has({"table"}, ()) is not None:
            self._enter("tr", {})

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self._imply_ends(name)
        self._imply_starts(name)
        hidden = bool(self.open) and self.open[-1].hidden
        if name == "br":
            if not hidden:
                self.flows[-1].end_line(always=True)
        elif name == "hr":
            if not hidden:
                self.flows[-1].block(spaced=True)
        elif name == "input":
            if not hidden and attributes.get("type", "").lower() in ("submit", "button", "reset"):
                self.flows[-1].words(attributes.get("value", ""))
        elif name not in VOID:
            self._enter(name, attributes)

    def end(self, name: str) -> None:
        if name in ("br", "p") and self._has({name}, {"table"}) is None:
            if not (self.open and self.open[-1].hidden):
                self.flows[-1].block(spaced=name == "p")
            return
        walls: frozenset[str] | set[str] = frozenset()
        if name not in ("table", "body", "html"):
            walls = TABLE_WALL if name in ("tr", "td", "th", *SECTIONS) else TABLE_WALL | CELLS
            if name in CELLS:
                walls = TABLE_WALL
        i = self._has(HEADINGS if name in HEADINGS else {name}, walls)
        if i is not None:
            self._close_to(i)

    # --- layout ---

    def _invisible(self, name: str, attributes: dict[str, str]) -> bool:
        if name in HIDDEN or "hidden" in attributes or (name == "dialog" and "open" not in attributes):
            return True
        if _INVISIBLE.search(attributes.get("style", "")):
            return True
        parent = self.open[-1] if self.open else None
        return parent is not None and parent.name == "details" and parent.count == 0 and name != "summary"

    def _enter(self, name: str, attributes: dict[str, str]) -> None:
        parent = self.open[-1] if self.open else None
        hidden = (parent is not None and parent.hidden) or self._invisible(name, attributes)
        element = _Element(name, hidden, name in PREFORMATTED or (parent is not None and parent.exact))
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(element)
        if hidden:
            return
        flow = self.flows[-1]
        nested = name in LISTS and self._has(frozenset(("li",)), TABLE_WALL | {"body"}) is not None
        if name in BLOCKS:
            flow.block(name in SPACED and not nested)
        if name in LISTS:
            element.count = _number(attributes.get("start"), 1) if name == "ol" else None
        elif name == "li":
            place = self._innermost(LISTS)
            owner = self.open[place] if place >= 0 else element
            if owner.count is not None:
                owner.count = _number(attributes.get("value"), owner.count)
                flow.marker = f"{owner.count}. "
                owner.count += 1
            else:
                flow.marker = "- "
            element.indent = len(flow.marker)
        elif name in ("dd", "blockquote"):
            element.indent = 2
        elif name == "details":
            element.count = 1 if "open" in attributes else 0
        elif len(self.places.get("table", ())) > MOST_TABLES and name in ("table", "tr", "caption", *CELLS):
            flow.block(spaced=False)
        elif name == "table":
            self.tables.append(Table())
            element.table = self.tables[-1]
        elif name == "tr" and self.tables:
            self.tables[-1].start_row()
        elif name in CELLS | {"caption"} and self.tables and self._has({"table"}, ()) is not None:
            element.flow = Flow()
            self.flows.append(element.flow)
            element.across = min(max(_number(attributes.get("colspan"), 1), 1), MOST_ACROSS)
            element.down = min(max(_number(attributes.get("rowspan"), 1), 1), MOST_DOWN)
        flow.indent += element.indent

    def _left(self, element: _Element) -> None:
        if element.hidden:
            return
        if element.flow is not None:
            self.flows.pop()
            lines = element.flow.done()
            if element.name == "caption":
                self.tables[-1].caption += lines
            else:
                self.tables[-1].place(lines, element.across, element.down)
            return
        flow = self.flows[-1]
        if element.name == "li" and flow.marker:
            flow.end_line()  # an item without text keeps its mark
        if element.table is not None:
            self.tables.pop()
            flow.add_lines(element.table.rendered())
            flow.gap = True
        elif element.name in BLOCKS:
            nested = element.name in LISTS and self._has(frozenset(("li",)), TABLE_WALL | {"body"}) is not None
            flow.block(element.name in SPACED and not nested)
        flow.indent -= element.indent

    def text(self, text: str) -> None:
        element = self.open[-1] if self.open else None
        if element is None:
            self.flows[-1].words(text)
        elif element.hidden or (element.name == "details" and element.count == 0):
            return
        elif element.name in ("table", "tr", *SECTIONS) and not text.strip():
            return
        elif element.exact:
            self.flows[-1].exact(text)
        else:
            self.flows[-1].words(text)

    def done(self) -> str:
        self._close_to(0)
        return "\n".join(self.flows[0].done())


def _number(value: str | None, otherwise: int) -> int:
    try:
        return int((value or "").strip()[:9])
    except ValueError:
        return otherwise


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def _closes_itself(source: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value."""
    if not source.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(source):
        pass
    return last is None or last.end() < len(source)


def render(html: str) -> str:
    """The text of one page."""
    page, at, size = Page(), 0, len(html)
    while at < size:
        found = _TOKEN.match(html, at)
        if found is None:
            break
        at = found.end()
        kind = found.lastgroup
        if kind == "text":
            page.text(unescape(found["text"]))
        elif found["end"]:
            page.end(found["end"].lower())
        elif found["start"]:
            name = found["start"].lower()
            if (name in FOREIGN or page.foreign()) and _closes_itself(found["attributes"]):
                continue
            page.start(name, _attributes(found["attributes"]))
            if name in PREFORMATTED:  # the line break after the tag is not shown
                at += 2 if html.startswith("\r\n", at) else html.startswith(("\n", "\r"), at)
            if name == "plaintext":
                page.text(html[at:])
                at = size
            elif name in RAW or name in RAW_TEXT:
                ends = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                until = ends.start() if ends else size
                inner = html[at:until]
                page.text(unescape(inner) if name in RAW_TEXT else inner)
                at = until
    return page.done()


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of ``pages`` plus ``text``, all that a reader would see of the page.

    Tags are read leniently: paragraphs, items, rows and cells end where HTML
    says so, cells get a missing row, stray end tags count for nothing.  Scripts,
    styles, the head, closed details, and elements hidden by attribute or style
    show nothing.  White space collapses except in preformatted text; blocks
    stand on lines of their own, with an empty line around paragraphs, headings,
    lists, quotations and tables; list items carry a dash or their number, nested
    ones are indented; the cells of a table column stand below each other,
    separated by bars, with spans respected.  However deep elements are nested,
    all text is kept; lines are indented by 100 characters at most, and tables
    within 50 others are laid out as blocks.

    A null page gives null, an empty one an empty text.  Rows are read one by
    one, so repeated rows and empty tables need no care; a column that has the
    name of the result is replaced.
    """

    @F.pandas_udf("string")
    def rendered(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in column:
            yield pd.Series([None if h is None else render(h) for h in some], dtype=object)

    return pages.withColumn(text, rendered(F.col(html)))
