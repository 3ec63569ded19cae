"""Layout-aware text of HTML pages.

A forgiving tokenizer feeds a tree builder that adds the tags HTML implies (ends of paragraphs, list
items, cells, rows; starts of rows) and ignores ends that match nothing. The tree is then laid out:
blocks on lines of their own with blank lines around paragraphs, headings and the like, list markers
with nesting, preformatted text as it is, table cells padded to common column widths, which cells over
several columns widen. Text that a browser does not show (scripts, styles, the head, comments, what is not
displayed, what is invisible and not made visible again inside) is left out; all other text is kept whole,
that of formulas and drawings too.

Work and memory grow in proportion to a page: the spaces that align a table stay within a multiple of
its text (``PADDING``), and where columns would need more, longer cells push the next ones aside. Tables are laid
out from the inside, so depth is held in lists, not on the call stack; the text of a table in tables is
placed once for each of them. Defined results: a null page has null text, an empty or tagless page its own text with
white space collapsed; repeated rows are laid out each; an empty table gives an empty result. All
columns pass through, but for one that has the result's name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import ship_by_value

# ---- fixed values of HTML: names by role ---------------------------------------------------
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set(
    "script style template head title meta link base noembed noframes iframe noscript datalist "
    "audio video canvas param area rp desc metadata annotation annotation-xml".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul "
    "listing plaintext xmp summary".split()
)
#: blocks with a blank line around them, and blocks on lines of their own
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu dir".split())
LINED = set(
    "address article aside body center dd details dialog div dt figcaption footer form header "
    "hgroup html legend li main nav option optgroup section summary tr caption tbody thead tfoot "
    "listing plaintext xmp textarea".split()
)
PARTS = set("tbody thead tfoot".split())
#: an open element of the first kind is ended by a start of these, not looking past the others
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: ends of other elements do not reach past these
WALLS = set("table td th caption html template".split())
MOST_COLUMNS = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/><]*+)[^><]*+>?"
    r"|<(?P<start>[a-zA-Z][^\s/><]*+)(?P<rest>(?:\"[^\"<]*+\"|'[^'<]*+'|[^>\"'<]|[\"'])*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_GAP = re.compile(r"[ \t\n\r\f]+")
#: spaces that align a table's columns, at most so many for each visible character of it and each line
PADDING, LINE_PADDING = 4, 40


class Element:
    """A tag with its attributes, and texts and elements inside."""

    __slots__ = ("name", "attributes", "inside", "lines")

    def __init__(self, name: str, rest: str = ""):
        self.name = name
        self.inside: list[Element | str] = []
        self.lines: list[str] = []  # of a table that is laid out
        self.attributes = {}
        if rest.strip("/ \n\t"):
            for key, value in _ATTRIBUTE.findall(rest):
                self.attributes.setdefault(key.lower(), unescape(value.strip("\"'")))

    def seen(self) -> bool:
        """Whether a browser shows the element."""
        if self.name in UNSEEN or "hidden" in self.attributes:
            return False
        return not self.attributes or not _GONE.search(self.attributes.get("style", ""))

    def number(self, key: str, usual: int) -> int:
        found = re.match(r"\s*-?\d{1,9}", self.attributes.get(key, ""))
        return int(found[0]) if found else usual


class _Builder:
    """Open elements, outermost first, and how many of each name are open."""

    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.count: dict[str, int] = {"html": 1}

    def push(self, element: Element) -> None:
        self.open[-1].inside.append(element)
        self.open.append(element)
        self.count[element.name] = self.count.get(element.name, 0) + 1

    def pop(self) -> None:
        self.count[self.open.pop().name] -= 1

    def end(self, names: tuple[str, ...], walls) -> bool:
        """End the innermost open element of these names, and all inside it, unless a wall is nearer."""
        if not any(self.count.get(n) for n in names):
            return False
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if name in names:
                while len(self.open) > k:
                    self.pop()
                return True
            if name in walls:
                return False
        return False

    def start(self, name: str, rest: str) -> Element:
        if name in CLOSES_P and self.count.get("p"):
            self.end(("p",), WALLS)
        if name in ENDED_BY:
            names, walls = ENDED_BY[name]
            while self.end(names, walls):
                pass
        if name in ("td", "th") and self.open[-1].name in ("table", *PARTS):
            self.push(Element("tr"))
        if name in CLOSES_P and self.count.get("head"):
            self.end(("head",), ())
        element = Element(name, rest)
        if name in VOID:
            self.open[-1].inside.append(element)
        else:
            self.push(element)
        return element


def parse(html: str) -> Element:
    """Tree of a page."""
    builder, at = _Builder(), 0
    while at < len(html):
        open_ = html.find("<", at)
        if open_ < 0:
            open_ = len(html)
        if open_ > at:
            builder.open[-1].inside.append(unescape(html[at:open_]))
            at = open_
            continue
        found = _TOKEN.match(html, at)
        if not found:
            builder.open[-1].inside.append("<")
            at += 1
            continue
        at = found.end()
        if found["end"]:
            name = found["end"].lower()
            if name == "br":
                builder.open[-1].inside.append(Element("br"))
            elif name not in ("body", "html") and name not in VOID:
                walls = () if name in WALLS or name in PARTS or name == "tr" else WALLS
                builder.end((name,), walls)
        elif found["start"]:
            name = found["start"].lower()
            if name in ("html", "body"):
                builder.end(("head",), ())
                continue
            if name == "plaintext":
                builder.start("pre", "").inside.append(html[at:])
                break
            element = builder.start(name, found["rest"])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                stop = close.start() if close else len(html)
                raw = html[at:stop]
                element.inside.append(unescape(raw) if name in ("textarea", "title") else raw)
                builder.end((name,), ())
                at = close.end() if close else len(html)
    return builder.root


class _Page:
    """Lines laid out so far; a gap of blank lines waits for the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line being written
        self.space = False
        self.gap = 0
        self.indent = [""]
        self.marker = ""

    def _begin(self) -> None:
        if not self.parts:
            if self.lines:
                self.lines += [""] * (self.gap - 1 if self.gap else 0)
            self.gap = 0
            self.parts.append(self.indent[-1][: len(self.indent[-1]) - len(self.marker)] + self.marker)
            self.marker, self.space = "", False

    def text(self, value: str) -> None:
        words = _GAP.sub(" ", value)
        if words in ("", " "):
            self.space = self.space or (bool(words) and bool(self.parts))
            return
        self._begin()
        if self.space or (words[0] == " " and len(self.parts) > 1):
            self.parts.append(" ")
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def exact(self, value: str) -> None:
        for k, line in enumerate(value.replace("\r\n", "\n").split("\n")):
            if k:
                self.newline()
            if line:
                self._begin()
                self.parts.append(line)

    def newline(self) -> None:
        """End the line, also an empty one."""
        self._begin()
        self.lines.append("".join(self.parts).rstrip(" "))
        self.parts, self.space = [], False

    def block(self, blank: int) -> None:
        """End the line if it has text, and keep ``blank`` empty lines before the next."""
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False
        self.gap = max(self.gap, 1 + blank)

    def finished(self) -> list[str]:
        self.block(0)
        return self.lines


def _marker(element: Element, lists: list[list]) -> str:
    if not lists or lists[-1][0] != "ol":
        return "- "
    number = element.number("value", lists[-1][1])
    lists[-1][1] = number + 1
    return f"{number}. "


def settle(root: Element) -> list[Element]:
    """Empty what ``visibility`` hides, which children may show again; the tables, outer ones first."""
    tables, work = [], [(root, False)]
    while work:
        element, hidden = work.pop()
        if element.attributes and (own := _VISIBILITY.findall(element.attributes.get("style", ""))):
            hidden = own[-1].lower() != "visible"
        if element.name == "table":
            tables.append(element)
        if hidden:
            element.inside = [x for x in element.inside if isinstance(x, Element)]
            if element.name in ("img", "input", "hr"):
                element.name = "span"
        work += [(x, hidden) for x in element.inside if isinstance(x, Element)]
    return tables


def lay_out(root: Element) -> list[str]:
    """Lines of an element's visible text; tables inside have their lines already."""
    page, lists, exact = _Page(), [], 0
    work: list[tuple[bool, Element | str]] = [(False, x) for x in reversed(root.inside)]
    while work:
        leaving, item = work.pop()
        if isinstance(item, str):
            page.exact(item) if exact else page.text(item)
            continue
        name = item.name
        inner = name in ("ul", "ol") and len(lists) > leaving  # a list in a list
        blank = 1 if name in SPACED and not inner else 0
        lined = name in SPACED or name in LINED
        if leaving:
            if name in ("pre", "listing", "xmp", "textarea"):
                exact -= 1
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if name in ("li", "dd", "blockquote"):
                page.indent.pop()
                page.marker = ""
            if lined:
                page.block(blank)
            elif name in ("td", "th"):
                page.text(" ")
            continue
        if not item.seen():
            continue
        if name == "br":
            page.newline()
            continue
        if name == "img":
            page.text(item.attributes.get("alt", ""))
            continue
        if name == "input":
            if item.attributes.get("type", "text").lower() != "hidden":
                page.text(item.attributes.get("value", ""))
            continue
        if lined:
            page.block(blank)
        if name == "hr":
            page.exact("---")
            page.block(1)
            continue
        if name == "table":
            for line in item.lines:
                page.exact(line)
                page.block(0)
            page.block(1)
            continue
        if name in ("pre", "listing", "xmp", "textarea"):
            exact += 1
            if item.inside and isinstance(item.inside[0], str):
                item.inside[0] = item.inside[0].removeprefix("\n")
        if name in ("ul", "ol", "menu", "dir"):
            lists.append([name, item.number("start", 1)])
        if name == "li":
            page.marker = _marker(item, lists)
            page.indent.append(page.indent[-1] + " " * len(page.marker))
        elif name in ("dd", "blockquote"):
            page.indent.append(page.indent[-1] + "  ")
        work.append((True, item))
        work += [(False, x) for x in reversed(item.inside)]
    return page.finished()


def _rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """Captions and stray content, and the cells of every row."""
    other, rows = [], []
    work = list(reversed(table.inside))
    while work:
        item = work.pop()
        if isinstance(item, str):
            if item.strip():
                loose = Element("div")
                loose.inside.append(item)
                other.append(loose)
        elif not item.seen():
            continue
        elif item.name in PARTS:
            work += reversed(item.inside)
        elif item.name == "tr":
            cells = []
            for x in item.inside:
                if isinstance(x, Element) and x.name in ("td", "th"):
                    if x.seen():
                        cells.append(x)
                elif isinstance(x, Element) or x.strip():
                    loose = Element("div")
                    loose.inside.append(x)
                    other.append(loose)
            rows.append(cells)
        else:
            other.append(item)
    return other, rows


_Cells = list[tuple[int, int, list[str]]]  # column, columns spanned, lines


def _placed(rows: list[list[Element]]) -> list[_Cells]:
    """The cells of every row with the columns that spans leave to them."""
    placed: list[_Cells] = []
    taken: dict[int, int] = {}  # column: rows for which a cell from above still holds it
    for cells in rows:
        row, column, held = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in cells:
            while taken.get(column, 0) > 0:
                column += 1
            span = min(max(1, cell.number("colspan", 1)), MOST_COLUMNS)
            row.append((column, span, lay_out(cell)))
            down = min(max(1, cell.number("rowspan", 1)), len(rows))
            if down > 1:
                held |= {c: down - 1 for c in range(column, column + span)}
            column += span
        taken = held
        placed.append(row)
    return placed


def _widths(placed: list[_Cells], most: int) -> dict[int, int]:
    """Widths of the columns, none counted above ``most``; a cell over several widens the last of them."""
    widths: dict[int, int] = {}
    wide = []
    for row in placed:
        for column, span, lines in row:
            own = min(max(map(len, lines), default=0), most)
            if span == 1:
                widths[column] = max(widths.get(column, 0), own)
            else:
                wide.append((column, span, own))
    columns = sorted(widths)
    for column, span, own in wide:
        inside = columns[bisect_left(columns, column) : bisect_left(columns, column + span)]
        if inside:
            held = sum(widths[c] for c in inside) + 2 * (len(inside) - 1)
            widths[inside[-1]] += max(0, own - held)
    return widths


def _aligned(placed: list[_Cells]) -> tuple[list[int], list[int]]:
    """Columns and where they start, so that the spaces before cells stay in proportion to the text."""
    lines = [x for row in placed for _, _, own in row for x in own]
    heights = [max((len(own) for _, _, own in row), default=0) for row in placed]
    bound = PADDING * sum(len(x) - x.count(" ") for x in lines) + LINE_PADDING * sum(heights)
    for most in (max(map(len, lines), default=0), 256, 64, 16, 0):
        widths = _widths(placed, most)
        starts = [0, *accumulate(widths[c] + 2 for c in sorted(widths))]
        columns = sorted(widths)
        padded = sum(
            max((starts[bisect_left(columns, column)] for column, _, own in row if k < len(own)), default=0)
            for row, height in zip(placed, heights, strict=True)
            for k in range(height)
        )
        if padded <= bound:
            break
    return columns, starts


def _table(table: Element) -> list[str]:
    """Lines of a table whose columns start below each other, as far as ``PADDING`` allows."""
    other, rows = _rows(table)
    out = []
    for x in other:
        holder = Element("div")
        holder.inside.append(x)
        out += lay_out(holder)
    placed = _placed(rows)
    columns, starts = _aligned(placed)
    for row in placed:
        height = max((len(lines) for _, _, lines in row), default=0)
        for k in range(height):
            parts, length = [], 0
            for column, _, lines in row:
                if k >= len(lines) or not lines[k]:
                    continue
                start = starts[bisect_left(columns, column)]
                gap = start - length if length <= start else 2
                parts += [" " * gap, lines[k]]
                length += gap + len(lines[k])
            out.append("".join(parts).rstrip(" "))
    return out


def text_of(html: str | None) -> str | None:
    """Visible text of a page."""
    if html is None:
        return None
    root = parse(html)
    for table in reversed(settle(root)):  # inner ones first
        table.lines = _table(table)
    lines = lay_out(root)
    return "\n".join(lines).strip("\n").replace("\xa0", " ")


def extract_text(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``column``, and ``to``, its visible text."""
    kept = [c for c in pages.columns if c.lower() not in (column.lower(), to.lower())]
    input_ = pages.select(*[F.col(f"`{c}`") for c in (*kept, column)])
    fields = [f for f in input_.schema if f.name in kept]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([text_of(x) for x in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], [*kept, to])

    return input_.mapInArrow(task, T.StructType([*fields, T.StructField(to, T.StringType())]))


ship_by_value(__name__)
