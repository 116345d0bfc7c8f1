"""HTML to the text that a reader sees, laid out.

A tree is built with implied end tags (a list item ends the one before, a block ends a paragraph, a cell
a cell) and void elements; unknown or stray end tags are ignored. Rendering walks it without recursion:
white space collapses outside pre, blocks are set apart by line breaks or blank lines, list items get
bullets or numbers and are indented by depth, rows of a table have their cells padded to columns, which
colspan and rowspan take into account. What isn't shown isn't rendered: head, scripts, styles, templates,
dialogs that aren't open, elements with the attribute hidden, and those whose own style has display:none.
visibility, in an element's own style, is inherited until an element inside sets it anew. Style sheets are
not evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, importable, sliced

#: Fixed values of HTML: elements without content, those that are never shown, blocks with a blank line
#: around them, other blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div article section header footer nav main aside address li dt dd tr form details summary figcaption caption center legend option thead tbody tfoot".split())
#: What an opening tag ends, up to what it doesn't cross.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Where an open paragraph isn't looked for.
_SCOPE = frozenset("td th table button caption object".split())
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
#: Fixed values of HTML: the most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_WHITE = re.compile("[ \t\n\r\f]+")
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("text", pa.string())])


class Node:
    __slots__ = ("children", "columns", "hidden", "rows", "start", "tag", "visible")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):  # type: ignore[assignment]
        self.tag, self.children, self.start, self.columns, self.rows = tag, [], 1, 1, 1
        self.hidden, self.visible = tag in UNSEEN or tag == "dialog" and "open" not in {n for n, _ in attrs}, None
        for name, value in attrs:
            if name == "hidden" or name == "type" and tag == "input" and (value or "").lower() == "hidden":
                self.hidden = True
            elif name == "style" and value:
                style = {k.lower(): v.lower() for k, v in _STYLE.findall(value)}  # the last one counts
                self.hidden = self.hidden or style.get("display") == "none"
                if "visibility" in style:
                    self.visible = style["visibility"] not in {"hidden", "collapse"}
            elif name == "start" and tag == "ol" and value and re.fullmatch(r"-?\d{1,9}", value.strip()):
                self.start = int(value)
            elif name == "colspan" and value and re.fullmatch(r"\d{1,9}", value.strip()):
                self.columns = min(max(1, int(value)), MOST_COLUMNS)
            elif name == "rowspan" and value and re.fullmatch(r"\d{1,9}", value.strip()):
                self.rows = min(max(1, int(value)), MOST_ROWS)


class Builder(HTMLParser):
    """open: the elements that are; at: by tag, their places in it, so that none is searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _end(self, ends: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the innermost of ends, and what is in it, unless one of stop is further in."""
        i = self._last(ends)
        if i and i > self._last(stop):
            for node in self.open[i:]:
                self.at[node.tag].pop()
            del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end({"p"}, _SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end({tag}, frozenset() if tag in {"table", "body", "html"} else {"table"} if tag not in {"td", "th", "tr"} else set())

    def handle_data(self, data):
        self.open[-1].children.append(data)


class _Flow:
    """Lines of one context: the page, a list item, or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines that the next text needs before it

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.split("\n")
            self._add(first, True)
            for line in more:
                self._line(True)
                self._add(line, True)
        else:
            self._add(_WHITE.sub(" ", data), False)

    def _add(self, data: str, pre: bool) -> None:
        if not pre and (not self.now or self.now[-1][-1:] == " "):
            data = data.lstrip(" ")
        if data:
            self.now.append(data)

    def _line(self, always: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line or always:
            self._blank()
            self.lines.append(line)

    def _blank(self) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def block(self, spaced: bool) -> None:
        self._line()
        self.gap = max(self.gap, int(spaced))

    def br(self) -> None:
        self._line(True)

    def put(self, lines: list[str]) -> None:
        self._line()
        if lines:
            self._blank()
            self.lines += lines

    def done(self) -> list[str]:
        self._line()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        start = next((i for i, x in enumerate(lines) if x.strip()), 0)
        return lines[start:]


Cell = tuple[str, int, int]  # text, columns, rows


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, str, int]]]:
    """Each row's (column, text, columns): cells go past the columns that a cell above spans. A cell is
    taken to span as many columns as some row has cells, at most, which looks the same; from column
    MOST_COLUMNS on no cell spans rows."""
    out, taken, most = [], {}, max(map(len, rows), default=1)
    for row in rows:
        at, line = 0, []
        for text, columns, tall in row:
            columns = min(columns, most)
            while taken.get(at, 0) > 0:
                at += 1
            line.append((at, text, columns))
            for k in range(at, min(at + columns, MOST_COLUMNS)) if tall > 1 else ():
                taken[k] = tall
            at += columns
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        out.append(line)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Cells padded to columns, two spaces between; columns without text of their own take no room."""
    lines = placed(rows)
    widths: dict[int, int] = {}
    for line in lines:
        for at, text, columns in line:
            if columns == 1:
                widths[at] = max(widths.get(at, 0), len(text))
    room = lambda at, n: sum(w + 2 for k in range(at, at + n) if (w := widths.get(k, 0))) - 2
    for line in lines:  # what spans columns and is wider widens the first of them
        for at, text, columns in line:
            if columns > 1 and (more := len(text) - max(0, room(at, columns))) > 0:
                widths[at] = widths.get(at, 0) + more
    starts, now = {}, 0
    for k in sorted(widths):
        starts[k] = now
        now += widths[k] + 2 if widths[k] else 0
    out = []
    for line in lines:
        if any(text for _, text, _ in line):
            text = ""
            for at, own, _ in line:
                if own:
                    text = text.ljust(starts[at]) + own
            out.append(text)
    return out


def render(root: Node) -> str:
    page = _Flow()
    flows, lists, tables, pre, shown = [page], [], [], 0, [True]
    #: What is left to do, last first: an opening (node, True), an ending (node, False), or text.
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, opens = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown[-1]:
                continue
            if not (tables and flow is tables[-1][1]):  # white space between rows and cells; other text goes before
                flow.text(node, pre > 0)
            elif node.strip():
                tables[-1][2].text(node, False)
            continue
        tag = node.tag
        if opens:
            if node.hidden:
                continue
            if tag == "br":
                flow.br()
                continue
            if tag in BLOCKS:
                flow.block(tag in SPACED and not (tag in {"ul", "ol"} and lists))
            if tag in {"ul", "ol"}:
                lists.append([tag, node.start])
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                outer = flow
                inner = _Flow()
                tables.append((([]), inner, outer))
                flows.append(inner)
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in {"td", "th"} and tables or tag == "li":
                flows.append(_Flow())
            shown.append(shown[-1] if node.visible is None else node.visible)
            todo.append((node, False))
            todo.extend((child, True) for child in reversed(node.children))
            continue
        shown.pop()
        if tag in {"ul", "ol"}:
            lists.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "li":
            flows.pop()
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            lines = flow.done()
            flows[-1].put([(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)])
            continue
        elif tag in {"td", "th"} and tables:
            flows.pop()
            rows = tables[-1][0]
            if not rows:
                rows.append([])
            rows[-1].append((" ".join(x.strip() for x in flow.done() if x.strip()), node.columns, node.rows))
            continue
        elif tag == "table":
            rows, inner, outer = tables.pop()
            flows.pop()
            outer.put(inner.done() + aligned(rows))
            outer.block(True)
            continue
        if tag in BLOCKS:
            flows[-1].block(tag in SPACED and not (tag in {"ul", "ol"} and lists))
    return "\n".join(page.done())


def extract(html: str) -> tuple[str, str]:
    """The title, with white space collapsed, and the visible text."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    title, todo = "", [builder.root]
    while todo and not title:
        node = todo.pop()
        if node.tag == "title":
            title = _WHITE.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip()
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return title, render(builder.root)


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sliced(parts, 200):
        found = [extract(x) if x else ("", "") for x in part.column("html").to_pylist()]
        yield batches({"page_id": part.column("page_id"), "url": part.column("url"), "title": [t for t, _ in found], "text": [x for _, x in found]}, OUT)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a row of pages (page_id, url, html): page_id, url, title, text.

    Null and empty html give an empty title and text. Repeated rows are each rendered. An empty table
    gives no rows. Other columns aren't read. Nothing is shuffled.
    """
    importable(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, title string, text string")
