"""Typed elements of pages of markup: blocks of text, tables as grids, images and links, in the order of the page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags at which a block of text ends, those whose contents are not shown, and those without an end (fixed values).
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
MOST_COLUMNS = 1000  # of a cell, as in the standard for pages
BLANKS = re.compile(r"[ \t\r\n\f]+")


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of (content, rows, columns that the cell spans) as a full grid: a cell's content is in every place it spans; places that
    no cell spans are empty. Spans end with the table."""
    placed: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for content, high, wide in row:
            while (y, x) in placed:
                x += 1
            for dy in range(min(high, len(rows) - y)):
                for dx in range(wide):
                    placed.setdefault((y + dy, x + dx), content)
            x += wide
    width = max((x for _, x in placed), default=-1) + 1
    return [[placed.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def markdown(table: list[list[str]]) -> str:
    """The first row is the head."""
    line = lambda cells: "| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(table[0]), line(["---"] * len(table[0])), *map(line, table[1:])]) if table and table[0] else ""


class Table:
    def __init__(self):
        self.rows, self.cell, self.spans = [], None, (1, 1)

    def row(self) -> None:
        self.end_cell()
        self.rows.append([])

    def start_cell(self, attrs: dict) -> None:
        self.end_cell()
        if not self.rows:
            self.rows.append([])
        whole = lambda x, most: min(most, max(1, int(x))) if (x or "").strip().isdecimal() else 1
        self.cell, self.spans = [], (whole(attrs.get("rowspan"), 65534), whole(attrs.get("colspan"), MOST_COLUMNS))

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((BLANKS.sub(" ", "".join(self.cell)).strip(), *self.spans))
            self.cell = None

    def text(self) -> str:
        self.end_cell()
        return markdown(grid([r for r in self.rows if r]))


class Scanner(HTMLParser):
    """Takes markup as it comes: tags that are never closed end with what holds them, ends without a start are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.tables, self.link, self.hidden = [], [], [], None, []

    def flush(self) -> None:
        text = BLANKS.sub(" ", "".join(self.text)).strip()
        if text:
            self.found.append(("text", text, None))
        self.text = []

    def end_link(self) -> None:
        if self.link:
            target, parts = self.link
            self.found.append(("link", BLANKS.sub(" ", "".join(parts)).strip(), target))
            self.link = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden:
            return
        attrs = {k: v for k, v in reversed(attrs)}
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag == "table":
            if not self.tables:
                self.flush()
            self.tables.append(Table())
        elif self.tables and tag == "tr":
            self.tables[-1].row()
        elif self.tables and tag in ("td", "th"):
            self.tables[-1].start_cell(attrs)
        elif tag == "img":
            self.found.append(("image", BLANKS.sub(" ", attrs.get("alt") or "").strip(), attrs.get("src")))
        elif tag == "a" and attrs.get("href") is not None:
            self.end_link()
            self.link = (attrs["href"], [])
        elif tag in BLOCKS:
            self.handle_data(" ") if self.tables else self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag == "a":
            self.end_link()
        elif tag == "table" and self.tables:
            self.end_table()
        elif self.tables and tag in ("td", "th"):
            self.tables[-1].end_cell()
        elif tag in BLOCKS:
            self.handle_data(" ") if self.tables else self.flush()

    def end_table(self) -> None:
        text = self.tables.pop().text()
        if text and self.tables:
            self.handle_data(" ")  # a table inside a cell is an element of its own, and leaves the cell
        if text:
            self.found.append(("table", text, None))

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.link:
            self.link[1].append(data)
        if not self.tables:
            self.text.append(data)
        elif self.tables[-1].cell is not None:
            self.tables[-1].cell.append(data)
        elif data.strip():
            self.text.append(data)  # text between rows stands before the table

    def elements(self, html: str) -> list[tuple[str, str, str | None]]:
        self.feed(html)
        self.close()
        self.end_link()
        while self.tables:
            self.end_table()
        self.flush()
        return self.found


def elements(pages: DataFrame, pk: str = "page_id", html: str = "html") -> DataFrame:
    """pk, element_no, kind (text, table, image, link), content (of a table markdown, of an image its alternative text), target (of an
    image or link where it leads). Null pages have none; pages of any length are read whole."""
    kind = pages.schema[pk].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, page in enumerate(batch.column(1).to_pylist()):
                found = Scanner().elements(page) if page else []
                if found:
                    columns = list(zip(*found))
                    own = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], [pk, "element_no", "kind", "content", "target"])

    return pages.select(pk, html).mapInArrow(run, f"`{pk}` {kind}, element_no long, kind string, content string, target string")
