"""Web pages to plain text: block elements to lines, cells joined by bars, pages per batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_BLOCKS = {"p", "div", "br", "tr", "table", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title", "pre", "blockquote", "hr"}
_HIDDEN = {"script", "style", "noscript", "template"}
_FOLDS = str.maketrans({0xA0: " ", 0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "--", 0x2026: "..."})


class _Reader(HTMLParser):
    """Text with line breaks at blocks; headings and table rows by their element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.tables: list[list[list[str]]] = []
        self.inside: list[list[list[str]]] = []  # the open tables, the innermost last
        self.hidden = 0
        self.open: list[tuple[str, int, list[str]]] = []

    def table(self) -> list[list[str]]:
        """The innermost open table, a new one if none is open."""
        if not self.inside:
            self.start_table()
        return self.inside[-1]

    def start_table(self) -> None:
        self.tables.append([])
        self.inside.append(self.tables[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.parts.append("\n")
        if tag == "table":
            self.start_table()
        if tag == "tr":
            self.table().append([])
        if re.fullmatch("h[1-6]", tag):
            self.open.append((tag, len(self.parts), []))
        if tag in ("td", "th"):
            rows = self.table()
            if not rows:
                rows.append([])
            self.open.append((tag, len(self.parts), rows[-1]))

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        if self.open and self.open[-1][0] == tag:
            _, at, row = self.open.pop()
            body = clean("".join(self.parts[at:])).replace("\n", " ")
            if tag in ("td", "th"):
                row.append(body)
                self.parts.append(" | ")
            else:
                self.headings.append((int(tag[1]), body))
        if tag == "table" and self.inside:
            self.inside.pop()
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data.translate(_FOLDS))


def clean(text: str) -> str:
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip().removesuffix("|").rstrip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def read_page(html: str) -> tuple[str, list[tuple[int, str]], list[str]]:
    """Plain text, headings with their level, and tables as pipe rows, each with a rule under its
    first row and an empty line before the next table. A table inside a cell is one of its own."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    rendered: list[str] = []
    for table in reader.tables:
        if rows := [r for r in table if any(r)]:
            lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
            rendered += [*([""] if rendered else []), lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]
    return clean("".join(reader.parts)), reader.headings, rendered


def parsed_pages(pages: DataFrame, id: str, html: str) -> DataFrame:
    """id, text, headings, table."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string())]))
        for b in batches:
            made = [read_page(x or "") for x in b.column(1).to_pylist()]
            headings = [[{"level": n, "title": t} for n, t in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made]), pa.array(headings, kind), pa.array([m[2] for m in made], pa.list_(pa.string()))], names=[id, "text", "headings", "table"])

    heading = StructType([StructField("level", IntegerType()), StructField("title", StringType())])
    out = StructType([pages.schema[id], StructField("text", StringType()), StructField("headings", ArrayType(heading)), StructField("table", ArrayType(StringType()))])
    return pages.select(id, html).mapInArrow(step, out)


def is_heading(line: Column) -> Column:
    """Short, with a letter, without final punctuation, not a list item."""
    return (F.length(line) <= 80) & line.rlike(r"\p{L}") & ~line.rlike(r"[.,;:]$") & ~line.rlike(r"^[-*•\d]")


def is_furniture(line: Column) -> Column:
    """Page numbers and contents lines."""
    return line.rlike(r"^(?i:page\s*)?\d{1,4}$") | line.rlike(r"\.{4,}\s*\d+$")
