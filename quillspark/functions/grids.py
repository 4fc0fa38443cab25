"""Tables as arrays of rows of cells: split figures, spanned columns, layout tables, Markdown.

All are Column functions over array<array<string>>, so that tables by the million stay in the JVM.
Empty cells are empty strings, and rows may differ in length where that is said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that stand beside a figure, and what counts as a figure, a year, a marker.
BEFORE = ("$", "€", "£", "¥")
AFTER = (")", "%", ")%", "%)", "pts", "bps")
FIGURE = r"^[($€£¥]*-?[\d,]*\.?\d+[)%]*$|^[-—–]+$"
YEAR = r"^(?:19|20)\d\d$"
MARKER = r"^(?:[•●◦▪■·\-–—*]|\(?\d{1,2}\)|\(?[a-z]\)|\d{1,2}\.)$"


def filled(row: Column) -> Column:
    return F.filter(row, lambda c: c != "")


def square(grid: Column) -> Column:
    """All rows as long as the longest."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def glue_figures(grid: Column) -> Column:
    """Currency signs go before the next figure of their row, closing signs after the last one;
    their own cells stay, empty, so that places of columns hold."""
    zero = F.struct(F.array().cast("array<string>").alias("cells"), F.lit("").alias("held"))

    def step(state: Column, cell: Column) -> Column:
        cells, held = state["cells"], state["held"]
        last = F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i)))
        grown = F.transform(cells, lambda c, i: F.when(i == last, F.concat(c, cell)).otherwise(c))
        state_of = lambda cells, held: F.struct(cells.alias("cells"), held.alias("held"))
        none = F.array(F.lit(""))
        return (
            F.when(cell.isin(*BEFORE), state_of(F.concat(cells, none), cell))
            .when(cell.isin(*AFTER) & last.isNotNull(), state_of(F.concat(grown, none), held))
            .when((held != "") & (cell != ""), state_of(F.concat(cells, F.array(F.concat(held, cell))), F.lit("")))
            .otherwise(state_of(F.concat(cells, F.array(cell)), held))
        )

    return F.transform(square(grid), lambda row: F.aggregate(row, zero, step, lambda s: s["cells"]))


def merge_spanned(grid: Column, spans: Column) -> Column:
    """Columns under one spanning cell become one where no row fills two of them, short spans
    first; columns that no row fills go. spans: array<struct<start, width>>; the grid is square."""
    width = F.size(F.get(grid, F.lit(0)))
    own = F.sequence(F.lit(0), width - 1)
    in_order = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["width"].alias("width"), i.alias("nth"), s["start"].alias("start"))))

    def join(groups: Column, span: Column) -> Column:
        start, end = span["start"], F.least(span["start"] + span["width"], width)
        alone = F.forall(grid, lambda row: F.size(filled(F.slice(row, start + 1, F.greatest(end - start, F.lit(0))))) <= 1)
        first = F.get(groups, start)
        return F.when((end - start >= 2) & alone, F.transform(groups, lambda g, i: F.when((i >= start) & (i < end), first).otherwise(g))).otherwise(groups)

    groups = F.aggregate(in_order, own, join)

    def merged(groups: Column) -> Column:
        cell = lambda row, g: F.array_join(filled(F.filter(F.transform(row, lambda c, i: F.when(F.get(groups, i) == g, c)), lambda c: c.isNotNull())), " ")
        rows = F.transform(grid, lambda row: F.transform(F.array_sort(F.array_distinct(groups)), lambda g: cell(row, g)))
        return F.transform(F.array(rows), lambda rows: _without_empty(rows))[0]

    return F.transform(F.array(groups), merged)[0]


def _without_empty(rows: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    keep = F.filter(places, lambda i: F.exists(rows, lambda r: F.get(r, i) != ""))
    return F.transform(F.array(keep), lambda keep: F.transform(rows, lambda r: F.transform(keep, lambda i: F.get(r, i))))[0]


def layout_lines(grid: Column) -> Column:
    """The lines of a table that is a box (one cell a row) or a list (a marker and a text a row);
    null for a table of data. The rows hold filled cells only."""
    box = F.forall(grid, lambda r: F.size(r) == 1)
    listed = F.forall(grid, lambda r: (F.size(r) == 2) & F.rlike(F.get(r, F.lit(0)), F.lit(MARKER)))
    return F.when(box | listed, F.transform(grid, lambda r: F.array_join(r, " ")))


def header_rows(grid: Column) -> Column:
    """Rows before the first one with a figure after its label, 1 at least; years are labels."""
    figure = lambda c: c.rlike(FIGURE) & ~c.rlike(YEAR)
    data = F.transform(grid, lambda r: F.exists(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), figure))
    return F.greatest(F.lit(1), F.coalesce(F.nullif(F.array_position(data, True), F.lit(0)) - 1, F.lit(1))).cast("int")


def markdown(grid: Column, headers: Column) -> Column:
    """A Markdown table with a rule after the header rows; bars in cells are escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(grid, F.lit(0)))))
    lines = F.transform(grid, line)
    # slice() refuses a start beyond the array only if it is 0, and all rows may be headers
    return F.array_join(F.concat(F.slice(lines, F.lit(1), headers), F.array(rule), F.slice(lines, headers + 1, F.size(lines))), "\n")


def looks_like_heading(text: Column) -> Column:
    """Short, with a letter, without a sentence's end or an item's start."""
    return F.length(text).between(1, 120) & ~text.rlike(r"[.,;:]$") & text.rlike(r"\p{L}") & ~text.rlike(r"^[•(*]")


def is_page_number(text: Column) -> Column:
    return text.rlike(r"(?i)^(?:page\s+)?[-–—]?\s*[ivxlc\d]{1,4}\s*[-–—]?$")


def is_contents_line(text: Column) -> Column:
    return text.rlike(r"(?i)^(?:return\s+to\s+|back\s+to\s+)?table\s+of\s+contents$")


def prominence(style: Column, body: Column) -> Column:
    """How a style stands out from the body's, as a struct that orders headings; null if it
    doesn't. Styles: struct<size, caps, bold, color, underline, italic>, size and color may be
    null. Larger type counts first, then capitals, bold, color, underline, italic; capitals alone
    are no heading, nor is smaller type that isn't bold."""
    gain = F.when((style["size"] > 0) & (body["size"] > 0), style["size"] - body["size"]).otherwise(F.lit(0.0))
    more = lambda name: (style[name] & ~body[name]).cast("int")
    color = (style["color"].isNotNull() & ~style["color"].eqNullSafe(body["color"])).cast("int")
    marks = [more("bold").alias("bold"), color.alias("color"), more("underline").alias("underline"), more("italic").alias("italic")]
    stands = (gain > 0) | (more("bold") == 1) | ((gain == 0) & ((color == 1) | (more("underline") == 1) | (more("italic") == 1)))
    return F.when(stands, F.struct(gain.alias("gain"), style["caps"].cast("int").alias("caps"), *marks))
