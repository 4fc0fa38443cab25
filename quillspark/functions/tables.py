"""Tables inside Markdown texts as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW, RULE = r"^\s*\|", r"^\s*\|(\s*:?-+:?\s*\|)+\s*$"


def table_start(text: Column, start: Column) -> Column:
    """mid_row, later_row or null for a chunk that begins at an offset (from 0); blank lines
    between rows do not end a table."""
    rest = F.substr(text, start + 1)
    at = start + F.length(rest) - F.length(F.regexp_replace(rest, r"(?U)^\s+", ""))
    before = F.substr(text, F.lit(1), at)
    head = F.substring_index(before, "\n", -1)
    line = F.concat(head, F.substring_index(F.substr(text, at + 1), "\n", 1))
    above = F.regexp_replace(F.substr(before, F.lit(1), F.length(before) - F.length(head)), r"(?U)\s+\z", "")
    previous = F.substring_index(above, "\n", -1)
    return F.when(~line.rlike(ROW), None).when(F.trim(head) != "", "mid_row").when(previous.rlike(ROW), "later_row")


def data_rows(text: Column) -> Column:
    """Rows of pipe tables that are no rule."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(ROW) & ~x.rlike(RULE)))


def table_header(text: Column, start: Column) -> Column:
    """The header rows of the table around an offset: its rows through the rule, else its first
    row; blank lines between rows do not end it. The offset lies in a row."""
    before = F.substr(text, F.lit(1), start)
    head = F.substring_index(before, "\n", -1)
    row = F.concat(head, F.substring_index(F.substr(text, start + 1), "\n", 1))
    filled = lambda lines: F.filter(lines, lambda x: F.trim(x) != "")
    above = F.reverse(filled(F.split(F.substr(before, F.lit(1), F.length(before) - F.length(head)), "\n")))
    first_other = F.array_position(F.transform(above, lambda x: x.rlike(ROW)), False)
    upper = F.reverse(F.when(first_other > 0, F.slice(above, F.lit(1), (first_other - 1).cast("int"))).otherwise(above))
    below = filled(F.slice(F.split(F.substr(text, start + 1), "\n"), 2, 1 << 20))
    last_other = F.array_position(F.transform(below, lambda x: x.rlike(ROW)), False)
    lower = F.when(last_other > 0, F.slice(below, F.lit(1), (last_other - 1).cast("int"))).otherwise(below)
    rows = F.concat(upper, F.array(row), lower)
    rule = F.array_position(F.transform(rows, lambda x: x.rlike(RULE)), True)
    return F.array_join(F.slice(rows, F.lit(1), F.greatest(rule, F.lit(1)).cast("int")), "\n")


def chunk_table_start(text: Column, start: Column, chunk: Column) -> Column:
    """table_start, but null for a chunk that repeats its table's header."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    where = table_start(text, start)
    repeats = F.startswith(flat(chunk), flat(table_header(text, start)))
    return F.when(where.isNotNull() & repeats, None).otherwise(where)
