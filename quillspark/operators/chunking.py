"""Chunkers: one row per document to many rows per document.

Where a chunk ends depends on where the one before it ended, so the walk over one document is
sequential and runs in Arrow batches of Python; documents are independent, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, strip
from .structure import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHARS, SNAP, SPLIT_LEVEL, Rules, Structure

_SCHEMA = "document_id string, chunk_index int, char_start int, char_end int, text string, section_path string, block_types string"


def exploded(docs: DataFrame, id: str, text: str, chunks: Callable[[str], list[tuple]]) -> DataFrame:
    """The rows that `chunks` makes of each text: (index, start, end, text, section, kinds)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, *c) for c in chunks(body or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    made = docs.select(F.col(id).cast("string"), F.col(text)).mapInArrow(step, _SCHEMA)
    return made.withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_index")))


# --- fixed size

def fixed_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows whose ends move back, and starts forward, to a near blank."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    n = len(text)
    flat = text.replace("\n", " ")
    at = 0
    while at < n or n == 0:
        stop = at + size
        if n <= size and at == 0 or stop >= n:
            yield at, n
            return
        blank = flat.rfind(" ", max(0, stop - SNAP), stop)
        stop = blank + 1 if blank >= 0 else stop
        yield at, stop
        again = stop - overlap
        if again <= at:
            at = stop
            continue
        blank = flat.find(" ", again, min(stop, again + SNAP))
        again = blank + 1 if blank >= 0 else again
        at = again if again > at else stop


def fixed_chunks(docs: DataFrame, id: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Blank windows are dropped but keep their index; texts are stripped, offsets are not."""

    def chunks(body: str) -> list[tuple]:
        spans = enumerate(fixed_spans(body, size, overlap)) if body else ()
        return [(i, a, b, part, None, None) for i, (a, b) in spans if (part := body[a:b].strip())]

    return exploded(docs, id, text, chunks).drop("section_path", "block_types")


def whole_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One chunk for each text that is not blank, untouched; a projection, no Python."""
    body = F.col(text)
    rows = docs.filter(strip(body) != "")
    key = F.col(id).cast("string")
    return rows.select(key.alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length(body).alias("char_end"), body.alias("text"), chunk_id(key, F.lit(0)).alias("chunk_id"))


def line_spans(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, nth, start, end of each line, and the end without blanks at its right."""
    lines = F.split(F.col(text), "\n")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<nth:int,start:int,end:int,bare:int>>").alias("out"))

    def step(state, line):
        end = state["at"] + F.length(line)
        bare = state["at"] + F.length(F.regexp_replace(line, r"(?U)\s+\z", ""))
        row = F.struct(F.size(state["out"]).alias("nth"), state["at"].alias("start"), end.alias("end"), bare.alias("bare"))
        return F.struct((end + 1).alias("at"), F.array_append(state["out"], row).alias("out"))

    return docs.select(id, F.explode(F.aggregate(lines, zero, step, lambda s: s["out"])).alias("x")).select(id, "x.*")


# --- by structure

def structured_chunks(
    docs: DataFrame, id: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, split_level: int = SPLIT_LEVEL,
    least: int = MIN_CHARS, prose_overlap: bool = False, length: Callable[[str], int] = len,
) -> DataFrame:
    """Chunks by headings, tables and sentences; `length` measures a text."""
    rules = Rules(size, overlap, split_level, least, prose_overlap, length)

    return exploded(docs, id, text, lambda body: Structure(body, rules).rows())
