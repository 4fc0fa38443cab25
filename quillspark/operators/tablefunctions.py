"""Chunkers and section candidates as table functions of SQL.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL fixed_chunks(d.text, 1000, 150) c
    SELECT d.doc_id, c.* FROM documents d, LATERAL structured_chunks(d.text, 200, 0, 50, 'words') c
    SELECT * FROM numbered_lines(TABLE(documents) PARTITION BY doc_id)

Thin over the same functions that the DataFrame operators use. Sizes are checked when a query is
planned, lengths are measured by a function that MEASURES names.

Defined results: null and empty texts give no rows; a size that isn't a constant or an unknown
measure fails before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .chunking import fixed_spans
from .drafts import section_candidates
from .structure import Rules, Structure

#: Lengths of a text by name.
MEASURES: dict[str, Callable[[str], int]] = {"characters": len, "words": lambda s: len(s.split()), "bytes": lambda s: len(s.encode())}

_PLACE = [StructField("chunk_index", IntegerType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("text", StringType())]


def constant(argument: AnalyzeArgument, name: str) -> object:
    if argument.isTable or not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class FixedChunks:
    """Overlapping windows that end and begin at blanks."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if constant(overlap, "overlap") >= constant(size, "size"):
            raise ValueError("the overlap must be smaller than the size")
        return AnalyzeResult(StructType(_PLACE))

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (a, b) in enumerate(fixed_spans(text, size, overlap)) if text else ():
            if part := text[a:b].strip():
                yield i, a, b, part


class StructuredChunks:
    """By headings, tables and sentences; at most `size` by the named measure."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, least: AnalyzeArgument, measure: AnalyzeArgument) -> AnalyzeResult:
        if constant(measure, "measure") not in MEASURES:
            raise ValueError(f"the measure must be one of {', '.join(MEASURES)}")
        Rules(constant(size, "size"), constant(overlap, "overlap"), least=constant(least, "least"))
        return AnalyzeResult(StructType([*_PLACE, StructField("section_path", StringType()), StructField("block_types", StringType())]))

    def eval(self, text: str, size: int, overlap: int, least: int, measure: str) -> Iterator[tuple]:
        yield from Structure(text or "", Rules(size, overlap, least=least, length=MEASURES[measure])).rows()


class SectionCandidates:
    """Where a section may start and end."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType(_PLACE))

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (a, b) in enumerate(section_candidates(text or "")):
            yield i, a, b, text[a:b]


class NumberedLines:
    """The lines of a table's column `text`, numbered over all rows of a partition of the table."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "text" not in rows.dataType.names:
            raise ValueError("give a table with a column `text`")
        return AnalyzeResult(StructType([StructField("nth", LongType()), StructField("line", StringType())]))

    def __init__(self) -> None:
        self.nth = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for line in (row["text"] or "").split("\n") if row["text"] else ():
            yield self.nth, line
            self.nth += 1


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, kind in {"fixed_chunks": FixedChunks, "structured_chunks": StructuredChunks, "section_candidates": SectionCandidates, "numbered_lines": NumberedLines}.items():
        spark.udtf.register(name, udtf(kind))
