"""What the operators of this subpackage share: columns, shared storage, batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

#: What separates words, as a class for regular expressions.
BLANK = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where Spark runs in
    this one process is there a folder of our own without it; on a cluster that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/quillspark-{uuid.uuid4().hex}"
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What materialize() writes inside is deleted at the end, but for what it was told to keep."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            forget(df)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts that go to a Python worker at once.
BATCH = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(step: Step) -> Step:
    """The step; what its worker has freed goes back to the machine, as workers live on between
    tasks and each would keep the most it ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def map_texts(df: DataFrame, step: Step, schema) -> DataFrame:
    """mapInArrow over rows with texts. Batches are held to BATCH bytes, unless the session sets
    another bound, so that a worker's memory follows the longest text and not the sum of thousands."""
    spark = df.sparkSession
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH))
    return df.mapInArrow(trimmed(step), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold about `limit` bytes: Python's strings and what is made
    of them take several times the bytes of the batch itself."""
    data = batch.column(column)
    start = size = 0
    for i in range(len(data)):
        n = len(data[i].as_buffer()) if data[i].is_valid else 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(data):
        yield batch.slice(start)


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for piece in slices(batch, at):
            yield piece, [x or "" for x in piece.column(at).to_pylist()]
