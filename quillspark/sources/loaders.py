"""A folder of files as a Spark data source, and a sink for turns that commits whole batches.

    spark.dataSource.register(CorpusSource)
    spark.read.format("corpus").load(folder)          # also readStream
    spark.dataSource.register(TurnSink)
    turns.writeStream.format("turns").option("path", folder) ...

Documents come one partition for every few files; filters on `doc_type` and `modified` choose files
before any is opened (with option filters=true and spark.sql.python.filterPushdown.enabled). A file that fails is a row with its `error`. As a
stream, a file comes once for each time it was changed; the offset is the time up to which files
were taken, so a file must not be given an older time than one that was taken.

The sink's tasks write files of their own and report their names; a batch counts when the driver
has written one small file that lists them, never over another. So a batch that was aborted
leaves nothing that is read, and one that is repeated after a failure counts once. read_turns gives the
rows of whole batches; nested spans, attempts and calls come back by projection.

Paths are opened by pyarrow's file systems (local, or any that a URI names there).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, TimestampType

from .readers import DOCUMENT, _read_file

KINDS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "jsonl": "passages"}
#: Files of a partition, and rows that a sink's task holds at most.
FILES, ROWS = 16, 10_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Found:
    path: str
    relative: str
    kind: str
    nanos: int


def listed(folder: str) -> list[Found]:
    """Files of known kinds, oldest first; dot files are passed over."""
    system, root = opened(folder.rstrip("/"))
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        kind = KINDS.get(info.extension.lower())
        if info.type == fs.FileType.File and kind and not info.base_name.startswith("."):
            out.append(Found(info.path, info.path.removeprefix(root).lstrip("/"), kind, info.mtime_ns or 0))
    return sorted(out, key=lambda f: (f.nanos, f.path))


@dataclass
class Files(InputPartition):
    files: list[Found]


def dealt(files: list[Found]) -> list[Files]:
    return [Files(files[i : i + FILES]) for i in range(0, len(files), FILES)]


def documents_of(folder: str, part: Files) -> Iterator[tuple]:
    system, _ = opened(folder)
    for f in part.files:
        modified = datetime.fromtimestamp(f.nanos / 1e9, timezone.utc)
        try:
            with system.open_input_stream(f.path) as file:
                content = file.read()
            for suffix, text, meta in _read_file(f.path, f.kind, content):
                yield suffix if f.kind == "passages" else f.relative + suffix, text, f.relative, f.kind, meta, None, modified
        except (ValueError, KeyError, OSError) as e:
            yield None, None, f.relative, f.kind, {}, f"{type(e).__name__}: {e}", modified


class CorpusReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.kinds, self.after, self.before = folder, None, None, None

    def chosen(self) -> list[Found]:
        nanos = lambda t: t.timestamp() * 1e9
        return [
            f for f in listed(self.folder)
            if (self.kinds is None or f.kind in self.kinds) and (self.after is None or f.nanos >= nanos(self.after) - 1000) and (self.before is None or f.nanos <= nanos(self.before) + 1000)
        ]

    def partitions(self) -> list[Files]:
        return dealt(self.chosen()) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return documents_of(self.folder, partition)


class ChoosingReader(CorpusReader):
    """Spark takes a reader with filters only where the session allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Kinds and times choose files; times are left to Spark as well, which sees microseconds."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("doc_type",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.kinds = wanted if self.kinds is None else self.kinds & wanted
                continue
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("modified",):
                self.after = max(self.after or f.value, f.value)
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("modified",):
                self.before = min(self.before or f.value, f.value)
            yield f


class CorpusStream(DataSourceStreamReader):
    """`settle`: seconds for which a file is left alone after its last change."""

    def __init__(self, folder: str, settle: float) -> None:
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(self.settle * 1e9)
        return {"until": max((f.nanos for f in listed(self.folder) if f.nanos <= limit), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.folder) if start["until"] < f.nanos <= end["until"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return documents_of(self.folder, partition)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> StructType:
        return StructType([*DOCUMENT.fields, StructField("modified", TimestampType())])

    def reader(self, schema: StructType) -> CorpusReader:
        kind = ChoosingReader if self.options.get("filters", "false").lower() == "true" else CorpusReader
        return kind(self.options["path"])

    def streamReader(self, schema: StructType) -> CorpusStream:
        return CorpusStream(self.options["path"], float(self.options.get("settle", "1")))


# --- turns

#: A turn as it is recorded: what was asked and answered, and by which steps.
TURN = """turn_id string, at timestamp, query string, outcome string, answer string,
 attempts array<struct<nth int, query string, passages array<string>, outcome string>>,
 events array<struct<stage string, elapsed double, attempt int>>,
 calls array<struct<tool string, arguments string, status string>>,
 usage struct<requests int, input_tokens long, output_tokens long>"""


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TurnWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.schema = folder.rstrip("/"), schema

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.folder)
        arrow, files, held = to_arrow_schema(self.schema), [], []

        def put() -> None:
            name = f"rows-{uuid.uuid4().hex}.parquet"
            system.create_dir(f"{root}/turns", recursive=True)
            table = pa.Table.from_pylist([r.asDict(recursive=True) for r in held], schema=arrow)
            with system.open_output_stream(f"{root}/turns/{name}") as out:
                pq.write_table(table, out)
            files.append(name)
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                put()
        if held:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = opened(self.folder)
        system.create_dir(f"{root}/batches", recursive=True)
        mark = f"{root}/batches/{batchId:012}.json"
        files = [f for m in messages if m for f in m.files]
        if system.get_file_info(mark).type != fs.FileType.NotFound:
            self._drop(files)  # the batch was committed before a failure
            return
        with system.open_output_stream(f"{mark}.part") as out:
            out.write((json.dumps({"batch": batchId, "files": files}) + "\n").encode())
        system.move(f"{mark}.part", mark)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop([f for m in messages if m for f in m.files])

    def _drop(self, files: list[str]) -> None:
        system, root = opened(self.folder)
        for name in files:
            if system.get_file_info(f"{root}/turns/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/turns/{name}")


class TurnSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "turns"

    def streamWriter(self, schema: StructType, overwrite: bool) -> TurnWriter:
        return TurnWriter(self.options["path"], schema)


def read_turns(spark: SparkSession, folder: str, schema: str = TURN) -> DataFrame:
    """The turns of all whole batches."""
    folder = folder.rstrip("/")
    system, root = opened(folder)
    if system.get_file_info(f"{root}/batches").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    names = spark.read.schema("batch long, files array<string>").option("pathGlobFilter", "*.json").json(f"{folder}/batches")
    paths = [f"{folder}/turns/{f}" for r in names.collect() for f in r["files"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
