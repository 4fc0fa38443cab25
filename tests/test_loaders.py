"""The folder source and the turn sink: partitions, filters, streams, batches that fail and repeat."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import Row, StructType

from quillspark.sources import loaders as L
from quillspark.sources import readers as R


def put(path, text: str, second: int) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, ns=(second * 10**9, second * 10**9))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    put(root / "a.txt", "one", 1000)
    put(root / "deep" / "b.md", "# Bee\n\nbody", 2000)
    put(root / "c.jsonl", '{"_id": "p1", "title": "T", "text": "x"}\n{"_id": "p2", "text": "y"}\n', 3000)
    put(root / "bad.md", "---\nopen", 4000)
    put(root / ".hidden.txt", "no", 4000)
    put(root / "d.png", "no", 4000)
    for i in range(40):
        put(root / f"n{i}.txt", f"text {i}", 5000 + i)
    return root


def test_reads_as_the_reader(spark, folder):
    spark.dataSource.register(L.CorpusSource)
    got = spark.read.format("corpus").load(str(folder))
    good, failed = R.corpus(spark, str(folder))
    key = lambda df: sorted((r["id"], r["text"], r["source"], r["doc_type"], tuple(sorted(r["metadata"].items()))) for r in df.collect())
    assert key(got.filter("error is null")) == key(good) and got.count() == 45
    assert [r["source"] for r in got.filter("error is not null").collect()] == [r["source"] for r in failed.collect()] == ["bad.md"]
    assert got.rdd.getNumPartitions() == 3 and got.filter("source = 'a.txt'").first()["modified"].replace(tzinfo=timezone.utc).timestamp() == 1000


def test_filters_choose_files(spark, folder):
    reader = L.ChoosingReader(str(folder))
    when = datetime.fromtimestamp(5030, timezone.utc)
    left = list(reader.pushFilters([In(("doc_type",), ("text", "markdown")), EqualTo(("doc_type",), "text"), GreaterThan(("modified",), when), EqualTo(("id",), "x")]))
    assert left == [GreaterThan(("modified",), when), EqualTo(("id",), "x")] and [f.relative for f in reader.chosen()] == [f"n{i}.txt" for i in range(30, 40)]
    spark.dataSource.register(L.CorpusSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        chosen = spark.read.format("corpus").option("filters", "true").load(str(folder))
        rows = chosen.filter("doc_type = 'passages'")
        assert sorted(r["id"] for r in rows.collect()) == ["p1", "p2"] and rows.rdd.getNumPartitions() == 1
        assert chosen.filter("doc_type = 'none'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_streams_each_change_once(spark, folder, tmp_path):
    spark.dataSource.register(L.CorpusSource)

    def run() -> list:
        stream = spark.readStream.format("corpus").option("settle", "0").load(str(folder)).select("id", "text", "error")
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        job.awaitTermination()
        return sorted((r["id"] or "", r["text"] or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 45 and run() == first
    put(folder / "a.txt", "changed", 9000)
    put(folder / "e.txt", "new", 9001)
    assert run() == sorted([*first, ("a.txt", "changed"), ("e.txt", "new")])


def turn(i: int) -> Row:
    return Row(
        turn_id=f"t{i}", at=datetime(2024, 1, 1, 0, i % 60), query=f"q{i}", outcome="answered", answer=None,
        attempts=[Row(nth=1, query="q", passages=["a", "b"], outcome="weak"), Row(nth=2, query="r", passages=[], outcome="good")], events=[Row(stage="search", elapsed=1.5 * i, attempt=1)], calls=[], usage=None,
    )


def test_sink_commits_whole_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "ROWS", 3)
    folder = f"file://{tmp_path}/turns"
    schema = spark.createDataFrame([], L.TURN).schema
    assert L.read_turns(spark, folder).count() == 0
    writer = L.TurnWriter(folder, schema)
    writer.commit([writer.write(iter([turn(i) for i in range(7)])), writer.write(iter([])), None], 0)
    lost = writer.write(iter([turn(99)]))
    writer.abort([lost, None], 1)
    writer.write(iter([turn(98)]))  # a task whose driver was lost: nobody committed it
    writer.commit([writer.write(iter([turn(7)]))], 1)
    writer.commit([writer.write(iter([turn(7)]))], 1)  # again, after a failure
    got = L.read_turns(spark, folder)
    assert sorted(r["turn_id"] for r in got.collect()) == [f"t{i}" for i in range(8)]
    assert len(os.listdir(tmp_path / "turns" / "turns")) == 5 and isinstance(got.schema, StructType)
    spans = got.select("turn_id", F.inline("events")).filter("elapsed > 9").collect()
    assert [(r["turn_id"], r["stage"], r["elapsed"]) for r in spans] == [("t7", "search", 10.5)]
    attempts = got.filter("turn_id = 't3'").select(F.inline("attempts")).collect()
    assert [(r["nth"], r["passages"]) for r in attempts] == [(1, ["a", "b"]), (2, [])]


def test_sink_as_a_stream(spark, tmp_path):
    """Several batches and a second start: every turn once."""
    spark.dataSource.register(L.TurnSink)
    folder, source = f"file://{tmp_path}/turns", str(tmp_path / "in")
    schema = spark.createDataFrame([], L.TURN).schema

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        job = stream.writeStream.format("turns").option("path", folder).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()

    spark.createDataFrame([turn(i) for i in range(10)], schema).repartition(3).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([turn(i) for i in range(10, 14)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(int(r["turn_id"][1:]) for r in L.read_turns(spark, folder).collect()) == list(range(14))
