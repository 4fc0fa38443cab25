from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import readers as R
from quillspark.sources import sinks as S


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nperiod: 2024-09-28\nticker: 'AB'\n---\n# Title\nbody")
    (tmp_path / "sub/b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "p.jsonl").write_text(json.dumps({"_id": "7", "title": "t", "text": "x"}) + "\n")
    (tmp_path / "bad.md").write_text("---\nnever closed")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "c.bin").write_text("x")
    docs, failed = R.corpus(spark, str(tmp_path))
    rows = {r["id"]: r for r in docs.collect()}
    assert set(rows) == {"a.md", "sub/b.TXT", "7"}
    assert rows["a.md"]["metadata"] == {"title": "Title", "period": "20240928", "ticker": "AB"}
    assert rows["sub/b.TXT"]["text"] == "caf�"
    assert rows["7"]["text"] == "t x"
    assert [r["source"] for r in failed.collect()] == ["bad.md"]


def test_guards(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t2\n1\tb\t0\n")
    assert sorted(map(tuple, R.qrels(spark, str(tmp_path / "q.tsv")).collect())) == [("1", "a", 2), ("1", "b", 0)]
    (tmp_path / "bad.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t2\n1\ta\t1\n")
    with pytest.raises(Exception, match="repeated"):
        R.qrels(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "p.jsonl").write_text('{"_id": "1", "text": "a"}\n{"_id": "1", "text": "b"}\n')
    with pytest.raises(Exception, match="repeated"):
        R.passages(spark, str(tmp_path / "p.jsonl")).collect()


def test_run_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25)], "query_id string, document string, rank int, score double")
    S.write_run(hits, str(tmp_path / "run"), "t")
    assert sorted(map(tuple, R.run_file(spark, str(tmp_path / "run")).collect())) == [("q1", "d1", 0.5, 1), ("q1", "d2", 0.25, 2)]
    with pytest.raises(Exception, match="blanks"):
        S.write_run(hits.withColumn("document", F.lit("a b")), str(tmp_path / "bad"), "t")


def test_samples_and_logs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "1", "query": "q", "expected_spans": ["x", {"text": "y", "grade": 3, "alternatives": ["z"]}], "expected_doc_ids": []}, {"id": "2", "query": "r", "expected_spans": [], "expected_doc_ids": ["d", {"id": "e", "grade": 0}]}]))
    a, b = R.samples(spark, str(tmp_path / "s.json")).orderBy("id").collect()
    assert a["mode"] == "span" and [tuple(s) for s in a["spans"]] == [("x", 1, []), ("y", 3, ["z"])]
    assert b["mode"] == "document" and [tuple(d) for d in b["documents"]] == [("d", 1), ("e", 0)]
    (tmp_path / "log.jsonl").write_text('{"turn_id": "1"}\nnot json\n{"turn_id": "2"}\n')
    good, bad = R.turn_log(spark, str(tmp_path / "log.jsonl"), "turn_id string")
    assert sorted(r[0] for r in good.collect()) == ["1", "2"]
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "context": "1"}\n{"key": "a", "context": "2"}\n{"key": "b", "con')
    assert [tuple(r) for r in R.last_by_key(spark, str(tmp_path / "cache.jsonl")).collect()] == [("a", "2")]


def test_write_once(spark, tmp_path):
    rows = spark.range(3).withColumn("x", F.lit("a"))
    name = S.revision(rows, "id", "x")
    assert name == S.revision(rows.orderBy(F.desc("id")), "id", "x")
    path = S.write_once(rows, str(tmp_path), name)
    S.write_once(rows.limit(1), str(tmp_path), name)
    assert spark.read.parquet(path).count() == 3
