"""Steps around generators, manifests and table headers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions.tables import chunk_table_start, table_header
from quillspark.functions.text import build_list
from quillspark.operators import generation as G
from quillspark.operators import manifest as M


def failing():
    """Made here, so that it travels to the workers by value."""

    def broken(prompts):
        raise RuntimeError("no model")

    return broken


def test_contexts_are_cached_and_fail_open(spark):
    chunks = spark.createDataFrame([("d", "a"), ("d", "b")], "document_id string, text string")
    docs = spark.createDataFrame([("d", "a b")], "id string, text string")
    none = spark.createDataFrame([], "key string, context string")
    out, add = G.contextualized(chunks, docs, none, "m", 100, lambda ps: [p[-1] + "!" for p in ps])
    assert sorted((r["text"], r["context"]) for r in out.collect()) == [("a", "a!"), ("b", "b!")]
    again, more = G.contextualized(chunks, docs, add, "m", 100, failing())
    assert more.count() == 0 and {r["context"] for r in again.collect()} == {"a!", "b!"}
    failed, _ = G.contextualized(chunks, docs, none, "m", 100, failing())
    assert [r["context"] for r in failed.collect()] == [None, None]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "ask")], "query_id int, text string")
    rows = G.rewrites(q, 2, lambda ps: ["1. ask\n- Other\nother\nthird\nfourth"] * len(ps)).filter("consumer = 'sparse'").orderBy("ordinal")
    assert [r["text"] for r in rows.collect()] == ["ask", "Other", "third"]
    dense = G.hypothetical(q, lambda ps: [" made up "] * len(ps)).orderBy("consumer", "ordinal").collect()
    assert [(r["consumer"], r["text"]) for r in dense] == [("dense", "made up"), ("dense", "ask"), ("sparse", "ask")]
    assert G.hypothetical(q, failing()).filter("consumer = 'dense'").count() == 1
    assert spark.range(1).select(build_list(F.lit("B\nb\n\n* a"))).first()[0] == ["B", "a"]


def test_judgments(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, answer string")
    said = {"x": "PASS it is", "y": "hm"}
    out = {r["id"]: r["verdict"] for r in G.judged(rows, F.col("answer"), lambda ps: [said[p] for p in ps]).collect()}
    assert out == {1: True, 2: False, 3: None}
    held = G.grounded(rows.filter("id = 1"), F.col("answer"), lambda ps: ["ungrounded."] * len(ps)).first()["grounded"]
    assert held is False


def test_condensed(spark):
    turns = spark.createDataFrame([(1, 0, "user", "what"), (1, 1, "assistant", "this [2]"), (1, 2, "user", "and?"), (2, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    out = {r["conv_id"]: r["question"] for r in G.condensed(turns, 4, lambda ps: [p.replace("\n", "/") for p in ps]).collect()}
    assert out == {1: "User: what/Assistant: this//Follow-up: and?", 2: "Follow-up: hi"}
    assert {r["question"] for r in G.condensed(turns, 4, failing()).collect()} == {"and?", "hi"}


def test_manifest(spark):
    built = {"chunk": {"size": 1000}, "embed": {"model": "m", "dims": 4}, "run": {"k": 5}}
    now = M.overridden(built, "run.k", 7)
    M.check_extend(spark, built, now)
    M.check_query(spark, built, now)
    assert M.fingerprint(built) != M.fingerprint(now) and M.fingerprint(built, ["run"]) == M.fingerprint(now, ["run"])
    other = M.overridden(built, "embed.model", "n")
    with pytest.raises(ValueError, match="embed.model"):
        M.check_extend(spark, built, other)
    with pytest.raises(ValueError, match="other vectors"):
        M.check_query(spark, built, other)
    M.check_extend(spark, built, other, reset=True)
    first = M.build_record(None, "abcdef0123456789")
    assert M.build_record(first, "abcdef0123456789") == first and M.build_record(first, "ff" * 8)["id"] != first["id"]
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, label string")
    assert [(r["id"], r["problems"]) for r in M.readiness(rows, {"unlabelled": F.col("label").isNull()}).collect()] == [(1, ["unlabelled"])]


def test_table_headers(spark):
    text = "intro\n| a |\n|---|\n\n| 1 |\n| 2 |\nend"
    at = text.index("| 2 |")
    row = spark.range(1).select(table_header(F.lit(text), F.lit(at)).alias("h"), chunk_table_start(F.lit(text), F.lit(at), F.lit("| a |\n|---|\n| 2 |")).alias("same"), chunk_table_start(F.lit(text), F.lit(at), F.lit("| 2 |")).alias("bare")).first()
    assert row["h"] == "| a |\n|---|" and row["same"] is None and row["bare"] == "later_row"
