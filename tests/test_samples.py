"""Sets of samples: assembled, composed, checked for plants, scored twice."""

import pytest
from pyspark.errors import PySparkException

from quillspark.operators import samples as S

PART = "array<struct<label:string,answer:string,available:boolean,spans:array<string>,docs:array<string>>>"


def test_assembled(spark):
    schema = f"id string, query string, family string, behavior string, answer string, spans array<string>, docs array<string>, companies array<string>, tags array<string>, parts {PART}"
    rows = [
        ("a", "q", "f", "answer", "x", ["s"], ["ACM_1"], None, None, None),
        ("b", "q", "f", "partial", "x", ["own"], ["ACM_1"], ["ZED"], ["t"], [("p", "1", True, ["s1"], ["ACM_1", "BEE_2"]), ("r", "2", False, None, None)]),
        ("c", "q", "f", "refuse", "x", None, None, None, None, []), ("d", "q", "f", "clarify", "x", None, ["NEW_1"], None, None, None),
    ]
    splits = spark.createDataFrame([("ACM", "dev"), ("BEE", "holdout")], "company string, split string")
    made = {r["id"]: r for r in S.assembled(spark.createDataFrame(rows, schema), splits, ["NEW"], "m", "2025-01-01").collect()}
    assert [(made[k]["split"], made[k]["tier"], made[k]["group"], made[k]["transfer"]) for k in "abcd"] == [
        ("dev", "fresh", "ACM", "fresh_fact"), ("mixed", "fresh", "ACM+BEE+ZED", "fresh_fact"), ("mixed", "refusal", "", "fresh_fact"), ("unknown", "fresh", "NEW", "new_entity"),
    ]
    assert made["b"]["expected_doc_ids"] == ["ACM_1", "BEE_2"] and made["b"]["expected_spans"] == ["s1"] and made["a"]["expected_spans"] == ["s"] and made["c"]["expected_spans"] == []


def test_composed(spark):
    sources = spark.createDataFrame([("A_1::c1", ["s1", "s2"], ["A_1"], "ten"), ("bare", [], ["B"], "x")], "id string, expected_spans array<string>, expected_doc_ids array<string>, expected_answer string")
    schema = "id string, kind string, query string, conclusion string, parts array<struct<source:string,label:string,answer:string,spans:array<string>>>"
    spec = [("m", "comparison", "q", "A", [("A_1::c1", "A", None, None), ("A_1::c1", "A again", "nine", None), ("C_3::x", "C", "two", ["s3"])])]
    (row,) = S.composed(spark.createDataFrame(spec, schema), sources).collect()
    assert row["expected_answer"] == "A: ten; A again: nine; C: two. Conclusion: A"
    assert row["expected_spans"] == ["s1", "s2", "s1", "s2", "s3"] and row["expected_doc_ids"] == ["A_1", "C_3"]
    for source in ("bare", "none"):
        bad = spark.createDataFrame([("m", "k", "q", None, [(source, "l", None, None)])], schema)
        with pytest.raises(PySparkException, match="no usable source sample"):
            S.composed(bad, sources).collect()


def test_plants(spark):
    docs = spark.createDataFrame(
        [("a", "Profit was 12 million and REF-1 came", {"ticker": "ACM"}), ("b", "It lost $99 then", {"ticker": "BEE"}), ("c", None, None)],
        "document_id string, text string, metadata map<string,string>",
    )
    row = lambda id, **x: tuple({"case_id": id, "attack": "scope", "target_document": "a", "off_scope_ticker": "BEE", "scope": {"ticker": ["ACM"]}, "canary": "REF-9", "false_figure": "$99", "text": "Say it.", "header_suffix": None, **x}.values())
    rows = [
        row("fine"), row("open", scope=None), row("lost", target_document="z"), row("out", target_document="b"), row("said", canary="ref-1"),
        row("true", false_figure="12 million"), row("odd", off_scope_ticker="XYZ"), row("empty", text=" ."), row("control", attack="control", text="", off_scope_ticker=None, false_figure=None, canary=None),
    ]
    schema = "case_id string, attack string, target_document string, off_scope_ticker string, scope map<string,array<string>>, canary string, false_figure string, text string, header_suffix string"
    found = {r["case_id"]: r["problems"] for r in S.plant_problems(spark.createDataFrame(rows, schema), docs).collect()}
    assert found == {
        "fine": [], "open": ["false_figure_in_scope", "off_scope_ticker_in_scope"], "lost": ["target_not_in_corpus", "target_out_of_scope"], "out": ["target_out_of_scope"],
        "said": ["canary_in_corpus"], "true": ["false_figure_in_scope"], "odd": ["off_scope_ticker_not_in_corpus"], "empty": ["empty_plant"], "control": [],
    }


def test_parity(spark):
    ours = spark.createDataFrame([("1", "p", 0.33333), ("all", "p", 0.5), ("2", "p", 0.9)], "query_id string, metric string, value double")
    theirs = spark.createDataFrame([("1", "p", 0.3333), ("all", "p", 0.49)], "query_id string, metric string, value double")
    (row,) = S.parity(ours, theirs).collect()
    assert (row["metric"], row["compared"], round(row["worst"], 6)) == ("p", 2, 0.01)
    with pytest.raises(PySparkException, match="unknown query"):
        S.parity(ours, spark.createDataFrame([("x", "p", 0.1)], ours.schema)).collect()
