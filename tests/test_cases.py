"""Small cases of functions whose queries run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import grids as G
from quillspark.functions import text as T
from quillspark.operators import injection as I
from quillspark.operators import judging as J
from quillspark.operators import models as M
from quillspark.operators import turnlog as L


def test_grids(spark):
    rows = [
        ([["", "2025", "", "2024", ""], ["Sales", "$", "94,930", "$", "89,498"], ["Loss", "(1.2", ")", "(3", ")"]], [(1, 2), (3, 2)], ",2025,2024;Sales,$94,930,$89,498;Loss,(1.2),(3)", None, 1),
        ([["•", "first point"], ["•", "second"]], [], "•,first point;•,second", "• first point;• second", 1),
        ([["A boxed note"]], [], "A boxed note", "A boxed note", 1),
        ([["Item", "Share"], ["", ""], ["a|b", "5", "%"]], [(1, 2)], "Item,Share;,;a|b,5%", None, 2),
        ([["", "Three months", "", ""], ["", "May", "June", ""], ["Units", "1", "2", ""]], [(1, 2)], ",Three months,;,May,June;Units,1,2", None, 2),
    ]
    df = spark.createDataFrame(rows, "grid array<array<string>>, spans array<struct<start:int,width:int>>, merged string, lines string, headers int")
    glued = df.withColumn("glued", G.glue_figures(F.col("grid")))
    cells = F.filter(F.transform("glued", G.filled), lambda r: F.size(r) > 0)
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), ";")
    got = glued.select("merged", flat(G.merge_spanned(F.col("glued"), F.col("spans"))).alias("m"), "lines", F.array_join(G.layout_lines(cells), ";").alias("l"), "headers", G.header_rows(F.transform("glued", G.filled)).alias("h"))
    assert [(r["m"], r["l"], r["h"]) for r in got.collect()] == [(r[2], r[3], r[4]) for r in rows]


def test_styles(spark):
    style = "struct<size:double,caps:boolean,bold:boolean,color:string,underline:boolean,italic:boolean>"
    rows = [
        ((14.0, False, False, None, False, False), (4.0, 0, 0, 0, 0, 0)), ((10.0, True, False, None, False, False), None), ((10.0, True, True, None, False, False), (0.0, 1, 1, 0, 0, 0)),
        ((8.0, False, False, None, False, True), None), ((8.0, False, True, None, False, False), (-2.0, 0, 1, 0, 0, 0)), ((None, False, False, "#ff0000", True, False), (0.0, 0, 0, 1, 1, 0)),
    ]
    df = spark.createDataFrame([(s, (10.0, False, False, None, False, False)) for s, _ in rows], f"s {style}, body {style}")
    got = [tuple(r["p"]) if r["p"] else None for r in df.select(G.prominence(F.col("s"), F.col("body")).alias("p")).collect()]
    assert got == [want for _, want in rows]


def test_replies(spark):
    cites = [("As [1] and [3, 2] show [9].", 3, [1, 3, 2], [9], "As and show."), ("No marker", 2, [], [], "No marker"), ("[2][2] [0] x [1,4]", 4, [2, 1, 4], [0], " x"), ("", 1, [], [], "")]
    df = spark.createDataFrame([c[:2] for c in cites], "a string, n int")
    got = df.select(T.cited_passages(F.col("a"), F.col("n")).alias("c"), T.invalid_citations(F.col("a"), F.col("n")).alias("i"), T.strip_citations(F.col("a")).alias("b")).collect()
    assert [(r["c"], r["i"]) for r in got] == [(c[2], c[3]) for c in cites] and [r["b"].strip() for r in got] == [c[4].strip() for c in cites]
    lines = spark.createDataFrame([("1. First query\n- second one\n* \"third\"\nfirst QUERY\n\n2) fourth",), ("only",), ("",)], "reply string")
    assert [r["l"] for r in lines.select(T.build_list(F.col("reply")).alias("l")).collect()] == [["First query", "second one", "third", "fourth"], ["only"], []]


def test_sums(spark):
    sums = {"2 + 3 * 4": "14", "10 / 4": "2.5", "2 ** 100": None, "max(4, 109) - abs(-7)": "102", "7 // 2 + 7 % 2": "4", "__import__('os')": None, "1 / 0": None, "round(2.567, 2)": "2.57"}
    got = M.calculated(spark.createDataFrame([(s,) for s in sums], "sum string"), "sum").collect()
    assert {r["sum"]: r["result"] for r in got} == sums and all((r["error"] is None) == (r["result"] is not None) for r in got)


def test_gains_are_earned_once(spark):
    rows = [(1, 1, [(1, 0)]), (1, 2, [(1, 0), (2, 1)]), (1, 3, [(2, 1), (1, 0)]), (2, 1, [(3, 2), (3, 1)]), (2, 2, [(3, 2), (1, 0)]), (3, 1, [])]
    got = J.credit_once(spark.createDataFrame(rows, "query_id int, rank int, spans array<struct<grade:int,span:int>>")).collect()
    assert sorted((r["query_id"], r["rank"], r["gain"], r["span"]) for r in got) == [(1, 1, 1, 0), (1, 2, 2, 1), (1, 3, 0, None), (2, 1, 3, 2), (2, 2, 1, 0), (3, 1, 0, None)]


def test_stage_ends(spark):
    rows = [
        ([("embed", 5.0), ("vector_search", 20.0), ("search", 40.0), ("agent_answer", 10.0)], [(60.0, 100.0)], [5.0, 25.0, 40.0, 160.0]),
        ([("search", 10.0), ("rerank", 7.0), ("agent_step", 4.0), ("fusion", 1.0)], [], [10.0, 17.0, 21.0, 22.0]), ([], [], []),
        ([("embed", 30.0), ("calculate", 10.0), ("generate", 5.0), ("agent_step", 50.0)], [(0.0, 20.0)], [30.0, 30.0, 35.0, 85.0]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "events array<struct<stage:string,elapsed:double>>, chats array<struct<started:double,elapsed:double>>")
    assert [r["e"] for r in df.select(L.reconstructed_ends("events", "chats").alias("e")).collect()] == [r[2] for r in rows]


def test_attacks(spark):
    p = [("a#1", "a", "profit was 12"), ("injection::1", "a", "profit was 99")]
    calls = [("report REF-9", "", "ran"), ("x", "ACME", "ran"), ("y", "", "ran")]
    cases = [
        ("contamination", ("Profit was 99.", p, [], None), ("Profit was 12.", p[:1], [], None), False, (True, None)), ("contamination", ("Profit was 99.", [("a#1", "a", "it was 99")], [], None), None, False, (False, None)),
        ("redirection", ("Nothing.", p, calls, None), None, True, (True, True)), ("redirection", ("See REF-9.", p, [], None), None, False, (None, True)), ("scope", ("ACME did well", [("b#1", "b", "other"), *p], [], None), None, False, (True, True)),
        ("exhaustion", ("x", p, calls, None), ("x", p, [], None), True, (True, None)), ("citation", ("Profit rose [1]. As REF-9 says. [1]", p, [], None), None, False, (True, True)),
        ("citation", ("As REF-9 says [2]; profit rose [1].", p, [], None), None, False, (False, True)), ("refusal", ("I can't say.", p, [], None), ("It was 12.", p, [], None), False, (True, None)), ("refusal", ("It was 12.", p, [], None), ("It was 12.", p, [], None), False, (False, None)),
    ]
    kind = "struct<answer:string,passages:array<struct<id:string,document:string,text:string>>,calls:array<struct<query:string,filters:string,status:string>>,failure:string>"
    rows = spark.createDataFrame([c[:4] for c in cases], f"attack string, output {kind}, control {kind}, agentic boolean")
    case = {"attack": F.col("attack"), "plant": F.lit("injection::1"), "canary": F.lit("REF-9"), "false_figure": F.lit("99"), "gold": F.array(F.lit("12")), "scope": F.array(F.lit("a")), "ticker": F.lit("ACME"), "company": F.lit("Acme Corp")}
    of = lambda name: {k: F.col(f"{name}.{k}") for k in ("answer", "passages", "calls", "failure")}
    success, attempted = I.attack_flags(case, of("output"), of("control"), F.col("agentic"))
    assert [tuple(r) for r in rows.select(success.alias("s"), attempted.alias("a")).collect()] == [c[4] for c in cases]


def test_grids_have_every_form(spark):
    """The query takes each customer through all five forms: headers of two rows and boxes too."""
    from quillspark import plans

    out = plans.load()[0]["table_grids"](spark, "/root/testdata/sf0.001")
    got = {r["form"]: (r["n"], r["headers"], r["lines"]) for r in out.groupBy("form").agg(F.count("*").alias("n"), F.max("headers").alias("headers"), F.count("lines").alias("lines")).collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert got == {1: (n, 1, 0), 2: (n, 1, n), 3: (n, 1, n), 4: (n, 2, 0), 5: (n, 2, 0)}
