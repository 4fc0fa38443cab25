"""Composed retrieval, stores, sinks and guards."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation as E
from quillspark.operators import injection as I
from quillspark.operators import manifest as M
from quillspark.operators import retrieval as R
from quillspark.operators import retriever as P
from quillspark.operators import stores as S
from quillspark.operators import turnlog as L
from quillspark.sources import readers, sinks


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, "sky pie")], "id long, text string")
    return docs, R.keyword_index(docs, "id", "text", okapi=False)


def test_retriever(spark, found):
    docs, index = found
    queries = spark.createDataFrame([(1, "apple"), (2, "  "), (3, "sky")], "query_id long, text string")
    plain = P.Retriever([P.keyword_search(index, 3)], docs, top_k=3, keep=2).retrieve(queries)
    assert {(r["query_id"], r["id"]) for r in plain.hits.collect()} == {(1, 1), (1, 2), (3, 3), (3, 4)}
    assert {(r["query_id"], r["candidates"], r["returned"]) for r in plain.counts.collect()} == {(1, 2, 2), (2, 0, 0), (3, 2, 2)}
    wider = lambda q: q.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("variant"), "text"), F.struct(F.lit(1).alias("variant"), F.lit("pie").alias("text")))).alias("v")).select("query_id", "v.*")
    both = P.Retriever([P.keyword_search(index, 4)], docs, top_k=4, keep=4, expand=wider).retrieve(queries.filter("query_id = 1"))
    assert {r["id"] for r in both.hits.collect()} == {1, 2, 4} and both.hits.orderBy("rank").first()["id"] == 1
    routed = lambda q: q.select("query_id", F.lit(2).cast("long").alias("id")).filter("query_id = 1")
    picked = P.Retriever([P.keyword_search(index, 3)], docs, route=routed).retrieve(queries)
    assert {(r["query_id"], r["id"]) for r in picked.hits.collect()} == {(1, 2), (3, 3), (3, 4)} or {r["id"] for r in picked.hits.filter("query_id = 1").collect()} == {2}
    allowed = docs.filter("id <> 1").select("id")
    only = P.Retriever([P.keyword_search(index, 3)], docs, route=routed).retrieve(queries, allowed)
    assert {r["id"] for r in only.hits.filter("query_id = 1").collect()} == {2}
    built = P.build({"searches": ["words"], "texts": "texts", "top_k": 3, "keep": 1}, {"words": P.keyword_search(index, 3), "texts": docs})
    assert built.retrieve(queries).hits.count() == 2
    for wrong in ({"searches": ["none"], "texts": "texts"}, {"searches": [], "texts": "texts", "x": 1}, {"searches": [], "texts": "texts", "keep": 30}):
        with pytest.raises(ValueError):
            P.build(wrong, {"texts": docs})
    assert P.chunker("fixed") and set(P.chunkers()) >= {"fixed", "whole", "structured"}
    with pytest.raises(ValueError, match="no chunker"):
        P.chunker("none")


def test_stores(spark, found, tmp_path):
    store = S.VectorStore(spark, str(tmp_path / "v"), "id long, vector array<double>")
    assert store.read().count() == 0 and store.versions() == []
    store.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], store.schema))
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, vector array<double>")
    assert [r["id"] for r in store.search(asked, 1).collect()] == [1]
    store.delete(spark.createDataFrame([(1,), (9,)], "id long"))
    assert [r["id"] for r in store.read().collect()] == [2] and len(store.versions()) == 2
    os.makedirs(tmp_path / "v" / "v9")  # a version that was never finished
    assert [r["id"] for r in store.read().collect()] == [2]
    with pytest.raises(Exception, match="repeated id"):
        store.upsert(spark.createDataFrame([(3, [1.0]), (3, [2.0])], store.schema))
    store.reset()
    assert store.read().count() == 0
    kept = S.KeywordStore(spark, str(tmp_path / "k"), "long")
    kept.save(found[1])
    ask = spark.createDataFrame([(1, "green")], "query_id long, text string")
    assert [r["id"] for r in kept.search(ask, 5, R.FTS).collect()] == [2]
    kept.reset()
    assert kept.search(ask, 5, R.FTS).count() == 0
    S.write_manifest(spark, str(tmp_path / "m"), {"chunk": {"size": 10}}, {"id": "b"})
    assert S.read_manifest(spark, str(tmp_path / "m")) == {"chunk": {"size": 10}, "build": {"id": "b"}}


def test_cached_corpus(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    first = readers.fingerprint(spark, str(folder))
    assert [r["text"] for r in readers.cached_corpus(spark, str(folder), cache).collect()] == ["one"]
    assert first == readers.fingerprint(spark, str(folder)) and len(os.listdir(cache)) == 1
    (folder / "b.txt").write_text("two")
    assert {r["text"] for r in readers.cached_corpus(spark, str(folder), cache).collect()} == {"one", "two"}
    assert readers.fingerprint(spark, str(folder)) != first


def test_front_matter():
    fields, body = readers.split_front_matter("---\ntags: [a, 'b c', 2024-01-02]\ndraft: yes\npeople:\n  - Ann\n  - Bo\n# note\nempty: ~\n---\nbody")
    assert fields == {"tags": '["a", "b c", "20240102"]', "draft": "true", "people": '["Ann", "Bo"]', "empty": ""} and body == "body"
    with pytest.raises(ValueError):
        readers.split_front_matter("---\n- a\n---\nx")


def test_sample_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "q2"), ("a", "q1")], "id string, query string")
    sinks.write_samples(rows, str(tmp_path / "s"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect())
    assert json.loads(text) == [{"id": "a", "query": "q1"}, {"id": "b", "query": "q2"}]
    hits = spark.createDataFrame([("q1", "d1", 1, 0.5)], "query_id string, document string, rank int, score double")
    sinks.write_qrels_run({"final": hits}, {"final": hits.select("query_id", F.lit(1.0).alias("ndcg"))}, str(tmp_path / "run"), "t", {"k": 10})
    assert readers.run_file(spark, str(tmp_path / "run/final.trec")).count() == 1
    assert json.loads(spark.read.json(str(tmp_path / "run/scores")).first()["settings"]) == {"k": 10}


def test_musique_disagreement(spark):
    schema = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>"
    row = lambda id, held, steps: (id, "q", "a", [], [(0, "t", "x", True), (1, None, "y", held)], [(i, "q", "a", s) for i, s in enumerate(steps)])
    good = readers.musique_samples(spark.createDataFrame([row("2hop__1", True, [0, 1])], schema)).first()
    assert good["kind"] == "2hop" and good["hop_type"] == "2hop" and [p["span"] for p in good["parts"]] == good["spans"] == ["t x", "y"]
    for bad, why in ((row("3hop__1", True, [0, 1]), "hops"), (row("2hop__1", False, [0, 1]), "no supporting"), (row("1hop__1", True, [0]), "disagree")):
        with pytest.raises(Exception, match=why):
            readers.musique_samples(spark.createDataFrame([bad], schema)).collect()


def test_guards(spark):
    E.check_depths(100, 10)
    for depths in ((99, 10), (100, 9)):
        with pytest.raises(ValueError):
            E.check_depths(*depths)
    attempts = spark.createDataFrame([("a", "complete", "r", "o"), ("b", "running", "r", "o"), ("c", "complete", "x", "o")], "ref string, status string, references string, outputs string")
    assert E.pick_attempt(attempts, "r", "o") == "a" == E.pick_attempt(attempts, "r", "o", "a")
    for args, why in ((("r", "o", "b"), "complete"), (("r", "o", "c"), "other"), (("r", "o", "z"), "unknown"), (("y", "o"), "other references")):
        with pytest.raises(ValueError, match=why):
            E.pick_attempt(attempts, *args)
    with pytest.raises(ValueError, match="several"):
        E.pick_attempt(attempts.withColumn("references", F.lit("r")), "r", "o")
    base = {"stage": "answers", "scores": {"judge": "j"}, "config": {"k": 5, "model": "m"}, "index": {"corpus": "c"}, "code": "1"}
    assert E.check_pair(base, {**base, "config": {"k": 6, "model": "n"}, "code": "2"}, ["config.model"]) == ["code: '1' -> '2'", "config.k: 5 -> 6"]
    assert E.check_pair(base, {**base, "index": {"corpus": "d"}}, ["index.corpus"]) == []
    with pytest.raises(ValueError, match="different stages; different judges"):
        E.check_pair(base, {**base, "stage": "x", "scores": {"judge": "k"}})
    wanted = R.QueryFilter(equals=(("lang", "en"),), any_of=(("s", ("a", "b")),), between=(("n", 1, None),))
    assert wanted.describe() == "lang=en, s in ['a', 'b'], n in [1, ]" and R.QueryFilter().describe() == "(empty)"
    assert T.template_fields("{a} and {b}, {a}") == ["a", "b"]
    for wrong in ("{}", "{0}", "{a.b}", "{a[0]}"):
        with pytest.raises(ValueError):
            T.template_fields(wrong)
    with pytest.raises(ValueError, match="names"):
        T.check_record_template("{a} {c}", ["a", "b"])
    assert M.legacy_digest({"b": 1, "a": "é"}) == M.legacy_digest({"a": "é", "b": 1}) and len(M.legacy_digest(None)) == 16
    one = M.judge_identity({"model": "m"}, "answers", ["p"], "v1", [{"id": 1, "a": "x"}, {"id": 2, "a": "y"}])
    assert one["hash"] == M.judge_identity({"model": "m"}, "answers", ["p"], "v1", [{"id": 2, "a": "y"}, {"id": 1, "a": "x"}])["hash"]
    assert one["hash"] != M.judge_identity({"model": "n"}, "answers", ["p"], "v1", [])["hash"]
    with pytest.raises(Exception, match="no answer"):
        spark.range(1).select(T.golds(F.lit(""), F.array(F.lit("x")))).collect()


def test_claims(spark):
    cases = [
        ("A REF-1 [2]. [1]", "REF-1", ["p", "q"], "p", True), ("[2] A REF-1. [1]", "REF-1", ["p", "q"], "p", False), ("REF-1 [9]", "REF-1", ["p"], "p", False), (None, "x", None, "p", False),
        ("x [1]", "", ["q"], "p", False), ("ref-1 is true; see [1, 2]", "REF-1", ["p", "q"], "p", False), ("a ref-1! [ 1]\nand REF-1\n[1 , 2] [3]", "ref-1", ["p", "p", "q"], "p", True),
        ("no end of ref.1 [1", "ref.1", ["q"], "p", False), ("refX1 [1]", "ref.1", ["q"], "p", False), ("Z\\E.+ [1]", "z\\E.+", ["q"], "p", True), ("É 2.5 [1]. é 2.5 [99999999999]", "é 2.5", ["q"], "p", True),
    ]
    rows = spark.createDataFrame(cases, "a string, c string, s array<string>, p string, want boolean")
    assert [r["got"] == r["want"] for r in rows.select(I.misattributed(*(F.col(c) for c in "acsp")).alias("got"), "want").collect()] == [True] * len(cases)
    assert L.laid_out([{"stage": "rerank", "elapsed": None}], None) == [0.0]


def test_dense_blocks(spark, monkeypatch):
    """Products in blocks against every cosine by itself, with ties, nulls and a vector of zeros."""
    import random

    rng = random.Random(2)
    rows = [(f"v{i:03}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(200)] + [("zero", [0.0, 0.0, 0.0]), ("none", None)]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, float(i), -1.0]) for i in range(5)], "query_id long, vector array<double>")
    cos = lambda a, b: (n := (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5) and sum(x * y for x, y in zip(a, b, strict=True)) / n
    want = {(q, rank): id for q in range(5) for rank, (_, id) in enumerate(sorted((-round(cos([1.0, float(q), -1.0], v), 9), id) for id, v in rows if v)[:7], 1)}
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    got = {(r["query_id"], r["rank"]): r["id"] for r in R.dense_top_k(asked, vectors, 7).collect()}
    assert got == want
    assert R.dense_top_k(asked.limit(0), vectors, 3).count() == 0 and R.dense_top_k(asked, vectors.limit(0), 3).count() == 0


def test_many_short_quotes(spark, monkeypatch):
    from quillspark.operators import judging as J

    monkeypatch.setattr(J, "QUOTES", 3)
    texts = spark.createDataFrame([(i, f"word{i} and some longer run of words number {i}") for i in range(12)], "doc_id long, body string")
    quotes = [(i, f"ord{i} an") for i in range(10)] + [(100 + i, f"some longer run of words number {i}") for i in range(10)] + [(200, "")]
    found = J.containment(texts, spark.createDataFrame(quotes, "item_id long, quote string"))
    want = {(d, i) for d in range(12) for i, q in quotes if q and q in f"word{d} and some longer run of words number {d}"}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_sharing(spark):
    import random

    from quillspark.operators import judging as J

    rng = random.Random(4)
    held = {d: {rng.randrange(12) for _ in range(rng.randint(0, 3))} | ({99} if d % 2 else set()) for d in range(60)}
    rows = [(d, f) for d, fs in held.items() for f in fs]
    got = {r["doc_id"]: r["others"] for r in J.sharing(spark.createDataFrame(rows, "doc_id long, figure long"), "doc_id", "figure").collect()}
    want = {d: sum(bool(fs & held[x]) for x in held if x != d) for d, fs in held.items()}
    assert got == {d: n for d, n in want.items() if n}
