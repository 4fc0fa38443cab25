"""Queries over the operators around models, with stub models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import retrieval as R
from .registry import Tables, query
from .retrieval import _benchmark_queries


def _first_words(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query()
def embed_and_search(t: Tables) -> DataFrame:
    """Rows 253, 282-284, 353, 440: stub vectors of documents and queries, exact top-5."""
    docs = M.embedded(t.documents.select(F.col("doc_id").alias("id"), "text")).select("id", "vector")
    asked = M.embedded(_first_words(t)).select("query_id", "vector")
    return R.dense_top_k(asked, docs, 5).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query(r"""
WITH t AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:8], ' ')), '[a-z0-9]+(?:''[a-z]+)?')) AS q FROM benchmark),
c AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS was, q, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS p FROM t JOIN documents ON doc_id % 40 = query_id),
s AS (SELECT query_id, id, was, 1 / (1 + exp(-(8.0::DOUBLE * len(list_filter(q, lambda x: list_contains(p, x))) / len(q) - 4))) AS score FROM c)
SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, was) AS rank FROM s) WHERE rank <= 5""")
def rerank_stub(t: Tables) -> DataFrame:
    """Rows 136, 210: candidates re-scored by a stub, ties in their old order."""
    from pyspark.sql.window import Window as W

    d = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("query_id"), F.col("text").alias("passage"))
    hits = d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).join(_benchmark_queries(t), "query_id")
    return M.reranked(hits, M.stub_overlap(F.col("text"), F.col("passage")), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def similarity_dedup(t: Tables) -> DataFrame:
    """Row 261: results that are not too similar to a better one."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.filter("id < 10").select(F.col("id").alias("query_id"), "vector")
    hits = R.dense_top_k(asked, e.filter("id >= 10"), 20).join(e, "id").select("query_id", "id", "rank", "score", "vector")
    return M.greedy_distinct(hits, 0.5).select("query_id", "id", "rank")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN (o_custkey // 7 + o_custkey % 7)::VARCHAR
  ELSE (o_custkey + 3 * greatest(o_orderkey % 11, 4) - abs(5 - o_custkey))::VARCHAR END AS result FROM orders""")
def calculator(t: Tables) -> DataFrame:
    """Rows 97, 98: safe arithmetic over each order's keys; what is not allowed, or has no value, is
    an error."""
    a, b = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 11).cast("string")
    kind = F.col("o_orderkey") % 5
    told = (
        F.when(kind == 0, F.concat(a, F.lit(" / (1 - 1)"))).when(kind == 1, F.concat(F.lit("open("), a, F.lit(")"))).when(kind == 2, F.concat(a, F.lit(" // 7 + "), a, F.lit(" % 7")))
        .otherwise(F.concat(a, F.lit(" + 3 * max("), b, F.lit(", 4) - abs(5 - "), a, F.lit(")")))
    )
    return M.calculated(t.orders.select(F.col("o_orderkey").alias("id"), told.alias("sum")), "sum").select("id", "result")


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'YES' WHEN doc_id % 3 = 1 THEN 'MAYBE' END AS grade FROM documents WHERE doc_id % 3 < 2")
def grade_passages(t: Tables) -> DataFrame:
    """Row 286: passages graded NO go, unreadable grades stay."""
    n = F.col("doc_id") % 3
    reply = F.when(n == 0, "yes.").when(n == 1, "maybe so").otherwise("No, off topic")
    return M.graded(t.documents.select("doc_id", "source"), reply).select("doc_id", "source", "grade")


@query("SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 0 ELSE 1 END::INT AS attempt FROM benchmark WHERE item_id % 4 < 3")
def correction_loop(t: Tables) -> DataFrame:
    """Rows 287, 299: queries without surviving hits are rewritten and tried once more."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4).alias("text"))
    good = lambda hits: hits.filter("text <= 0").select("query_id")
    rewrite = lambda q: q.withColumn("text", F.col("text") - 2)
    return M.corrected(queries, lambda q: q, good, rewrite)


@query()
def near_miss(t: Tables) -> DataFrame:
    """Row 139: similar known names for an unknown one."""
    known = ["ALGERIA", "BRAZIL", "CANADA", "CHINA", "EGYPT", "FRANCE", "GERMANY", "INDIA", "JAPAN", "KENYA", "PERU"]
    return M.near_names(t.nation.select("n_nationkey", F.concat(F.col("n_name"), F.lit("X")).alias("asked")), "asked", known).select("n_nationkey", "near")


@query("""
SELECT n_nationkey, attack, carrier, n_name || ' / ' || attack || ' / ' || carrier AS "case" FROM nation, (VALUES ('figure'), ('scope'), ('control')) a(attack), (VALUES ('text'), ('header')) c(carrier) WHERE NOT (attack = 'control' AND carrier = 'header')""")
def injection_cases(t: Tables) -> DataFrame:
    """Row 252: each base question with every attack and carrier, and one control."""
    cases = F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(c).alias("carrier")) for a in ("figure", "scope", "control") for c in ("text", "header") if (a, c) != ("control", "header")])
    rows = t.nation.select("n_nationkey", "n_name", F.explode(cases).alias("c"))
    return rows.select("n_nationkey", "c.attack", "c.carrier", F.concat_ws(" / ", "n_name", "c.attack", "c.carrier").alias("case"))


@query("""
WITH k AS (SELECT query_id, id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id < 10 AND b.vec_id >= 10) WHERE rank <= 10),
s AS (SELECT query_id, id, rank + (rank >= 3)::INT AS rank FROM k UNION ALL SELECT DISTINCT query_id, -1, 3 FROM k)
SELECT query_id, id, rank::INT AS rank FROM s WHERE rank <= 10""")
def forced_exposure(t: Tables) -> DataFrame:
    """Row 263: a planted result at rank 3 displaces the last real one."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = R.dense_top_k(e.filter("id < 10").select(F.col("id").alias("query_id"), "vector"), e.filter("id >= 10"), 10)
    moved = hits.select("query_id", "id", (F.col("rank") + (F.col("rank") >= 3).cast("int")).alias("rank"))
    plant = hits.select("query_id").distinct().select("query_id", F.lit(-1).cast("long").alias("id"), F.lit(3).alias("rank"))
    return moved.unionByName(plant).filter("rank <= 10")


@query("""
SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'graded_out' WHEN quality = 0 THEN 'below_min_score' WHEN toxic = 1 THEN NULL ELSE 'answered' END AS outcome FROM labels""")
def no_context_outcome(t: Tables) -> DataFrame:
    """Row 300: why a question has no context."""
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return t.labels.select("doc_id", F.when(bad & toxic, "graded_out").when(bad, "below_min_score").when(toxic, None).otherwise("answered").alias("outcome"))
