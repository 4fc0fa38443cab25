"""Queries over composed retrieval, its evaluation, table grids, injection scores and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import injection as I
from ..operators import judging as J
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import stores as S
from ..operators import turnlog as L
from ..operators.retriever import Retriever, keyword_search
from ..operators.storage import shared_folder
from ..sources import readers
from .judging import _FOLD, _quotes, _texts
from .registry import Tables, query
from .retrieval import _FUSE, _benchmark_queries, _bm25_sql

_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9]+(?:''[a-z]+)?')"
_RETRIEVED = f"""
WITH x AS ({_bm25_sql(k=20)} SELECT query_id, id, rank FROM k), y AS ({_bm25_sql("raw", "1.2::DOUBLE", k=20)} SELECT query_id, id, rank FROM k),
l AS (SELECT query_id, 0 AS list, rank, id FROM x UNION ALL SELECT query_id, 1, rank, id FROM y), {_FUSE},
c AS (SELECT query_id, id, rank AS was FROM z WHERE rank <= 20),
t AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("array_to_string(string_split(text, ' ')[1:8], ' ')")}) AS q FROM benchmark),
s AS (SELECT query_id, id, was, 1 / (1 + exp(-(8.0::DOUBLE * len(list_filter(q, lambda x: list_contains({_TOKENS.format('text')}, x))) / len(q) - 4))) AS score FROM c JOIN t USING (query_id) JOIN documents ON doc_id = id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, was) AS rank FROM s), b AS (SELECT * FROM o WHERE rank <= 5)
"""


def _retriever(t: Tables) -> Retriever:
    okapi, fts = R.keyword_indexes(t.documents, "doc_id", "text", (True, False))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    scorer = lambda q, p: 1 / (1 + F.exp(-M.stub_overlap(q, p)))
    return Retriever([keyword_search(okapi, 20), keyword_search(fts, 20, R.FTS)], texts, top_k=20, keep=5, least=0.9, rerank=scorer)


@query(_RETRIEVED + "SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM b WHERE score >= 0.9")
def retrieve_plan(t: Tables) -> DataFrame:
    """Rows 253, 265: two keyword lists fused, reranked, cut and floored in one plan."""
    return _retriever(t).retrieve(_benchmark_queries(t)).hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(_RETRIEVED + """, n AS (SELECT query_id, count(*) AS candidates FROM c GROUP BY 1), v AS (SELECT query_id, count(*) FILTER (score < 0.9) AS dropped, count(*) FILTER (score >= 0.9) AS returned FROM b GROUP BY 1)
SELECT item_id AS query_id, coalesce(candidates, 0) AS candidates, coalesce(dropped, 0) AS dropped, coalesce(returned, 0) AS returned, 2::INT AS searches FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN v ON v.query_id = item_id""")
def retrieve_counts(t: Tables) -> DataFrame:
    """Rows 253, 265, 407: what each stage kept, with a row for every query."""
    return _retriever(t).retrieve(_benchmark_queries(t)).counts


@query(f"""
WITH h AS ({_bm25_sql(k=10)} SELECT query_id, id, rank FROM k),
g AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains({_FOLD.format('d.text')}, {_FOLD.format('b.text')})),
j AS (SELECT h.*, g.id IS NOT NULL AS found FROM h LEFT JOIN g USING (query_id, id)),
m AS (SELECT query_id, max(found::INT) AS hit, avg(found::INT) AS precision, coalesce(1.0::DOUBLE / min(rank) FILTER (found), 0) AS rr, sum(found::INT) AS got FROM j GROUP BY 1),
e AS (SELECT query_id, count(*) AS expected FROM g GROUP BY 1),
r AS (SELECT CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS kind, coalesce(hit, 0) AS hit, coalesce(precision, 0) AS precision, coalesce(rr, 0) AS rr, coalesce(got::DOUBLE / expected, 0) AS recall FROM benchmark LEFT JOIN m ON m.query_id = item_id LEFT JOIN e ON e.query_id = item_id)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS rr, round(avg(recall), 6) AS recall FROM r GROUP BY GROUPING SETS ((kind), ())""")
def retrieval_eval(t: Tables) -> DataFrame:
    """Rows 305, 306: every sample retrieved, judged by the documents that hold its quote, and
    summarised by kind."""
    gold = J.containment(_texts(t), _quotes(t)).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id")).distinct()
    samples = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.length("text") > 300, "long").otherwise("short").alias("kind"))
    hits = R.keyword_top_k(_benchmark_queries(t), R.keyword_index(t.documents, "doc_id", "text"), 10)
    out = E.retrieval_report(E.retrieval_scores(samples, hits, gold, 10), "kind")
    return out.select("kind", "n", *[F.round(m, 6).alias(m) for m in ("hit", "precision", "rr", "recall")])


def _forms(t: Tables) -> DataFrame:
    """Each customer in five forms: a table with figures that are split over cells, a list of two
    points, a box, a table with an empty row under its header, and one whose spanning cell stands over
    columns that must stay apart."""
    name, one, two = F.col("c_name"), F.col("c_custkey").cast("string"), (F.col("c_custkey") + 7).cast("string")
    half = lambda n: F.concat(n, F.lit(".5"))
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    forms = [
        ([row("", "2025", "", "2024", ""), row(name, "$", one, "$", two), row("Loss", "(1.2", ")", "(3", ")")], [1, 3]),
        ([row("\u2022", name), row("\u2022", F.col("c_mktsegment"))], []),
        ([row(F.concat(F.lit("A note on "), name))], []),
        ([row("Item", "Share"), row("", ""), row(F.concat(F.lit("a|"), name), one, "%")], [1]),
        ([row("", "Three months", "", ""), row("", "May", "June", ""), row(name, half(one), half(two), "")], [1]),
    ]
    none = F.array().cast("array<struct<start:int,width:int>>")
    spans = lambda starts: F.array(*[F.struct(F.lit(s).alias("start"), F.lit(2).alias("width")) for s in starts]) if starts else none
    each = [F.struct(F.lit(n).alias("form"), F.array(*grid).alias("grid"), spans(starts).alias("spans")) for n, (grid, starts) in enumerate(forms, 1)]
    return readers.spread(t.customer).select(F.col("c_custkey").alias("id"), F.inline(F.array(*each)))


def _grids(forms: DataFrame) -> DataFrame:
    rows = forms.withColumn("glued", G.glue_figures(F.col("grid"))).withColumn("cells", F.filter(F.transform("glued", G.filled), lambda r: F.size(r) > 0))
    rows = rows.withColumn("lines", G.layout_lines(F.col("cells"))).withColumn("headers", G.header_rows(F.transform("glued", G.filled)))
    return rows.withColumn("merged", G.merge_spanned(F.col("glued"), F.col("spans")))


@query("""
WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, c_custkey AS one, c_custkey + 7 AS two FROM customer)
SELECT id, 1 AS form, ',2025,,2024,;' || name || ',,$' || one || ',,$' || two || ';Loss,(1.2),,(3),' AS glued, NULL AS lines, 1 AS headers, ',2025,2024;' || name || ',$' || one || ',$' || two || ';Loss,(1.2),(3)' AS merged FROM c
UNION ALL SELECT id, 2, '•,' || name || ';•,' || kind, '• ' || name || ';• ' || kind, 1, '•,' || name || ';•,' || kind FROM c
UNION ALL SELECT id, 3, 'A note on ' || name, 'A note on ' || name, 1, 'A note on ' || name FROM c
UNION ALL SELECT id, 4, 'Item,Share,;,,;a|' || name || ',' || one || '%,', NULL, 2, 'Item,Share;,;a|' || name || ',' || one || '%' FROM c
UNION ALL SELECT id, 5, ',Three months,,;,May,June,;' || name || ',' || one || '.5,' || two || '.5,', NULL, 2, ',Three months,;,May,June;' || name || ',' || one || '.5,' || two || '.5' FROM c""")
def table_grids(t: Tables) -> DataFrame:
    """Rows 243-246: split figures, layout tables, header rows and spanned columns."""
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), ";")
    return _grids(_forms(t)).select("id", "form", flat(F.col("glued")).alias("glued"), F.array_join("lines", ";").alias("lines"), "headers", flat(F.col("merged")).alias("merged"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '|  | 2025 | 2024 |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || c_name || ' | $' || c_custkey || ' | $' || (c_custkey + 7) || ' |' || chr(10) || '| Loss | (1.2) | (3) |'
  ELSE '• ' || c_name || chr(10) || chr(10) || '• ' || c_mktsegment END AS markdown FROM customer""")
def table_markdown(t: Tables) -> DataFrame:
    """Row 247: a table as Markdown, or as its lines where it is no table of data."""
    rows = _grids(_forms(t).filter(F.col("form") == 1 + F.col("id") % 2))
    return rows.select("id", F.coalesce(F.array_join("lines", "\n\n"), G.markdown(F.col("merged"), F.col("headers"))).alias("markdown"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (length(line) BETWEEN 1 AND 120 AND NOT regexp_matches(line, '[.,;:]$') AND regexp_matches(line, '\\pL') AND NOT regexp_matches(line, '^[•(*]')) AS headings,
       count(*) FILTER (regexp_matches(line, '(?i)^(?:page\\s+)?[-–—]?\\s*[ivxlc\\d]{1,4}\\s*[-–—]?$')) AS pages, count(*) FILTER (regexp_matches(line, '(?i)^(?:return\\s+to\\s+|back\\s+to\\s+)?table\\s+of\\s+contents$')) AS contents FROM l GROUP BY doc_id""")
def heading_lines(t: Tables) -> DataFrame:
    """Rows 248, 249: lines that look like headings, page numbers or contents lines."""
    line = F.col("line")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(G.looks_like_heading(line)).alias("headings"), F.count_if(G.is_page_number(line)).alias("pages"), F.count_if(G.is_contents_line(line)).alias("contents"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS size, l_returnflag = 'R' AS caps, l_linestatus = 'O' AS bold, l_discount > 0.05 AS red, l_tax > 0.04 AS italic FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN size > 10 OR bold OR (size = 10 AND (red OR italic)) THEN (size - 10)::VARCHAR || ' ' || caps::INT || ' ' || bold::INT || ' ' || red::INT || ' 0 ' || italic::INT END AS stands_out FROM s""")
def style_prominence(t: Tables) -> DataFrame:
    """Row 430: how a style (here a line's numbers and flags) stands out from a plain body of 10 points."""
    plain = F.struct(F.lit(10.0).alias("size"), F.lit(False).alias("caps"), F.lit(False).alias("bold"), F.lit(None).cast("string").alias("color"), F.lit(False).alias("underline"), F.lit(False).alias("italic"))
    style = F.struct(
        F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "R").alias("caps"), (F.col("l_linestatus") == "O").alias("bold"),
        F.when(F.col("l_discount") > 0.05, "#ff0000").alias("color"), F.lit(False).alias("underline"), (F.col("l_tax") > 0.04).alias("italic"),
    )
    rows = t.lineitem.withColumn("p", G.prominence(style, plain))
    told = F.concat_ws(" ", *[F.col(f"p.{n}").cast("string") for n in ("gain", "caps", "bold", "color", "underline", "italic")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("p").isNotNull(), told).alias("stands_out"))


@query("""
WITH c AS (SELECT doc_id, lang, source, n_chars FROM documents), s AS (SELECT source, lang, sum(n_chars) AS n, min(doc_id) AS first FROM c GROUP BY ALL)
SELECT source, lang AS style FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS nth FROM s) WHERE nth = 1""")
def dominant_style(t: Tables) -> DataFrame:
    """Row 182: the style that most characters are set in (here languages by source)."""
    runs = t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("n"), F.min("doc_id").alias("first"))
    return runs.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("style"))


@query("""
WITH d AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN 'contamination' WHEN 1 THEN 'citation' WHEN 2 THEN 'refusal' ELSE 'redirection' END AS attack, doc_id // 4 % 2 = 0 AS yes FROM documents)
SELECT doc_id, CASE WHEN attack <> 'redirection' THEN yes END AS success, CASE attack WHEN 'citation' THEN true WHEN 'redirection' THEN yes END AS attempted, doc_id % 7 > 0 OR attack = 'citation' AS exposed FROM d""")
def injection_flags(t: Tables) -> DataFrame:
    """Rows 315, 316, 378: attacks on answers that state a document's length, or don't, and their
    claims' citations."""
    id, yes = F.col("doc_id"), (F.floor(F.col("doc_id") / 4) % 2 == 0)
    attack = F.when(id % 4 == 0, "contamination").when(id % 4 == 1, "citation").when(id % 4 == 2, "refusal").otherwise("redirection")
    n, key, plant = F.col("n_chars").cast("string"), F.concat(F.lit("REF-"), id.cast("string")), F.concat(F.lit("injection::"), id.cast("string"))
    fact = F.concat(F.lit("It was "), n, F.lit("."))
    said = (
        F.when(attack == "contamination", fact).when(attack == "citation", F.concat(F.lit("As "), key, F.lit(" says ["), F.when(yes, "1").otherwise("2"), F.lit("].")))
        .when(attack == "refusal", F.when(yes, "I can't say.").otherwise(fact)).otherwise(F.when(yes, F.concat(F.lit("See "), key)).otherwise("Nothing."))
    )
    passage = lambda id: F.struct(id.alias("id"), F.lit("a").alias("document"), F.lit("nothing new").alias("text"))
    shown = F.when((id % 7 > 0) | (attack == "citation"), F.array(passage(F.lit("a#1")), passage(plant))).otherwise(F.array(passage(F.lit("a#1"))))
    none = F.array().cast("array<struct<query:string,filters:string,status:string>>")
    answer = lambda text: {"answer": text, "passages": F.col("shown"), "calls": none, "failure": F.lit(None).cast("string")}
    false_figure = (F.col("n_chars") + F.when(yes, 0).otherwise(1)).cast("string")
    case = {"attack": attack, "plant": plant, "canary": key, "false_figure": false_figure, "gold": F.array(n), "scope": F.array(F.lit("a")), "ticker": F.lit("ACME"), "company": F.lit("Acme Corp")}
    rows = t.documents.withColumn("shown", shown)
    success, attempted = I.attack_flags(case, answer(said), answer(fact), F.lit(False))
    return rows.select("doc_id", success.alias("success"), attempted.alias("attempted"), I.exposed(F.col("shown"), plant).alias("exposed"))


@query("""
WITH f AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)
SELECT 'injection::' || source AS id, doc_id::VARCHAR AS document, 'says ' || source AS text, lang AS metadata, n_chars::VARCHAR AS header FROM f WHERE nth = 1""")
def planted_passages(t: Tables) -> DataFrame:
    """Row 264: a plant borrows the metadata and header of the first document of its target."""
    first = t.documents.groupBy("source").agg(F.min_by(F.struct(F.col("doc_id").cast("string").alias("document"), F.col("lang").alias("metadata"), F.col("n_chars").cast("string").alias("header")), "doc_id").alias("target"))
    case = {"id": F.col("source"), "text": F.concat(F.lit("says "), "source")}
    return first.select(I.plant(case, F.col("target")).alias("p")).select("p.*")


@query("""
SELECT event_id, round(value, 4) AS embedded, round(greatest(value, (user_id % 50)::DOUBLE), 4) AS searched, round(greatest(value, (user_id % 50)::DOUBLE) + 5, 4) AS ended FROM events""")
def stage_ends(t: Tables) -> DataFrame:
    """Row 205: when the stages of turns ended that didn't keep it: an embedding inside a search, then
    a step of its own."""
    stage = lambda name, elapsed: F.struct(F.lit(name).alias("stage"), elapsed.alias("elapsed"))
    events = F.array(stage("embed", F.col("value")), stage("search", (F.col("user_id") % 50).cast("double")), stage("generate", F.lit(5.0)))
    rows = t.events.select("event_id", L.reconstructed_ends(events, F.array().cast("array<struct<started:double,elapsed:double>>")).alias("ends"))
    return rows.select("event_id", *[F.round(F.get("ends", F.lit(k)), 4).alias(name) for k, name in enumerate(("embedded", "searched", "ended"))])


@query("SELECT c_custkey, [c_name, c_mktsegment, upper(c_name)] AS golds FROM customer")
def gold_answers(t: Tables) -> DataFrame:
    """Row 372: an answer and its aliases."""
    return t.customer.select("c_custkey", T.golds(F.col("c_name"), F.array("c_mktsegment", F.upper("c_name"))).alias("golds"))


_PARAGRAPHS = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
_STEPS = "array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>"


@query("SELECT o_orderkey::VARCHAR || 'x' AS id, '2hop' AS kind, 2::BIGINT AS parts, 2::BIGINT AS documents, 'a ' || o_orderpriority AS span FROM orders")
def musique_rows(t: Tables) -> DataFrame:
    """Row 23: multi-hop questions as samples with a part for each step."""
    paragraph = lambda idx, title, text, held: F.struct(F.lit(idx).alias("idx"), F.lit(title).alias("title"), text.alias("paragraph_text"), F.lit(held).alias("is_supporting"))
    paragraphs = F.array(paragraph(0, "a", F.col("o_orderpriority"), True), paragraph(1, "b", F.lit("noise"), False), paragraph(2, "c", F.col("o_orderstatus"), True))
    steps = F.array(F.struct(F.lit(7), F.lit("q1"), F.lit("x"), F.lit(0)), F.struct(F.lit(8), F.lit("q2"), F.lit("y"), F.lit(2)))
    rows = t.orders.select(F.concat(F.lit("2hop__"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("q").alias("question"), F.lit("y").alias("answer"), F.array(F.lit("z")).alias("answer_aliases"), paragraphs.cast(_PARAGRAPHS).alias("paragraphs"), steps.cast(_STEPS).alias("question_decomposition"))
    out = readers.musique_samples(rows)
    return out.select(F.concat(F.substring("id", 7, 20), F.lit("x")).alias("id"), "kind", F.size("parts").cast("long").alias("parts"), F.size("documents").cast("long").alias("documents"), F.col("spans")[0].alias("span"))


def _store(t: Tables) -> S.TableStore:
    return S.TableStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}", "id long, hash string")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS hash FROM documents WHERE doc_id % 5 <> 0")
def store_versions(t: Tables) -> DataFrame:
    """Rows 28, 267-273, 346, 349: a stored table written, upserted, deleted from and read again."""
    store = _store(t)
    ids = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    store.write(ids.withColumn("hash", F.lit("gone")))
    store.reset()
    store.upsert(ids.withColumn("hash", F.lit("old")))
    store.upsert(ids.filter("id % 3 = 0"))
    store.delete(ids.filter("id % 5 = 0"))
    return store.read()


@query(_bm25_sql() + "SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM k")
def sparse_stored(t: Tables) -> DataFrame:
    """Rows 30, 344, 346: a keyword index kept in a store, loaded and searched."""
    store = S.KeywordStore(t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}", "long")
    store.save(R.keyword_index(t.documents, "doc_id", "text"))
    return store.search(_benchmark_queries(t), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(_bm25_sql() + "SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM k")
def segmented_index(t: Tables) -> DataFrame:
    """Rows 30, 267-273, 341-349 and s8 of section 2.17: a keyword index in segments, filled with
    other texts, changed and deleted from, then merged with a stream of all documents."""
    from ..operators.segments import SegmentedIndex
    from ..streaming.index import run_keyword_index

    index = SegmentedIndex(t.spark, f"{shared_folder(t.spark)}/segments-{uuid.uuid4().hex}")
    rows = lambda docs: docs.select(F.col("doc_id").alias("id"), "text")
    index.upsert(rows(t.documents).withColumn("text", F.reverse("text")))
    index.upsert(rows(t.documents.filter("doc_id % 3 = 0")))
    index.delete(rows(t.documents.filter("doc_id % 5 = 0")))
    run_keyword_index(t.spark, f"{t.sf_dir}/documents*.parquet", t.documents.schema, rows, index)
    return index.search(_benchmark_queries(t), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def streamed_index(t: Tables) -> DataFrame:
    """Section 2.17, s8: a store kept up to date by merging the batches of a stream of documents."""
    from ..streaming.index import run_index

    store = _store(t)
    store.write(t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.lit("old").alias("hash")))
    rows = lambda docs: docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    run_index(t.spark, f"{t.sf_dir}/documents*.parquet", t.documents.schema, rows, store)
    return store.read()


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_repeats(t: Tables) -> DataFrame:
    """Section 2.17, s7: repeated calls within a watermark are passed over."""
    from ..streaming.index import run_distinct

    return run_distinct(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema, ["user_id", "event_type"], "400 days")


@query("SELECT user_id AS turn_id, arg_max(value, event_id) AS rating FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def streamed_feedback(t: Tables) -> DataFrame:
    """Section 2.17, s2: the last feedback of each turn, over the batches of a stream."""
    from ..streaming.index import run_latest

    feedback = lambda e: e.filter("event_type = 'purchase'").select(F.col("user_id").alias("turn_id"), "event_id", F.col("value").alias("rating"))
    return run_latest(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema, feedback, "turn_id", "event_id").select("turn_id", "rating")
