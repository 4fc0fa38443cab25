"""Queries over drafted samples: reasons, tables to draft from, sets that are assembled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import chunking as C
from ..operators import drafts as D
from ..operators import samples as S
from .chunks import _markdown
from .registry import Tables, query
from .texts import _FOLD

@query("""
WITH s AS (SELECT n_regionkey, n_name, '## ' || n_name || chr(10) || chr(10) || repeat(n_name || ' trades. ', 3 + n_nationkey % 3) || 'End.' AS body, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
p AS (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY n_regionkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s)
SELECT n_regionkey::VARCHAR AS document_id, i::INT AS chunk_index, a::INT AS char_start, (a + length(body))::INT AS char_end, n_name AS section_path, 'heading,paragraph' AS block_types FROM p""")
def chunk_sections(t: Tables) -> DataFrame:
    """Rows 230, 231, 235, 237: a section for each nation of a region, all of which open chunks."""
    body = F.concat(F.lit("## "), "n_name", F.lit("\n\n"), F.repeat(F.concat("n_name", F.lit(" trades. ")), F.lit(3) + F.col("n_nationkey") % 3), F.lit("End."))
    rows = t.nation.select("n_regionkey", F.struct("n_nationkey", body.alias("body")).alias("x")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    made = C.structured_chunks(rows.select("n_regionkey", F.array_join(F.transform("x", lambda x: x["body"]), "\n\n").alias("text")), "n_regionkey", "text", 300, 0, least=0)
    return made.select("document_id", "chunk_index", "char_start", "char_end", "section_path", "block_types")


@query("""
WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth, count(*) OVER (PARTITION BY c_nationkey) AS many FROM customer),
c AS (SELECT c_nationkey, nth // 9 AS i, min(nth) AS lo, max(nth) AS hi FROM r GROUP BY ALL)
SELECT c_nationkey::VARCHAR AS document_id, i::INT AS chunk_index, (CASE WHEN i = 0 THEN 0 ELSE 41 + 38 * lo END)::INT AS char_start, (40 + 38 * (hi + 1))::INT AS char_end, (40 + 38 * (hi + 1 - lo))::INT AS n_chars FROM c""")
def chunk_cases(t: Tables) -> DataFrame:
    """Rows 232, 335: each nation's customers as rows of 37 characters, nine of which fit below the
    repeated header of 40."""
    row = F.format_string("| Customer#%09d | %12.2f |", "c_custkey", "c_acctbal")
    rows = t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("x"))
    head = "| Customer name  | Amount |\n|-----|----|"
    text = F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda x: x["row"]), "\n"))
    made = C.structured_chunks(rows.select("c_nationkey", text.alias("text")), "c_nationkey", "text", 390, 0, least=0)
    return made.select("document_id", "chunk_index", "char_start", "char_end", F.length("text").alias("n_chars"))


@query(f"""
WITH d AS (SELECT doc_id, coalesce(substr(text, 11, 80), '') AS span, coalesce(text, '') AS excerpt, coalesce(substr(text, 1, 60), '') AS question FROM documents),
f AS (SELECT *, count(*) OVER (PARTITION BY span) AS holders, {_FOLD.format('span')} AS folded, {_FOLD.format('excerpt')} AS body, list_filter(string_split({_FOLD.format('question')}, ' '), lambda w: w <> '') AS asked FROM d)
SELECT doc_id, CASE WHEN length(span) < 40 THEN 'span_too_short' WHEN folded = '' THEN 'span_empty' WHEN NOT contains(body, folded) THEN 'span_not_verbatim' WHEN holders > 1 THEN 'span_not_unique'
  WHEN len(list_filter(range(1, len(asked) - 6), lambda i: contains(body, array_to_string(asked[i:i + 7], ' ')))) > 0 THEN 'question_copies_excerpt' END AS reason FROM f""")
def candidate_reasons(t: Tables) -> DataFrame:
    """Row 113: why a drafted question and quote are rejected; each text's own start as its draft."""
    text = F.col("text")
    d = t.documents.select("doc_id", "text", F.substr(text, F.lit(11), F.lit(80)).alias("span"), F.substr(text, F.lit(1), F.lit(60)).alias("question"))
    counted = d.groupBy("span").agg(F.count("*").alias("holders"))
    return d.join(counted, "span", "left").select("doc_id", D.candidate_reason(F.col("question"), F.col("span"), text, F.col("holders")).alias("reason"))


_ROW = "Net sales rose by nine percent to 12.4 billion in the quarter"


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'question_missing_period' WHEN 2 THEN 'question_missing_company' WHEN 3 THEN 'generation_failed' END AS period,
  CASE c_custkey % 4 WHEN 0 THEN 'paraphrase:dropped_period' WHEN 1 THEN 'paraphrase:changed_meaning' WHEN 2 THEN 'paraphrase:dropped_period' ELSE 'paraphrase:generation_failed' END AS rewrite,
  CASE c_custkey % 4 WHEN 0 THEN 'answer_missing_value' WHEN 2 THEN 'question_missing_company' WHEN 3 THEN 'generation_failed' END AS table_row FROM customer""")
def draft_reasons(t: Tables) -> DataFrame:
    """Rows 114-116: ordered reasons against period, rewritten and table questions about each
    customer's segment: without a period, complete, without the name, and not generated."""
    name, kind = F.initcap("c_mktsegment"), F.col("c_custkey") % 4
    q = F.when(kind == 0, F.concat(F.lit("How much was "), name, F.lit(" revenue?"))).when(kind == 1, F.concat(F.lit("How much was "), name, F.lit(" revenue on May 3, 2025?"))).when(kind == 2, "How much was it, May 3?")
    a = F.when(kind == 0, "It was 3").when(kind == 1, "It was $12.4 billion").when(kind == 2, "12.4")
    ticker, names, phrase = F.lit("ACM"), F.array(F.lower("c_mktsegment")), F.lit("May 3, 2025")
    stop, yes, no = ["the", "was", "how", "much", "it"], F.lit(True), F.lit(False)
    period = D.period_reason(q, F.lit(_ROW), F.lit(_ROW + "."), ticker, names, phrase, yes, F.lit(2), F.lit(1), stop)
    asked = F.concat(F.lit("What did "), name, F.lit(" sell in 2025?"))
    rewrite = D.rewrite_reason(F.lit("paraphrase"), asked, q, F.array(F.lit(_ROW)), ticker, names, no, stop)
    table = D.table_reason(q, a, F.lit("$12.4"), F.array(F.lit("Quarter")), ticker, names, F.lit(1))
    return t.customer.select("c_custkey", period.alias("period"), rewrite.alias("rewrite"), table.alias("table_row"))


@query("""
WITH n AS (SELECT n_regionkey, n_nationkey, n_name, count(*) AS n_rows FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey AS r_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS nth, n_name AS section, n_rows::INT AS n_rows, 'Balance' AS label,
       length('Customers of ' || n_name || '. ' || repeat('The balance of ' || n_name || ' is listed. ', 30)) - 1 AS lead FROM n WHERE n_rows > 1""")
def drafting_tables(t: Tables) -> DataFrame:
    """Rows 240, 117: tables of data with their headings, lead-in and column labels."""
    found = D.markdown_tables(_markdown(t), "r_regionkey", "text")
    label = F.array_join(D.column_path(F.col("header_lines"), F.lit(1)), ">")
    return found.select("r_regionkey", "nth", F.array_join("headings", ">").alias("section"), F.size("rows").alias("n_rows"), label.alias("label"), F.length("lead_in").cast("long").alias("lead"))


@query("""
WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS nth, p_name, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey::VARCHAR AS id, string_agg(nth::VARCHAR || ': ' || p_type, '; ' ORDER BY nth) || '. Conclusion: done' AS expected_answer, string_agg(p_name, '|' ORDER BY nth) AS spans, array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS docs FROM p GROUP BY l_orderkey""")
def composed_samples(t: Tables) -> DataFrame:
    """Row 251: samples of several parts, each from a source sample; orders of parts."""
    sources = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.array("p_name").alias("expected_spans"), F.array("p_brand").alias("expected_doc_ids"), F.col("p_type").alias("expected_answer"))
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", nth.alias("nth"))
    none = F.lit(None).cast("string")
    part = F.struct(F.col("l_partkey").cast("string").alias("source"), F.col("nth").cast("string").alias("label"), none.alias("answer"), F.lit(None).cast("array<string>").alias("spans"))
    spec = lines.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    made = S.composed(spec.select("id", F.lit("orders").alias("kind"), F.lit("q").alias("query"), F.lit("done").alias("conclusion"), "parts"), sources)
    return made.select("id", "expected_answer", F.array_join("expected_spans", "|").alias("spans"), F.array_join("expected_doc_ids", "|").alias("docs"))


@query("""
SELECT c_custkey, CASE WHEN (r_regionkey < 2) = (n_nationkey < 12) THEN CASE WHEN r_regionkey < 2 THEN 'dev' ELSE 'holdout' END ELSE 'mixed' END AS split,
       CASE WHEN n_name < r_name THEN n_name || '+' || r_name ELSE r_name || '+' || n_name END AS companies, CASE WHEN n_name = 'CANADA' THEN 'new_entity' ELSE 'fresh_fact' END AS transfer,
       CASE WHEN c_acctbal < 0 THEN 'refusal' ELSE 'fresh' END AS tier FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def assembled_samples(t: Tables) -> DataFrame:
    """Row 413: authored samples with split, group, transfer and tier; customers by nation and region."""
    splits = t.region.select(F.col("r_name").alias("company"), F.when(F.col("r_regionkey") < 2, "dev").otherwise("holdout").alias("split"))
    splits = splits.unionByName(t.nation.select(F.col("n_name").alias("company"), F.when(F.col("n_nationkey") < 12, "dev").otherwise("holdout").alias("split")))
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    none = F.lit(None).cast("array<string>")
    sources = c.select(
        F.col("c_custkey").alias("id"), F.lit("q").alias("query"), F.lit("direct_lookup").alias("family"), F.when(F.col("c_acctbal") < 0, "refuse").otherwise("answer").alias("behavior"),
        F.col("c_name").alias("answer"), none.alias("spans"), F.array(F.concat("r_name", F.lit("_"), "c_mktsegment")).alias("docs"), F.array("n_name").alias("companies"), none.alias("tags"),
        F.lit(None).cast("array<struct<label:string,answer:string,available:boolean,spans:array<string>,docs:array<string>>>").alias("parts"),
    )
    made = S.assembled(sources, splits, ["CANADA"], "none", "2025-01-01")
    return made.select(F.col("id").alias("c_custkey"), "split", F.col("group").alias("companies"), "transfer", "tier")


@query("""
WITH s AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS own, round(avg(l_tax), 4) AS their FROM lineitem GROUP BY ALL)
SELECT l_returnflag AS metric, count(*) AS compared, round(max(abs(round(own, 4) - their)), 3) AS worst FROM s GROUP BY ALL""")
def scorer_parity(t: Tables) -> DataFrame:
    """Row 438: the largest difference of two scorers, by metric."""
    means = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_returnflag").alias("metric")).agg(F.avg("l_discount").alias("own"), F.round(F.avg("l_tax"), 4).alias("their"))
    found = S.parity(means.select("query_id", "metric", F.col("own").alias("value")), means.select("query_id", "metric", F.col("their").alias("value")))
    return found.select("metric", "compared", F.round("worst", 3).alias("worst"))
