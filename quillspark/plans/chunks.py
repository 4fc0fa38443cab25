"""Queries over chunkers and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import markup as M
from ..operators import rendering as R
from ..operators import tablefunctions as TF
from .registry import Tables, query


_FIXED = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, translate(text, chr(10), ' ') AS flat, length(text) AS n FROM documents WHERE text <> ''),
s AS (
  SELECT doc_id, 0 AS i, 0 AS a, CASE WHEN n <= 1000 THEN n ELSE CASE WHEN strpos(reverse(substr(flat, 951, 50)), ' ') > 0 THEN 1001 - strpos(reverse(substr(flat, 951, 50)), ' ') ELSE 1000 END END AS b FROM d
  UNION ALL
  SELECT doc_id, i + 1, a2, CASE WHEN a2 + 1000 >= n THEN n WHEN strpos(reverse(substr(flat, a2 + 951, 50)), ' ') > 0 THEN a2 + 1001 - strpos(reverse(substr(flat, a2 + 951, 50)), ' ') ELSE a2 + 1000 END
  FROM (SELECT *, CASE WHEN b - 150 <= a THEN b ELSE CASE WHEN strpos(substr(flat, b - 150 + 1, least(b, b - 150 + 50) - (b - 150)), ' ') > 0 THEN greatest(b - 150 + strpos(substr(flat, b - 150 + 1, least(b, b - 150 + 50) - (b - 150)), ' '), 0) ELSE b - 150 END END AS a2 FROM s JOIN d USING (doc_id) WHERE b < n)
), k AS (SELECT doc_id, i, a, b, trim(substr(text, a + 1, b - a), ' ' || chr(10)) AS part FROM s JOIN d USING (doc_id))
SELECT doc_id::VARCHAR || '::chunk' || i AS chunk_id, a::INT AS char_start, b::INT AS char_end, sha256(part) AS content_hash FROM k WHERE part <> ''"""


@query(_FIXED)
def chunk_fixed(t: Tables) -> DataFrame:
    """Rows 54, 225-228, 331: overlapping windows that end and begin at blanks."""
    return C.fixed_chunks(t.documents, "doc_id", "text").select("chunk_id", "char_start", "char_end", F.sha2("text", 256).alias("content_hash"))


@query(_FIXED)
def chunk_sql(t: Tables) -> DataFrame:
    """Rows 54, 225-229, 331 by a table function of SQL: a lateral join of texts with their chunks."""
    TF.register(t.spark)
    t.documents.createOrReplaceTempView("chunked_documents")
    made = t.spark.sql("SELECT doc_id, c.* FROM chunked_documents d, LATERAL fixed_chunks(d.text, 1000, 150) c")
    return made.select(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), "char_start", "char_end", F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id || '::chunk0' AS chunk_id, length(text)::INT AS char_end, sha256(text) AS content_hash FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def chunk_whole(t: Tables) -> DataFrame:
    """Rows 229, 332: one chunk per document."""
    return C.whole_chunks(t.documents, "doc_id", "text").select("chunk_id", "char_end", F.sha2("text", 256).alias("content_hash"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
s AS (SELECT doc_id, nth, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, nth::INT AS nth, start::INT AS start, (start + length(line))::INT AS "end", (start + length(rtrim(line)))::INT AS bare FROM s""")
def chunk_lines(t: Tables) -> DataFrame:
    """Rows 333, 334: line spans and their ends without blanks."""
    return C.line_spans(t.documents, "doc_id", "text")


def _markdown(t: Tables) -> DataFrame:
    """A filing per region: headings, a table of its customers by nation, and prose."""
    row = F.concat(F.lit("| "), F.col("c_name"), F.lit(" | "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" |"))
    rows = t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    body = F.concat(F.lit("## "), F.col("n_name"), F.lit("\n\nCustomers of "), F.col("n_name"), F.lit(". " * 1), F.repeat(F.concat(F.lit("The balance of "), F.col("n_name"), F.lit(" is listed. ")), 30), F.lit("\n\n| Name | Balance |\n|---|---|\n"), F.col("rows"))
    n = t.nation.join(rows, F.col("n_nationkey") == F.col("c_nationkey")).select("n_regionkey", "n_nationkey", body.alias("body"))
    whole = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    return t.region.join(whole, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n"), F.col("body")).alias("text"))


@query()
def chunk_structured(t: Tables) -> DataFrame:
    """Rows 230-237, 335-338, u-Length function: chunks by headings, tables and sentences."""
    return C.structured_chunks(_markdown(t), "r_regionkey", "text").select("chunk_id", "char_start", "char_end", "section_path", "block_types", F.sha2("text", 256).alias("content_hash"))


@query()
def chunk_structured_prose(t: Tables) -> DataFrame:
    """Row 234 on the documents: prose by sentences with overlap."""
    return C.structured_chunks(t.documents, "doc_id", "text").select("chunk_id", "char_start", "char_end", "block_types", F.sha2("text", 256).alias("content_hash"))


@query()
def page_text(t: Tables) -> DataFrame:
    """Rows 101, 247: pages as text, headings and tables by their elements."""
    p = M.parsed_pages(t.pages, "page_id", "html")
    return p.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("content_hash"), F.size("headings").alias("headings"), F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["title"])), "\n").alias("outline"), F.size(F.filter("table", lambda x: x != "")).alias("table_rows"), F.size(F.filter("table", lambda x: x.rlike(r"^\|(---\|)+$"))).alias("tables"))


@query()
def page_lines(t: Tables) -> DataFrame:
    """Rows 248, 249: heading and furniture tests over page lines."""
    lines = M.parsed_pages(t.pages, "page_id", "html").select("page_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if(M.is_heading(F.col("line"))).alias("headings"), F.count_if(M.is_furniture(F.col("line"))).alias("furniture"))


@query()
def page_plain(t: Tables) -> DataFrame:
    """Rows 101, 242, 426-428: the plain text that offsets of spans refer to."""
    return R.plain_pages(t.pages, "page_id", "html").select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("content_hash"))


@query()
def page_markdown(t: Tables) -> DataFrame:
    """Rows 182, 243-250, 429, 430: pages as Markdown without furniture, headings by prominence."""
    made = R.rendered(R.page_blocks(t.pages, "page_id", "html"), "page_id")
    return made.select("page_id", F.sha2("markdown", 256).alias("content_hash"), F.size("headings").alias("headings"), "tables", "dropped")


@query()
def page_spans(t: Tables) -> DataFrame:
    """Row 431: of each page the second half of its plain text as Markdown."""
    plain = R.plain_pages(t.pages, "page_id", "html").select("page_id", (F.length("text") / 2).cast("int").alias("start"), F.length("text").alias("end"))
    made = R.rendered(R.page_blocks(t.pages.join(plain, "page_id"), "page_id", "html", "start", "end"), "page_id")
    return made.select("page_id", F.sha2("markdown", 256).alias("content_hash"), "tables")
