"""Queries over corpus reports, samples and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import corpus as C
from .registry import Tables, query


@query(r"""
SELECT source, count(*) AS documents, count(*) FILTER (trim(text, ' ' || chr(10)) = '') AS empty, min(n_chars) AS least, round_even(quantile_cont(n_chars, 0.1), 0) AS p10, round_even(quantile_cont(n_chars, 0.5), 0) AS p50,
       round_even(quantile_cont(n_chars, 0.9), 0) AS p90, round_even(quantile_cont(n_chars, 0.99), 0) AS p99, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source""")
def corpus_report(t: Tables) -> DataFrame:
    """Rows 144, 145, 179, 330, 439: sizes, empty rows and repeated texts of each source."""
    p = F.percentile("n_chars", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99)]))
    # Repeats by hash first: a count over two columns needs no list of texts.
    twice = t.documents.groupBy("source", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    out = t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(T.strip(F.col("text")) == "").alias("empty"), F.min("n_chars").alias("least"), p.alias("p"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))
    at = lambda i, name: F.bround(F.get("p", F.lit(i))).alias(name)
    return out.join(twice, "source").select("source", "documents", "empty", "least", at(0, "p10"), at(1, "p50"), at(2, "p90"), at(3, "p99"), "most", "mean", "duplicates")


@query(r"""
SELECT count(*) AS n, substr(sha256(sum(('0x' || substr(sha256(doc_id || chr(31) || lang || chr(31) || text), 1, 15))::BIGINT::HUGEINT)::VARCHAR), 1, 16) AS digest FROM documents""")
def corpus_hash(t: Tables) -> DataFrame:
    """Rows 176, 177, 381, 387, 417: one digest of a table, whatever its order."""
    return C.table_hash(t.documents, F.col("doc_id"), F.col("lang"), F.col("text"))


@query(r"""
WITH p AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM documents)
SELECT md5(p) AS paragraph, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM p WHERE length(p) >= 80 AND length(p) - length(replace(p, '|', '')) <= 4 GROUP BY p HAVING count(DISTINCT doc_id) > 1""")
def repeated_paragraphs(t: Tables) -> DataFrame:
    """Rows 178, 193: paragraphs in two documents or more."""
    return C.repeated_paragraphs(t.documents, 80).withColumn("paragraph", F.md5("paragraph"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
e AS (SELECT regexp_replace(trim(line), '\d', '#', 'g') AS mask FROM l WHERE i = 1 OR i = n)
SELECT mask, count(*) AS seen FROM e WHERE mask <> '' GROUP BY mask HAVING count(*) >= 3""")
def running_headers(t: Tables) -> DataFrame:
    """Rows 181, 249: first and last lines with digits masked, seen three times or more."""
    lines = F.split("text", "\n")
    ends = F.when(F.size(lines) > 1, F.array(F.element_at(lines, 1), F.element_at(lines, -1))).otherwise(lines)
    mask = F.regexp_replace(F.trim("line"), r"\d", "#")
    return t.documents.select(F.explode(ends).alias("line")).select(mask.alias("mask")).filter("mask <> ''").groupBy("mask").agg(F.count("*").alias("seen")).filter("seen >= 3")


@query(r"""
SELECT coalesce(lang, 'all') AS lang, count(*) AS judged, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def benchmark_inventory(t: Tables) -> DataFrame:
    """Rows 179, 180: label counts by language and over all."""
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    out = rows.rollup("lang").agg(F.count("*").alias("judged"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_distinct("source").alias("sources"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(r"""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS key FROM lineitem),
c(item, root) USING KEY (item) AS (
  SELECT DISTINCT item, item FROM e
  UNION (SELECT e.item, min(k.root) AS root FROM e JOIN (SELECT e.key, min(c.root) AS root FROM c JOIN e USING (item) GROUP BY e.key) k USING (key) JOIN recurring.c r ON r.item = e.item GROUP BY e.item HAVING min(k.root) < min(r.root)))
SELECT item, root FROM c""")
def related_groups(t: Tables) -> DataFrame:
    """Row 183: orders linked by shared parts, over any number of steps; all lines."""
    e = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key"))
    return C.related(e)


@query(r"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1:' || doc_id), doc_id) AS turn FROM documents)
SELECT doc_id, source, turn::INT AS turn FROM r ORDER BY turn, md5('s1:' || source), doc_id LIMIT 45""")
def sample_round_robin(t: Tables) -> DataFrame:
    """Rows 192-194: one document of each source per turn after a seeded shuffle."""
    return C.round_robin(t.documents.select("doc_id", "source"), "source", "doc_id", "s1", 45)


@query(r"""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, count(*) OVER () AS n FROM orders), p AS (SELECT DISTINCT floor(i * (SELECT any_value(n) FROM n) / 37.0)::BIGINT AS nth FROM range(37) r(i))
SELECT nth, o_orderkey FROM n JOIN p USING (nth)""")
def sample_stride(t: Tables) -> DataFrame:
    """Row 195: every element at an even stride."""
    return C.stride(t.orders.select("o_orderkey"), "o_orderkey", 37)


_QUOTAS = r"""
WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, 101 * n / sum(n) OVER ()::DOUBLE AS exact FROM c),
b AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, c_mktsegment) AS place FROM e),
q AS (SELECT c_mktsegment, n, (base + (place <= 101 - sum(base) OVER ())::INT)::BIGINT AS quota FROM b)
"""


@query(_QUOTAS + "SELECT * FROM q")
def sample_quotas(t: Tables) -> DataFrame:
    """Row 196: largest-remainder quotas."""
    return C.quotas(t.customer, "c_mktsegment", 101)


@query(_QUOTAS + r""", r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s2:' || c_custkey), c_custkey) AS nth FROM customer)
SELECT c_mktsegment, c_custkey FROM r JOIN q USING (c_mktsegment) WHERE nth <= quota""")
def sample_stratified(t: Tables) -> DataFrame:
    """Rows 196, 197, 433: a seeded draw by quotas."""
    return C.stratified(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", "s2", 101)


@query(r"""
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s3:' || o_orderkey), o_orderkey) AS nth FROM orders)
SELECT o_orderkey, CASE WHEN nth <= 20 THEN 'dev' ELSE 'train' END AS part FROM r WHERE nth <= 60""")
def sample_disjoint(t: Tables) -> DataFrame:
    """Rows 198, 323: two disjoint slices of one shuffle in each cell."""
    nth = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(C.draw(F.col("o_orderkey"), "s3"), "o_orderkey"))
    return t.orders.withColumn("nth", nth).filter("nth <= 60").select("o_orderkey", F.when(F.col("nth") <= 20, "dev").otherwise("train").alias("part"))


@query(r"""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s4:' || c_nationkey), c_nationkey) AS nth FROM c)
SELECT c_mktsegment, coalesce(sum(n) FILTER (nth = 1), 0)::BIGINT AS holdout, coalesce(sum(n) FILTER (nth > 1), 0)::BIGINT AS dev, count(DISTINCT c_nationkey) AS groups FROM r GROUP BY c_mktsegment""")
def split_coverage(t: Tables) -> DataFrame:
    """Rows 185, 199: one group of each sector is held out; counts by sector and split."""
    c = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(C.draw(F.col("c_nationkey"), "s4"), "c_nationkey")) == 1
    split = c.withColumn("split", F.when(first, "holdout").otherwise("dev"))
    counts = split.groupBy("c_mktsegment").pivot("split", ["holdout", "dev"]).agg(F.sum("n")).na.fill(0)
    return counts.join(c.groupBy("c_mktsegment").agg(F.count("*").alias("groups")), "c_mktsegment")


_STORES = r"""
WITH cur AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 0),
vec AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 0),
spa AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
d AS (SELECT coalesce(c.id, v.id, s.id) AS id, CASE WHEN c.id IS NULL THEN 'stale' WHEN v.id IS NULL OR s.id IS NULL THEN 'new' WHEN v.hash <> c.hash OR s.hash <> c.hash THEN 'changed' ELSE 'same' END AS status
      FROM cur c FULL JOIN vec v ON c.id = v.id FULL JOIN spa s ON coalesce(c.id, v.id) = s.id)
"""


def _stores(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    id = F.col("doc_id")
    d = t.documents.select(id.alias("id"), F.sha2("text", 256).alias("hash"))
    return d.filter("id % 11 <> 0"), d.filter("id % 10 <> 0").withColumn("hash", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("hash"))), d.filter("id % 13 <> 0")


@query(_STORES + "SELECT * FROM d")
def index_diff(t: Tables) -> DataFrame:
    """Rows 132, 219-221, 281, 418: corpus against both stores."""
    current, vectors, sparse = _stores(t)
    return C.index_diff(current, vectors, sparse)


@query(_STORES + """SELECT id, hash FROM (SELECT v.id, v.hash FROM vec v JOIN cur c ON c.id = v.id WHERE v.hash = c.hash UNION ALL SELECT c.id, c.hash FROM cur c LEFT JOIN vec v ON c.id = v.id WHERE v.id IS NULL OR v.hash <> c.hash)""")
def index_run(t: Tables) -> DataFrame:
    """Rows 266-270: what an incremental run leaves in the vector store."""
    current, vectors, _ = _stores(t)
    return C.maintained(vectors, current)


@query(_STORES + """SELECT id, hash FROM spa WHERE id % 5 <> 0 AND id % 4 <> 0 UNION ALL SELECT id, 'new' FROM vec WHERE id % 5 = 0 AND id % 4 <> 0""")
def index_upsert(t: Tables) -> DataFrame:
    """Rows 267-271, 273-275: an upsert by id, a delete, and lookups as semi-joins."""
    _, vectors, sparse = _stores(t)
    fresh = vectors.filter("id % 5 = 0").withColumn("hash", F.lit("new"))
    return C.deleted(C.upserted(sparse.filter("id % 5 <> 0"), fresh), t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id")))


@query("""
WITH a AS (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey % 4 <> 1), b AS (SELECT n_name AS key, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR END AS value FROM nation WHERE n_nationkey % 5 <> 2)
SELECT coalesce(a.key, b.key) AS key, a.value AS "left", b.value AS "right" FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def manifest_compare(t: Tables) -> DataFrame:
    """Rows 223, 224, 277, 388: settings that differ; a nation's region is a setting, which one
    side lacks or has without a value."""
    key, n = F.col("n_nationkey"), t.nation
    left = n.filter(key % 4 != 1).select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    right = n.filter(key % 5 != 2).select(F.col("n_name").alias("key"), F.when(key % 3 != 0, F.col("n_regionkey").cast("string")).alias("value"))
    return C.differences(left, right)


@query("SELECT lang || '/' || doc_id AS id, lang AS corpus, length(text) AS n_chars FROM documents WHERE lang IN ('en', 'fr')")
def corpus_pooling(t: Tables) -> DataFrame:
    """Rows 11, 12, 24: corpora pooled, a repeated id raises."""
    one = lambda lang: t.documents.filter(F.col("lang") == lang).select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("corpus"), F.length("text").cast("long").alias("n_chars"))
    return C.unique_ids(one("en").unionByName(one("fr")), "id")


@query("SELECT source, arg_min(doc_id, doc_id) AS first_document, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_per_group(t: Tables) -> DataFrame:
    """Rows 142, 143, 380: the first row of each group by one aggregation."""
    return t.documents.groupBy("source").agg(F.min("doc_id").alias("first_document"), F.min_by("lang", "doc_id").alias("lang"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@query("""
SELECT item_id AS judged, 'document' AS missing FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.item_id)
UNION ALL SELECT doc_id, 'query' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = l.doc_id)""")
def referential_checks(t: Tables) -> DataFrame:
    """Rows 137, 320: ids of one table that the other lacks, both ways."""
    return _unmatched(t.benchmark, t.labels)


def _unmatched(benchmark: DataFrame, labels: DataFrame) -> DataFrame:
    a = benchmark.join(labels, F.col("item_id") == F.col("doc_id"), "left_anti").select(F.col("item_id").alias("judged"), F.lit("document").alias("missing"))
    b = labels.join(benchmark, F.col("item_id") == F.col("doc_id"), "left_anti").select(F.col("doc_id").alias("judged"), F.lit("query").alias("missing"))
    return a.unionByName(b)


@query("""
WITH n AS (SELECT c_custkey, c_name || ' (C' || c_custkey || ') 10-K -- period ended 2024-0' || (1 + c_custkey % 9) || '-15' AS title FROM customer)
SELECT c_custkey, regexp_extract(title, '^(.+) \\(([^)]+)\\) (\\S+) -- period ended (\\d{4}-\\d{2}-\\d{2})$', 1) AS company, regexp_extract(title, '\\(([^)]+)\\)', 1) AS ticker, regexp_extract(title, '\\) (\\S+) --', 1) AS form, replace(regexp_extract(title, '\\d{4}-\\d{2}-\\d{2}'), '-', '')::INT AS period_end FROM n""")
def filing_identity(t: Tables) -> DataFrame:
    """Rows 140, 424: attributes parsed from a title."""
    title = F.concat(F.col("c_name"), F.lit(" (C"), F.col("c_custkey").cast("string"), F.lit(") 10-K -- period ended 2024-0"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit("-15"))
    pattern = r"^(.+) \(([^)]+)\) (\S+) -- period ended (\d{4}-\d{2}-\d{2})$"
    part = lambda i: F.regexp_extract(title, pattern, i)
    return t.customer.select("c_custkey", part(1).alias("company"), part(2).alias("ticker"), part(3).alias("form"), T.date_number(F.to_date(part(4))).alias("period_end"))
