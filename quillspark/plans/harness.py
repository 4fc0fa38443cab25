"""Queries over the evaluation harness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import harness as H
from .registry import Tables, query


@query("""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'stated' WHEN quality = 1 THEN 'span' ELSE 'document' END AS mode, CASE WHEN doc_id % 5 = 0 THEN 'refusal' ELSE 'answer' END AS rubric,
       CASE WHEN quality = 1 THEN toxic = 0 END AS evidence, CASE WHEN doc_id % 7 = 0 THEN false WHEN doc_id % 3 < 2 THEN doc_id % 3 = 0 END AS passed, round(CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE (doc_id % 4 - quality)::DOUBLE / (doc_id % 4) END, 6) AS recall FROM labels""")
def sample_state(t: Tables) -> DataFrame:
    """Rows 16, 304, 313, 363-367, 369: modes, rubrics, three-valued evidence and verdicts."""
    id, good = F.col("doc_id"), F.col("quality")
    spans = F.when(good == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t.labels.select(
        "doc_id", H.matching_mode(F.when(F.col("toxic") == 1, "stated"), spans).alias("mode"), H.rubric(F.when(id % 5 == 0, "refusal").otherwise("x")).alias("rubric"),
        H.evidence_status(good, F.col("toxic")).alias("evidence"), H.passed(F.when(id % 3 < 2, id % 3 == 0), id % 7 == 0).alias("passed"),
        F.round(H.evidence_recall(id % 4, good), 6).alias("recall"),
    )


@query("""
SELECT n_nationkey, contains(' ' || n_name || ' in 2024 ', ' ' || substr(n_name, 1, 5) || ' ') OR lower(n_name) IN ('france', 'china', 'japan') AS named, contains(lower('about ' || n_name), lower(substr(n_name, 2, 3))) AS mentioned FROM nation""")
def company_names(t: Tables) -> DataFrame:
    """Rows 81, 379: a company's ticker or alias in a question."""
    name = F.col("n_name")
    aliases = F.array(*[F.lit(x) for x in ("france", "china", "japan")])
    return t.nation.select("n_nationkey", T.names_company(F.concat(name, F.lit(" in 2024 ")), F.substring(name, 1, 5), aliases).alias("named"), F.contains(F.lower(F.concat(F.lit("about "), name)), F.lower(F.substring(name, 2, 3))).alias("mentioned"))


@query("""
WITH r AS (SELECT user_id % 30 AS identity, event_id AS run_id, ts AS started, CASE WHEN value > 50 THEN 'running' ELSE 'done' END AS status FROM events)
SELECT identity, arg_max(run_id, struct_pack(s := started, r := run_id)) AS run_id FROM r WHERE status = 'running' GROUP BY identity""")
def run_resume(t: Tables) -> DataFrame:
    """Rows 319, 384, 392, 397: the newest unfinished run of each identity."""
    return H.resumable(_runs(t.events), ["identity"])


def _runs(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 30).alias("identity"), F.col("event_id").alias("run_id"), F.col("ts").alias("started"), F.when(F.col("value") > 50, "running").otherwise("done").alias("status"))


@query("""
WITH e AS (SELECT DISTINCT user_id AS id FROM events), g AS (SELECT user_id AS id, count(*) AS n FROM events WHERE value > 97 GROUP BY 1)
SELECT coalesce(e.id, g.id) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'repeated' END AS problem FROM e FULL JOIN g ON e.id = g.id WHERE n IS NULL OR e.id IS NULL OR n > 1""")
def run_completeness(t: Tables) -> DataFrame:
    """Rows 320, 383, 398: ids that a run lacks, repeats or has too many."""
    ids = t.events.select(F.col("user_id").alias("id"), "value")
    return H.completeness(ids.select("id").distinct(), ids.filter("value > 97"), "id")


@query("""
WITH k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, n_chars / 1000.0::DOUBLE AS score FROM documents)
SELECT doc_id, rank::INT AS rank, round(score, 4) AS score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, 10 AS start, (10 + least(length(text), 200))::INT AS "end", length(text) > 200 AS more,
       doc_id || '@' || substr(sha256(text), 1, 16) || ':10-' || (10 + least(length(text), 200)) AS passage FROM k WHERE rank <= 5""")
def tool_results(t: Tables) -> DataFrame:
    """Rows 324, 327, 394, 401, 406: ranked passages as a tool shows them, with their names."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = t.documents.withColumn("rank", rank).filter("rank <= 5").withColumn("e", H.tool_entry(F.col("rank"), F.col("n_chars") / 1000.0, F.col("text"), F.lit(10)))
    name = H.passage_name(F.col("doc_id").cast("string"), T.short_hash(F.col("text")), F.col("e.start"), F.col("e.end"))
    return rows.select("doc_id", name.alias("passage"), "e.*")


@query("""
WITH c AS (SELECT user_id, list(value::BIGINT) FILTER (event_type = 'view' AND value > 20) AS v, count(*) FILTER (event_type = 'view') AS windows FROM events GROUP BY 1)
SELECT user_id, coalesce(list_sum(v), 0)::BIGINT AS characters, windows FROM c""")
def reads(t: Tables) -> DataFrame:
    """Rows 366, 404, 405: read windows, and the characters of those that ran."""
    call = F.struct(F.when(F.col("event_type") == "view", "read").otherwise("search").alias("tool"), F.when(F.col("value") > 20, "ok").otherwise("error").alias("status"), F.lit(0).cast("long").alias("start"), F.bround("value", 0).cast("long").alias("end"))
    name = F.concat(F.when(F.col("event_type") == "view", "read:").otherwise("x:"), F.col("event_id").cast("string"))
    return t.events.groupBy("user_id").agg(H.characters_read(F.collect_list(call)).alias("characters"), F.count_if(H.is_window(name)).alias("windows"))


_HEADS = """
WITH RECURSIVE n AS (SELECT r_regionkey AS id, '# ' || r_name || chr(10) || string_agg('## ' || n_name || chr(10) || '### part' || chr(10) || 'line ' || n_nationkey || chr(10) || '# break', chr(10) ORDER BY n_nationkey) AS md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name),
l AS (SELECT id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS nth FROM n),
w AS (SELECT l.id, l.nth, l.line, (SELECT max(nth) FROM l x WHERE x.id = l.id AND x.nth <= l.nth AND x.line LIKE '# %') AS a, (SELECT max(nth) FROM l x WHERE x.id = l.id AND x.nth <= l.nth AND x.line LIKE '## %') AS b, (SELECT max(nth) FROM l x WHERE x.id = l.id AND x.nth <= l.nth AND x.line LIKE '### %') AS c FROM l)
SELECT w.id AS r_regionkey, w.nth::INT AS nth, concat_ws(' > ', CASE WHEN a > 0 THEN (SELECT substr(line, 3) FROM l x WHERE x.id = w.id AND x.nth = a) END, CASE WHEN b > a THEN (SELECT substr(line, 4) FROM l x WHERE x.id = w.id AND x.nth = b) END, CASE WHEN c > b AND c > a THEN 'part' END) AS path FROM w"""


@query(_HEADS)
def heading_paths(t: Tables) -> DataFrame:
    """Rows 200, 201: the open headings above each line."""
    n = t.nation.select("n_regionkey", "n_nationkey", F.concat(F.lit("## "), F.col("n_name"), F.lit("\n### part\nline "), F.col("n_nationkey").cast("string"), F.lit("\n# break")).alias("s"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "s"))), lambda x: x["s"]), "\n").alias("body"))
    md = t.region.join(body, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", F.posexplode(F.split(F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"), F.col("body")), "\n")).alias("nth", "line"))
    return H.heading_paths(md, "r_regionkey", "nth", "line").select("r_regionkey", "nth", "path")


@query("""
SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag || l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)""")
def header_fill(t: Tables) -> DataFrame:
    """Row 202: header labels filled to the right."""
    label = F.when(F.col("l_linenumber") % 3 == 1, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise("")
    cells = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return H.filled_right(cells.withColumn("label", label), ["l_orderkey"], "l_linenumber", "label").select("l_orderkey", "l_linenumber", "filled")


@query("""
WITH p AS (SELECT o_custkey AS pair, list(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS withheld, list(DISTINCT o_orderkey) AS pool FROM orders GROUP BY 1)
SELECT pair, len(withheld) AS withheld FROM p WHERE len(withheld) > 0 AND len(withheld) = len(pool)""")
def pooling_leak(t: Tables) -> DataFrame:
    """Row 138: pairs whose withheld ids make up the pool; counts say so without any list."""
    p = t.orders.groupBy(F.col("o_custkey").alias("pair")).agg(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("withheld"), F.count_distinct("o_orderkey").alias("pool"))
    return p.filter("withheld > 0 and withheld = pool").select("pair", "withheld")


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber AS hop, l_discount > 0.03 AS found FROM lineitem), s AS (SELECT l_orderkey, count(*) AS hops, count(*) FILTER (found) AS got FROM h GROUP BY 1)
SELECT hop, count(*) AS n, round(avg(found::INT), 6) AS evidence, round(avg((got = hops)::INT), 6) AS complete FROM h JOIN s USING (l_orderkey) GROUP BY hop""")
def hops(t: Tables) -> DataFrame:
    """Rows 23, 165, 318: evidence by hop, and whole samples among those that have the hop."""
    found = F.col("l_discount") > 0.03
    s = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("hop"), found.alias("found")))).alias("hops"))
    s = s.withColumn("whole", F.forall("hops", lambda h: h["found"]))
    rows = s.select("whole", F.explode("hops").alias("h"))
    return rows.groupBy(F.col("h.hop").alias("hop")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("h.found").cast("int")), 6).alias("evidence"), F.round(F.avg(F.col("whole").cast("int")), 6).alias("complete"))


@query("""
WITH c AS (SELECT source, doc_id, n_chars, lang FROM documents)
SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS flat, round(1 - n_chars / 100000.0::DOUBLE, 6) AS score, 'query: ' || source AS asked, lang || ': ' || n_chars AS passage FROM c""")
def vector_records(t: Tables) -> DataFrame:
    """Rows 256, 341, 342, 347, 351: records flattened for a store, rebuilt with a score, and
    the templates of both sides of a pair."""
    return _records(t.documents)


def _records(documents: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("page"), F.lit(None).cast("string"), F.lit("source"), F.col("source"))
    flat = F.to_json(F.map_filter(meta, lambda k, v: v.isNotNull()))
    return documents.select("doc_id", flat.alias("flat"), F.round(1 - F.col("n_chars") / 100000.0, 6).alias("score"), F.replace(F.lit("query: {text}"), F.lit("{text}"), F.col("source")).alias("asked"), T.render("{lang}: {n}", lang=F.col("lang"), n=F.col("n_chars")).alias("passage"))


@query("""
SELECT item_id, item_id % 3 > 0 OR item_id % 5 = 0 AS expanded, 1 + (item_id % 3 = 1)::INT AS n_queries FROM benchmark""")
def expansion(t: Tables) -> DataFrame:
    """Rows 257-259, 356: whether a query was expanded, for one or all consumers."""
    id, text = F.col("item_id"), F.col("text")
    sparse = F.when(id % 3 == 1, F.array(text, F.upper(text))).otherwise(F.array(text))
    dense = F.when((id % 3 == 2) | (id % 5 == 0), F.array(F.concat(F.lit("passage on "), text))).otherwise(sparse)
    return t.benchmark.select("item_id", ((F.size(sparse) > 1) | (dense != sparse)).alias("expanded"), F.size(F.array_distinct(sparse)).alias("n_queries"))


@query("""
WITH s AS (SELECT c_custkey, c_mktsegment, c_nationkey % 2 = 0 AS spans, c_nationkey % 3 = 0 AS parts FROM customer)
SELECT c_custkey, 'spans' AS subset FROM s WHERE spans UNION ALL SELECT c_custkey, 'single' FROM s WHERE NOT parts UNION ALL SELECT c_custkey, 'parts' FROM s WHERE parts""")
def runner_files(t: Tables) -> DataFrame:
    """Rows 416, 419: three overlapping subsets in one pass over the samples."""
    n = F.col("c_nationkey")
    subsets = F.filter(F.array(F.when(n % 2 == 0, "spans"), F.when(n % 3 != 0, "single"), F.when(n % 3 == 0, "parts")), lambda x: x.isNotNull())
    return t.customer.select("c_custkey", F.explode(subsets).alias("subset"))


@query("""
WITH d AS (SELECT event_type AS dataset, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT dataset, n, round(m, 6) AS mean, round(m - 2.575829303549::DOUBLE * sd / sqrt(n), 6) AS low, round(m + 2.575829303549::DOUBLE * sd / sqrt(n), 6) AS high, round(m / 100 * n)::BIGINT AS headline FROM d""")
def comparison_table(t: Tables) -> DataFrame:
    """Rows 312, 395, 434, 436: means by data set with an interval for five comparisons."""
    z = H.bonferroni(5)
    d = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    half = z * F.col("sd") / F.sqrt("n")
    return d.select("dataset", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.round(F.col("m") / 100 * F.col("n")).cast("long").alias("headline"))


@query("""
WITH m AS (SELECT c_custkey, '| Name | Balance |' || chr(10) || '|---|---|' || chr(10) || chr(10) || '| ' || c_name || ' | 1 |' || chr(10) || 'after' AS md FROM customer)
SELECT c_custkey, NULL::VARCHAR AS first_row, 'later_row' AS last_row, 'mid_row' AS inside, NULL::VARCHAR AS after, 2::BIGINT AS data_rows FROM m""")
def table_starts(t: Tables) -> DataFrame:
    """Rows 92, 241: where an offset falls relative to a table, and a table's rows."""
    from ..functions.tables import data_rows, table_start

    md = F.concat(F.lit("| Name | Balance |\n|---|---|\n\n| "), F.col("c_name"), F.lit(" | 1 |\nafter"))
    rows = t.customer.withColumn("md", md)
    last = F.instr("md", "| Customer").cast("int") - 1
    after = F.length("md") - 5
    return rows.select("c_custkey", table_start(F.col("md"), F.lit(0)).alias("first_row"), table_start(F.col("md"), last).alias("last_row"), table_start(F.col("md"), last + 4).alias("inside"), table_start(F.col("md"), after).alias("after"), data_rows(F.col("md")).cast("long").alias("data_rows"))
