"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Tables, query

# Words without a topic, and those that name a period.
STOPWORDS = (
    "a an the of in on at for to from by with and or as is was were be been are what which who whom how much many did does do its it their this that these those during over per than "
    "s company inc corp co fiscal year years quarter quarters month months ended ending three six nine twelve period periods "
    "january february march april may june july august september october november december"
).split()

_SQL_CLEAN = r"""
  SELECT doc_id, text, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9f}]', '', 'g') AS bare FROM documents
), h AS (
  SELECT *, regexp_replace(bare, '([a-z])-\n([a-z])', '\1\2', 'g') AS joined FROM c
), w AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(joined, '\n$', ''), '[ \t]+', ' ', 'g'), ' +(\n|$)', '\1', 'g') AS lines FROM h
), b AS (
  SELECT *, trim(regexp_replace(lines, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS clean FROM w
)
"""


@query("WITH c AS (" + _SQL_CLEAN + """
SELECT doc_id, md5(bare) AS bare, md5(joined) AS joined, md5(lines) AS lines, md5(clean) AS clean, length(clean) AS n_chars,
       sha256(clean) AS content_hash, substr(sha256(clean), 1, 16) AS version FROM b""")
def text_clean(t: Tables) -> DataFrame:
    """Rows 37-42, 53, 57: the cleaning steps, content hash and document version."""
    text = F.col("text")
    bare = T.strip_control(text)
    joined = T.dehyphenate(bare)
    lines = T.normalize_whitespace(joined)
    clean = T.clean_text(text)
    return t.documents.select("doc_id", F.md5(bare).alias("bare"), F.md5(joined).alias("joined"), F.md5(lines).alias("lines"), F.md5(clean).alias("clean"), F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("content_hash"), T.short_hash(clean).alias("version"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS tokens FROM t""")
def text_tokenize(t: Tables) -> DataFrame:
    """Rows 43, 345."""
    w = T.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.md5(F.array_join(w, " ")).alias("tokens"))


_FOLD = r"""replace(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, chr(160), ' '), chr(8216), ''''), chr(8217), ''''), chr(8220), '"'), chr(8221), '"'), chr(8211), '-'), chr(8212), '-'), chr(8230), '...'), '--', '-'), '[\s\x1C-\x1F]+', ' ', 'g'))), 'ß', 'ss')"""


@query(f"""
WITH f AS (SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents)
SELECT doc_id, md5(folded) AS folded, len(regexp_extract_all(folded, '[a-z0-9]+(?:\\.[0-9]+)?')) AS n_words FROM f""")
def text_fold(t: Tables) -> DataFrame:
    """Rows 44, 79, 407, 432: the form in which quotes are compared."""
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"), F.size(T.words_of_question(F.col("text"))).cast("long").alias("n_words"))


_ANSWER = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '(^|[^\pL\pN_])(?:a|an|the)\b', '\1 ', 'g'), '\s+', ' ', 'g'))"""


@query(r"""
WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS gold, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
), w AS (
  SELECT *, string_split(regexp_replace(lower(gold), '[!-/:-@\[-`{-~]', '', 'g'), ' ') AS g0, string_split(regexp_replace(lower(answer), '[!-/:-@\[-`{-~]', '', 'g'), ' ') AS a0 FROM p
), n AS (
  SELECT conv_id, turn, list_filter(flatten(list_transform(g0, x -> string_split(x, chr(10)))), lambda y: y NOT IN ('', 'a', 'an', 'the')) AS g,
         list_filter(flatten(list_transform(a0, x -> string_split(x, chr(10)))), lambda y: y NOT IN ('', 'a', 'an', 'the')) AS a FROM w
), c AS (
  SELECT conv_id, turn, g, a, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, g)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS same FROM n
)
SELECT conv_id, turn, (array_to_string(a, ' ') = array_to_string(g, ' '))::INT AS em,
       round(CASE WHEN len(a) = 0 OR len(g) = 0 THEN (len(a) = len(g))::INT::DOUBLE ELSE 2.0::DOUBLE * same / (len(a) + len(g)) END, 6) AS f1,
       len(g) > 0 AND contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') AS contains_gold FROM c""".replace("x -> ", "lambda x: "))
def answer_match(t: Tables) -> DataFrame:
    """Rows 45-51: exact match, token F1 and containment of each turn in the next."""
    c = t.conversations
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.join(later, ["conv_id", "turn"])
    golds = F.array("text")
    return pairs.select("conv_id", "turn", T.best(T.exact_match, F.col("answer"), golds).alias("em"), F.round(T.best(T.token_f1, F.col("answer"), golds), 6).alias("f1"), T.contains_answer(F.col("answer"), golds).alias("contains_gold"))


@query(r"""
SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:%|percent|billion|million))?'), lambda x: regexp_replace(trim(x), '[,.]+$', '')), lambda x: regexp_matches(x, '[$%]|\d\.\d|\d,\d{3}|billion|million|percent'))) AS leads,
       round(coalesce(length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0), 6) AS digits,
       round(coalesce((length(text) - length(replace(text, '|', '')))::DOUBLE / nullif(length(text), 0), 0), 6) AS pipes FROM documents""")
def text_figures(t: Tables) -> DataFrame:
    """Rows 82, 87, 88."""
    text = F.col("text")
    return t.documents.select("doc_id", F.size(T.lead_figures(text)).cast("long").alias("leads"), F.round(T.digit_ratio(text), 6).alias("digits"), F.round(T.pipe_ratio(text), 6).alias("pipes"))


@query(rf"""
WITH f AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|billion|million|thousand)?'), lambda x: regexp_replace(trim({_FOLD.format('x')}), '[,.]+$', '')) AS found FROM documents
)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(found, lambda x: NOT regexp_full_match(x, '(19|20)\d\d') AND (regexp_matches(x, '\$|billion|million|thousand') OR length(regexp_replace(x, '\D', '', 'g')) >= 4 OR (regexp_matches(x, '%|percent') AND length(regexp_replace(x, '\D', '', 'g')) >= 3))))), ' ') AS figures FROM f""")
def text_leak_figures(t: Tables) -> DataFrame:
    """Row 83."""
    return t.documents.select("doc_id", F.array_join(T.leak_figures(F.col("text")), " ").alias("figures"))


@query(r"""
SELECT n_nationkey, 'n/' || n_nationkey || CASE WHEN n_regionkey > 1 THEN '#page=' || n_regionkey ELSE '' END AS document, 'n/' || n_nationkey || '::chunk' || n_regionkey AS chunk,
       substr(sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}'), 1, 16) AS stable, 'musique-' || substr(sha256(n_name || chr(10) || 'x'), 1, 16) AS paragraph,
       sha256('sys' || chr(0) || n_name || chr(0)) AS print, CASE WHEN n_name > 'J' THEN n_name || ' t' ELSE 't' END AS passage FROM nation""")
def text_identity(t: Tables) -> DataFrame:
    """Rows 7, 10, 54, 55, 58, 59: identities of documents, chunks and records."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    path = F.concat(F.lit("n/"), key.cast("string"))
    page = F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))
    return t.nation.select(
        "n_nationkey", T.document_id(path, page).alias("document"), T.chunk_id(path, F.col("n_regionkey")).alias("chunk"),
        T.stable_hash(key.alias("key"), name.alias("name")).alias("stable"),
        F.concat(F.lit("musique-"), T.short_hash(F.concat(name, F.lit("\nx")))).alias("paragraph"),
        T.fingerprint(F.lit("sys"), name).alias("print"), T.passage_text(F.when(name > "J", name).otherwise(""), F.lit("t")).alias("passage"),
    )


@query(r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS day, strftime(o_orderdate, '%B %-d, %Y') AS spelled, strftime(o_orderdate, '%Y-%m-%d') AS listed,
       'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%B %-d, %Y') AS record, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority || ': ' || o_orderstatus END AS header FROM orders""")
def text_dates(t: Tables) -> DataFrame:
    """Rows 60, 62-64, 360: dates as numbers and words, headers and records from templates."""
    date, status = F.col("o_orderdate"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", T.date_number(date).alias("day"), T.spell_date(date).alias("spelled"), F.date_format(date, "yyyy-MM-dd").alias("listed"),
        T.render("Order {key} of {on:date}", key=F.col("o_orderkey"), on=date).alias("record"),
        T.render("{priority}: {status}", priority=F.col("o_orderpriority"), status=F.when(status != "O", status).otherwise("")).alias("header"),
    )


@query(r"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), k AS (SELECT * FROM d WHERE n <= 3),
p AS (SELECT *, 'Passage [' || n || '] (source: ' || lang || CASE WHEN n > 1 THEN ' (p.' || n || ')' ELSE '' END || '):' || chr(10) || CASE WHEN n = 2 THEN 'Context: ' || source || chr(10) ELSE '' END || text AS block FROM k)
SELECT source, md5('Question: ' || source || chr(10) || chr(10) || string_agg('<passage>' || chr(10) || block || chr(10) || '</passage>', chr(10) || chr(10) ORDER BY n)) AS prompt,
       md5(string_agg(CASE WHEN n = 1 THEN lang || chr(10) || chr(10) ELSE '' END || text, '|' ORDER BY n)) AS index_texts FROM p GROUP BY source""")
def text_prompts(t: Tables) -> DataFrame:
    """Rows 52, 71-75, 340, 352: passages and prompts of the first three documents of each source."""
    from pyspark.sql.window import Window as W

    n = F.col("n")
    k = t.documents.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).filter("n <= 3")
    label = T.citation_label(F.lit(""), F.col("lang"), F.when(n > 1, n))
    block = T.delimit_passage(T.format_passage(n, label, F.when(n == 2, F.col("source")), F.col("text")))
    texts = T.index_text(F.when(n == 1, F.col("lang")), F.lit(""), F.col("text"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("x")))), lambda s: s["x"]), by)
    return k.groupBy("source").agg(F.md5(F.concat(F.lit("Question: "), F.first("source"), F.lit("\n\n"), joined(block, "\n\n"))).alias("prompt"), F.md5(joined(texts, "|")).alias("index_texts"))


@query(r"""
WITH a AS (SELECT doc_id AS id, 'As [' || doc_id % 5 || '] and [3, ' || doc_id % 7 || '] show ' || source || ' [9].' || CASE WHEN doc_id % 2 = 0 THEN ' [2][2] [0] x [1,4]' ELSE '' END AS answer, doc_id % 4 AS n FROM documents),
m AS (SELECT *, list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split(g, ','))), lambda x: trim(x)::INT) AS c FROM a),
f AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM m)
SELECT id, array_to_string(list_filter(u, lambda x: x BETWEEN 1 AND n), ',') AS cited, array_to_string(list_filter(u, lambda x: x NOT BETWEEN 1 AND n), ',') AS invalid,
       regexp_replace(answer, '[ \t]*\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g') AS bare FROM f""")
def text_citations(t: Tables) -> DataFrame:
    """Rows 68-70: answers that cite some passages of each document's list."""
    id = F.col("doc_id")
    more = F.when(id % 2 == 0, " [2][2] [0] x [1,4]").otherwise("")
    answer = F.concat(F.lit("As ["), (id % 5).cast("string"), F.lit("] and [3, "), (id % 7).cast("string"), F.lit("] show "), F.col("source"), F.lit(" [9]."), more)
    a = t.documents.select(id.alias("id"), answer.alias("answer"), (id % 4).cast("int").alias("n"))
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    return a.select("id", listed(T.cited_passages(F.col("answer"), F.col("n"))).alias("cited"), listed(T.invalid_citations(F.col("answer"), F.col("n"))).alias("invalid"), T.strip_citations(F.col("answer")).alias("bare"))


@query(r"""
WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'pass' WHEN turn % 3 = 1 THEN 'FAIL.' ELSE text END AS reply FROM conversations),
w AS (SELECT *, split_part(regexp_replace(trim(reply, ' ' || chr(10)), '\s+', ' ', 'g'), ' ', 1) AS w FROM r)
SELECT conv_id, turn, upper(trim(w, '.,:!*')) AS first_word, CASE upper(w) WHEN 'PASS' THEN true WHEN 'FAIL' THEN false END AS verdict FROM w""")
def text_verdicts(t: Tables) -> DataFrame:
    """Rows 66, 67: one-word verdicts; what is neither is null."""
    turn = F.col("turn")
    reply = F.when(turn % 3 == 0, "pass").when(turn % 3 == 1, "FAIL.").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", T.first_word(reply).alias("first_word"), T.pass_fail(reply).alias("verdict"))


@query(r"""
WITH r AS (SELECT c_custkey AS id, '1. ' || c_name || ' first' || chr(10) || '- ' || c_mktsegment || chr(10) || '* "' || lower(c_mktsegment) || '"' || chr(10) || upper(c_name || ' first') || chr(10) || chr(10) || '2) ' || c_name || ' again' AS reply, 1 + c_custkey % 4 AS n FROM customer),
l AS (SELECT id, n, unnest(string_split(reply, chr(10))) AS line, generate_subscripts(string_split(reply, chr(10)), 1) AS pos FROM r),
c AS (SELECT id, n, pos, trim(trim(trim(regexp_replace(trim(regexp_replace(trim(line), '^[-*]+', '')), '^\d+\s*[.):-]\s*', ''))), '"') AS q FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY id, lower(q) ORDER BY pos) AS k FROM c WHERE q <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS ordinal FROM u WHERE k = 1)
SELECT id, ordinal::INT AS ordinal, q AS query FROM o WHERE ordinal <= n""")
def query_lines(t: Tables) -> DataFrame:
    """Rows 76, 77, 218, 222: a reply's distinct queries in order, up to a limit."""
    from pyspark.sql.window import Window as W

    name, kind = F.col("c_name"), F.col("c_mktsegment")
    parts = ["1. ", name, " first\n- ", kind, '\n* "', F.lower(kind), '"\n', F.upper(F.concat(name, F.lit(" first"))), "\n\n2) ", name, " again"]
    reply = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    r = t.customer.select(F.col("c_custkey").alias("id"), reply.alias("reply"), (1 + F.col("c_custkey") % 4).alias("n"))
    lines = r.select("id", "n", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).withColumn("query", T.clean_query_line(F.col("line"))).filter("query <> ''")
    first = lines.withColumn("k", F.row_number().over(W.partitionBy("id", F.lower("query")).orderBy("pos"))).filter("k = 1")
    return first.withColumn("ordinal", F.row_number().over(W.partitionBy("id").orderBy("pos"))).filter("ordinal <= n").select("id", "ordinal", "query")


@query(r"""
WITH m AS (
  SELECT c_custkey, '| ' || c_name || ' | $' || round(c_acctbal, 2)::DECIMAL(18,2) || ' | 20' || lpad((c_nationkey)::VARCHAR, 2, '0') || ' | a\|b |' AS line FROM customer
), c AS (
  SELECT c_custkey, line, list_transform(string_split(replace(regexp_replace(trim(line), '^\|(.*).$', '\1'), '\|', chr(1)), '|'), lambda x: replace(trim(x), chr(1), '|')) AS cells FROM m
)
SELECT c_custkey, line LIKE '|%' AS is_row, cells[1] AS name, replace(cells[2], '$', '') AS amount_key, regexp_matches(cells[2], '^[($€£¥]*-?[\d,]*\.?\d+[)%]*$') AND NOT regexp_full_match(cells[2], '(19|20)\d\d') AS is_amount,
       regexp_matches(cells[3], '^[($€£¥]*-?[\d,]*\.?\d+[)%]*$') AND NOT regexp_full_match(cells[3], '(19|20)\d\d') AS is_year_figure, cells[4] AS piped FROM c""")
def table_lines(t: Tables) -> DataFrame:
    """Rows 84-86, 91: cells of rendered table rows."""
    line = F.concat(F.lit("| "), F.col("c_name"), F.lit(" | $"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" | 20"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" | a\\|b |"))
    cells = t.customer.withColumn("line", line).withColumn("cells", T.table_cells(F.col("line")))
    cell = lambda k: F.get("cells", F.lit(k))
    return cells.select("c_custkey", T.is_table_row(F.col("line")).alias("is_row"), cell(0).alias("name"), T.figure_key(cell(1)).alias("amount_key"), T.is_figure(cell(1)).alias("is_amount"), T.is_figure(cell(2)).alias("is_year_figure"), cell(3).alias("piped"))


@query(r"""
WITH m AS (SELECT r_regionkey, '# ' || r_name || chr(10) || string_agg('## ' || n_name || chr(10) || 'text' || chr(10) || '###x', chr(10) ORDER BY n_nationkey) AS md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)
SELECT r_regionkey, len(regexp_extract_all(md, '(?m)^#{2,6} \S')) AS headings, trim(regexp_extract(md, '(?m)^\s*#+\s*(.*)$', 1)) AS title FROM m""")
def markdown_headings(t: Tables) -> DataFrame:
    """Rows 9, 90, 361: section headings and the first heading as title."""
    n = t.nation.select("n_regionkey", "n_nationkey", F.concat(F.lit("## "), F.col("n_name"), F.lit("\ntext\n###x")).alias("s"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "s"))), lambda x: x["s"]), "\n").alias("body"))
    md = t.region.join(body, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("md", F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"), F.col("body")))
    title = F.trim(F.regexp_extract("md", r"(?m)^\s*#+\s*(.*)$", 1))
    return md.select("r_regionkey", T.count_headings(F.col("md")).cast("long").alias("headings"), title.alias("title"))


@query(rf"""
WITH b AS (SELECT item_id, {_FOLD.format('text')} AS f FROM benchmark),
w AS (SELECT item_id, regexp_extract_all(f, '[a-z0-9]+(?:\.[0-9]+)?') AS q, regexp_extract_all(substr(f, 1, 60), '[a-z0-9]+(?:\.[0-9]+)?') AS s FROM b),
k AS (SELECT item_id, s, list_filter(q, lambda x: NOT list_contains([{', '.join(repr(x) for x in STOPWORDS)}], x) AND NOT regexp_full_match(x, '(?:19|20)\d\d|\d{{1,2}}|fy\d*|q[1-4]')) AS q FROM w)
SELECT item_id, round(coalesce(len(list_filter(q, lambda x: list_contains(s, x)))::DOUBLE / nullif(len(q), 0), 0), 6) AS overlap FROM k""")
def question_overlap(t: Tables) -> DataFrame:
    """Row 80: share of topic words that the quoted start has."""
    span = F.substring(T.fold(F.col("text")), 1, 60)
    return t.benchmark.select("item_id", F.round(T.content_overlap(F.col("text"), F.array(span), STOPWORDS), 6).alias("overlap"))


@query(r"""
SELECT page_id, CASE WHEN lower(regexp_extract(url, '\.[^./]+$')) = '.pdf' THEN 'pdf' WHEN lower(regexp_extract(url, '\.[^./]+$')) IN ('.md', '.markdown') THEN 'markdown' WHEN lower(regexp_extract(url, '\.[^./]+$')) = '.txt' THEN 'text' WHEN lower(regexp_extract(url, '\.[^./]+$')) = '.jsonl' THEN 'passages' END AS kind FROM pages""")
def extension_dispatch(t: Tables) -> DataFrame:
    """Row 2."""
    return t.pages.select("page_id", T.extension_kind(F.col("url")).alias("kind"))
