"""Queries over judgments, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S
from ..functions.text import fold, leak_figures
from ..operators import judging as J
from ..operators import order as O
from .registry import Tables, query

_FOLD = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_IN = f"contains({_FOLD.format('d.text')}, {_FOLD.format('b.text')})"


def _texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", fold(F.col("text")).alias("body"))


def _quotes(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", fold(F.col("text")).alias("quote"))


@query(f"SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE {_IN})")
def missing_evidence(t: Tables) -> DataFrame:
    """Rows 119, 121, 421: quotes that no document holds."""
    return J.without(_quotes(t), J.containment(_texts(t), _quotes(t)), "item_id").select("item_id")


@query(f"""
WITH w AS (SELECT item_id, string_split({_FOLD.format('text')}, ' ') AS w FROM benchmark), q AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS quote FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, {_FOLD.format('text')} AS body FROM documents)
SELECT quote, count(*) AS documents, min(doc_id) AS first_document FROM q JOIN d ON contains(body, quote) GROUP BY quote""")
def quote_search(t: Tables) -> DataFrame:
    """Rows 119-128, 262: every run of three words of the items, looked for in every text at once."""
    words = F.split("quote", " ")
    runs = F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " ")))
    asked = _quotes(t).select(F.explode(runs).alias("quote")).distinct()
    found = J.containment(_texts(t).select("doc_id", "body"), asked)
    return found.groupBy("quote").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))


@query(f"SELECT item_id, count(*) FILTER (lang = 'en') AS eligible, count(*) FILTER (lang <> 'en') AS blanked FROM benchmark b JOIN documents d ON {_IN} GROUP BY item_id")
def eligible_evidence(t: Tables) -> DataFrame:
    """Rows 109, 120: in document mode only eligible texts count."""
    found = J.containment(_texts(t), _quotes(t))
    return found.groupBy("item_id").agg(F.count_if(F.col("lang") == "en").alias("eligible"), F.count_if(F.col("lang") != "en").alias("blanked"))


@query(f"""
WITH f AS (SELECT item_id, d.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY d.doc_id) AS nth FROM benchmark b JOIN documents d ON {_IN})
SELECT doc_id, count(*) AS spans, min(item_id) AS first_span FROM f WHERE nth = 1 GROUP BY doc_id""")
def gold_chunks(t: Tables) -> DataFrame:
    """Rows 122, 124: the first text that holds each span, each text once."""
    gold = J.containment(_texts(t), _quotes(t)).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return gold.groupBy("doc_id").agg(F.count("*").alias("spans"), F.min("item_id").alias("first_span"))


@query(f"""
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, {_FOLD.format('line')} AS unit FROM u),
q AS (SELECT item_id, {_FOLD.format('text')} AS quote FROM benchmark)
SELECT item_id, count(DISTINCT doc_id) AS documents FROM q JOIN n ON contains(unit, substr(quote, 1, 40)) OR contains(unit, right(quote, 40)) WHERE length(quote) >= 40 GROUP BY item_id""")
def partial_overlap(t: Tables) -> DataFrame:
    """Rows 239, 414, 415: paragraphs that hold the first or last 40 characters of a quote."""
    ends = _quotes(t).filter(F.length("quote") >= 40).select("item_id", F.explode(F.array_distinct(F.array(F.substring("quote", 1, 40), F.expr("right(quote, 40)")))).alias("quote"))
    units = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", fold(F.col("line")).alias("body")).filter(F.length("body") >= 40)
    return J.containment(units, ends).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


@query(f"""
WITH q AS (SELECT item_id, {_FOLD.format('text')} AS quote FROM benchmark), w AS (SELECT item_id, string_split(quote, ' ') AS w FROM q),
r AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM w WHERE len(w) >= 8)
SELECT item_id, count(DISTINCT d.doc_id) AS documents FROM r JOIN documents d ON contains({_FOLD.format('d.text')}, r.run) GROUP BY item_id""")
def copied_words(t: Tables) -> DataFrame:
    """Row 425: documents that hold any run of eight words of an item."""
    w = F.split("quote", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.array_join(F.slice(w, i, F.lit(8)), " "))
    r = _quotes(t).filter(F.size(w) >= 8).select("item_id", F.explode(runs).alias("quote")).distinct()
    return J.containment(_texts(t), r).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


@query(f"""
WITH d AS (SELECT doc_id, source, {_FOLD.format('text')} AS body FROM documents), q AS (SELECT item_id, {_FOLD.format('text')} AS quote FROM benchmark),
x AS (SELECT item_id, source, min(doc_id) AS doc_id FROM q JOIN d ON contains(body, quote) GROUP BY ALL)
SELECT item_id, count(*) AS sources, count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3')) AS leaked FROM x GROUP BY item_id""")
def leakage_index(t: Tables) -> DataFrame:
    """Rows 127, 128: quotes by the sources that hold them, and which of those are held out."""
    where = J.containment(_texts(t), _quotes(t)).select("item_id", "source").distinct()
    return where.groupBy("item_id").agg(F.count("*").alias("sources"), F.count_if(F.col("source").isin("src0", "src1", "src2", "src3")).alias("leaked"))


@query(r"""
WITH n AS (SELECT l_orderkey AS id, list((l_quantity::INT + l_linenumber) % 4 ORDER BY l_linenumber, l_quantity) AS gains FROM lineitem GROUP BY 1), g AS (SELECT *, list_reverse_sort(list_concat([3], list_filter(gains, lambda x: x > 0))) AS ideal FROM n),
e AS (SELECT *, list_sum(list_transform(gains, lambda x, i: (pow(2.0::DOUBLE, x) - 1) / log2(i + 1))) AS d, list_sum(list_transform(ideal, lambda x, i: (pow(2.0::DOUBLE, x) - 1) / log2(i + 1))) AS best FROM g)
SELECT id, (list_max(gains) > 0)::INT::DOUBLE AS hit, round(len(list_filter(gains, lambda x: x > 0))::DOUBLE / len(gains), 6) AS precision,
       round(coalesce(1.0::DOUBLE / list_position(list_transform(gains, lambda x: x > 0), true), 0), 6) AS rr, round(d, 6) AS dcg, round(d / best, 6) AS ndcg, round(len(list_filter(gains, lambda x: x > 0))::DOUBLE / len(ideal), 6) AS recall FROM e""")
def graded_metrics(t: Tables) -> DataFrame:
    """Rows 147-152, 306, 377, 396: an order's lines as a ranking, with one more relevant item."""
    line = F.struct("l_linenumber", "l_quantity", ((F.col("l_quantity").cast("int") + F.col("l_linenumber")) % 4).alias("gain"))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["gain"]).alias("gains"))
    g = g.withColumn("ideal", F.sort_array(F.concat(F.array(F.lit(3)), F.filter("gains", lambda x: x > 0)), asc=False))
    gains, ideal = F.col("gains"), F.col("ideal")
    r = lambda c: F.round(c, 6)
    found = F.size(F.filter(gains, lambda x: x > 0))
    return g.select("id", J.hit_rate(gains).alias("hit"), r(J.precision(gains)).alias("precision"), r(J.reciprocal_rank(gains)).alias("rr"), r(J.dcg(gains)).alias("dcg"), r(J.ndcg(gains, ideal)).alias("ndcg"), r(J.recall(found, F.size(ideal))).alias("recall"))


@query(r"""
WITH r AS (SELECT d.source AS query_id, d.doc_id AS document, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, d.doc_id::VARCHAR DESC) AS rank FROM documents d),
g AS (SELECT DISTINCT source AS query_id, d.doc_id AS document, greatest(0, quality + 1 - toxic) AS grade FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
j AS (SELECT r.query_id, rank, coalesce(grade, 0) AS grade FROM r LEFT JOIN g USING (query_id, document)),
x AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 20 AND grade > 0) AS found FROM j GROUP BY 1),
i AS (SELECT query_id, sum(CASE WHEN n <= 10 THEN grade / log2(n + 1) ELSE 0 END) AS best, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g WHERE grade > 0) GROUP BY 1)
SELECT query_id, round(dcg / best, 6) AS ndcg, round(found::DOUBLE / relevant, 6) AS recall FROM x JOIN i USING (query_id)""")
def qrels_metrics(t: Tables) -> DataFrame:
    """Rows 118, 155-157, 188, 307, 389: linear nDCG@10 and recall@20 of documents ranked by
    length, with grades from labels."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), F.desc(F.col("doc_id").cast("string"))))
    ranking = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("document"), rank.alias("rank"))
    grade = F.greatest(F.lit(0), F.col("quality") + 1 - F.col("toxic"))
    grades = t.documents.select("doc_id", F.col("source").alias("query_id")).join(t.labels, "doc_id").select("query_id", F.col("doc_id").alias("document"), grade.alias("grade")).distinct()
    out = J.score_rankings(ranking.select("query_id").distinct(), ranking, grades, 10, 20)
    return out.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@query(r"""
WITH h AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INT AS rank, (l_suppkey % 3)::INT AS span FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, span ORDER BY rank) = 1 AS first FROM h)
SELECT query_id, rank, CASE WHEN first THEN 1 + span ELSE 0 END AS gain, CASE WHEN first THEN span END AS span FROM f""")
def gains_once(t: Tables) -> DataFrame:
    """Row 190: each chunk earns the best span that none before it has; lines hold the span of
    their supplier."""
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    span = (F.col("l_suppkey") % 3).cast("int")
    rows = t.lineitem.select(F.col("l_orderkey").alias("query_id"), nth.alias("rank"), F.array(F.struct((1 + span).alias("grade"), span.alias("span"))).alias("spans"))
    return J.credit_once(rows).select("query_id", "rank", "gain", "span")


@query(f"""
WITH f AS (SELECT d.source AS query_id, item_id AS span, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS pos, d.doc_id FROM benchmark b JOIN documents d ON {_IN}),
r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
h AS (SELECT f.query_id, span, min(rank) AS rank FROM f JOIN r USING (query_id, doc_id) GROUP BY ALL),
e AS (SELECT DISTINCT query_id FROM h)
SELECT e.query_id, k.depth, round(count(*) FILTER (h.rank <= k.depth)::DOUBLE / 5, 6) AS recall FROM e JOIN h USING (query_id), (VALUES (1), (3), (5), (10), (20)) k(depth) GROUP BY ALL""")
def recall_prefixes(t: Tables) -> DataFrame:
    """Rows 148, 191: recall at the prefixes 1, 3, 5, 10, 20 of each source's documents."""
    rank = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    texts = _texts(t).withColumn("rank", rank)
    hits = J.containment(texts, _quotes(t)).select(F.col("source").alias("query_id"), "rank", F.col("item_id").alias("span"))
    expected = hits.select("query_id").distinct().withColumn("expected", F.lit(5))
    return J.recall_at(hits, [1, 3, 5, 10, 20], expected).select("query_id", "depth", F.round("recall", 6).alias("recall"))


@query(r"""
WITH p AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS s FROM documents JOIN labels USING (doc_id) GROUP BY lang),
w AS (SELECT *, s::DOUBLE / n AS p, 1.959964::DOUBLE AS z FROM p)
SELECT lang, n, s AS passed, round(p, 6) AS rate, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS low,
       round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS high FROM w""")
def wilson_rates(t: Tables) -> DataFrame:
    """Rows 154, 160, 375, 391: rates with score intervals."""
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))
    low, high = S.wilson(F.col("passed"), F.col("n"))
    return rows.select("lang", "n", "passed", F.round(F.col("passed") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(r"""
WITH m AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (toxic = 1 AND quality = 0) AS false_pass, count(*) FILTER (toxic = 0 AND quality = 1) AS false_fail, doc_id % 2 AS category FROM labels GROUP BY doc_id % 2)
SELECT category, n, agree, false_pass, false_fail, round(agree::DOUBLE / n, 6) AS agreement FROM m""")
def confusion(t: Tables) -> DataFrame:
    """Rows 166, 167, 374: a judge against human labels, by category."""
    human, judge = F.col("quality"), F.col("toxic")
    m = t.labels.groupBy((F.col("doc_id") % 2).alias("category")).agg(F.count("*").alias("n"), F.count_if(human == judge).alias("agree"), F.count_if((judge == 1) & (human == 0)).alias("false_pass"), F.count_if((judge == 0) & (human == 1)).alias("false_fail"))
    return m.withColumn("agreement", F.round(F.col("agree") / F.col("n"), 6))


_PAIRS = r"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS nth FROM events),
p AS (SELECT a.user_id, a.nth, (a.value > 50)::INT AS base, (b.value > 50)::INT AS cand FROM e a JOIN e b ON a.user_id = b.user_id AND a.nth = b.nth AND a.event_id % 2 = 0 AND b.event_id % 2 = 1),
"""


def _pairs(t: Tables) -> DataFrame:
    side = F.col("event_id") % 2
    e = t.events.withColumn("nth", F.row_number().over(W.partitionBy("user_id", side).orderBy("event_id")).cast("long")).withColumn("hit", (F.col("value") > 50).cast("int"))
    base = e.filter(side == 0).select("user_id", "nth", F.col("hit").alias("base"))
    return base.join(e.filter(side == 1).select("user_id", "nth", F.col("hit").alias("cand")), ["user_id", "nth"])


@query(_PAIRS + r"""
d AS (SELECT count(*) AS n, avg(cand - base) AS mean, stddev_samp(cand - base) AS sd, count(*) FILTER (cand > base) AS wins, count(*) FILTER (cand < base) AS losses FROM p),
g AS (SELECT count(*) AS groups, sum(v * v) AS squares FROM (SELECT user_id, sum(cand - base - (SELECT mean FROM d)) AS v FROM p GROUP BY user_id))
SELECT n, round(mean, 6) AS mean_diff, round(mean - 1.959964::DOUBLE * sd / sqrt(n), 6) AS ci_low, round(mean + 1.959964::DOUBLE * sd / sqrt(n), 6) AS ci_high, wins, losses,
       round(1.959964::DOUBLE * sqrt(groups / (groups - 1.0::DOUBLE) * squares / (n * n)), 6) AS grouped_half FROM d, g""")
def paired_difference(t: Tables) -> DataFrame:
    """Rows 130, 131, 169, 170, 172, 376, 390, 435: paired and cluster-robust differences."""
    from ..operators.evaluation import paired

    out = paired(_pairs(t), "base", "cand", "user_id")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("n", r("mean_diff"), r("ci_low"), r("ci_high"), "wins", "losses", r("grouped_half"))


@query(r"""
WITH RECURSIVE k AS (SELECT event_type, count(*) FILTER (value > 60) AS w, count(*) FILTER (value <= 20) AS l FROM events GROUP BY 1),
s AS (SELECT event_type, w, l, least(w, l) AS k, w + l AS n, 0 AS i, -(w + l) * ln(2.0::DOUBLE) AS term, exp(-(w + l) * ln(2.0::DOUBLE)) AS total FROM k
  UNION ALL SELECT event_type, w, l, k, n, i + 1, term + ln(n - i) - ln(i + 1), total + exp(term + ln(n - i) - ln(i + 1)) FROM s WHERE i < k)
SELECT event_type, w AS wins, l AS losses, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * total) END, 6) AS p FROM s WHERE i = k""")
def sign_test(t: Tables) -> DataFrame:
    """Row 171: the exact two-sided sign test."""
    return _signs(t.events)


def _signs(events: DataFrame) -> DataFrame:
    k = events.groupBy("event_type").agg(F.count_if(F.col("value") > 60).alias("wins"), F.count_if(F.col("value") <= 20).alias("losses"))
    return k.withColumn("p", F.round(S.sign_test(F.col("wins"), F.col("losses")), 6))


@query(_PAIRS + r"""
o AS (SELECT user_id, nth, CASE WHEN base = 1 AND cand = 1 THEN 'both pass' WHEN base = 0 AND cand = 0 THEN 'both fail' WHEN cand > base THEN 'win' ELSE 'loss' END AS outcome FROM p)
SELECT user_id, nth, outcome, row_number() OVER (ORDER BY CASE outcome WHEN 'loss' THEN 0 ELSE 1 END, user_id, nth) AS place FROM o WHERE outcome IN ('win', 'loss')""")
def flips(t: Tables) -> DataFrame:
    """Rows 309, 310: outcome classes and flip rows, losses first."""
    both = F.col("base") + F.col("cand")
    outcome = F.when(both == 2, "both pass").when(both == 0, "both fail").when(F.col("cand") > F.col("base"), "win").otherwise("loss")
    rows = _pairs(t).select("user_id", "nth", outcome.alias("outcome")).filter(F.col("outcome").isin("win", "loss"))
    return O.placed(rows, F.when(F.col("outcome") == "loss", 0).otherwise(1), "user_id", "nth", name="at").withColumn("place", F.col("at") + 1).drop("at")


@query(r"""
WITH r AS (SELECT event_type AS variant, user_id % 5 AS repeat, avg((value > 50)::INT) AS rate FROM events GROUP BY ALL)
SELECT variant, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd, round(max(rate) - min(rate), 6) AS spread,
       CASE WHEN max(rate) - min(rate) > 0.05 AND avg(rate) > 0.5 THEN 'improved' WHEN max(rate) - min(rate) > 0.05 THEN 'worse' ELSE 'not shown' END AS reading FROM r GROUP BY variant""")
def repeat_spread(t: Tables) -> DataFrame:
    """Rows 173, 322: mean, deviation and range across repeats, and a reading of it."""
    r = t.events.groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 5).alias("repeat")).agg(F.avg((F.col("value") > 50).cast("int")).alias("rate"))
    out = r.groupBy("variant").agg(F.avg("rate").alias("m"), F.round(F.stddev_samp("rate"), 6).alias("sd"), (F.max("rate") - F.min("rate")).alias("s"))
    reading = F.when((F.col("s") > 0.05) & (F.col("m") > 0.5), "improved").when(F.col("s") > 0.05, "worse").otherwise("not shown")
    return out.select("variant", F.round("m", 6).alias("mean"), "sd", F.round("s", 6).alias("spread"), reading.alias("reading"))


@query(r"""
WITH s AS (SELECT l_orderkey, count(*) AS parts, count(*) FILTER (l_discount > 0.03) AS passed, any_value(o_orderpriority) AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, count(*) FILTER (passed = parts) AS complete, round(avg(passed::DOUBLE / parts), 6) AS completeness, round(sum(passed)::DOUBLE / sum(parts), 6) AS evidence FROM s GROUP BY GROUPING SETS ((kind), ())""")
def multi_part(t: Tables) -> DataFrame:
    """Rows 158, 163, 164, 317, 368-371: parts to samples to kinds, with the total."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.count_if(F.col("l_discount") > 0.03).alias("passed"))
    s = s.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("kind")), "l_orderkey")
    out = s.rollup("kind").agg(F.count("*").alias("n"), F.count_if(F.col("passed") == F.col("parts")).alias("complete"), F.round(F.avg(F.col("passed") / F.col("parts")), 6).alias("completeness"), F.round(F.sum("passed") / F.sum("parts"), 6).alias("evidence"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(r"""
WITH c AS (SELECT user_id % 4 AS attack, event_type AS carrier, value > 70 AS success, value > 30 AS attempt, value > 90 AS harm FROM events)
SELECT attack, carrier, count(*) AS n, round(avg(success::INT), 6) AS success, round(avg(attempt::INT), 6) AS attempt, round(avg(harm::INT), 6) AS harm FROM c GROUP BY GROUPING SETS ((attack), (attack, carrier), ())""")
def injection_summary(t: Tables) -> DataFrame:
    """Rows 168, 315, 378: rates by attack, by attack and carrier, and over all."""
    rate = lambda limit, name: F.round(F.avg((F.col("value") > limit).cast("int")), 6).alias(name)
    c = t.events.withColumns({"attack": F.col("user_id") % 4, "carrier": F.col("event_type")})
    return c.groupingSets([["attack"], ["attack", "carrier"], []], "attack", "carrier").agg(F.count("*").alias("n"), rate(70, "success"), rate(30, "attempt"), rate(90, "harm"))


@query(r"""
SELECT role, count(*) AS n, count(*) FILTER (turn % 3 = 0) AS passed, count(*) FILTER (turn % 3 = 1) AS failed, count(*) FILTER (turn % 3 = 2) AS unparseable, round(quantile_cont(length(text), 0.5), 6) AS p50,
       round(avg(CASE WHEN turn % 3 < 2 THEN length(text) END), 6) AS known_mean FROM conversations GROUP BY role""")
def answer_summary(t: Tables) -> DataFrame:
    """Rows 153, 159, 162: verdict counts, median and the mean of known values."""
    turn = F.col("turn") % 3
    rows = t.conversations.select("role", "turn", F.length("text").alias("size"))
    known = F.round(F.avg(F.when(turn < 2, F.col("size"))), 6).alias("known_mean")
    counts = rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(turn == 0).alias("passed"), F.count_if(turn == 1).alias("failed"), F.count_if(turn == 2).alias("unparseable"), known)
    median = O.quantiles(rows, ["role"], "size", {"p50": (F.col("n") + 1) / 2}).withColumnRenamed("role", "of")
    return counts.join(median, F.col("role").eqNullSafe(F.col("of")), "left").drop("of").withColumn("p50", F.round("p50", 6))


@query(r"""
WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1), p AS (SELECT *, len(v) AS n, greatest(1, least(len(v) - 1, 19 * (len(v) + 1) // 20)) AS j FROM l)
SELECT event_type, round(quantile_cont(x, 0.5), 6) AS p50, round(any_value(v[j] * (1 - (19.0::DOUBLE * (n + 1) / 20 - j)) + v[j + 1] * (19.0::DOUBLE * (n + 1) / 20 - j)), 6) AS p95
FROM (SELECT p.*, unnest(v) AS x FROM p) GROUP BY event_type""")
def latency(t: Tables) -> DataFrame:
    """Row 146: median, and p95 by the exclusive method from two order statistics."""
    found = O.quantiles(t.events, ["event_type"], "value", {"p50": (F.col("n") + 1) / 2, "p95": 19 * (F.col("n") + 1) / 20})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(r"""
SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[*&%$#]{3}') THEN 'noise' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents
WHERE text IS NULL OR n_chars < 200 OR regexp_matches(text, '[*&%$#]{3}') OR lang <> 'en'""")
def reject_reasons(t: Tables) -> DataFrame:
    """Row 423: ordered reasons, the first one counts."""
    from ..operators.evaluation import first_reason

    text = F.col("text")
    reason = first_reason({"missing": text.isNull(), "short": F.col("n_chars") < 200, "noise": text.rlike(r"[*&%$#]{3}"), "language": F.col("lang") != "en"})
    return t.documents.select("doc_id", reason.alias("reason")).filter("reason is not null")


@query(r"""
WITH f AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '\d{4,}')) AS figure FROM documents), u AS (SELECT DISTINCT * FROM f)
SELECT a.doc_id, count(DISTINCT b.doc_id) AS others FROM u a JOIN u b ON a.figure = b.figure AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
def restated_figures(t: Tables) -> DataFrame:
    """Rows 125, 126: other documents with the same figure, by sets of shared figures."""
    u = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d{4,}"), F.lit(0)))).alias("figure"))
    return J.sharing(u, "doc_id", "figure")
