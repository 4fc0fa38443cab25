"""Queries over the turn log (events) and chats (conversations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import turnlog as L
from .registry import Tables, query


@query(r"""
WITH p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events), f AS (SELECT prev AS turn_id, arg_max(value, event_id) AS rating FROM p WHERE event_type = 'purchase' AND prev IS NOT NULL GROUP BY prev)
SELECT event_type, count(*) AS turns, count(rating) AS rated, round(avg(rating), 6) AS mean FROM events LEFT JOIN f ON turn_id = event_id GROUP BY event_type""")
def turn_feedback(t: Tables) -> DataFrame:
    """Row 129: each turn's last feedback; here a purchase rates the user's event before it."""
    prev = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    feedback = t.events.withColumn("turn_id", prev).filter("event_type = 'purchase' and turn_id is not null").select("turn_id", F.col("value").alias("rating"), "event_id")
    turns = t.events.withColumn("turn_id", F.col("event_id"))
    return L.with_feedback(turns, feedback, "event_id").groupBy("event_type").agg(F.count("*").alias("turns"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 6).alias("mean"))


@query("SELECT user_id, event_type AS stage, round(sum(value), 4) AS total, count(*) AS calls, round(max(value), 4) AS most FROM events GROUP BY ALL")
def stage_totals(t: Tables) -> DataFrame:
    """Rows 174, 175, 393: elapsed time and calls of each stage."""
    return t.events.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("calls"), F.round(F.max("value"), 4).alias("most"))


@query(r"""
SELECT event_type, count(*) FILTER (value > 20) AS checked, count(*) FILTER (value > 60) AS ungrounded, count(*) FILTER (value > 60 AND user_id % 2 = 0) AS ungrounded_failed, count(*) FILTER (value > 20 AND value <= 60 AND user_id % 2 = 0) AS grounded_failed FROM events GROUP BY event_type""")
def groundedness(t: Tables) -> DataFrame:
    """Row 161: checked, ungrounded, and each by failure."""
    v, failed = F.col("value"), F.col("user_id") % 2 == 0
    return t.events.groupBy("event_type").agg(F.count_if(v > 20).alias("checked"), F.count_if(v > 60).alias("ungrounded"), F.count_if((v > 60) & failed).alias("ungrounded_failed"), F.count_if((v > 20) & (v <= 60) & failed).alias("grounded_failed"))


@query(r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, (ts - INTERVAL 8 HOUR)::DATE ORDER BY ts, event_id) AS nth FROM events)
SELECT user_id, count(*) FILTER (nth <= 2) AS allowed, count(*) FILTER (nth > 2) AS refused FROM r GROUP BY user_id""")
def quota(t: Tables) -> DataFrame:
    """Row 410: a daily request quota."""
    return L.daily_quota(t.events, "user_id", "ts", "event_id", 2).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query(r"""
SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS load FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""")
def pacing(t: Tables) -> DataFrame:
    """Row 411: requests and load of the last minute."""
    return L.minute_load(t.events, "event_type", "ts", F.col("value")).select("event_id", "requests", F.round("load", 4).alias("load"))


@query(r"""
WITH n AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS start, epoch_us(ts) / 1e6::DOUBLE + value * 600 AS "end" FROM events),
c AS (SELECT a.user_id, a.event_id AS node, b.event_id AS parent, row_number() OVER (PARTITION BY a.event_id ORDER BY b."end" - b.start, b.event_id) AS nth FROM n a JOIN n b ON a.user_id = b.user_id AND b.start <= a.start AND b."end" >= a."end" AND a.event_id <> b.event_id)
SELECT user_id, node, parent FROM c WHERE nth = 1""")
def timeline_parents(t: Tables) -> DataFrame:
    """Rows 135, 204: the innermost open stage that contains each node."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    n = t.events.select("user_id", F.col("event_id").alias("node"), F.col("event_id").alias("span"), start.alias("start"), (start + F.col("value") * 600).alias("end"))
    return L.innermost(n.select("user_id", "node", "start", "end"), n.select("user_id", "span", "start", "end"), "user_id", 21_600.0)


@query(r"""
WITH s AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS events, min(event_id) AS first_event FROM g GROUP BY ALL""")
def sessions(t: Tables) -> DataFrame:
    """Stream-shaped: sessions after a day without events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = t.events.withColumn("fresh", F.when(gap.isNull() | (gap > 86_400_000_000), 1).otherwise(0)).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query(r"""
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type)::INT AS number FROM f""")
def passage_ledger(t: Tables) -> DataFrame:
    """Row 203: dense numbers by first sight."""
    return L.ledger(t.events, "user_id", "event_id", "event_type")


@query(r"""
WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value / 10) ORDER BY event_id) > 1 AS refused FROM events) SELECT event_id, refused FROM r""")
def refused_repeats(t: Tables) -> DataFrame:
    """Row 303: a call equal to an earlier one of the turn is refused."""
    calls = t.events.withColumn("query", F.floor(F.col("value") / 10))
    return L.repeats(calls, ["user_id", "event_type", "query"], "event_id").select("event_id", "refused")


@query(r"""
WITH a AS (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY event_id)),
b AS (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY event_id))
SELECT user_id, a.day::VARCHAR AS day, a.k::INT AS k, a.event_id AS "left", b.event_id AS "right" FROM a JOIN b USING (user_id, day, k) WHERE a.n = b.n""")
def positional_join(t: Tables) -> DataFrame:
    """Row 134: the k-th call with the k-th event of a step."""
    e = t.events.withColumn("day", F.to_date("ts").cast("string"))
    return L.paired_by_place(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id", "day"], "event_id", "event_id")


@query("WITH n AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25) SELECT * FROM n ORDER BY event_id")
def last_turns(t: Tables) -> DataFrame:
    """Row 216: the newest turns after a filter, oldest first."""
    return t.events.filter("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).orderBy("event_id").select("event_id", "user_id", "value")


@query(r"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations)
SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10) ORDER BY turn)) AS transcript FROM n WHERE nth <= 4 GROUP BY conv_id""")
def chat_transcript(t: Tables) -> DataFrame:
    """Rows 290, 402: the last turns as a transcript."""
    return L.transcript(t.conversations, "conv_id", "turn", 4).withColumn("transcript", F.md5("transcript"))


@query(r"""
WITH s AS (SELECT *, sum(length(text) // 4 + 3) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, count(*) AS kept, min(turn) AS oldest, max(used)::BIGINT AS used FROM s WHERE used <= 800 GROUP BY conv_id""")
def history_budget(t: Tables) -> DataFrame:
    """Rows 408, 409: token estimates, and the newest turns within a budget."""
    size = F.floor(F.length("text") / 4) + 3
    return L.history_within(t.conversations, "conv_id", "turn", size, 800).groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("oldest"), F.max("used").alias("used"))


@query(r"""
WITH f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS nth FROM conversations WHERE role = 'user')
SELECT conv_id, turn, nth = 1 AS kept FROM f""")
def repeated_questions(t: Tables) -> DataFrame:
    """Row 222: the first row of each text is kept, the others reported; the hash of the text
    and the first place are all that is shuffled."""
    users = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    first = users.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    return users.join(first, "h").select("conv_id", "turn", (F.struct("conv_id", "turn") == F.col("first")).alias("kept"))


@query(r"""
SELECT event_id, CASE WHEN try_cast(props AS JSON) IS NULL THEN 'unreadable' ELSE 'object' END AS kind, json_extract_string(props, '$.k') AS k FROM events""")
def json_props(t: Tables) -> DataFrame:
    """Row 78: JSON replies read as VARIANT; what does not parse is null."""
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.when(v.isNull(), "unreadable").otherwise("object").alias("kind"), F.try_variant_get(v, "$.k", "string").alias("k"))


@query(r"""
SELECT window_start::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, value FROM events) GROUP BY ALL""")
def windowed_counts(t: Tables) -> DataFrame:
    """Section 2.17: tumbling windows in batch, the same plan as the streaming job."""
    from ..streaming.turns import windowed

    out = windowed(t.events, "6 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(r"""
SELECT window_start::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, value FROM events) GROUP BY ALL""")
def streamed_counts(t: Tables) -> DataFrame:
    """Section 2.17: the same windows by Structured Streaming over the events as a stream."""
    from ..streaming.turns import run_windowed

    out = run_windowed(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema, "6 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(r"""
WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id, count(*) AS turns, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY user_id""")
def streamed_totals(t: Tables) -> DataFrame:
    """Section 2.17: running totals by user, upserted batch by batch."""
    from ..streaming.turns import run_totals

    out = run_totals(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    return out.select("user_id", "turns", F.round("total", 4).alias("total"), F.round("most", 4).alias("most"))
