"""Queries over events as a turn log that is read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..streaming import log as S
from .registry import Tables, query

_DAY = 86_400_000_000


def _turns(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    none = F.lit(None)
    return t.events.select(F.lit("turn").alias("kind"), F.col("event_id").alias("id"), none.cast("long").alias("turn_id"), F.col("user_id").cast("string").alias("key"), at.alias("at"), none.cast("double").alias("rating"), at.alias("written"))


def _feedback(t: Tables) -> DataFrame:
    """A purchase rates the user's event before it. Every third line comes a day late, every fifth
    twice, and every seventh also names a turn that there isn't."""
    e = t.events.withColumn("turn", F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id")))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    given = e.filter("event_type = 'purchase' and turn is not null").select("event_id", "turn", "value", at.alias("at"))
    late = F.when(F.col("event_id") % 3 == 0, _DAY).otherwise(0)
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.col("turn"), F.col("turn"))).otherwise(F.array(F.col("turn")))
    unknown = F.when(F.col("event_id") % 7 == 0, F.array(-F.col("event_id"))).otherwise(F.array().cast("array<bigint>"))
    rows = given.select("*", F.explode(F.concat(copies, unknown)).alias("of"), late.alias("late"))
    return rows.select(F.lit("feedback").alias("kind"), F.col("event_id").alias("id"), F.col("of").alias("turn_id"), F.lit(None).cast("string").alias("key"), "at", F.col("value").alias("rating"), (F.col("at") + F.col("late")).alias("written"))


#: Files of a log at most. A batch goes over all that waits for feedback, which grows with the log, so
#: that the number of batches must not.
_MOST_FILES = 16


def _cut(n: int) -> tuple[int, int]:
    """Files of a log of n turns, and parts of each. A file holds a million turns or so, more in long
    logs, and the log has a few files at least; a part holds 100,000 or more."""
    files = min(max(4, n // 1_000_000), _MOST_FILES)
    return files, min(max(1, n // files // 100_000), 16)


def _closing(rows: DataFrame) -> DataFrame:
    """A line of each kind a month later, after which nothing waits for feedback any more."""
    end = rows.agg(F.max("at").alias("at")).withColumn("at", F.col("at") + 30 * _DAY)
    last = F.explode(F.array(F.lit("turn"), F.lit("feedback"))).alias("kind")
    return end.select(last, F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("turn_id"), F.lit(None).cast("string").alias("key"), "at", F.lit(None).cast("double").alias("rating"))


@query("""
WITH p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events), f AS (SELECT turn, event_id, value, ts FROM p WHERE event_type = 'purchase' AND turn IS NOT NULL)
SELECT e.event_id AS turn_id, arg_max(f.value, (f.ts, f.event_id)) AS rating FROM events e LEFT JOIN f ON f.turn = e.event_id AND f.ts BETWEEN e.ts AND e.ts + INTERVAL 2 DAYS GROUP BY 1""")
def streamed_ratings(t: Tables) -> DataFrame:
    """Rows s1, s2 of section 2.17: a stream-stream left outer join of turns and the feedback of the
    two days after them, with late, repeated and unknown feedback."""
    folder = S.fresh_root(t.spark, "log")
    files, parts = _cut(t.events.count())
    S.write_log(_turns(t).unionByName(_feedback(t)), folder, "written", files, _closing, parts)
    return S.run_rated(t.spark, folder, "2 DAYS", "2 days", files=parts).filter("turn_id >= 0")


@query(r"""
WITH r AS (SELECT *, ts - INTERVAL 8 HOUR AS there FROM events)
SELECT event_id, there::DATE::VARCHAR AS day, (row_number() OVER (PARTITION BY user_id, there::DATE ORDER BY ts, event_id))::INT AS used, row_number() OVER (PARTITION BY user_id, there::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM r""")
def streamed_budget(t: Tables) -> DataFrame:
    """Row s4 of section 2.17: a daily budget by keyed state with a timer at midnight, over several
    batches; the rows of `quota`, request by request."""
    folder = S.fresh_root(t.spark, "log")
    files, parts = _cut(t.events.count())
    S.write_log(_turns(t), folder, "written", files, parts=parts)
    out = S.run_budgeted(t.spark, folder, 2, "America/Los_Angeles", "1 day", files=parts)
    return out.select(F.col("id").alias("event_id"), "day", "used", "allowed")


@query("SELECT event_id::VARCHAR AS turn_id, 'q' || user_id AS query, event_type AS stage, round(value, 6) AS elapsed, 2::INT AS attempt, CASE WHEN value > 50 THEN 'good' ELSE 'weak' END AS outcome FROM events")
def recorded_turns(t: Tables) -> DataFrame:
    """Rows 28, 34, 399 and TurnSink of section 2.18: turns with nested attempts and stages, streamed
    into a sink that commits whole batches, and read back as spans."""
    from ..sources import loaders

    t.spark.dataSource.register(loaders.TurnSink)
    folder, state = S.fresh_root(t.spark, "turns"), S.fresh_root(t.spark, "state")
    outcome = F.when(F.col("value") > 50, "good").otherwise("weak")
    attempt = lambda nth, outcome: F.struct(F.lit(nth).alias("nth"), F.lit("q").alias("query"), F.array().cast("array<string>").alias("passages"), outcome.alias("outcome"))
    none = F.array().cast("array<struct<tool:string,arguments:string,status:string>>")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet").select(
        F.col("event_id").cast("string").alias("turn_id"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"), F.lit("answered").alias("outcome"),
        F.lit(None).cast("string").alias("answer"), F.array(attempt(1, F.lit("weak")), attempt(2, outcome)).alias("attempts"), F.array(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"), F.lit(2).alias("attempt"))).alias("events"),
        none.alias("calls"), F.struct(F.lit(1).alias("requests"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens")).alias("usage"),
    )
    stream.writeStream.format("turns").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    spans = loaders.read_turns(t.spark, folder).select("turn_id", "query", "attempts", F.inline("events"))
    return spans.select("turn_id", "query", "stage", F.round("elapsed", 6).alias("elapsed"), "attempt", F.element_at("attempts", F.col("attempt"))["outcome"].alias("outcome"))
