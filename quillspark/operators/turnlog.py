"""Analytics over an append-only turn log: feedback, timelines, quotas, ledgers, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window as W


def with_feedback(turns: DataFrame, feedback: DataFrame, order: str) -> DataFrame:
    """Each turn with its last feedback (turn_id, rating, order); feedback on unknown turns is
    dropped. The last one is an aggregate, so a turn with much feedback is no window."""
    last = feedback.groupBy("turn_id").agg(F.max_by("rating", order).alias("rating"))
    return turns.join(last, "turn_id", "left")


def innermost(nodes: DataFrame, spans: DataFrame, by: str, width: float) -> DataFrame:
    """node, parent: the shortest span (span, start, end) of the same `by` that holds a node's
    interval; of equally short ones the smallest. Spans fall into levels by their length, from
    `width` on each twice as wide as the one before, and a level's cells are as wide as its longest
    span: so a span lies in two cells at most, whatever its length, and a node looks into one cell
    of each level that its `by` has. Spans that end before they start hold nothing."""
    long = F.col("end") - F.col("start")
    level = F.greatest(F.ceil(F.log2(F.greatest(long, F.lit(width)) / width)), F.lit(0)).cast("int")
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(F.col(c) / size)
    dealt = spans.filter(long >= 0).withColumn("level", level).withColumn("cell", F.explode(F.array_distinct(F.array(at("start"), at("end")))))
    held = dealt.select(by, "level", "cell", F.col("span").alias("parent"), F.col("start").alias("s"), F.col("end").alias("e"))
    asked = nodes.join(dealt.select(by, "level").distinct(), by).withColumn("cell", at("start"))
    met = asked.join(held, [by, "level", "cell"])
    inside = (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & (F.col("parent") != F.col("node"))
    return met.filter(inside).groupBy(by, "node").agg(F.min_by("parent", F.struct(F.col("e") - F.col("s"), "parent")).alias("parent"))


def daily_quota(requests: DataFrame, key: str, ts: str, id: str, limit: int, zone: str = "America/Los_Angeles") -> DataFrame:
    """Requests with `allowed`: the first `limit` of each key and day; days start at midnight in
    the zone, times are UTC."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    nth = F.row_number().over(W.partitionBy(key, day).orderBy(ts, id))
    return requests.withColumn("allowed", nth <= limit)


# Stages by what their events time.
RETRIEVAL = ("route", "expand", "embed", "vector_search", "sparse_search", "web_search", "fusion", "rerank", "select")
TOOLS = ("search", "search_refused", "list_documents", "read_document", "calculate")
MODEL = ("agent_step", "agent_answer")


def laid_out(events: list | None, chats: list | None) -> list[float]:
    """When each event (stage, elapsed) of a turn ended, in ms, for turns that didn't keep it.
    Retrieval stages wait for the next other event: a tool's event starts with the first of them,
    a model's event ends with its call (started, elapsed), and the rest follow end to end."""
    ends, clock, calls = [], 0.0, iter(chats or [])
    waiting = 0  # retrieval events at the end of `ends`, laid from the clock on
    for event in events or []:
        elapsed = event["elapsed"] or 0.0
        laid = ends[-1] if waiting else clock
        if event["stage"] in RETRIEVAL:
            ends.append(laid + elapsed)
            waiting += 1
            continue
        call = next(calls, None) if event["stage"] in MODEL else None
        if event["stage"] in TOOLS:
            clock = max(clock + elapsed, laid)
        else:
            clock = laid + elapsed if call is None else max(call["started"] + call["elapsed"], laid + elapsed)
        ends.append(clock)
        waiting = 0
    return ends


reconstructed_ends = F.udf(laid_out, ArrayType(DoubleType()), useArrow=True)


def minute_load(requests: DataFrame, key: str, ts: str, size: Column) -> DataFrame:
    """Requests with the count and total size of the 60 s before them, themselves included."""
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    recent = W.partitionBy(key).orderBy(second).rangeBetween(-60_000_000, 0)
    return requests.withColumns({"requests": F.count("*").over(recent), "load": F.sum(size).over(recent)})


def history_within(turns: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """The newest turns whose running size stays within a budget."""
    newest = W.partitionBy(by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(size).over(newest)).filter(F.col("used") <= budget)


def transcript(turns: DataFrame, by: str, order: str, last: int) -> DataFrame:
    """The last turns of each conversation as one text."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    rows = turns.withColumn("nth", nth).filter(F.col("nth") <= last)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def ledger(hits: DataFrame, by: str, seq: str, item: str) -> DataFrame:
    """by, item, number: passages numbered by first sight, across searches."""
    first = hits.groupBy(by, item).agg(F.min(seq).alias("first"))
    return first.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy("first", item))).drop("first")


def repeats(calls: DataFrame, by: list[str], order: str) -> DataFrame:
    """Calls with `refused`: a repeat of an earlier equal one."""
    return calls.withColumn("refused", F.row_number().over(W.partitionBy(*by).orderBy(order)) > 1)


def paired_by_place(a: DataFrame, b: DataFrame, step: list[str], a_id: str, b_id: str) -> DataFrame:
    """The k-th row of a with the k-th of b within a step, only where a step has as many of each."""
    def numbered(df: DataFrame, id: str, name: str) -> DataFrame:
        w = W.partitionBy(*step)
        return df.select(*step, F.col(id).alias(name), F.row_number().over(w.orderBy(id)).alias("k"), F.count("*").over(w).alias(f"{name}_n"))

    both = numbered(a, a_id, "left").join(numbered(b, b_id, "right"), [*step, "k"])
    return both.filter(F.col("left_n") == F.col("right_n")).select(*step, "k", "left", "right")
