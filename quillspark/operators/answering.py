"""Answers to the turns of many conversations at once, step by step.

A turn goes through condensing, retrieval, grading, rewriting, generation, a check against its
passages and, where that fails, generation anew. Each step is asked only for the turns that need it (a
frontier that shrinks), and is written before the next one starts, so no model is called twice
for the same prompt because an executor was lost. Attempts and regenerations are bounded.

What fails is a row: a failed condensing leaves the question as it is, a failed or unreadable grade keeps
its passage, a failed rewriting ends the attempts, a failed generation is the turn's outcome with its
message, and a failed or unreadable check passes.

Outcomes: answered; ungrounded (the last answer still went beyond its passages); nothing_found and
graded_out (no attempt left a passage, and none or some had found any); failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_word, strip, strip_citations
from .generation import Generator, generated, stub_generate
from .storage import saved

#: query_id, text -> query_id, id, text, rank.
Retrieve = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Steps:
    """The generator of each step, and how often a turn may try again."""

    condense: Generator = stub_generate
    grade: Generator = stub_generate
    rewrite: Generator = stub_generate
    generate: Generator = stub_generate
    check: Generator = stub_generate
    attempts: int = 2
    regenerations: int = 1


AGAIN = "\nThe last answer went beyond the passages."


def passages_text(kept: Column) -> Column:
    """Numbered passages of array<struct<rank, id, text>>."""
    return F.array_join(F.transform(kept, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["text"], F.lit("")))), "\n")


def usable(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def standalone(turns: DataFrame, condense: Generator) -> DataFrame:
    """turn_id, query: a question with a history is condensed; markers of citations stay out of it."""
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), strip_citations(F.coalesce(m["text"], F.lit(""))))
    prompt = F.concat(F.lit("Conversation:\n"), F.array_join(F.transform("history", line), "\n"), F.lit("\nFollow-up: "), F.col("question"))
    told = F.size(F.coalesce("history", F.array().cast(turns.schema["history"].dataType))) > 0
    first = turns.filter(~told).select("turn_id", F.col("question").alias("query"))
    later = generated(turns.filter(told), prompt, "reply", condense)
    return first.unionByName(later.select("turn_id", F.coalesce(usable(F.col("reply")), F.col("question")).alias("query")))


def graded_hits(asked: DataFrame, retrieve: Retrieve, grade: Generator) -> DataFrame:
    """turn_id, query, found (how many passages), kept (those not graded NO, in order)."""
    hits = saved(retrieve(asked.select(F.col("turn_id").alias("query_id"), F.col("query").alias("text"))), "turn-hits")
    rows = hits.select(F.col("query_id").alias("turn_id"), "rank", "id", "text").join(asked.select("turn_id", "query"), "turn_id")
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\nPassage: "), F.coalesce("text", F.lit("")))
    marked = generated(rows, prompt, "reply", grade).withColumn("good", F.coalesce(first_word(F.col("reply")) != "NO", F.lit(True)))
    passage = F.struct("rank", F.col("id").cast("string").alias("id"), "text")
    lists = marked.groupBy("turn_id").agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.when(F.col("good"), passage))).alias("kept"))
    out = asked.select("turn_id", "query").join(lists, "turn_id", "left")
    none = F.array().cast("array<struct<rank:int,id:string,text:string>>")
    return out.select("turn_id", "query", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.col("kept").cast("array<struct<rank:int,id:string,text:string>>"), none).alias("kept"))


def checked(asked: DataFrame, again: bool, steps: Steps) -> DataFrame:
    """turn_id, query, kept, answer, failure, grounded of one generation each."""
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\n"), passages_text(F.col("kept")), F.lit(AGAIN if again else ""))
    made = saved(generated(asked.select("turn_id", "query", "kept"), prompt, "answer", steps.generate, "failure").withColumn("answer", usable(F.col("answer"))), "turn-answers")
    claim = F.concat(F.lit("Answer: "), F.col("answer"), F.lit("\n\n"), passages_text(F.col("kept")))
    word = generated(made.filter("answer is not null"), claim, "reply", steps.check).withColumn("grounded", first_word(F.col("reply")) != "UNGROUNDED")
    failed = made.filter("answer is null").withColumns({"grounded": F.lit(True), "failure": F.coalesce("failure", F.lit("no text"))})
    return saved(word.drop("reply").withColumn("grounded", F.coalesce("grounded", F.lit(True))).unionByName(failed), "turn-checks")


def answer_turns(turns: DataFrame, retrieve: Retrieve, steps: Steps = Steps()) -> DataFrame:
    """turns: turn_id, question, history (array<struct<role, text>>, null or empty for a first turn)
    -> turn_id, query, attempts (nth, query, found, kept ids), answer, generations, outcome, failure."""
    asked = saved(standalone(turns, steps.condense), "turn-queries")
    tries, ready = [], []
    for nth in range(1, steps.attempts + 1):
        rows = saved(graded_hits(asked, retrieve, steps.grade), "turn-passages")
        tries.append(rows.select("turn_id", F.struct(F.lit(nth).alias("nth"), "query", F.col("found").cast("int").alias("found"), F.transform("kept", lambda p: p["id"]).alias("kept")).alias("attempt")))
        ready.append(rows.filter(F.size("kept") > 0).select("turn_id", "query", "kept"))
        if nth < steps.attempts:
            left = generated(rows.filter(F.size("kept") == 0), F.concat(F.lit("Rewrite: "), F.col("query")), "reply", steps.rewrite)
            left = left.withColumn("other", usable(F.col("reply"))).filter("other is not null and other <> query")
            asked = saved(left.select("turn_id", F.col("other").alias("query")), "turn-queries")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    open_, done = union(ready), []
    for n in range(steps.regenerations + 1):
        rows = checked(open_, n > 0, steps).withColumn("generations", F.lit(n + 1))
        last = n == steps.regenerations
        done.append(rows if last else rows.filter("grounded"))
        open_ = rows.filter("not grounded")
    answers = union(done).select("turn_id", "answer", "failure", "grounded", "generations")
    attempts = union(tries).groupBy("turn_id").agg(F.array_sort(F.collect_list("attempt")).alias("attempts"))
    out = turns.select("turn_id").join(attempts, "turn_id", "left").join(answers, "turn_id", "left")
    found = F.exists("attempts", lambda a: a["found"] > 0)
    outcome = (
        F.when(F.col("failure").isNotNull(), "failed").when(F.col("answer").isNotNull() & F.col("grounded"), "answered").when(F.col("answer").isNotNull(), "ungrounded")
        .when(found, "graded_out").otherwise("nothing_found")
    )
    return out.select("turn_id", F.element_at("attempts", -1)["query"].alias("query"), "attempts", "answer", F.coalesce("generations", F.lit(0)).alias("generations"), outcome.alias("outcome"), "failure")
