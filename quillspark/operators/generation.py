"""Steps around a text generator, over tables of prompts.

A generator is a function from a list of prompts to a list of replies, run batch by batch on the
executors; it may fail, and then the steps fall back as each says. `stub_generate` is a
deterministic stand-in and marks what it writes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import build_list, fingerprint, first_word, pass_fail, strip, strip_citations
from .turnlog import transcript

Generator = Callable[[list[str]], list[str]]


def stub_generate(prompts: list[str]) -> list[str]:
    """A stub: one of a few fixed replies, by the prompt's hash."""
    replies = ("PASS", "FAIL", "YES", "NO", "GROUNDED", "stub: first line\n2. second line")
    return [replies[hashlib.blake2b(p.encode(), digest_size=1).digest()[0] % len(replies)] for p in prompts]


def replies(prompts: list[str], generate: Generator) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt. Prompts that fail together are asked again by halves, so that
    only those that fail by themselves have no reply."""
    try:
        found = list(generate(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} replies to {len(prompts)} prompts")
        return [(r, None) for r in found]
    except Exception as e:  # noqa: BLE001  a generator may fail in any way
        if len(prompts) < 2:
            return [(None, f"{type(e).__name__}: {e}") for _ in prompts]
        half = len(prompts) // 2
        return replies(prompts[:half], generate) + replies(prompts[half:], generate)


def generated(df: DataFrame, prompt: Column, out: str = "reply", generate: Generator = stub_generate, error: str | None = None) -> DataFrame:
    """Adds replies, null where the generator failed, and under `error` why it did."""
    kind = StructType([StructField("reply", StringType()), StructField("error", StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(replies([x or "" for x in b], generate), columns=["reply", "error"])

    asked = df.withColumn("_asked", run(prompt))
    added = {out: F.col("_asked.reply"), **({error: F.col("_asked.error")} if error else {})}
    return asked.withColumns(added).drop("_asked")


def contextualized(chunks: DataFrame, documents: DataFrame, cache: DataFrame, model: str, most: int, generate: Generator = stub_generate) -> tuple[DataFrame, DataFrame]:
    """Chunks (document_id, text) with `context`, and the rows to add to the cache (key, context).
    The key covers model, document excerpt and chunk; what the cache has is not generated."""
    excerpt = F.substring("document", 1, most)
    rows = chunks.join(documents.select(F.col("id").alias("document_id"), F.col("text").alias("document")), "document_id")
    rows = rows.withColumn("key", fingerprint(F.lit(model), F.lit(str(most)), excerpt, F.col("text")))
    known = rows.join(cache.select("key", F.col("context").alias("cached")), "key", "left")
    fresh = known.filter("cached is null").dropDuplicates(["key"])
    prompt = F.concat(F.lit("Document:\n"), excerpt, F.lit("\n\nExcerpt:\n"), F.col("text"))
    made = generated(fresh, prompt, "made", generate).select("key", strip(F.col("made")).alias("made")).filter("made <> ''")
    out = known.join(made, "key", "left").withColumn("context", F.coalesce("cached", "made"))
    return out.drop("key", "cached", "made", "document"), made.select("key", F.col("made").alias("context"))


def rewrites(queries: DataFrame, count: int, generate: Generator = stub_generate) -> DataFrame:
    """query_id, consumer, ordinal, text: the query first, then distinct rewrites for both lists."""
    asked = generated(queries, F.concat(F.lit("Rephrase:\n"), F.col("text")), "reply", generate)
    lines = F.slice(F.array_distinct(F.concat(F.array("text"), build_list(F.coalesce("reply", F.lit(""))))), 1, count + 1)
    rows = asked.select("query_id", F.posexplode(lines).alias("ordinal", "text"))
    return rows.withColumn("consumer", F.explode(F.array(F.lit("dense"), F.lit("sparse"))))


def hypothetical(queries: DataFrame, generate: Generator = stub_generate) -> DataFrame:
    """A generated passage for the dense list only, before the query itself; without one, the query."""
    asked = generated(queries, F.concat(F.lit("Write a passage that answers:\n"), F.col("text")), "reply", generate)
    dense = F.filter(F.array(strip(F.col("reply")), F.col("text")), lambda x: x.isNotNull() & (x != ""))
    rows = asked.select("query_id", "text", dense.alias("dense"))
    lists = rows.select("query_id", F.lit("dense").alias("consumer"), F.posexplode("dense").alias("ordinal", "text"))
    return lists.unionByName(rows.select("query_id", F.lit("sparse").alias("consumer"), F.lit(0).alias("ordinal"), "text"))


def judged(answers: DataFrame, prompt: Column, generate: Generator = stub_generate) -> DataFrame:
    """Adds `verdict`: true, false, or null for an unreadable judgment; an answer that failed
    (null) is false and not judged."""
    todo = generated(answers.filter("answer is not null"), prompt, "judgment", generate).withColumn("verdict", pass_fail(F.col("judgment")))
    failed = answers.filter("answer is null").withColumns({"judgment": F.lit("the generation failed"), "verdict": F.lit(False)})
    return todo.unionByName(failed)


def grounded(answers: DataFrame, prompt: Column, generate: Generator = stub_generate) -> DataFrame:
    """Adds `grounded`: true, false, or null."""
    word = first_word(F.col("check"))
    return generated(answers, prompt, "check", generate).withColumn("grounded", F.when(word == "GROUNDED", True).when(word == "UNGROUNDED", False)).drop("check")


def condensed(turns: DataFrame, last: int, generate: Generator = stub_generate) -> DataFrame:
    """A conversation's follow-up as a standalone question; the follow-up itself where that fails.
    Citation markers of earlier answers do not enter the prompt."""
    newest = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("followup"), F.max("turn").alias("at"))
    earlier = turns.join(newest.select("conv_id", "at"), "conv_id").filter("turn < at").withColumn("text", strip_citations(F.col("text")))
    rows = newest.join(transcript(earlier, "conv_id", "turn", last), "conv_id", "left")
    prompt = F.concat(F.coalesce(F.concat("transcript", F.lit("\n\n")), F.lit("")), F.lit("Follow-up: "), F.col("followup"))
    asked = generated(rows, prompt, "reply", generate)
    return asked.select("conv_id", F.coalesce(F.nullif(strip(F.col("reply")), F.lit("")), F.col("followup")).alias("question"))
