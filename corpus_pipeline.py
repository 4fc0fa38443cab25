"""From raw documents to token ids in five stages, each by one operator of quillspark.llm.

quality   rejects documents that the nearest-neighbour classifier scores below its threshold
lines     deletes aligned blocks of lines from later documents; what is emptied by that goes
similar   keeps one document of each component of the n-gram Jaccard join
mixture   repeats or thins sources to their target weights
tokens    encodes texts by byte-level BPE; ids as little-endian unsigned 32-bit integers

All stages but the last return the columns of documents. Each reads all rows its predecessor kept.
Null and empty texts pass: they get the classifier's prior, lose no lines and link with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, jaccard, linededup, mixing, quality
from quillspark.llm.shared import documents, forget, materialize, scratch

#: Pre-tokens that a worker of the last stage keeps; the workers of all stages share an executor's memory.
CACHE = 40_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(docs, quality.quality_space(spark, sf_dir), names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(docs, names=("__lines", "__removed", "__words"))
    whole = F.size("__removed") == 0
    kept = done.filter(whole | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and whether the ids decode to the text's very bytes."""
    done = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), cache=CACHE)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_shared_lines),
    ("similar", keep_one_of_similar),
    ("mixture", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is deleted once its result is written,
    and that once the next one's is; the last but one stays, as the result is read from it."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if last:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the alignment or the tokens.
ORACLE_SQL = None
