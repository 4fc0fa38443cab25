"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source has a weight and may be repeated `max_epochs` times at most. The wanted total is
`share` times the size of everything. Sources whose fair part would exceed their cap are clamped
to it and what they leave is shared out again by weight among the others, until nobody exceeds a
cap. The end of that process is a water level: with sources in order of cap / weight, the clamped
ones are a prefix, so one running sum over the small table of sources finds it without a loop.

A source's target is met by whole repetitions and one fractional one: its documents stand in the
order of a seeded hash, and those whose middle lies before the fraction's size are taken once more.
The taken size therefore misses the target by half a document at most.

The order inside a source is never sorted as a whole. Documents fall into BUCKETS hash ranges;
sums per (source, range) tell the range in which the fraction ends, and only that range is put in
order. A source that holds most of the rows spreads over all ranges.

Defined results: a null or blank text has size 0 and is never taken more than its whole
repetitions give (0 words). A null source is a source of its own, last in order. Rows that repeat
a doc_id share its hash and are ordered by size; equal rows are interchangeable. An empty table
gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import BLANK, documents, materialize

#: Hash ranges inside a source; three hexadecimal digits.
BUCKETS = 4096
WEIGHTS = (3, 1, 2)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """60 bits of a seeded hash."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def water_level(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """source, source_size -> the same with `target`. One row per source, so the windows over the
    whole table see as many rows as there are sources."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(W.unboundedPreceding, -1)
    left = (
        ranked.withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("size_left", F.col("wanted") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("clamped", F.col("cap") * F.col("weight_left") <= F.col("size_left") * F.col("weight"))
    )
    free = lambda c: F.sum(F.when(~F.col("clamped"), F.col(c))).over(everything)
    held = F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0.0))
    share_out = F.col("weight") * (F.col("wanted") - held) / free("weight")
    return left.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(share_out).alias("target"))


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size, place, bucket."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place"))
    return slim.withColumn("bucket", F.shiftright("place", 48))


def plan_mix(rows: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """One row for each source: of, source_size, target, whole repetitions, part (the size of the
    fractional one), the hash range in which that ends, and the size before it."""
    by_bucket = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mixing-buckets")
    targets = water_level(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = W.partitionBy("source").orderBy("bucket")
    ends = (
        by_bucket.withColumn("until", F.sum("size").over(upto))
        .withColumnRenamed("source", "of")
        .join(targets, F.col("of").eqNullSafe(F.col("source")))
        .filter(F.col("until") > F.col("part"))
        .groupBy("source")
        .agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("size")).alias("before")), "bucket").alias("end"))
        .select(F.col("source").alias("of"), "end.bucket", "end.before")
    )
    plan = targets.join(ends, F.col("of").eqNullSafe(F.col("source")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "whole", "part", F.coalesce("bucket", F.lit(BUCKETS)).alias("end"), F.coalesce("before", F.lit(0)).alias("before")
    )
    return materialize(plan, "mixing-plan")


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows (of measured(), with any other columns) with source_size, target and epochs."""
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of")
    clear = rows.filter(F.col("bucket") != F.col("end")).withColumn("extra", (F.col("bucket") < F.col("end")).cast("long"))
    upto = W.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("before") + F.sum("size").over(upto) - F.col("size") / 2
    ending = rows.filter(F.col("bucket") == F.col("end")).withColumn("extra", (middle <= F.col("part")).cast("long"))
    out = clear.unionByName(ending).withColumn("epochs", F.col("whole") + F.when(F.col("part") > 0, F.col("extra")).otherwise(F.lit(0)))
    return out.drop("place", "bucket", "whole", "part", "end", "before", "extra")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (times taken), taken (words taken)."""
    slim = materialize(measured(docs, seed), "mixing")
    out = apply_mix(slim, plan_mix(slim, weights, share, max_epochs))
    return out.withColumn("taken", F.col("epochs") * F.col("size"))


def repeat_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, its columns unchanged."""
    plan = plan_mix(measured(docs, seed), weights, share, max_epochs)
    rows = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place"))
    rows = apply_mix(rows.withColumn("bucket", F.shiftright("place", 48)), plan).filter("epochs > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select("document.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), r AS (
  SELECT *, [3.0, 1.0, 2.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s
), l AS (
  SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) <= (wanted - coalesce(sum(cap) OVER w, 0)) * weight AS clamped
  FROM r WINDOW w AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap
              ELSE weight * (wanted - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / sum(weight) FILTER (NOT clamped) OVER () END AS target
  FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), m AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN part > 0 AND middle <= part THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""
