"""Distinct counts of unions, intersections and differences, exact and from sketches.

For every day and every ordered pair of kinds, A is the ids that kind_a has in the `days` calendar
days ending with that day, and B the ids that kind_b has in the `days` days ending `lag` days
before it.

Sketches: one HyperLogLog sketch for each kind and day (2^LG_K registers), made from distinct
(kind, day, id). A range join deals each day's sketch to the windows that it falls into, and
hll_union_agg merges them; hll_union merges the two windows of a pair. Of the three estimates a, b
and u of one pair, the sizes follow by inclusion and exclusion: both = a + b - u, only_a = u - b,
each clamped to what sets allow (0 <= both <= min(a, b), 0 <= only_a <= a, max(a, b) <= u <= a + b).
An estimate of n ids has the standard error 1.04 / sqrt(2^LG_K) * n; those of a difference or sum
add in squares, and `err` columns are SPREAD standard errors plus one id for rounding.

Exact counts: the days on which an id is in a kind's window are few intervals, as runs of days not
more than `days` apart merge. A pair's intervals of one id are joined with each other, and only
their starts and ends are counted; running sums over days give the sizes. So the work follows the
distinct (kind, day, id) rows, not ids times days times pairs, and a hot id has one row for each
kind and day at most before it is ever brought together.

Nothing goes to the driver or is broadcast by request. The grid of days and pairs is what the result
itself holds; it is made by joins on dealt keys.

Defined results: rows with a null id, kind or time are not used, nor do their days count; repeated
rows count once; an empty kind is a kind; a window without ids has 0 everywhere, estimates and errors
included (but for the one id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize

#: Calendar days of a window, and days that B's window ends before A's.
DAYS, LAG = 7, 1
#: Binary logarithm of a sketch's registers.
LG_K = 9
#: Standard errors in an err column.
SPREAD = 3.0
#: Keys over which days are dealt where they meet all kinds.
DEALT = 16


def used_ids(events: DataFrame, id: str, kind: str, ts: str) -> DataFrame:
    """Distinct kind, day, id. Times without a zone are taken as they stand."""
    rows = events.select(F.col(kind).alias("kind"), F.unix_date(F.to_date(ts)).cast("long").alias("day"), F.col(id).alias("id"))
    return rows.dropna().distinct()


def window_sketches(used: DataFrame, days: int, lg_k: int) -> DataFrame:
    """kind, day, sketch, of every day on which the window of a kind holds anything (days after
    the last one too)."""
    daily = used.groupBy("kind", "day").agg(F.hll_sketch_agg("id", lg_k).alias("sketch"))
    reach = daily.select("kind", F.explode(F.sequence("day", F.col("day") + (days - 1))).alias("day"), "sketch")
    return reach.groupBy("kind", "day").agg(F.hll_union_agg("sketch").alias("sketch"))


def coverage(used: DataFrame, days: int) -> DataFrame:
    """kind, id, first, last: the runs of days on which the id is in the kind's window."""
    of = W.partitionBy("id", "kind").orderBy("day")
    gap = F.col("day") - F.lag("day").over(of) > days
    runs = used.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(of))
    return runs.groupBy("id", "kind", "run").agg(F.min("day").alias("first"), (F.max("day") + (days - 1)).alias("last")).drop("run")


def steps(first: Column, last: Column) -> Column:
    """A run of days as the change on its first day and that after its last."""
    return F.inline(F.array(F.struct(first.alias("day"), F.lit(1).alias("by")), F.struct((last + 1).alias("day"), F.lit(-1).alias("by"))))


def by_day(changes: DataFrame, grid: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The grid's rows with the running sum of the changes up to each row's day."""
    rows = changes.groupBy(*keys, "day").agg(F.sum("by").alias("by")).withColumn("asked", F.lit(False))
    rows = rows.unionByName(grid.select(*keys, "day", F.lit(0).cast("long").alias("by"), F.lit(True).alias("asked")))
    upto = W.partitionBy(*keys).orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum("by").over(upto)).filter("asked").drop("by", "asked")


def distinct_algebra(events: DataFrame, id: str, kind: str, ts: str, days: int = DAYS, lag: int = LAG, lg_k: int = LG_K) -> DataFrame:
    """day, kind_a, kind_b, n_union, n_both, n_only_a and the est_ and err_ columns of the same."""
    used = materialize(used_ids(events, id, kind, ts), "used-ids")
    sketches = materialize(window_sketches(used, days, lg_k), "window-sketches")
    runs = materialize(coverage(used, days), "coverage")

    # Every day with all kinds: kinds are copied to DEALT keys, and each day has one of those.
    present = used.groupBy("kind", "day").agg(F.count("*").alias("n"))
    present = materialize(present.select("kind", "day"), "kind-days")
    kinds = present.select("kind").distinct().withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dates = present.select("day").distinct().withColumn("dealt", F.pmod("day", F.lit(DEALT)).cast("int"))
    grid = materialize(dates.join(kinds, "dealt").select("kind", "day"), "days-kinds")

    ends = runs.select("kind", steps(F.col("first"), F.col("last")))
    lagged = grid.unionByName(grid.select("kind", (F.col("day") - lag).alias("day"))).distinct()
    sizes = by_day(ends, lagged, ["kind"], "n").join(sketches, ["kind", "day"], "left").withColumn("est", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("double"))
    sizes = materialize(sizes, "window-sizes")
    a = grid.join(sizes, ["kind", "day"]).select("day", *[F.col(c).alias(f"{c}_a") for c in ("kind", "n", "sketch", "est")])
    b = sizes.select((F.col("day") + lag).alias("day"), *[F.col(c).alias(f"{c}_b") for c in ("kind", "n", "sketch", "est")])
    pairs = a.join(b, "day")

    one = runs.select("id", F.col("kind").alias("kind_a"), F.col("first").alias("a0"), F.col("last").alias("a1"))
    other = runs.select("id", F.col("kind").alias("kind_b"), (F.col("first") + lag).alias("b0"), (F.col("last") + lag).alias("b1"))
    start, end = F.greatest("a0", "b0"), F.least("a1", "b1")
    meet = one.join(other, "id").filter(start <= end).select("kind_a", "kind_b", steps(start, end))
    both = by_day(meet, pairs.select("kind_a", "kind_b", "day"), ["kind_a", "kind_b"], "n_both")

    merged = F.when(F.col("sketch_a").isNull(), F.col("sketch_b")).when(F.col("sketch_b").isNull(), F.col("sketch_a")).otherwise(F.hll_union("sketch_a", "sketch_b"))
    u = F.coalesce(F.hll_sketch_estimate(merged), F.lit(0)).cast("double")
    out = pairs.withColumn("u", F.least(F.greatest(u, "est_a", "est_b"), F.col("est_a") + F.col("est_b"))).join(both, ["day", "kind_a", "kind_b"])
    error = lambda *names: F.lit(SPREAD * 1.04 / math.sqrt(1 << lg_k)) * F.sqrt(sum(F.col(n) * F.col(n) for n in names)) + 1
    return out.select(
        "day", "kind_a", "kind_b", (F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("n_union"), "n_both", (F.col("n_a") - F.col("n_both")).alias("n_only_a"),
        F.col("u").alias("est_union"),
        F.least(F.greatest(F.col("est_a") + F.col("est_b") - F.col("u"), F.lit(0.0)), F.col("est_a"), F.col("est_b")).alias("est_both"),
        F.least(F.greatest(F.col("u") - F.col("est_b"), F.lit(0.0)), F.col("est_a")).alias("est_only_a"),
        error("u").alias("err_union"), error("est_a", "est_b", "u").alias("err_both"), error("u", "est_b").alias("err_only_a"),
    )


def op13_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_algebra(spark.read.parquet(f"{sf_dir}/clicks.parquet"), "client_id", "kind", "ts")
