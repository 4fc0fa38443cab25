"""Places and order statistics of groups of any size, with no task that holds a group.

`values_at` finds the values at asked places by quantile sketches: a sketch of a group's values says
about where a place is, the values before, in and after that stretch are counted exactly, and the
search goes on in the one that holds the place, some 40 times smaller whatever the distribution, until
few values are left there or all of them are equal; only those few are put in order. `smallest` uses
it to cut each group at its n-th row. `placed` numbers rows of one global order: ranges of it are
sorted, and the counts of the ranges before are added.

Defined results: null values have no place, NaN is taken as the largest value; groups may be null;
places beyond a group's size have no row; equal values are interchangeable, rows are told apart by
the further columns of an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import saved

#: Quantiles of a sketch and its accuracy, and values that are put in order at once.
CUTS, ACCURACY, FEW = 256, 4096, 10_000


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Column]:
    """b with its group columns under other names, and that the groups are the same."""
    renamed = b.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in b.columns])
    same = F.lit(True)
    for c in by:
        same = same & a[c].eqNullSafe(renamed[f"_{c}"])
    return renamed, same


def values_at(df: DataFrame, by: Sequence[str], value: str, places: DataFrame, few: int = FEW) -> DataFrame:
    """places: the group columns and `place` (from 1) -> the same with `value`, as a double."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    top = F.lit(float("inf"))
    rows = rows.withColumn("_v", F.when(F.isnan("_v"), top).otherwise(F.col("_v")))
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    right, same = _same(places, ends, by)
    state = places.join(right, same).drop(*[f"_{c}" for c in by]).filter(F.col("place").between(1, F.col("_n"))).withColumn("_before", F.lit(0).cast("long"))
    columns = [*by, "place", "_n", "_lo", "_hi", "_before"]
    state = saved(state.select(columns), "places")

    def within(state: DataFrame) -> DataFrame:
        right, same = _same(rows, state, by)
        return rows.join(right, same & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_{c}" for c in by])

    cuts = F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY)
    while (state.filter("_lo < _hi").agg(F.max("_n")).first()[0] or 0) > few:
        done, open_ = state.filter(f"_lo = _hi or _n <= {few}"), state.filter(f"_lo < _hi and _n > {few}")
        near = F.round((F.col("place") - F.col("_before")) / F.col("_n") * CUTS).cast("int")
        cut = lambda k, end: F.coalesce(F.get("_cuts", k - 1), F.col(end))
        sketch = within(open_).groupBy(*columns).agg(cuts.alias("_cuts"))
        middle = F.least(F.greatest(near, F.lit(1)), F.lit(CUTS - 1))
        aim = saved(sketch.select(*columns, cut(near - 3, "_lo").alias("_a"), cut(middle, "_lo").alias("_m"), cut(near + 3, "_hi").alias("_z")), "aims")
        # The middle is one of the values, so that every stretch is smaller than all of them.
        v, (a, m, z) = F.col("_v"), (F.col(c) for c in ("_a", "_m", "_z"))
        stretch = F.when(v < F.least(a, m), 0).when(v < m, 1).when(v == m, 2).when(v <= z, 3).otherwise(4)
        counts = within(aim).groupBy(*columns, stretch.alias("_stretch")).agg(F.count("*").alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = W.partitionBy(*by, "place").orderBy("_stretch")
        counts = counts.withColumn("_until", F.sum("_m").over(upto) + F.col("_before"))
        into = counts.filter((F.col("_until") >= F.col("place")) & (F.col("_until") - F.col("_m") < F.col("place")))
        into = into.select(*by, "place", F.col("_m").alias("_n"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_until") - F.col("_m")).alias("_before"))
        state = saved(done.unionByName(into), "places")
    order = W.partitionBy(*by, "place").orderBy("_v")
    last = within(state.filter("_lo < _hi")).withColumn("_nth", F.row_number().over(order) + F.col("_before")).filter("_nth = place")
    return state.filter("_lo = _hi").select(*by, "place", F.col("_lo").alias("value")).unionByName(last.select(*by, "place", F.col("_v").alias("value")))


def quantiles(df: DataFrame, by: Sequence[str], value: str, spots: dict[str, Column]) -> DataFrame:
    """The group columns and a column for each spot: a place, from 1 and not whole as a rule, as an
    expression of `n` (how many values the group has); values at both sides of it are mixed by the
    part beyond the lower one, which may lie outside 0 to 1 where the place is held to the group."""
    by = list(by)
    sizes = saved(df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    wanted = sizes.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("spot"), s.cast("double").alias("at")) for k, s in spots.items()])).alias("x")).select(*by, "n", "x.*")
    low = F.greatest(F.lit(1), F.least(F.floor("at"), F.col("n") - 1))
    wanted = wanted.withColumn("low", low).withColumn("part", F.when(F.col("n") == 1, 0.0).otherwise(F.col("at") - low))
    both = wanted.select(*by, "spot", "part", F.explode(F.array(F.struct(F.col("low").alias("place"), (1 - F.col("part")).alias("weight")), F.struct((F.col("low") + 1).alias("place"), F.col("part").alias("weight")))).alias("x"))
    both = both.select(*by, "spot", "x.*").filter("weight <> 0")
    found = values_at(df, by, value, both.select(*by, "place").distinct())
    right, same = _same(both, found.withColumnRenamed("place", "_place"), by)
    mixed = both.join(right, same & (F.col("place") == F.col("_place")))
    return mixed.groupBy(*by).agg(*[F.sum(F.when(F.col("spot") == k, F.col("weight") * F.col("value"))).alias(k) for k in spots])


def smallest(df: DataFrame, by: Sequence[str], key: Column, n: DataFrame, *ties: Column | str) -> DataFrame:
    """The rows of each group with the n smallest keys (a number), then in the order of `ties`.
    n: the group columns and `n`; a group that isn't there gives no rows."""
    by = list(by)
    rows = df.withColumn("_key", key.cast("double"))
    sizes = rows.groupBy(*by).agg(F.count("_key").alias("_size"))
    right, same = _same(n, sizes, by)
    cut = n.join(right, same).select(*by, F.least("n", "_size").cast("long").alias("place")).filter("place > 0")
    ends = saved(values_at(rows, by, "_key", cut).withColumnRenamed("value", "_end"), "cuts")
    right, same = _same(rows, ends, by)
    near = rows.join(right, same & (F.col("_key") <= F.col("_end"))).drop(*[f"_{c}" for c in by])
    # All before the cut, and of those at it as many as are still wanted.
    below = near.filter("_key < _end").groupBy(*by).agg(F.count("*").alias("_below"))
    at = near.filter("_key = _end").withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(*ties)))
    right, same = _same(at, below, by)
    few = at.join(right, same, "left").filter(F.col("_nth") + F.coalesce("_below", F.lit(0)) <= F.col("place"))
    return near.filter("_key < _end").select(df.columns).unionByName(few.select(df.columns))


def placed(df: DataFrame, *order: Column | str, name: str = "nth") -> DataFrame:
    """df with each row's place, from 0, in one order over all rows; rows equal in it in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(ranged.withColumns({"_part": F.spark_partition_id(), "_in": inside}), "placed")
    # A row for each range.
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    return rows.join(before.select("_part", "_before"), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
