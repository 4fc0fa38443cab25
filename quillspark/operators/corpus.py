"""Corpus audits, groups of related rows, index maintenance, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import placed, smallest
from .storage import saved


def table_hash(df: DataFrame, *columns: Column) -> DataFrame:
    """n and digest of a table, whatever its order: the sum of 60-bit row hashes, so that no task
    holds more than a running sum."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.substring(F.sha2(F.sum(number).cast("string"), 256), 1, 16).alias("digest"))


def repeated_paragraphs(docs: DataFrame, least: int, split: str = "\n") -> DataFrame:
    """paragraph, documents (count), first: paragraphs of `least` characters or more that stand
    in two documents or more and are not tables."""
    p = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", split), lambda x: F.trim(x)))).alias("paragraph"))
    p = p.filter((F.length("paragraph") >= least) & (F.length("paragraph") - F.length(F.replace("paragraph", F.lit("|"), F.lit(""))) <= 4))
    return p.groupBy("paragraph").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first")).filter("documents > 1")


def related(edges: DataFrame) -> DataFrame:
    """item, key -> item, root: items that share keys, directly or over others, get the smallest
    item as root. Each item hangs on its least key and links its other keys with that one; the rows
    are moved for these two steps only, and the rest of the work is on links of keys. An item without a key is its own
    root. Keys and items with many rows are reduced by the aggregation, not collected."""
    least = F.min(F.when(F.col("item").isNotNull(), F.col("key")))
    items = saved(edges.groupBy("item").agg(least.alias("low")), "related")
    links = edges.join(items, "item").select(F.col("key").alias("a"), F.col("low").alias("b"))
    roots = hung(links).withColumnRenamed("a", "low")
    first = items.filter("low is not null").groupBy("low").agg(F.min("item").alias("item"))
    keys = saved(first.join(roots, "low", "left").select("low", "item", F.coalesce("b", "low").alias("b")), "related")
    named = keys.join(keys.groupBy("b").agg(F.min("item").alias("root")), "b").select("low", "root")
    return items.join(named, "low", "left").select("item", F.coalesce("root", "item").alias("root"))


def hung(links: DataFrame) -> DataFrame:
    """Links (a, b), a >= b -> a, b: each node that isn't the least of its component, and that least
    node. A round hangs every node on its least neighbour below it, follows that to the end, and
    puts these ends in the place of the nodes, which leaves half of the nodes after two rounds at
    most. Links are moved three times a round and end as loops, which are dropped."""
    found = None
    while True:
        links = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        if links.isEmpty():
            return found if found is not None else links
        up = ended(links.groupBy("a").agg(F.min("b").alias("b")))
        end = lambda rows, side: rows.join(up.select(F.col("a").alias(side), F.col("b").alias("end")), side, "left").withColumn(side, F.coalesce("end", side)).drop("end")
        found = up if found is None else saved(end(found, "b").select("a", "b").unionByName(up), "hung")
        links = end(end(links, "a"), "b")


def ended(up: DataFrame) -> DataFrame:
    """a, b: where each node's way over ever smaller b ends; the ways double with each round."""
    while True:
        up = saved(up, "ways")
        on = up.select(F.col("a").alias("b"), F.col("b").alias("further"))
        if up.join(on, "b", "left_semi").isEmpty():
            return up
        up = up.join(on, "b", "left").select("a", F.coalesce("further", "b").alias("b"))


# --- samples. The order of a draw is a hash of a seed and the id, which is the same everywhere.

def draw(id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), id.cast("string")))


def drawn(id: Column, seed: str) -> Column:
    """The draw's first 52 bits, as a number."""
    return F.conv(F.substring(draw(id, seed), 1, 13), 16, 10).cast("double")


def round_robin(df: DataFrame, group: str, id: str, seed: str, limit: int) -> DataFrame:
    """One row of each group per turn; no group needs more than `limit` rows ranked."""
    some = df.select(group).distinct().withColumn("n", F.lit(limit))
    few = smallest(df, [group], drawn(F.col(id), seed), some, draw(F.col(id), seed), id)
    turns = few.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(draw(F.col(id), seed), id)))
    return turns.orderBy("turn", draw(F.col(group), seed), id).limit(limit)


def quotas(df: DataFrame, group: str, total: int) -> DataFrame:
    """group, n, quota: largest remainders, ties to the first group."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    exact = F.lit(total) * F.col("n") / F.sum("n").over(everything)
    base = counts.withColumn("quota", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    left = F.lit(total) - F.sum("quota").over(everything)
    place = F.row_number().over(W.orderBy(F.desc(F.round("rest", 9)), group))
    return base.withColumn("extra", (place <= left).cast("long")).select(group, "n", (F.col("quota") + F.col("extra")).alias("quota"))


def stratified(df: DataFrame, group: str, id: str, seed: str, total: int) -> DataFrame:
    """Of each group its quota of rows, by draw; a group is cut at the draw of its last row."""
    wanted = quotas(df, group, total).select(group, F.col("quota").alias("n"))
    return smallest(df, [group], drawn(F.col(id), seed), wanted, draw(F.col(id), seed), id)


def stride(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The elements floor(i n / limit) for i below limit."""
    n = df.count()
    places = df.sparkSession.range(limit).select(F.floor(F.col("id") * n / limit).alias("nth")).distinct()
    return placed(df, key).join(F.broadcast(places), "nth")


# --- index maintenance

def index_diff(current: DataFrame, *stores: DataFrame) -> DataFrame:
    """id, status of (id, hash) tables: new, changed, stale or same against all stores."""
    rows = current.select("id", F.col("hash").alias("now"), F.lit(True).alias("is_now"))
    for i, s in enumerate(stores):
        rows = rows.join(s.select("id", F.col("hash").alias(f"h{i}"), F.lit(True).alias(f"in{i}")), "id", "full")
    missing = [F.col(f"in{i}").isNull() for i in range(len(stores))]
    changed = [~F.col(f"h{i}").eqNullSafe(F.col("now")) for i in range(len(stores))]
    any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs], F.lit(0)) == 1
    status = F.when(F.col("is_now").isNull(), "stale").when(any_of(missing), "new").when(any_of(changed), "changed").otherwise("same")
    return rows.select("id", status.alias("status"))


def upserted(store: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """The store with rows replaced by id and added; a repeated id among the rows raises."""
    checked = rows.withColumn(id, F.when(F.count("*").over(W.partitionBy(id)) == 1, F.col(id)).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col(id).cast("string"))).cast(rows.schema[id].dataType)))
    return store.join(rows.select(id), id, "left_anti").unionByName(checked.select(store.columns))


def deleted(store: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """The store without the ids; absent ones are ignored."""
    return store.join(ids.select(id), id, "left_anti")


def maintained(store: DataFrame, current: DataFrame, purge: bool = True) -> DataFrame:
    """What an incremental run leaves: unchanged rows of the store, new and changed rows of the
    corpus, and stale rows only if purging is held back (a file failed to load)."""
    status = index_diff(current, store)
    fresh = current.join(status.filter(F.col("status").isin("new", "changed")).select("id"), "id", "left_semi")
    keep = ["same"] if purge else ["same", "stale"]
    return store.join(status.filter(F.col("status").isin(keep)).select("id"), "id", "left_semi").unionByName(fresh.select(store.columns))


def differences(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys whose values differ, a missing key included."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def unique_ids(df: DataFrame, id: str) -> DataFrame:
    """df with an error for any id that stands in two rows."""
    many = F.count("*").over(W.partitionBy(id)) > 1
    return df.withColumn(id, F.when(many, F.raise_error(F.concat(F.lit("repeated id "), F.col(id).cast("string"))).cast(df.schema[id].dataType)).otherwise(F.col(id)))
