"""Connected components by alternating large-star and small-star steps.

Edges stay tables; every step sends each edge to an aggregation by node and joins the minimum back,
so a node with very many edges is reduced before it is shuffled and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs neighbours of each node on the least of them and itself: the larger ones (large
    star), or the smaller ones and the node (small star)."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small star: a > b holds, so b are a's smaller neighbours
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    near = both.join(least, both["a"] == least["n"])
    if small:
        hung = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    else:
        hung = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.filter("a != b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Links (a long, b long) -> node, root (the least node of its component); nodes without
    links do not appear. The loop ends when a round changes no edge."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = materialize(edges, name)
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        last, edges = edges, materialize(_star(_star(edges, small=False), small=True), name)
        forget(last)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
