"""Queries over the vector index: every hundredth vector asks, all vectors are indexed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vectors as V
from .registry import Tables, query

#: Shares of the cells that a query looks into.
BEAMS = (0.05, 0.2, 0.5, 0.75)


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    all_ = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return all_.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), all_


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS asked FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(asked, embedding::DOUBLE[]) AS score FROM q, embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s)
SELECT query_id, id, rank, round(score, 6) AS score FROM o WHERE rank <= 10""")
def vector_index(t: Tables) -> DataFrame:
    """Rows 206, 343: the index with every cell in the beam gives the exact result."""
    asked, all_ = _vectors(t)
    index = V.build(all_)
    return V.search(asked, all_, index, 10, len(index.cells.centroids)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_beams(t: Tables) -> DataFrame:
    """Row 343: recall at 10 against the exact way, and the share of vectors scored, by beam."""
    asked, all_ = _vectors(t)
    index, exact = V.build(all_), R.dense_top_k(asked, all_, 10)
    exact = V.saved(exact.select("query_id", "id"), "vector-exact")
    total = index.sizes.agg(F.sum("vectors")).first()[0] or 1

    def measured(share: float) -> DataFrame:
        beam = max(1, round(share * len(index.cells.centroids)))
        found = V.recall(V.search(asked, all_, index, 10, beam), exact).join(V.scored_share(asked, index, beam), "query_id")
        return found.agg(F.lit(beam).alias("beam"), F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("scored") / total, 4).alias("scored_share"))

    return reduce(DataFrame.unionByName, [measured(share) for share in BEAMS])
