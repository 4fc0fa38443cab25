"""Retrieval as one plan over a batch of queries: expand, search, fuse, rerank, floor; and its parts.

The protocols name what can be exchanged. Each works on DataFrames, so that an implementation is a
plan and not a loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R
from .storage import saved


class Loader(Protocol):
    def __call__(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """Documents of a path, and the files that failed."""


class Chunker(Protocol):
    def __call__(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """chunk_id, document_id, char_start, char_end, text."""


class LengthFunction(Protocol):
    def __call__(self, text: Column) -> Column:
        """The size of a text in a chunker's units."""


class EmbeddingModel(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """Adds `vector` to rows with `text`."""


class QueryExpander(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, text -> query_id, variant (0 for the query itself), text."""


class PassageRetriever(Protocol):
    def __call__(self, queries: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """query_id, text -> query_id, id, rank, score; only allowed ids if there are any given."""


class Reranker(Protocol):
    def __call__(self, query: Column, passage: Column) -> Column:
        """A score in [0, 1]."""


class Router(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, id: the only ids for queries that it routes; others have no rows."""


#: Chunkers by name.
def chunkers() -> dict[str, Chunker]:
    from . import chunking as K

    return {name[: -len("_chunks")]: f for name, f in vars(K).items() if name.endswith("_chunks") and callable(f)}


def chunker(name: str) -> Chunker:
    known = chunkers()
    if name not in known:
        raise ValueError(f"no chunker {name!r}; there are {sorted(known)}")
    return known[name]


@dataclass
class Retrieved:
    """hits: query_id, id, rank, score; candidates: the fused list before reranking; counts, a row
    for each query: searches, candidates, dropped (below the floor), returned."""

    hits: DataFrame
    candidates: DataFrame
    counts: DataFrame


@dataclass
class Retriever:
    """searches: one ranked list of each query (and of each variant of it) apiece. texts: id, text
    of what can be found, for the reranker. A filter that the caller gives wins over routing."""

    searches: Sequence[PassageRetriever]
    texts: DataFrame
    top_k: int = 20
    keep: int = 5
    least: float = 0.0
    expand: QueryExpander | None = None
    rerank: Reranker | None = None
    route: Router | None = None

    def candidates(self, queries: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """query_id, id, score, rank: every variant's lists fused."""
        if self.expand:
            # A list is one variant by one search; the variant travels in the query's key.
            wide = self.expand(queries).select(F.struct("query_id", F.col("variant").cast("int").alias("variant")).alias("query_id"), "text")
        else:
            wide = queries.select(F.struct("query_id", F.lit(0).alias("variant")).alias("query_id"), "text")
        n = len(self.searches)
        lists = [search(wide, allowed).select("query_id.query_id", (F.col("query_id.variant") * n + i).alias("list"), "rank", "id", "score") for i, search in enumerate(self.searches)]
        return R.stage_one(reduce(DataFrame.unionByName, lists), self.top_k)

    def retrieve(self, queries: DataFrame, allowed: DataFrame | None = None) -> Retrieved:
        """queries: query_id, text; allowed: id. Blank queries find nothing."""
        asked = queries.filter(F.trim("text") != "")
        # Few rows, which several steps read.
        found = saved(self.candidates(asked, allowed), "candidates")
        if self.route and allowed is None:
            routed = self.route(asked)
            only = found.join(routed.select("query_id").distinct(), "query_id", "left_anti")
            found = only.unionByName(found.join(routed, ["query_id", "id"], "left_semi").select(only.columns))
        if self.rerank:
            rows = saved(found.join(asked.select("query_id", F.col("text").alias("_asked")), "query_id"), "asked").join(self.texts.select("id", F.col("text").alias("_passage")), "id")
            scored = rows.select("query_id", "id", F.col("rank").alias("was"), self.rerank(F.col("_asked"), F.col("_passage")).alias("score"))
            best = saved(R.ranked(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("was")], self.keep).drop("was"), "reranked")
        else:
            best = found.filter(F.col("rank") <= self.keep)
        hits, floor = R.floor(best, self.least)
        counts = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("candidates")), "query_id", "left")
        counts = counts.join(floor.select("query_id", "dropped", (F.col("candidates") - F.col("dropped")).alias("returned")), "query_id", "left").na.fill(0)
        return Retrieved(hits.select("query_id", "id", "rank", "score"), found, counts.withColumn("searches", F.lit(len(self.searches))))


def keyword_search(index: R.KeywordIndex, k: int, constants: tuple[float, float] = R.OKAPI) -> PassageRetriever:
    return lambda queries, allowed: R.keyword_top_k(queries, index, k, constants, allowed)


def dense_search(vectors: DataFrame, embed: EmbeddingModel, k: int) -> PassageRetriever:
    def search(queries: DataFrame, allowed: DataFrame | None) -> DataFrame:
        pool = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
        return R.dense_top_k(embed(queries).select("query_id", "vector"), pool, k)

    return search


def build(config: dict, parts: dict[str, Callable]) -> Retriever:
    """A retriever from settings: `searches` names parts, the rest are numbers or names of parts.
    An unknown name raises."""
    known = {"searches", "texts", "top_k", "keep", "least", "expand", "rerank", "route"}
    if unknown := sorted(set(config) - known):
        raise ValueError(f"unknown settings {unknown}")
    named = lambda name: parts[name] if name in parts else _missing(name, parts)
    if config.get("keep", 5) > config.get("top_k", 20):
        raise ValueError("keep is more than top_k")
    values = {k: v for k, v in config.items() if k in ("top_k", "keep", "least")}
    chosen = {k: named(config[k]) for k in ("expand", "rerank", "route", "texts") if config.get(k)}
    return Retriever(searches=[named(name) for name in config["searches"]], **values, **chosen)


def _missing(name: str, parts: dict):
    raise ValueError(f"no part {name!r}; there are {sorted(parts)}")
