"""The vector index against every cosine."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import retrieval as R
from quillspark.operators import vectors as V

SCHEMA = "id long, vector array<float>"


def rows_of(x: np.ndarray, first: int = 0) -> list[tuple]:
    return [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]


def clustered(rng, groups: int, each: int, spread: float) -> np.ndarray:
    return (rng.standard_normal((groups, 1, 16)) + spread * rng.standard_normal((groups, each, 16))).reshape(-1, 16)


def found(df) -> list:
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = rows_of(clustered(rng, 12, 60, 0.3))
    # A third of all are copies, some have no length, and some are missing.
    rows += rows_of(np.repeat(rng.standard_normal((1, 16)), 400, axis=0), 1000)
    rows += [(2000, [0.0] * 16), (2001, [0.0] * 16), (2002, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_whole_beam_is_exact(spark, corpus, monkeypatch):
    """With all cells, in blocks of few: the exact result, ties by id; a hot cell is cut."""
    monkeypatch.setattr(V, "BLOCK", 40)
    index = V.build(corpus)
    assert index.codes.count() == corpus.count() - 1 and index.sizes.agg({"blocks": "max"}).first()[0] >= 10
    asked = corpus.filter("id % 90 = 0 or id in (1000, 2000, 2002)").withColumnRenamed("id", "query_id")
    cells = len(index.cells.centroids)
    got = V.search(asked, corpus, index, 7, cells)
    assert found(got) == found(R.dense_top_k(asked.filter("vector is not null"), corpus, 7))
    assert {r["scored"] for r in V.scored_share(asked, index, cells).collect()} == {corpus.count() - 1}


def test_recall_follows_the_beam(spark):
    rng = np.random.default_rng(6)
    corpus = spark.createDataFrame(rows_of(clustered(rng, 40, 50, 0.5)), SCHEMA)
    asked = corpus.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    index, exact = V.build(corpus), R.dense_top_k(asked, corpus, 10).select("query_id", "id")
    shares = {}
    for beam in (1, 4, 12):
        mean = V.recall(V.search(asked, corpus, index, 10, beam), exact).agg({"recall": "avg"}).first()[0]
        scored = V.scored_share(asked, index, beam).agg({"scored": "avg"}).first()[0] / 2000
        shares[beam] = (mean, scored)
    assert shares[1][0] <= shares[4][0] <= shares[12][0] and shares[12][0] >= 0.95 and shares[12][1] < 0.4


def test_odd_indexes(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = V.build(none)
    assert V.search(none.withColumnRenamed("id", "query_id"), none, index, 3, 2).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    asked = few.withColumnRenamed("id", "query_id")
    assert V.search(asked, none, index, 3, 2).count() == 0
    got = V.search(asked, few, V.build(few, cells=9), 3, 9)
    assert found(got) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0)]
    words = few.selectExpr("concat('v', id) as id", "vector")
    assert found(V.search(asked, words, V.build(words), 1, 5)) == [(1, 1, "v1", 1.0), (2, 1, "v2", 1.0)]


def test_learning_is_repeatable():
    rng = np.random.default_rng(1)
    x = clustered(rng, 5, 30, 0.05)
    a, b = V.learn(x, 5), V.learn(x, 5)
    assert np.array_equal(a.centroids, b.centroids) and len(np.unique(a.nearest(V.units(x)))) == 5
    assert np.abs(a.codes(V.units(x)) * a.scale - V.units(x)).max() <= a.scale
    assert len(V.learn(np.repeat(x[:1], 4, axis=0), 3).centroids) == 3


def test_near_copies_beyond_the_codes(spark):
    """Many vectors that differ by less than a code's unit: the whole beam still is exact."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1, 16)) + 0.004 * rng.standard_normal((600, 16))
    corpus = spark.createDataFrame(rows_of(x), SCHEMA)
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = V.build(corpus)
    assert found(V.search(asked, corpus, index, 10, len(index.cells.centroids), rerank=1)) == found(R.dense_top_k(asked, corpus, 10))
    assert found(V.search(asked, corpus, index, 10, len(index.cells.centroids))) == found(R.dense_top_k(asked, corpus, 10))
